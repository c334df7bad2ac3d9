"""lexmill: document analytics as Spark DataFrame operators."""
