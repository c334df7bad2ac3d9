"""Every query of the catalogue against its SQL, on whole tables."""

import pytest
from compare import rows_of, rows_of_sql

from lexmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_same_as_sql(spark, name):
    assert rows_of(catalogue.QUERIES[name](spark, SF)) == rows_of_sql(catalogue.ORACLES[name], SF)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_runs_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
