"""BPE encoding and decoding of documents."""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import slices
from lexmill.llm.bpe import TextCodec, codec


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, token_ids, decoded): each text's ids as a comma-joined string, and the text they decode to.

    A narrow map: no shuffle, each task holds a few hundred texts and a bounded cache of pieces. `tokenizer` is the
    path of a byte-level tokenizers JSON file, present on every executor. Null text counts as empty (no ids, empty
    text); an empty table gives an empty table; repeated rows give repeated rows; other columns are not read.
    """

    def run(batches):
        c = codec(TextCodec, tokenizer)
        for b in slices(batches):
            found = c.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["doc_id", "token_ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, token_ids string, decoded string")


def encoding_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_documents, worked out beside the ids."""

    def run(batches):
        c = codec(TextCodec, tokenizer)
        for b in slices(batches):
            ids = c.encode([t or "" for t in b.column("text").to_pylist()])
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x.count(",") + 1 if x else 0 for x, _ in ids], pa.int64()), pa.array([sha(x) for x, _ in ids], pa.string()), pa.array([sha(x) for _, x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
