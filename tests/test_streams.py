"""Streams with late rows and batches that are played again, against what one batch gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.operators import postings as P
from lexmill.streaming.maintenance import Held, index_changes

SCHEMA = StructType().add("k", "long").add("ts", "timestamp").add("nth", "long").add("v", "string")
START = datetime.datetime(2024, 1, 1)


def batches(seed, n=5):
    rng = random.Random(seed)
    out = []
    for b in range(n):
        rows = [(rng.choice([None, *range(12)]), START + datetime.timedelta(days=4 * b + rng.randrange(-6, 4), hours=rng.randrange(3)) if rng.random() > 0.05 else None, rng.randrange(3), rng.choice(["a", "b", None])) for _ in range(30)]
        out.append([r for r in rows if rng.random() > 0.02] + rows[:3])
    return out


def plain(all_batches, delay):
    """Held rows and rejected rows."""
    import hashlib

    digest = lambda r: hashlib.md5("|".join("\\N" if v is None else str(v) for v in r).encode()).hexdigest()
    held, bad, latest = {}, [], None
    for rows in all_batches:
        taken = []
        for r in rows:
            why = "no key" if r[0] is None else "no time" if r[1] is None else "late" if latest and r[1] < latest - delay else None
            (bad.append((*r, why)) if why else taken.append(r))
        for r in taken:
            if r[0] not in held or (r[1], r[2], digest(r)) > (held[r[0]][1], held[r[0]][2], digest(held[r[0]])):
                held[r[0]] = r
        latest = max([x for x in [latest, *[r[1] for r in taken]] if x], default=None)
    return sorted(map(str, held.values())), sorted(map(str, bad))


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_replays_and_late_rows(spark, tmp_path, seed):
    held = Held(f"file://{tmp_path}/held", SCHEMA, "k", "ts", ("nth",), "3 days")
    every = batches(seed)
    frames = [spark.createDataFrame(b, SCHEMA) for b in every]
    for i, frame in enumerate(frames):
        held.apply(frame, i)
        if i in (1, 3):
            held.apply(frame, i)  # a failure after the writes: the same batch again
        if i == 2:
            held.snapshot(spark)
        want = plain(every[: i + 1], datetime.timedelta(days=3))
        assert (rows(held.now(spark)), rows(held.rejected(spark).drop("batch"))) == want
    held.apply(frames[4], 4)
    assert rows(held.now(spark)) == want[0]
    for r in held.progress(spark).collect():
        assert r["n_rows"] == len(every[r["batch"]]) and r["n_new"] + r["n_updated"] + r["n_unchanged"] + r["n_older"] <= r["n_rows"] - r["n_rejected"]
    assert any("'late'" in x for x in want[1]) and held.progress(spark).count() == 5


def test_stream_and_its_index(spark, tmp_path):
    schema = StructType().add("doc_id", "long").add("ts", "timestamp").add("text", "string")
    texts = ["增值税 优惠", "契税的办法", "关税 notice", "增值税 notice 二", None, "优惠优惠"]
    rng = random.Random(7)
    every = [[(rng.randrange(8), START + datetime.timedelta(hours=10 * b + rng.randrange(-30, 9)), rng.choice(texts)) for _ in range(6)] for b in range(4)]
    held = Held(f"file://{tmp_path}/held", schema, "doc_id", "ts", (), "1 day")
    none = F.lit(None).cast("string")
    columns = {"doc_id": F.col("doc_id"), "title": none, "number": none, "issuer": none, "text": F.col("text"), "keywords": none, "day": F.col("ts").cast("date"), "number_year": F.lit(None).cast("int"), "in_year": F.lit(None).cast("int"), "tier": F.lit(0), "is_official": F.lit(1)}
    index = f"file://{tmp_path}/index"
    after = index_changes(held, index, columns)
    for b in every:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/arrived")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/arrived")
        held.run(stream, f"file://{tmp_path}/checkpoint", after, 120)
    after(spark, 2)
    assert rows(held.now(spark))
    batch = f"file://{tmp_path}/batch"
    P.append(held.now(spark).select(*[e.alias(c) for c, e in columns.items()]), batch, 0)
    for term in ("增值税", "优惠", "notice", "税"):
        ids = [[r["doc_id"] for r in P.search(spark, p, P.Search([term], sort="date_asc", limit=50)).collect()] for p in (index, batch)]
        assert ids[0] == ids[1], term
