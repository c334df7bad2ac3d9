"""Writing operations, sources and streams on small fixtures with nulls, ties, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import identifiers as I
from lexmill.functions import text as T
from lexmill.operators import maintenance as M
from lexmill.sources import files
from lexmill.streaming import events as E


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_insert_rebuild_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y"), (3, "y")], "k int, v string")
    assert rows(M.insert_or_ignore(old, new, ["k"])) == rows(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (3, "y")], "k int, v string"))
    assert rows(M.rebuild(old, new.filter("k = 2"), "k", F.lit(False)).select("k", "v")) == sorted(["(1, 'a')", "(2, 'x')", "(None, 'n')"])
    left = M.cascade_delete(new, "k", {"old": (old, "k")})
    assert rows(left["old"].select("k", "v")) == ["(1, 'a')", "(None, 'n')"]
    assert M.insert_or_ignore(old.filter("false"), new.filter("false"), ["k"]).count() == 0


def test_copies_and_partial_upserts(spark):
    a = spark.createDataFrame([(1, "a", None), (2, None, "q"), (3, "c", "d")], "k int, v string, w string")
    b = spark.createDataFrame([(1, "a", None), (2, "q", None), (4, "c", "d")], "k int, v string, w string")
    assert rows(M.copy_differences(a, b, "k")) == ["(2, 'changed')", "(3, 'missing')", "(4, 'extra')"]
    assert M.copy_differences(a, a, "k").count() == 0
    assert M.table_digest(a, a.columns).collect() == M.table_digest(a.orderBy(F.desc("k")), a.columns).collect() != M.table_digest(b, b.columns).collect()
    assert rows(M.partial_upsert(a, b.select("k", "v"), "k", ["v", "w", "other"])) == ["(1, 'a', None)", "(2, 'q', 'q')", "(3, 'c', 'd')"]
    assert rows(M.first_by_key(a.unionByName(a), ["w"], F.col("k").desc()).select("k")) == ["(1,)", "(2,)", "(3,)"]


@pytest.mark.parametrize("text", [None, "", "a", "x" * 5000, "One. " * 600, "p\n\n" * 900, "long sentence " * 200 + ". End.\n" + "y" * 1201, "税。" * 1500])
def test_split_pieces_lose_nothing(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(T.split_pieces(F.col("t"), 1200).alias("p")).first()["p"]
    assert "".join(found) == (text or "") and all(0 < len(p) <= 1200 for p in found)
    assert all(len(a) + len(b) > 1200 for a, b in zip(found, found[1:], strict=False))


def test_identifiers(spark):
    one = lambda expr, x: spark.createDataFrame([(x,)], "x string").select(expr(F.col("x")).alias("v")).first()["v"]
    assert one(I.number_key, "中华人民共和国 财税〔2016〕 36号") == "财税(2016)36号" and one(I.number_key, None) is None
    assert one(lambda x: I.number_year(x, 2026), "发改投资〔2014〕2091号") == 2014 and one(lambda x: I.number_year(x, 2026), "（1988）国税地字第28号") == 1988
    assert [one(I.looks_like_number, x) for x in ("[84]财政65号", "161", "号", "国务院")] == [True, False, False, False]
    assert one(I.repealed_titles, "本条不废止《甲办法》。《乙办法》同时废止；废止《本办法》") == ["乙办法"]
    assert one(I.repeals_itself, "本公告自即日起全文废止。") and not one(I.repeals_itself, "《某办法》全文废止。")
    assert one(I.mentioned_titles, "见《〈税务（试行）办法〉》和《短》") == ["《税务（试行）办法》"]
    assert [one(I.notice_key, x) for x in ("10建行税务服务", "7建行税务服务", "2026年度", "1. 标题")] == ["建行税务服务", "建行税务服务", "2026年度", "标题"]
    assert one(I.tight, "国 家 税务 a b") == "国家税务 a b"


def test_archive_kinds_and_schemas(spark, tmp_path):
    frame = spark.createDataFrame([(1, "t", "s1"), (2, None, "s2")], "doc_id long, text string, source string")
    for _ in range(2):
        files.write_archive(frame, f"{tmp_path}/a", ["source"])
    assert files.read_table(spark, f"{tmp_path}/a", "json").count() == 4
    files.write_table(frame, f"{tmp_path}/t", by=["source"])
    assert files.read_table(spark, f"{tmp_path}/t").count() == 2
    assert files.with_columns_of(frame, files.DOCUMENTS).columns == files.DOCUMENTS.names
    with pytest.raises(ValueError, match="unknown"):
        files.with_columns_of(frame.withColumn("odd", F.lit(1)), files.DOCUMENTS)
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "y.txt").write_bytes(b"plain")
    (tmp_path / "z.docx").write_bytes(b"PK\x03\x04rest")
    kinds = files.read_table(spark, f"{tmp_path}/*.*", "binaryFile").select(files.sniff(F.col("content")).alias("k"))
    assert sorted(r["k"] for r in kinds.collect()) == ["pdf", "text", "zip"]


def test_streams_give_what_batches_give(spark, tmp_path):
    sf = "/root/testdata/sf0.001"

    def run(stream, mode, name):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(run(E.daily_buckets(E.event_stream(spark, sf), "7 days"), "complete", "days").select("day", "event_type", "n")) == rows(E.daily_buckets(batch).select("day", "event_type", "n"))
    assert run(E.distinct_events(E.event_stream(spark, sf)), "append", "once").count() == batch.select("event_id").distinct().count()
