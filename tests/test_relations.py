"""Relations on literal cases: who names whom, what is in force, chains and circles of repeals."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import identifiers as I
from lexmill.operators import relations as R
from lexmill.plans.policies import listed_documents

DOC = "doc_id long, title string, number string, text string, aging string, effective date, catalog string"


def frame(spark, *rows):
    """rows: (doc_id, title, number, text, ...)."""
    import datetime

    full = [(*r, *[None] * (7 - len(r))) for r in rows]
    full = [tuple(datetime.date.fromisoformat(v) if i == 5 and v else v for i, v in enumerate(r)) for r in full]
    return spark.createDataFrame(full, DOC).withColumn("catalog", listed_documents(F.col("catalog")))


def edges(relations, kind=None):
    return sorted(((r["src"], r["relation"], r["dst"], r["dst_no"]) for r in relations.collect() if kind in (None, r["relation"])), key=str)


def one(spark, expr, x):
    return spark.createDataFrame([(x,)], "x string").select(expr(F.col("x")).alias("v")).first()["v"]


def test_repeal_sentences(spark):
    cases = {
        "根据《国务院关于废止2000年底以前发布的部分行政法规的决定》（国务院令第319号），全文废止": True,
        "《税收办法》（国务院令第319号），全文废止": True,
        "自1994年1月1日起本法规全文废止。": True,
        "《财政部关于某事项的管理办法》全文废止": False,
        "本公告不废止现行有效的规定。": False,
        "正文内容，无废止表述。": False,
    }
    assert {x: one(spark, I.repeals_itself, x) for x in cases} == cases
    assert one(spark, I.repealed_titles, "本条不废止《国家税务总局关于某某事项的公告》。上述规定未废止《某文件》。") == []
    assert one(spark, I.repeal_objects, "废止《 甲 办法》；停止执行《财税〔2016〕36号》。《乙》《丙办法》一并废止") == ["甲 办法", "财税〔2016〕36号", "丙办法"]


def test_numbers_in_texts(spark):
    assert one(spark, I.mentioned_numbers, "按照财政部税务总 局公告2026 年第9 号和（财税〔2016〕36号）、财税〔2016〕36号执行") == ["财政部税务总局公告2026年第9号", "财税(2016)36号"]
    assert one(spark, I.mentioned_numbers, "依据财税〔2016〕36号文件的规定办理。") == ["财税(2016)36号"]
    assert [one(spark, lambda x: I.sort_year(x, 2026), x) for x in ("[84]财政65号", "（85）财改字第103号", "财税〔2004〕1号", "〔04〕9号", None)] == [1984, 1985, 2004, None, None]
    assert one(spark, I.number_key, "日日国家税务总局公告2016 年第38 号") == "国家税务总局公告2016年第38号"
    assert one(spark, I.title_key, "财政部 关于发布〈办 法〉的公告") == one(spark, I.title_key, "财政部关于发布《办法》的公告")


def test_targets_by_number_title_and_best_match(spark):
    docs = frame(
        spark,
        (1, "国家税务总局关于旧事项处理问题的公告", "国家税务总局公告2020年第5号", None),
        (2, "国家税务总局关于新事项的公告", "国家税务总局公告2026年第19号", "现将有关事项公告如下。《国家税务总局关于旧事项处理有关问题的公告》同时废止。"),
        (3, "国家税务总局关于申报事项的公告", None, "根据《财政部 税务总局关于发布〈境内单位代扣代缴自然人增值税管理办法〉的公告》（2026年第28号）有关规定，现予公布。停止执行《国家税务总局公告2020年第5号》"),
        (4, "财政部 税务总局关于发布《境内单位代扣代缴自然人增值税管理办法》的公告", "财政部 税务总局公告2026年第28号", "本公告（财政部税务总局公告2026年第28号）自发布之日起施行。"),
        (5, "关于《国家税务总局关于旧事项处理问题的公告》的解读", None, "本公告全文废止136件。依据财税〔1999〕1号。依据财税〔2099〕1号。"),
        (6, "中华人民共和国某某税法", None, "《国家税务总局关于新事项的公告》同时废止。"),
        (7, None, None, "废止《中华人民共和国某某税法》"),
        (None, "国家税务总局关于旧事项处理问题的公告", None, "《国家税务总局关于新事项的公告》同时废止。"),
    )
    found = R.build_relations(docs)
    assert edges(found, "repeals") == [(2, "repeals", 1, "国家税务总局公告2020年第5号"), (3, "repeals", 1, "国家税务总局公告2020年第5号"), (7, "repeals", None, "中华人民共和国某某税法")]
    cites = edges(found, "cites")
    assert (3, "cites", 4, "财政部 税务总局公告2026年第28号") in cites and (5, "cites", None, "财税(2099)1号") in cites
    assert not [e for e in edges(found) if e[0] == 4 or e[0] == e[2]] and not edges(found, "self_repealed")
    assert edges(R.build_relations(docs, held=found)) == edges(found)
    # what people entered stays, and stands for what is derived alike
    said = found.limit(0).unionByName(spark.createDataFrame([(2, "repeals", 1, "国家税务总局公告2020年第5号", "seen", "manual", "high"), (9, "cites", None, "x", "old", "content", "low")], found.schema))
    again = R.build_relations(docs, held=said)
    assert edges(again) == edges(found) and again.filter("evidence_source = 'manual'").count() == 1
    judged = {r["doc_id"]: (r["status"], r["source"], r["needs_review"]) for r in R.judge(docs, found, "2020-01-01").collect()}
    assert judged[1] == ("已废止", "inferred", True) and judged[2] == judged[5] == judged[6] == ("现行有效", "default", False)


def test_order_of_evidence(spark):
    title = "国家税务总局关于印发若干事项管理办法的通知{}"
    docs = frame(
        spark,
        (1, title.format("甲"), "财税〔2001〕1号", "本通知全文废止", "现行有效"),
        (2, title.format("乙乙乙乙乙乙"), "财税〔2001〕2号", "本通知全文废止", "尚未生效"),
        (3, title.format("丙丙丙丙丙丙"), "财税〔2001〕3号", "本通知全文废止", "不详", "2030-01-01"),
        (4, "完全不同的一份文件的名称在这里", "财税〔2001〕4号", "无", None, "2030-01-01"),
        (5, "某年失效废止文件目录", None, None, None, None, "序号|名称|文号\n1| |财税〔2001〕1号\n2|短|x\n"),
    )
    judged = {r["doc_id"]: (r["status"], r["source"]) for r in R.judge(docs, R.build_relations(docs), "2020-01-01").collect()}
    assert judged == {1: ("已废止", "official"), 2: ("尚未生效", "official"), 3: ("已废止", "inferred"), 4: ("尚未生效", "inferred"), 5: ("现行有效", "default")}


def test_no_documents_and_many_of_one_title(spark):
    none = frame(spark, (1, "t", None, "x")).filter("false")
    assert R.build_relations(none).count() == 0 and R.repeal_closure(R.build_relations(none)).count() == 0
    same = frame(spark, *[(i, "国家税务总局关于同一事项的通知", None, "依据《国家税务总局关于同一事项的通告》办理。" if i > 90 else None) for i in range(100)], (200, "国家税务总局关于另一事项的规定", None, "《国家税务总局关于同一事项的通知》废止。"))
    found = edges(R.build_relations(same))
    assert sorted(e[:3] for e in found) == [(i, "cites", 0) for i in range(91, 100)] + [(200, "cites", 0), (200, "repeals", 0)]


@pytest.mark.parametrize("edge", [[], [(1, 2)], [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 1)], [(i, i + 1) for i in range(40)] + [(0, 39), (7, 3)]])
def test_closure_walks_chains_and_circles(spark, edge):
    near: dict = {e: 1 for e in edge}
    for _ in range(60):
        for (a, b), n in list(near.items()):
            for c, d in edge:
                if b == c and near.get((a, d), 99) > n + 1:
                    near[a, d] = n + 1
    rows = [(a, "repeals", b, None, None, "content", "high") for a, b in edge + edge] + [(1, "repeals", None, "x", None, "content", "low"), (2, "cites", 1, None, None, "content", "low")]
    frame = spark.createDataFrame(rows, "src long, relation string, dst long, dst_no string, evidence string, evidence_source string, confidence string")
    assert {(r["src"], r["dst"]): r["steps"] for r in R.repeal_closure(frame).collect()} == near


def test_issuers_and_built_numbers(spark):
    issuers = {"其企业所得税优惠政策可以按照财税": "财税", "注释 根据国家税务总局": "国家税务总局", "人力资源和社会保障部": "人力资源和社会保障部", "海关总署": "海关总署", "考虑在粤人社规": "粤人社规", "展期内销售的进口展品继续按照财关税": "财关税", "国家数据局": "国家数据局", "据国家税务总局": "国家税务总局", "财税": "财税", "可以": "可以", "": ""}
    assert {x: one(spark, I.issuer_in, x) for x in issuers} == issuers
    repairs = {"根据财企〔2002〕266号": "财企〔2002〕266号", "财企〔2002〕266号": None, "注释 根据国家税务总局公告2018年第33号": "国家税务总局公告2018年第33号", "161": None, None: None}
    assert {x: one(spark, I.repaired_number, x) for x in repairs} == repairs
    cases = [
        (("关于某事项的工业和信息化部 国家发展改革委 财政部 国家税务总局公告2021年第10号", None, None, None), ("工业和信息化部 国家发展改革委 财政部 国家税务总局公告2021年第10号", "high")), (("公告2021年第3号", "2021", "3", "财政部,国家税务总局"), ("财政部 国家税务总局2021年第3号", "medium")),
        (("关于某事的通知（财税〔2016〕36号）", None, None, None), ("财税〔2016〕36号", "high")), (("关于2019年某事的通知", None, "19", None), ("2019年第19号", "low")), (("关于某事的通知", "", "19", "财政部"), (None, "low")), ((None, None, None, None), (None, "low")), (("某事", "2020", "x", "财政部"), (None, "low")),
    ]
    frame = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, t string, y string, n string, o string")
    found = frame.select("i", I.built_number(F.col("t"), F.col("y"), F.col("n"), F.col("o")).alias("b")).orderBy("i").collect()
    assert [tuple(r["b"]) for r in found] == [want for _, want in cases]
