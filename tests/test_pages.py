"""Detail pages by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexmill.sources import pages as P

LONG = "各省、自治区、直辖市财政厅（局）：现将有关事项通知如下。" * 5
ART = f"<div class='article'><p>{LONG}</p></div>"
FILE = {"url": "http://x/d/files/a.pdf", "filename": "办法", "kind": "pdf"}

CASES = [
    # (page, known day, what is expected of it)
    ("<div class='currency cont'>关于对金融系统营业帐簿贴花问题的具体规定 成文日期：1988-12-12</div><div class='zs'>注释 根据《公告》（国家税务总局公告2022年第14号）规定，自2022年7月1日起，本文全文废止。</div>", "1988-12-12", {"number": None}),
    ('<h5 class="actfwzh">财税〔2014〕46号</h5><p>各省、自治区、直辖市财政厅（局）：现将有关事项通知如下。</p>', "2014-05-27", {"number": "财税〔2014〕46号", "body": None}),
    ("<div class='article'><p>《中华人民共和国增值税法》及其实施条例已于2026年1月1日起施行，现予公布如下各项。</p></div>", None, {"effective": "2026-01-01"}),
    ("<div class='article'><p>本规定自2025年3月24日起施行。</p><p>第二段也要足够长才能算作正文。</p></div>", "1986-12-31", {"effective": None}),
    ("<div class='article'><p>本规定自2025年3月24日起施行。</p><p>第二段也要足够长才能算作正文。</p></div>", "2010-01-01", {"effective": None}),
    ("<div class='article'><p>本规定自2025年3月24日起施行。</p><p>第二段也要足够长才能算作正文。</p></div>", "2024-01-01", {"effective": "2025-03-24"}),
    (f"<div class='content'><p>{LONG}菜单</p></div><div id='zoom'><p>{LONG}</p></div>", None, {"body": LONG}),
    (f"<div class='TRS_Editor'><p>空壳</p></div><div class='container content'><p>{LONG}</p></div>", None, {"body": LONG}),
    ("<div class='TRS_Editor'><p>短的通知也是通知，写了三十个字以上就行，这里一共有这么多字。</p></div>", None, {"body": "短的通知也是通知，写了三十个字以上就行，这里一共有这么多字。"}),
    (f"<div class='content'><p>{LONG}短</p></div><div class='content'><p>{LONG}{LONG}</p></div>", None, {"body": LONG + LONG}),
    (f"<div class='article'><p>当前位置：首页</p><p>相关政策文件</p><p>甲</p><p>{LONG}<p>第二段 文字</div>", None, {"body": LONG + "\n第二段 文字"}),
    (f"<div class='article'>没有段落{LONG}<script>var x='<p>不是</p>'</script><style>p</style></div>", None, {"body": "没有段落" + LONG}),
    ("<div class='article'><p>相关政策文件</p></div>", None, {"body": None}),
    ("<meta name='ArticleTitle' content='关于印发某某管理办法的通知'><title>站点 栏目</title><h1>某某省税务局网站首页</h1>", None, {"title": "关于印发某某管理办法的通知"}),
    ("<title>国家税务总局某省税务局 最新文件</title><h1>短</h1>", None, {"title": "国家税务总局某省税务局 最新文件"}),
    ("<div class='arc_date'>成文日期：2020-3-5 全文废止</div>", None, {"status": "已废止", "written": "2020-03-05"}),
    ("<div class='arc_date'>部分失效</div><div class='arc_date x'>成文日期：2021/11/30</div>", None, {"status": "部分失效", "written": "2021-11-30"}),
    ("<a href='files/a.pdf'>办法</a><a href='/d/files/a.pdf'>再来</a><a href='javascript:x.pdf'>坏</a><a href='b.html'>页</a><a href='http://y/q.DOCX?v=1'></a>", None, {"attachments": [FILE, {"url": "http://y/q.DOCX?v=1", "filename": "q.DOCX?v=1", "kind": "docx"}]}),
    ("<div class='artsets'><ul><li><a>关于某事的解读</a><li><a>短</a></ul></div><a>关于别事的解读</a>", None, {"related": ["关于某事的解读"]}),
    (f"<h4>国家税务总局 财政部公告 2026 年第 28 号</h4>{ART}<p>依据财税〔2016〕36号</p>", None, {"number": "国家税务总局财政部公告 2026 年第 28 号", "body": LONG}),
    ("<p>国家税务总局公告2026年第19号</p><div class='arc_date'>成文日期：2020-01-01</div>", None, {"number": None}),
    ("<div class=zs><b>财税〔2019〕1号</b></div><td>财税〔2018〕2号</td>", None, {"number": "财税〔2018〕2号"}),
    ("<p" * 300 + "<div>" * 3000 + "</b></i>", None, {"body": None}),
]


def test_pages_by_hand(spark):
    rows = [(i, "http://x/d/p.html", html, known and datetime.date.fromisoformat(known)) for i, (html, known, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, known date")
    found = {r["page_id"]: r.asDict(True) for r in P.details(frame, F.col("known")).collect()}
    for i, (_, _, want) in enumerate(CASES):
        got = {k: str(found[i][k]) if isinstance(found[i][k], datetime.date) else found[i][k] for k in want}
        assert got == want, CASES[i][0]
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (2, "http://[", "<a href='//[x.pdf'>x</a>")], "page_id long, url string, html string")
    assert [(r["title"], r["body"], r["attachments"]) for r in P.details(odd).collect()] == [(None, None, [])] * 3
    assert P.details(frame.filter("false")).count() == 0


@pytest.mark.parametrize("bad", ["<div>", "<p>", "<li>", "<a href='x.pdf'>", "<b class='zs'>号", "</div>"])
def test_time_of_broken_pages(bad):
    import time

    took = []
    for n in (2_000, 20_000):
        began = time.process_time()
        P.page_parts(bad * n, "http://x/")
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.05)
