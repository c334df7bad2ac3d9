"""Queries over official documents: numbers, references, repeal, validity, classes.

The tables hold no official documents, so `policies` makes one of each row of `documents`: issuer, number, title, day and
wording follow from doc_id, and the expressions are the same in either engine. What is tested are the operators on them.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import identifiers as I
from lexmill.functions import text as T
from lexmill.operators.maintenance import first_by_key
from lexmill.plans.registered import query
from lexmill.plans.storage import table

# Taxes and the words that stand for them.
TAXES = {
    "增值税": ("增值税",), "土地增值税": ("土地增值税",), "企业所得税": ("企业所得税",), "个人所得税": ("个人所得税", "个税"), "消费税": ("消费税",), "印花税": ("印花税",), "房产税": ("房产税",),
    "城镇土地使用税": ("城镇土地使用税", "土地使用税"), "耕地占用税": ("耕地占用税",), "契税": ("契税",), "车船税": ("车船税",), "车辆购置税": ("车辆购置税", "车购税"), "资源税": ("资源税",),
    "环境保护税": ("环境保护税", "环保税"), "关税": ("关税",), "出口退税": ("出口退税", "出口退（免）税", "出口货物退"), "税收征管": ("征收管理", "税收征管", "纳税申报", "发票管理"),
}
# Whom a document is for, and what it grants.
SUBJECTS = {
    "小微企业": ("小微企业", "小型微利企业", "小微"), "个体工商户": ("个体工商户", "个体户"), "小规模纳税人": ("小规模纳税人",), "高新技术企业": ("高新技术企业", "高新企业"), "科技型中小企业": ("科技型中小企业",),
    "制造业": ("制造业", "制造企业"), "软件与集成电路": ("软件企业", "集成电路"), "涉农": ("农业", "农产品", "涉农", "农民", "农村"),
    "重点群体": ("重点群体", "退役军人", "残疾", "失业人员", "建档立卡", "高校毕业生", "退役士兵"), "小型微利与创业投资": ("创业投资", "天使投资", "创投"),
}
PREFERENCES = {
    "减免税": ("减免", "免征", "减征", "免税"), "留抵退税": ("留抵退税", "留抵税额"), "出口退税": ("出口退税", "出口退（免）税"), "加计扣除与抵减": ("加计扣除", "加计抵减"), "税收抵免": ("抵免",), "核定征收": ("核定征收",),
    "延期与缓缴": ("延期缴纳", "缓缴", "延缓缴纳", "延期申报", "延期缴纳税款"), "并购重组": ("并购", "重组", "改制", "合并", "分立"), "跨境与税收协定": ("税收协定", "非居民", "常设机构", "跨境"),
    "税前扣除": ("税前扣除", "扣除标准"), "优惠资格与管理": ("优惠目录", "优惠资格", "备案", "留存备查"),
}
# Words of news and popular titles; columns whose documents are substantive, and those of interpretations;
# words and endings of titles outside the official layer; endings of titles of documents.
NEWS = (
    "小课堂", "一图了解", "图解", "漫画", "视频", "便利贴", "我来讲", "有回应", "办税小知识", "小贴士", "曝光", "访谈", "直播预告", "征期日历", "温馨提示", "热点问答", "注意！", "注意啦", "收藏！", "速看", "提醒！", "手把手", "了解一下", "算一算",
    "必看", "秒get", "看这里", "话税收", "热点问题", "办税知识", "开学第一课", "千万别踩", "要点解答", "答记者问", "典型案例", "案例解析", "案例解读", "案例警示", "提示案例",
)
SUBSTANTIVE_COLUMNS, INTERPRETING_COLUMNS = ("政策法规", "财税文件", "行政法规", "国务院文件", "税务规范性文件", "部门规章", "其他文件"), ("政策解读", "政策指引")
UNOFFICIAL = (
    "解读", "12366", "热点问题", "热点问答", "政策问答", "知识问答", "问题解答", "常见问题", "答记者问", "新闻发布会", "记者提问", "温馨提示", "一图", "图解", "读懂", "图说", "漫画", "漫解", "短视频", "Vlog", "H5", "秒懂", "速览", "一张图", "思维导图", "小课堂", "小知识",
    "小贴士", "指南针", "第一课", "教你", "带你", "带您", "帮您", "帮你", "收好", "点开", "戳视频", "戳图", "看这里", "了解一下", "个税APP", "视频版", "动漫丨", "动漫｜", "动漫|", "短片", "创意视频", "数字播报员",
)
UNOFFICIAL_FORMS = "(指南|指引|清单)[）)]?$|缴费事项清单|热线.*热点|热线.*问答|电子税务局.*操作|电子税务局.*怎么办"
GENRES = ("的通知", "的公告", "的决定", "的办法", "的规定", "的意见", "的批复", "的复函", "实施细则")
# Provinces in administrative order, and names of places in titles with the provinces they are in.
PROVINCES = ("北京", "天津", "河北", "山西", "内蒙古", "辽宁", "吉林", "黑龙江", "上海", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "广西", "海南", "重庆", "四川", "贵州", "云南", "西藏", "陕西", "甘肃", "青海", "宁夏", "新疆")
PLACES = {
    "北京": "北京", "上海": "上海", "天津": "天津", "重庆": "重庆", "广东": "广东", "广州": "广东", "深圳": "广东", "江苏": "江苏", "南京": "江苏", "苏州": "江苏", "浙江": "浙江", "杭州": "浙江", "宁波": "浙江", "山东": "山东", "济南": "山东", "青岛": "山东", "四川": "四川",
    "成都": "四川", "湖北": "湖北", "武汉": "湖北", "湖南": "湖南", "长沙": "湖南", "河南": "河南", "郑州": "河南", "河北": "河北", "石家庄": "河北", "福建": "福建", "福州": "福建", "安徽": "安徽", "合肥": "安徽", "陕西": "陕西", "西安": "陕西", "辽宁": "辽宁", "沈阳": "辽宁",
    "大连": "辽宁", "吉林": "吉林", "黑龙江": "黑龙江", "山西": "山西", "江西": "江西", "广西": "广西", "云南": "云南", "贵州": "贵州", "海南": "海南", "甘肃": "甘肃", "青海": "青海", "宁夏": "宁夏", "新疆": "新疆", "内蒙古": "内蒙古", "西藏": "西藏",
}
AS_OF, LATEST = "2020-01-01", 2026


def _pick(by: str, values) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " ELSE '其他' END"


def _issuer(i):
    return _pick(f"({i}) % 4", ["财税", "国税发", "国办发", "税总函"])


def _number(i):
    return f"concat({_issuer(i)}, '〔', 2000 + ({i}) % 25, '〕', ({i}) % 300 + 1, '号')"


def _title(i):
    tax = _pick(f"({i}) % 17", TAXES)
    return f"""CASE WHEN ({i}) % 23 = 0 THEN concat('一图读懂', {tax}, '优惠政策', {i}) WHEN ({i}) % 29 = 0 THEN concat('关于', {tax}, '公告', {i}, '的解读') WHEN ({i}) % 31 = 0 THEN concat({i}, {tax}, '需不需要申报？')
      ELSE concat('关于', {tax}, '若干 问题（第', {i}, '号）的通知') END"""


_COLUMNS = {
    "doc_id": "doc_id",
    "title": _title("doc_id"),
    "raw_no": f"""CASE doc_id % 7 WHEN 0 THEN {_number('doc_id')} WHEN 1 THEN concat({_issuer('doc_id')}, '[', 2000 + doc_id % 25, '] ', doc_id % 300 + 1, ' 号') WHEN 2 THEN concat('根据', {_number('doc_id')})
      WHEN 3 THEN concat('中华人民共和国财政部公告 ', 2000 + doc_id % 25, ' 年 第', doc_id % 300 + 1, '号') WHEN 4 THEN NULL WHEN 5 THEN concat('日', {_issuer('doc_id')}, '（', 1990 + doc_id % 50, '）', doc_id % 90 + 1, '号') ELSE CASE WHEN doc_id % 2 = 0 THEN concat('[', 80 + doc_id % 20, ']财政', doc_id % 90 + 1, '号') ELSE '161' END END""",
    "column_name": _pick("doc_id % 7", ["政策解读", "税务规范性文件", "地方政策", "政策法规"]),
    "tax_policy": f"CASE WHEN doc_id % 8 = 3 THEN {_pick('doc_id % 5', ['个税', '环保税', '车购税', '发票管理'])} END",
    "site": f"CASE WHEN doc_id % 6 > 0 THEN concat('国家税务总局', {_pick('doc_id % 36', PROVINCES)}, '税务局') END",
    "notice": f"concat({_pick('doc_id % 52', PLACES)}, '市', doc_id, {_pick('doc_id % 9', ['税务服务指南', '热线的问答', '电子税务局怎么办', '缴费清单）', 'Vlog', '动漫产业的通知', '典型案例', '数字播报员'])})",
    "day": "CAST(concat(2000 + doc_id % 19, '-0', 1 + doc_id % 9, '-1', doc_id % 10) AS DATE)",
    "aging": "CASE WHEN doc_id % 43 = 0 THEN '尚未生效' WHEN doc_id % 47 = 0 THEN '已废止' END",
    "keywords": f"concat({_pick('doc_id % 12', ['小微企业减免', '个体户免征', '农产品', '集成电路 加计扣除', '退役军人', '创投抵免', '备案', '非居民 税收协定', '缓缴', '重组', '高新企业'])}, ' ', coalesce(lang, ''))",
    "content": f"""concat('依据', {_number('doc_id - 1')}, '和《', {_title('doc_id - 3')}, '》执行。', CASE WHEN doc_id % 11 = 0 THEN concat('《', {_title('doc_id - 5')}, '》同时废止。') ELSE '' END,
      CASE WHEN doc_id % 6 = 0 THEN concat('按照财 税〔2016〕 ', doc_id % 90, ' 号办理。') ELSE '' END, CASE WHEN doc_id % 17 = 0 THEN '根据《国务院关于清理的决定》（国务院令第319号），全文废止。' ELSE '' END,
      CASE WHEN doc_id % 37 = 0 THEN concat('本条不废止《', {_title('doc_id - 2')}, '》。') ELSE '' END, CASE WHEN doc_id % 13 = 0 THEN '本通知自下月起全文废止。' ELSE '' END,
      CASE WHEN doc_id % 19 = 0 THEN concat('停止执行《', {_title('doc_id - 8')}, '》；废止《该办法的通知》') ELSE '' END,
      CASE WHEN doc_id % 5 = 0 THEN concat('自 ', 2000 + doc_id % 27, ' 年 ', 1 + doc_id % 12, ' 月 1 日起施行。') ELSE '' END)""",
    "catalog": f"""concat('序号|文件|文号', chr(10), '1|', {_title('doc_id - 7')}, '|', {_number('doc_id - 7')}, chr(10), '2|短|无', chr(10), {_number('doc_id - 9')}, '| |', chr(10), ' 3 | ', {_number('doc_id - 9')}, '|x', chr(10), '4|', {_title('doc_id - 4')})""",
}
POLICIES = "p AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _COLUMNS.items()) + " FROM documents WHERE doc_id IS NOT NULL)"


def policies(s, d):
    return table(s, d, "documents").filter("doc_id is not null").selectExpr(*[f"{e} AS {c}" for c, e in _COLUMNS.items()])


_SPACES = r"[\s　]+"
# Patterns of the SQL, written apart from those of the code.
_LEADS = "依据|根据|按照|依照|参照|遵照|详见|见"
_IN_BRACKETS = r"[一-龥]{2,24}[〔\[（(][ ]*20[0-9][0-9][ ]*[〕\]）)][ ]*[0-9]{1,6}[ ]*号"
_AS_NOTICE = r"[一-龥][一-龥、]{0,60}(?:公告|通知|令|决定|规定|办法|通告)[ ]*20[0-9][0-9][ ]*年[ ]*第[ ]*[0-9]{1,6}[ ]*号"
_SQL_YEARS = (r"[〔\[（(][ ]*((?:19|20)[0-9][0-9])[ ]*[〕\]）)]", r"((?:19|20)[0-9][0-9])[ ]*年[ ]*第", r"(?:公告|第)[ ]*((?:19|20)[0-9][0-9])[ ]*年")
_DENIED = "(不|不作|未|不再)废止"


def _sql_title(x):
    return f"regexp_replace(translate(coalesce({x}, ''), '〈〉﹝﹞', '《》《》'), '{_SPACES}', '', 'g')"


def _sql_number(x):
    return f"nullif(regexp_replace(translate(regexp_replace(replace(coalesce({x}, ''), '中华人民共和国', ''), '{_SPACES}', '', 'g'), '〔〕（）【】[]', '()()()()'), '^日+', ''), '')"


def _sql_year(x):
    return f"list_max(list_filter(list_transform({' || '.join(f"regexp_extract_all({x}, '{p}', 1)" for p in _SQL_YEARS)}, lambda y: y::INT), lambda y: y <= {LATEST}))"


def _sql_tight(x):
    return f"regexp_replace(regexp_replace({x}, '([一-龥])[ \\n　]+([一-龥])', '\\1\\2', 'g'), '([一-龥])[ \\n　]+([一-龥])', '\\1\\2', 'g')"


@query(rf"""WITH {POLICIES} SELECT doc_id, {_sql_number('raw_no')} AS number_key, {_sql_year("coalesce(raw_no, '')")} AS number_year, try_cast(list_last(regexp_extract_all(coalesce(raw_no, ''), '([0-9]+)\s*号', 1)) AS INT) AS in_year,
regexp_matches(coalesce(raw_no, ''), '(19|20)?[0-9]{{2}}\s*(〕|\]|）|\)|年).*[0-9]+\s*号') AS looks_right FROM p""")
def policy_numbers(s, d):
    """Numbers in comparable form, their year and the number within it."""
    no = F.col("raw_no")
    return policies(s, d).select("doc_id", I.number_key(no).alias("number_key"), I.number_year(no, LATEST).alias("number_year"), I.number_in_year(no).alias("in_year"), I.looks_like_number(no).alias("looks_right"))


@query(f"""WITH {POLICIES} SELECT doc_id, number_year, in_year, row_number() OVER (ORDER BY number_year DESC NULLS LAST, in_year DESC NULLS LAST, doc_id) AS place
FROM (SELECT doc_id, coalesce({_sql_year("coalesce(raw_no, '')")}, try_cast(nullif(regexp_extract(raw_no, '[〔\\[（(][ ]*([89][0-9])[ ]*[〕\\]）)]', 1), '') AS INT) + 1900) AS number_year, try_cast(list_last(regexp_extract_all(coalesce(raw_no, ''), '([0-9]+)\\s*号', 1)) AS INT) AS in_year FROM p) ORDER BY place LIMIT 50""")
def policies_by_number(s, d):
    """The first 50 documents by year and number, those without a number last; the limit is the feature."""
    no = F.col("raw_no")
    rows = policies(s, d).select("doc_id", I.sort_year(no, LATEST).alias("number_year"), I.number_in_year(no).alias("in_year"))
    top = rows.orderBy(F.col("number_year").desc_nulls_last(), F.col("in_year").desc_nulls_last(), "doc_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("number_year").desc_nulls_last(), F.col("in_year").desc_nulls_last(), "doc_id")))


@query(rf"""WITH {POLICIES}, q AS (SELECT *, regexp_replace(raw_no, '^({_LEADS})', '') AS bare, regexp_matches(coalesce(raw_no, ''), '(19|20)?[0-9]{{2}}\s*(〕|\]|）|\)|年).*[0-9]+\s*号') AS ok, {_sql_year("coalesce(raw_no, '')")} AS y FROM p)
SELECT doc_id, CASE WHEN bare <> raw_no THEN bare END AS repaired, CASE WHEN ok THEN raw_no END AS official, CASE WHEN y - year(day) >= 5 THEN NULL ELSE raw_no END AS scrubbed,
coalesce(raw_no, regexp_replace(nullif(regexp_extract(content, '{_IN_BRACKETS}'), ''), '^({_LEADS})', '')) AS filled FROM q""")
def policy_number_repairs(s, d):
    """Lead-ins cut off, invalid numbers cleared, numbers five years or more off cleared, missing ones from the text."""
    no = F.col("raw_no")
    bare = I.without_lead_in(no)
    found = F.nullif(F.regexp_extract("content", I.BRACKETED, 0), F.lit(""))
    return policies(s, d).select(
        "doc_id", F.when(bare != no, bare).alias("repaired"), F.when(I.looks_like_number(no), no).alias("official"),
        F.when(I.number_year(no, LATEST) - F.year("day") >= 5, None).otherwise(no).alias("scrubbed"), F.coalesce(no, I.without_lead_in(found)).alias("filled"),
    )


_SQL_EFFECTIVE = r"""SELECT doc_id, CASE WHEN e >= day AND year(e) - year(day) < 5 THEN e END AS effective FROM (SELECT doc_id, day, try_cast(nullif(concat_ws('-', regexp_extract(content, '自\s*([0-9]{4})\s*年', 1),
lpad(regexp_extract(content, '自\s*[0-9]{4}\s*年\s*([0-9]{1,2})\s*月', 1), 2, '0'), lpad(regexp_extract(content, '自\s*[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*([0-9]{1,2})\s*日起', 1), 2, '0')), '-00-00') AS DATE) AS e FROM p)"""


@query(f"WITH {POLICIES} {_SQL_EFFECTIVE}")
def effective_dates(s, d):
    return policies(s, d).select("doc_id", I.effective_date(F.col("content"), F.col("day")).alias("effective"))


@query(rf"""WITH {POLICIES} SELECT doc_id, r.kind, r.reference, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(list_filter(list_distinct(list_transform(regexp_extract_all(content, '《([^《》]+)》', 1), lambda t: {_sql_title('t')})), lambda t: len(t) >= 4), lambda t: {{'kind': 'title', 'reference': t}})
|| list_transform(list_distinct(list_transform(regexp_extract_all({_sql_tight('content')}, '{_AS_NOTICE}') || regexp_extract_all({_sql_tight('content')}, '{_IN_BRACKETS}'), lambda t: {_sql_number(f"regexp_replace(t, '^({_LEADS})', '')")})), lambda t: {{'kind': 'number', 'reference': t}})) AS r FROM p) GROUP BY ALL""")
def policy_references(s, d):
    """The titles and numbers that each document mentions."""
    named = lambda kind, found: F.transform(found, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("reference")))
    kinds = [named("title", I.mentioned_titles(F.col("content"))), named("number", I.mentioned_numbers(F.col("content")))]
    return policies(s, d).select("doc_id", F.explode(F.concat(*kinds)).alias("r")).groupBy("doc_id", "r.kind", "r.reference").agg(F.count("*").alias("n"))


_SQL_REPEALS = rf"""SELECT DISTINCT doc_id, target FROM (SELECT doc_id, {_sql_title('trim(t)')} AS target, trim(t) AS t FROM (SELECT doc_id, unnest(regexp_extract_all(sentence, '废止[ ]*《([^》]+)》', 1) || regexp_extract_all(sentence, '停止执行[ ]*《([^》]+)》', 1) || regexp_extract_all(sentence, '《([^》]+)》[ ]*(?:同时|一并|予以)?[ ]*废止', 1)) AS t
FROM (SELECT doc_id, unnest(string_split_regex(content, '[。；\n]')) AS sentence FROM p) WHERE NOT regexp_matches(sentence, '{_DENIED}')) WHERE len(trim(t)) >= 2 AND NOT regexp_matches(trim(t), '^(本|上述|该|原)'))"""
_SQL_SELF = rf"""SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split_regex(content, '[。；\n]')) AS sentence FROM p) WHERE NOT regexp_matches(sentence, '{_DENIED}')
AND (regexp_matches(sentence, '本(公告|通知|规定|办法|细则|法规|条例|决定|规则|意见|复函|批复|函|文件).{{0,40}}废止') OR regexp_matches(sentence, '(^|[^》」])(全文|全部|予以)废止'))"""


@query(f"WITH {POLICIES} {_SQL_REPEALS}")
def repeal_targets(s, d):
    return policies(s, d).select("doc_id", F.explode(I.repealed_titles(F.col("content"))).alias("target"))


@query(f"WITH {POLICIES} {_SQL_SELF}")
def self_repealed(s, d):
    return policies(s, d).filter(I.repeals_itself(F.col("content"))).select("doc_id")


_SQL_CATALOG = rf"""SELECT doc_id, {_sql_title('t')} AS listed, {_sql_number('no')} AS listed_no FROM (SELECT doc_id, list_filter(cells, lambda c: len(c) >= 10 AND contains(c, '关于'))[1] AS t, list_filter(cells, lambda c: regexp_matches(c, '〔[ ]*[0-9]{{4}}[ ]*〕'))[1] AS no
FROM (SELECT doc_id, list_filter(list_transform(string_split(unnest(string_split(catalog, chr(10))), '|'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM p WHERE doc_id % 41 = 0) WHERE len(cells) >= 2) WHERE t IS NOT NULL OR no IS NOT NULL"""


def listed_documents(x):
    """Rows of a catalogue of repealed documents, as array<struct<title, number>>: of the cells of a line (two or more with
    anything in them) the first of ten characters with 关于, and the first with a year in brackets; either is enough."""
    cells = F.transform(F.split(I.text_of(x), "\n", -1), lambda line: F.filter(F.transform(F.split(line, r"\|", -1), lambda c: F.trim(c)), lambda c: c != ""))
    rows = F.transform(
        F.filter(cells, lambda c: F.size(c) >= 2),
        lambda c: F.struct(F.get(F.filter(c, lambda t: (F.length(t) >= 10) & F.contains(t, F.lit("关于"))), 0).alias("title"), F.get(F.filter(c, lambda n: n.rlike(r"〔\s*[0-9]{4}\s*〕")), 0).alias("number")),
    )
    return F.filter(rows, lambda r: r["title"].isNotNull() | r["number"].isNotNull())


@query(f"WITH {POLICIES} {_SQL_CATALOG}")
def catalog_rows(s, d):
    """Rows of repeal catalogues; documents 41 apart have one."""
    rows = policies(s, d).filter("doc_id % 41 = 0").select("doc_id", F.explode(listed_documents(F.col("catalog"))).alias("r"))
    return rows.select("doc_id", I.title_key(F.col("r.title")).alias("listed"), I.number_key(F.col("r.number")).alias("listed_no"))


@query(f"""WITH {POLICIES}, r AS (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all({_sql_tight('content')}, '{_AS_NOTICE}') || regexp_extract_all({_sql_tight('content')}, '{_IN_BRACKETS}'), lambda t: {_sql_number(f"regexp_replace(t, '^({_LEADS})', '')")})) AS ref FROM p),
n AS (SELECT {_sql_number('raw_no')} AS ref, max(doc_id) AS target FROM p WHERE raw_no IS NOT NULL GROUP BY 1), e AS (SELECT r.doc_id, r.ref, n.target FROM r LEFT JOIN n USING (ref) WHERE n.target IS NULL OR n.target <> r.doc_id)
SELECT doc_id, count(target) AS n_cited, count(*) - count(target) AS n_dangling, coalesce((SELECT count(*) FROM e x WHERE x.target = e.doc_id), 0) AS n_citing FROM e GROUP BY doc_id""")
def policy_graph(s, d):
    """For each document that refers to any: references found (a number's last holder), dangling ones, and those to it."""
    p = policies(s, d)
    refs = p.select("doc_id", F.explode(I.mentioned_numbers(F.col("content"))).alias("ref"))
    holders = p.select(I.number_key(F.col("raw_no")).alias("ref"), "doc_id").filter("ref is not null").groupBy("ref").agg(F.max("doc_id").alias("target"))
    edges = refs.join(holders, "ref", "left").filter("target is null or target != doc_id")
    to = edges.filter("target is not null").groupBy(F.col("target").alias("doc_id")).agg(F.count("*").alias("n_citing"))
    return edges.groupBy("doc_id").agg(F.count("target").alias("n_cited"), (F.count("*") - F.count("target")).alias("n_dangling")).join(to, "doc_id", "left").fillna(0, ["n_citing"])


def _sql_any(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _sql_kind(title):
    return f"""CASE WHEN regexp_matches({title}, '[？?]$') THEN 'news' WHEN raw_no IS NOT NULL THEN 'substantive' WHEN {_sql_any(title, NEWS)} THEN 'news' WHEN column_name IN {INTERPRETING_COLUMNS} OR {_sql_any(title, ('解读', '答记者问'))} THEN 'interpretation'
    WHEN column_name IN {SUBSTANTIVE_COLUMNS} OR {" OR ".join(f"suffix({title}, '{g}')" for g in GENRES)} THEN 'substantive' ELSE 'other' END"""


def _sql_unofficial(title):
    return f"({_sql_any(title, UNOFFICIAL)} OR regexp_matches({title}, '{UNOFFICIAL_FORMS}'))"


def holds_any(x, words):
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(I.text_of(x), w))


def unofficial(title):
    """Titles outside the official layer: what explains, advertises or answers."""
    return holds_any(title, UNOFFICIAL) | I.text_of(title).rlike(UNOFFICIAL_FORMS)


def kind_of(title, number, column):
    """By question mark, number, wording, column and genre, in this order."""
    ends = F.exists(F.array(*map(F.lit, GENRES)), lambda g: F.endswith(I.text_of(title), g))
    out = F.when(title.rlike("[？?]$"), "news").when(number.isNotNull(), "substantive").when(holds_any(title, NEWS), "news")
    out = out.when(column.isin(*INTERPRETING_COLUMNS) | I.interprets(title), "interpretation")
    return out.when(column.isin(*SUBSTANTIVE_COLUMNS) | ends, "substantive").otherwise("other")


@query(f"""WITH {POLICIES} SELECT doc_id, {_sql_kind('title')} AS kind, {_sql_kind('notice')} AS notice_kind, CASE WHEN {_sql_unofficial('title')} THEN 0 ELSE 1 END AS is_official, CASE WHEN {_sql_unofficial('notice')} THEN 0 ELSE 1 END AS notice_official FROM p""")
def classified_policies(s, d):
    """Kinds of documents, of two titles each, and the gate of the official layer."""
    kinds = [kind_of(F.col(t), F.col("raw_no"), F.col("column_name")).alias(name) for t, name in (("title", "kind"), ("notice", "notice_kind"))]
    gates = [F.when(unofficial(F.col(t)), 0).otherwise(1).alias(name) for t, name in (("title", "is_official"), ("notice", "notice_official"))]
    return policies(s, d).select("doc_id", *kinds, *gates)


def first_of(x, words):
    """What the first of the words that x holds stands for, else null."""
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(m).alias("means")) for w, m in words.items()])
    return F.get(F.filter(pairs, lambda p: F.contains(I.text_of(x), p["word"])), 0)["means"]


def _sql_first(x, words):
    return "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{m}'" for w, m in words.items()) + " END"


@query(f"WITH {POLICIES} SELECT doc_id, coalesce({_sql_first('site', dict(zip(PROVINCES, PROVINCES, strict=True)))}, '全国') AS region, {_sql_first('notice', PLACES)} AS place FROM p")
def policy_regions(s, d):
    """The region of a site, that of the whole country where it names none, and of the place in a title, if any."""
    region = F.coalesce(first_of(F.col("site"), dict(zip(PROVINCES, PROVINCES, strict=True))), F.lit("全国"))
    return policies(s, d).select("doc_id", region.alias("region"), first_of(F.col("notice"), PLACES).alias("place"))


_TAX_PLACES = ("title", "keywords", "tax_policy")


@query(f"WITH {POLICIES}, r AS (SELECT region, rank FROM (SELECT unnest({[*PROVINCES, '全国']}) AS region, generate_subscripts({[*PROVINCES, '全国']}, 1) AS rank)) SELECT region, rank::INT AS rank, count(doc_id) AS n FROM r LEFT JOIN (SELECT doc_id, coalesce({_sql_first('site', dict(zip(PROVINCES, PROVINCES, strict=True)))}, '全国') AS region FROM p) USING (region) GROUP BY 1, 2")
def region_counts(s, d):
    """Documents a region in administrative order, with those that have none."""
    order = s.createDataFrame([(r, i) for i, r in enumerate([*PROVINCES, "全国"], 1)], "region string, rank int")  # the provinces
    counts = policy_regions(s, d).groupBy("region").agg(F.count("*").alias("n"))
    return F.broadcast(order).join(counts, "region", "left").select("region", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def tax_filter(tax, columns=_TAX_PLACES):
    """Documents of a tax: any of its words in any of the columns; an unknown tax filters nothing."""
    found = F.lit(tax not in TAXES)
    for c in columns:
        found = found | holds_any(F.col(c), TAXES.get(tax, ("",)))
    return found


@query(f"WITH {POLICIES} SELECT tax, n FROM ({' UNION ALL '.join(f"SELECT '{t}' AS tax, count(*) AS n FROM p WHERE {' OR '.join(_sql_any(f"coalesce({c}, '')", ws) for c in _TAX_PLACES)}" for t, ws in TAXES.items())})")
def tax_filter_counts(s, d):
    """How many documents each tax filter leaves, by title, keywords and the official tax column."""
    rows = policies(s, d).agg(*[F.count_if(tax_filter(t)).alias(t) for t in TAXES])
    return rows.select(F.explode(F.create_map(*[x for t in TAXES for x in (F.lit(t), F.col(t))])).alias("tax", "n"))


def _sql_labels(x, words, masked=None):
    hit = lambda w: f"contains(replace({x}, '{masked[0]}', ''), '{w}')" if masked and w == masked[1] else f"contains({x}, '{w}')"
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(map(hit, ws))} THEN '{k}' END" for k, ws in words.items()) + "], lambda l: l IS NOT NULL)"


@query(f"WITH {POLICIES} SELECT label, count(*) AS n FROM (SELECT unnest({_sql_labels('title', TAXES, ('土地增值税', '增值税'))}) AS label FROM p) GROUP BY 1")
def tax_label_counts(s, d):
    """Documents a tax; the longer name does not count as the shorter one within it."""
    return policies(s, d).select(F.explode(I.labels_of(F.col("title"), TAXES, ("土地增值税", "增值税"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {POLICIES} SELECT doc_id, array_to_string({_sql_labels('keywords', SUBJECTS)}, '|') AS subjects, array_to_string({_sql_labels('keywords', PREFERENCES)}, '|') AS preferences FROM p")
def policy_dimensions(s, d):
    label = lambda words: F.array_join(I.labels_of(F.col("keywords"), words), "|")
    return policies(s, d).select("doc_id", label(SUBJECTS).alias("subjects"), label(PREFERENCES).alias("preferences"))


@query(f"""WITH {POLICIES} SELECT doc_id, title, day, count(*) OVER () AS total, 4 < count(*) OVER () AS has_more FROM p WHERE NOT {_sql_unofficial('title')} AND day >= DATE '2010-01-01' AND day < DATE '2011-01-01' AND contains(title, '增值税')
AND (contains(title, '通知') OR contains(content, '通知') OR contains(keywords, '通知') OR contains(coalesce(raw_no, ''), '通知')) ORDER BY day DESC, doc_id LIMIT 3 OFFSET 1""")
def policy_search_page(s, d):
    """One page of a search over several columns, with year and tax filters in the official layer, newest first, and
    the total of the same predicate."""
    anywhere = F.concat_ws("\n", "title", "content", "keywords", "raw_no")
    hits = policies(s, d).filter(~unofficial(F.col("title")) & (F.col("day") >= F.lit("2010-01-01").cast("date")) & (F.col("day") < F.lit("2011-01-01").cast("date")) & F.contains("title", F.lit("增值税")) & F.contains(anywhere, F.lit("通知"))).select("doc_id", "title", "day")
    page = hits.orderBy(F.col("day").desc(), "doc_id").offset(1).limit(3)
    return page.crossJoin(F.broadcast(hits.agg(F.count("*").alias("total")))).select("doc_id", "title", "day", "total", (F.col("total") > 4).alias("has_more"))  # one row of totals


@query(f"""WITH {POLICIES} SELECT doc_id, {_sql_title('title')} AS title_key, regexp_replace(regexp_replace(concat(doc_id % 40, CASE WHEN doc_id % 2 = 0 THEN '、' ELSE '' END, regexp_replace(title, '{_SPACES}', '', 'g')), '^\\s*[0-9]{{1,2}}[.、,，]\\s*', ''), CASE WHEN doc_id % 2 = 1 THEN '^\\s*[0-9]{{1,2}}' ELSE '^$' END, '') AS notice FROM p WHERE title LIKE '关于%'""")
def policy_title_keys(s, d):
    """Titles in comparable form, and without a running number before them."""
    numbered = F.concat((F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 2 == 0, "、").otherwise(""), F.regexp_replace("title", " ", ""))
    rows = policies(s, d).filter(F.startswith("title", F.lit("关于")))
    return rows.select("doc_id", I.title_key(F.col("title")).alias("title_key"), I.notice_key(numbered).alias("notice"))


@query(f"""WITH {POLICIES}, j AS (SELECT rule, pos, word, unnest(['x']) FROM (VALUES ('entertainment', 0, '消费税'), ('entertainment', 1, '增值税'), ('education', 0, '无此词'), ('donation', 0, '契税')) r(rule, pos, word)),
h AS (SELECT rule, pos, doc_id, day, aging, row_number() OVER (PARTITION BY rule ORDER BY pos, day DESC, doc_id) AS nth FROM j JOIN p ON contains(title, word))
SELECT r.rule, h.doc_id, CASE WHEN h.rule IS NULL THEN 'unknown' WHEN h.aging IS NULL THEN 'unknown' WHEN h.aging = '已废止' THEN 'stale' ELSE 'ok' END AS basis FROM (SELECT DISTINCT rule FROM j) r LEFT JOIN (SELECT * FROM h WHERE nth = 1) h USING (rule)""")
def rule_basis(s, d):
    """For each rule the newest document that holds its first keyword with any hit, and whether that is still in force."""
    rules = s.createDataFrame([("entertainment", 0, "消费税"), ("entertainment", 1, "增值税"), ("education", 0, "无此词"), ("donation", 0, "契税")], "rule string, pos int, word string")
    hits = policies(s, d).join(F.broadcast(rules), F.contains("title", F.col("word")))  # four keywords
    first = first_by_key(hits.select("rule", "pos", "doc_id", "day", "aging"), ["rule"], "pos", F.col("day").desc(), "doc_id")
    basis = F.when(F.col("aging").isNull(), "unknown").when(F.col("aging") == "已废止", "stale").otherwise("ok")
    return rules.select("rule").distinct().join(first, "rule", "left").select("rule", "doc_id", basis.alias("basis"))


# Titles that state their number in different ways, and what else is known of it.
_UNNUMBERED = {
    "stated": """CASE doc_id % 7 WHEN 0 THEN concat('关于某事的财政部 国家税务总局公告20', 10 + doc_id % 15, '年第', doc_id % 900 + 1, '号') WHEN 1 THEN concat('注释 根据国家税务总局公告2021年第', doc_id % 900 + 1, '号') WHEN 2 THEN concat('关于某事的通知（财税〔20', 10 + doc_id % 15, '〕', doc_id % 900 + 1, '号）')
      WHEN 3 THEN '关于某事的通知' WHEN 4 THEN '关于2019年某事的通知' WHEN 5 THEN concat('公告2021年第', doc_id % 900 + 1, '号') END""",
    "year": "CASE WHEN doc_id % 5 = 0 THEN '2020' END",
    "nth": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '十' ELSE CAST(doc_id % 99 AS {s}) END",
    "issuer": "CASE WHEN doc_id % 2 = 0 THEN '财政部,国家税务总局' END",
}


def _sql_issuer(x):
    fits = f"NOT regexp_matches(e, '{I.TEXT_WORDS}') AND CASE WHEN regexp_matches(e, '(总局|管理局|局|部|委|院|署|厅|会|府|办公室|办公厅|中心|银行|分行)$') THEN NOT contains('{I.TEXT_CHARACTERS}', e[1]) ELSE NOT regexp_matches(e, '[{I.TEXT_CHARACTERS}]') END"
    return f"CASE WHEN len({x}) <= 2 THEN {x} ELSE coalesce(list_filter(list_transform(range(1, len({x})), lambda i: substring({x}, i::INT)), lambda e: {fits})[1], right({x}, 2)) END"


@query(rf"""WITH t AS (SELECT doc_id, {", ".join(f"{e.format(s='VARCHAR')} AS {c}" for c, e in _UNNUMBERED.items())} FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT *, coalesce(stated, '') AS z, regexp_extract(coalesce(stated, ''), '20[0-9][0-9]年第[0-9]+号') AS tail FROM t),
v AS (SELECT *, CASE WHEN tail <> '' THEN ltrim(list_last(string_split_regex(substring(z, 1, instr(z, tail) - 1), '关于|的|，|。|；|：|（|[(]|〔|[[]|《|》|:')), ' 、') ELSE '' END AS body, regexp_extract(z, '[\p{{Han}}]+〔20[0-9][0-9]〕[0-9]+号') AS bracketed FROM u),
w AS (SELECT *, CASE WHEN tail <> '' AND len(trim(body)) >= 2 AND trim(body) NOT IN ('公告', '通知', '令', '决定', '办法', '规定', '意见', '通告') THEN {_sql_issuer('trim(body)')} || tail WHEN bracketed <> '' THEN bracketed END AS in_title, coalesce(year, nullif(regexp_extract(z, '20[0-9][0-9]'), '')) AS y FROM v)
SELECT doc_id, coalesce(in_title, CASE WHEN y IS NOT NULL AND regexp_full_match(nth, '[0-9]+') THEN replace(coalesce(issuer, ''), ',', ' ') || y || '年第' || nth || '号' END) AS number,
CASE WHEN in_title IS NOT NULL THEN 'high' WHEN y IS NOT NULL AND regexp_full_match(coalesce(nth, ''), '[0-9]+') AND issuer IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM w""")
def built_numbers(s, d):
    """Numbers taken from titles or put together, with how sure they are."""
    rows = table(s, d, "documents").filter("doc_id is not null").selectExpr("doc_id", *[f"{e.format(s='STRING')} AS {c}" for c, e in _UNNUMBERED.items()])
    return rows.select("doc_id", I.built_number(*map(F.col, ("stated", "year", "nth", "issuer"))).alias("b")).select("doc_id", "b.number", "b.confidence")
