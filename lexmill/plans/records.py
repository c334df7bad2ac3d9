"""Queries over the other tables: maintenance, reviews, audits, notices, rules and runs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import identifiers as I
from lexmill.functions import text as T
from lexmill.operators import maintenance as M
from lexmill.plans.registered import query
from lexmill.plans.storage import table


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, min(l_quantity) FROM lineitem WHERE l_linenumber <= 2 AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_orderkey % 3 <> 0) GROUP BY 1, 2")
def insert_or_ignore(s, d):
    """Rows are inserted only where their key is not there yet."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return M.insert_or_ignore(rows.filter("l_orderkey % 3 != 0"), rows.filter("l_linenumber <= 2"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, o_custkey, 'old' AS origin FROM orders WHERE o_custkey % 5 <> 0 OR o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_custkey % 5 = 0 AND o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_custkey, 'old' FROM orders o WHERE o_custkey % 5 = 0 AND o_orderpriority <> '1-URGENT' AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderstatus = 'F')""")
def rebuilt_rows(s, d):
    """The rows of each rebuilt customer are replaced but for those that are kept by hand."""
    rows = table(s, d, "orders").withColumn("origin", F.lit("old"))
    new = rows.filter("o_custkey % 5 = 0 and o_orderstatus = 'F'").withColumn("origin", F.lit("new"))
    return M.rebuild(rows, new, "o_custkey", F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey", "origin")


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT 'orders' AS table_name, count(*) AS n_left FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)""")
def cascade_delete(s, d):
    orders, items = table(s, d, "orders"), table(s, d, "lineitem")
    left = M.cascade_delete(orders.filter("o_orderstatus = 'P'"), "o_orderkey", {"orders": (orders, "o_orderkey"), "lineitem": (items, "l_orderkey")})
    count = lambda name: left[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("n_left")).select("table_name", "n_left")
    return count("orders").unionByName(count("lineitem"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_acctbal > 0 THEN upper(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def partial_upsert(s, d):
    """Only allowed columns that the new rows have, and only where they are not null."""
    old = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.filter("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.upper("c_mktsegment")).alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return M.partial_upsert(old, new, "c_custkey", ["c_mktsegment", "c_comment"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 11 = 0 THEN 'changed' END AS difference FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0 UNION ALL SELECT -1 - p_partkey, 'extra' FROM part WHERE p_partkey % 13 = 0")
def copy_differences(s, d):
    """Rows that a copy lacks, has besides, or has otherwise, by digests of rows."""
    rows = table(s, d, "part").select("p_partkey", "p_name", "p_size")
    copy = rows.filter("p_partkey % 7 != 0").withColumn("p_name", F.when(F.col("p_partkey") % 11 == 0, None).otherwise(F.col("p_name")))
    return M.copy_differences(rows, copy.unionByName(rows.filter("p_partkey % 13 = 0").withColumn("p_partkey", -1 - F.col("p_partkey"))), "p_partkey")


@query(r"SELECT count(*) AS n_rows, CAST(sum(CAST(concat('0x', substring(md5(concat_ws('|', coalesce(n_nationkey::VARCHAR, '\N'), coalesce(n_name, '\N'), coalesce(n_regionkey::VARCHAR, '\N'))), 1, 8)) AS BIGINT)) AS BIGINT) AS digest FROM nation")
def table_digest(s, d):
    return M.table_digest(table(s, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query("""SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('signup', 'purchase') THEN 'pending' ELSE 'other' END AS mode, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1""")
def pending_work(s, d):
    """What each of three modes of work would take up: failed ones, pending ones, all others."""
    kind = F.when(F.startswith("event_type", F.lit("err")), "failed").when(F.col("event_type").isin("signup", "purchase"), "pending").otherwise("other")
    return table(s, d, "events").groupBy(kind.alias("mode")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog') OR contains(lower(url), 'token') OR contains(lower(url), 'secret') OR url IS NULL")
def denylist_hits(s, d):
    """Addresses that hold any word of a list."""
    words = F.array(*[F.lit(w) for w in ("blog", "token", "secret")])
    return table(s, d, "pages").filter(F.exists(words, lambda w: F.contains(F.lower("url"), w)) | F.col("url").isNull()).select("page_id", "url")


@query("""SELECT q.conv_id, q.turn, CASE WHEN a.text IS NULL THEN 'missing' WHEN len(a.text) < len(q.text) THEN 'stale' ELSE 'fresh' END AS state
FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""")
def answer_states(s, d):
    """Questions with the answer of the next turn, by a join of three keys one of which is a constant."""
    rows = table(s, d, "conversations")
    answers = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    state = F.when(F.col("answer").isNull(), "missing").when(F.length("answer") < F.length("text"), "stale").otherwise("fresh")
    return rows.filter("role = 'user'").join(answers, ["conv_id", "turn"], "left").select("conv_id", "turn", state.alias("state"))


@query("""SELECT doc_id, CASE WHEN bool_or(kind = 'toxic') THEN 'toxic' ELSE 'quality' END AS flag, count(*) AS n FROM (SELECT doc_id, 'toxic' AS kind FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'quality' FROM labels WHERE quality = 0) GROUP BY doc_id""")
def merged_flags(s, d):
    """Two lists of flags as one row a document, the graver flag first."""
    labels = table(s, d, "labels")
    both = labels.filter("toxic = 1").select("doc_id", F.lit(0).alias("rank"), F.lit("toxic").alias("flag")).unionByName(labels.filter("quality = 0").select("doc_id", F.lit(1).alias("rank"), F.lit("quality").alias("flag")))
    return both.groupBy("doc_id").agg(F.min_by("flag", "rank").alias("flag"), F.count("*").alias("n"))


@query("SELECT r_name, segment, concat(r_name, ':', segment) AS task FROM region, (SELECT DISTINCT c_mktsegment AS segment FROM customer)")
def keyword_tasks(s, d):
    """A task for each region and keyword; both lists are those of a configuration."""
    words = table(s, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return table(s, d, "region").select("r_name").join(words, F.lit(True)).select("r_name", "segment", F.concat_ws(":", "r_name", "segment").alias("task"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def listed_counts(s, d):
    """Counts of many keys in one pass."""
    keys = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(s, d, "lineitem").join(keys, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT w.first_day::DATE AS first_day, (w.first_day + INTERVAL 6 DAYS)::DATE AS last_day, count(event_id) AS n FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 7 DAYS)) AS first_day) w LEFT JOIN events ON ts::DATE BETWEEN w.first_day AND w.first_day + INTERVAL 6 DAYS GROUP BY 1, 2")
def date_windows(s, d):
    """Windows of seven days, empty ones too, with their events."""
    week = s.range(1).select(F.explode(F.expr("sequence(date'2023-12-25', date'2024-02-05', interval 7 days)")).alias("first_day"))
    days = table(s, d, "events").select(F.date_add(F.lit("2023-12-25").cast("date"), (F.floor(F.datediff(F.to_date("ts"), F.lit("2023-12-25").cast("date")) / 7) * 7).cast("int")).alias("first_day")).groupBy("first_day").agg(F.count("*").alias("n"))
    return week.join(days, "first_day", "left").select("first_day", F.date_add("first_day", 6).alias("last_day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT day, fetched, added + updated + skipped AS accounted, fetched = added + updated + skipped AS holds FROM (SELECT ts::DATE AS day, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'signup') AS added,
count(*) FILTER (WHERE event_type = 'purchase') AS updated, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS skipped FROM events GROUP BY 1)""")
def run_accounts(s, d):
    """Whether what a day's run fetched is what it added, updated and skipped."""
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    rows = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("fetched"), (n("signup") + n("purchase") + n("view", "click")).alias("accounted"))
    return rows.withColumn("holds", F.col("fetched") == F.col("accounted"))


@query("""SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error')::DATE AS last_ok, count(*) FILTER (WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-24') AS bad_in_week,
arg_max(event_id, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'error') AS last_bad FROM events GROUP BY 1""")
def run_health(s, d):
    bad = F.col("event_type") == "error"
    recent = bad & (F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"))
    return table(s, d, "events").groupBy("user_id").agg(
        F.to_date(F.max(F.when(~bad, F.col("ts")))).alias("last_ok"), F.count_if(recent).alias("bad_in_week"), F.max(F.when(bad, F.struct("ts", "event_id")))["event_id"].alias("last_bad")
    )


_SQL_ISSUES = "CASE WHEN len({0}) < 20 THEN 1 ELSE 0 END + CASE WHEN regexp_matches({0}, '[.!?…]\\s*$') THEN 0 ELSE 1 END + CASE WHEN contains(lower({0}), 'as an') THEN 1 ELSE 0 END"
_SQL_NUMBERS = "list_distinct(regexp_extract_all({0}, '[0-9]+'))"


@query(f"""WITH t AS (SELECT a.conv_id, a.turn, a.text AS before, b.text AS after FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 WHERE a.text IS NOT NULL AND b.text IS NOT NULL)
SELECT conv_id, turn, ({_SQL_ISSUES.format('after')}) <= ({_SQL_ISSUES.format('before')}) AS no_worse, len(after) >= 0.3 * len(before) AND (len({_SQL_NUMBERS.format('before')}) = 0 OR len(list_intersect({_SQL_NUMBERS.format('before')}, {_SQL_NUMBERS.format('after')})) >= 0.7 * len({_SQL_NUMBERS.format('before')})) AS guarded FROM t""")
def rewrites_accepted(s, d):
    """A rewrite (here: the turn after next) is taken if it has no more issues, and enough of the length and numbers."""
    rows = table(s, d, "conversations").filter("text is not null")
    both = rows.select("conv_id", "turn", F.col("text").alias("before")).join(rows.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("after")), ["conv_id", "turn"])
    issues = lambda c: (F.length(c) < 20).cast("int") + (~F.col(c).rlike(r"[.!?…]\s*$")).cast("int") + F.contains(F.lower(c), F.lit("as an")).cast("int")
    numbers = lambda c: F.array_distinct(I.every(F.col(c), "[0-9]+"))
    kept = (F.size(numbers("before")) == 0) | (F.size(F.array_intersect(numbers("before"), numbers("after"))) >= 0.7 * F.size(numbers("before")))
    return both.select("conv_id", "turn", (issues("after") <= issues("before")).alias("no_worse"), ((F.length("after") >= 0.3 * F.length("before")) & kept).alias("guarded"))


@query("""SELECT human, machine, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN quality = 1 THEN 'ok' ELSE 'issue' END AS human, CASE WHEN n_chars < 200 THEN 'unsure' WHEN contains(text, 'Copyright') THEN 'issue' ELSE 'ok' END AS machine FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY ALL""")
def reviews_compared(s, d):
    """Human against machine verdicts, what nobody has reviewed included."""
    rows = table(s, d, "documents").join(table(s, d, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    human = F.when(F.col("seen").isNull(), "unreviewed").when(F.col("quality") == 1, "ok").otherwise("issue")
    machine = F.when(F.col("n_chars") < 200, "unsure").when(F.contains("text", F.lit("Copyright")), "issue").otherwise("ok")
    return rows.groupBy(human.alias("human"), machine.alias("machine")).agg(F.count("*").alias("n"))


_VERDICT = "concat(CASE doc_id % 5 WHEN 0 THEN 'OK' WHEN 1 THEN ' issue: ' WHEN 2 THEN 'Unsure' WHEN 3 THEN 'okay, fine' ELSE 'problem?' END, ' ', coalesce(toxic, 0))"


@query(f"SELECT doc_id, CASE WHEN v LIKE 'ok%' THEN 'ok' WHEN v LIKE 'issue%' THEN 'issue' ELSE 'unsure' END AS verdict FROM (SELECT doc_id, lower(trim({_VERDICT})) AS v FROM labels)")
def parsed_verdicts(s, d):
    """Verdicts from free wording; what is not understood is unsure."""
    v = F.lower(F.trim(F.expr(_VERDICT)))
    return table(s, d, "labels").select("doc_id", F.when(F.startswith(v, F.lit("ok")), "ok").when(F.startswith(v, F.lit("issue")), "issue").otherwise("unsure").alias("verdict"))


_NOTICE = "concat(CASE WHEN p_partkey % 3 = 0 THEN concat(p_partkey % 90, '、') WHEN p_partkey % 3 = 1 THEN '2026年' ELSE '' END, CASE p_size % 5 WHEN 0 THEN '国家税务总局某局食堂采购' WHEN 1 THEN '企业所得税汇算清缴服务' WHEN 2 THEN '发票打印设备' WHEN 3 THEN '税收风险检查' ELSE CASE p_partkey % 4 WHEN 0 THEN 'TAX 复核' WHEN 1 THEN '国家税务局税务争议' WHEN 2 THEN '契税宣讲' ELSE '办公家具咨询' END END, p_brand)"
# Agencies whose names hold such words, words that suffice, and words that need a kind of service beside them.
AGENCIES = "国家税务总局|国家税务局|税务局|税务部门|税务机关|税务系统"
STRONG = (
    "税务咨询", "税务代理", "税务服务", "涉税服务", "涉税鉴证", "涉税专业服务", "汇算清缴", "税务师", "税务筹划", "税收筹划", "转让定价", "税务尽调", "税务检查", "税务稽查", "税务争议", "税务合规", "税收风险", "税收优惠", "税务顾问", "税务外包", "税审",
)
WEAK = ("税务", "涉税", "纳税", "税收", "发票", "关税", "增值税", "企业所得税", "个人所得税", "土地增值税", "契税", "印花税", "房产税", "消费税", "tax")
SERVICE = ("服务", "咨询", "代理", "鉴证", "审计", "筹划", "顾问", "外包", "委托", "尽调", "检查", "评估", "复核", "培训", "宣讲")
_HOLDS = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query(f"""SELECT p_partkey, {_HOLDS('raw', STRONG)} OR ({_HOLDS('lower(bare)', WEAK)} AND {_HOLDS('bare', SERVICE)}) AS relevant FROM (SELECT p_partkey, lower({_NOTICE}) AS raw, regexp_replace({_NOTICE}, '{AGENCIES}', ' ', 'g') AS bare FROM part)""")
def relevant_notices(s, d):
    """Notices on tax services: a word that suffices, wherever it stands; else a weaker one beside a kind of service, agencies'
    names left out."""
    return table(s, d, "part").select("p_partkey", relevant(F.expr(_NOTICE)).alias("relevant"))


def relevant(title):
    bare = F.regexp_replace(I.text_of(title), AGENCIES, " ")
    any_of = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))
    return any_of(F.lower(I.text_of(title)), STRONG) | (any_of(F.lower(bare), WEAK) & any_of(bare, SERVICE))


@query(f"""WITH n AS (SELECT p_partkey, p_type, {_NOTICE} AS title FROM part), k AS (SELECT *, regexp_replace(CASE WHEN title LIKE '2026%' THEN title ELSE regexp_replace(title, '^\\s*[0-9]{{1,2}}[.、,，]?\\s*', '') END, '\\s+', '', 'g') AS key FROM n),
a AS (SELECT *, min(p_partkey) OVER (PARTITION BY title, p_type) AS same, min(p_partkey) OVER (PARTITION BY key, p_type) AS alike FROM k)
SELECT p_partkey, CASE WHEN same < p_partkey THEN same WHEN alike < p_partkey THEN alike END AS duplicate_of, CASE WHEN same < p_partkey THEN 'exact' WHEN alike < p_partkey THEN 'normalised' ELSE 'first' END AS stage FROM a""")
def duplicate_notices(s, d):
    """Notices by exact title and buyer, then by title without running numbers."""
    rows = table(s, d, "part").select("p_partkey", "p_type", F.expr(_NOTICE).alias("title")).withColumn("key", I.notice_key(F.col("title")))
    first = lambda c: F.min("p_partkey").over(Window.partitionBy(c, "p_type"))
    rows = rows.withColumn("same", first("title")).withColumn("alike", first("key"))
    stage = lambda a, b, c: F.when(F.col("same") < F.col("p_partkey"), a).when(F.col("alike") < F.col("p_partkey"), b).otherwise(c)
    return rows.select("p_partkey", stage(F.col("same"), F.col("alike"), None).alias("duplicate_of"), stage("exact", "normalised", "first").alias("stage"))


_CONTACT = "concat('采购人：', s_name, '。联系电话：0', 10 + s_suppkey % 80, '-', 60000000 + s_suppkey, '；预算 ', 1000 + s_suppkey % 100, ',000.50 元，地址 https://', lower(CASE s_nationkey % 3 WHEN 0 THEN 'Trade' WHEN 1 THEN 'Bid' ELSE 'Other' END), '.example.com/n/', s_suppkey)"


@query(rf"""SELECT s_suppkey, nullif(regexp_extract(t, '采购人[:：]\s*([^。；，\s]+)', 1), '') AS buyer, nullif(regexp_extract(t, '(0[0-9]{{2,3}}-[0-9]{{7,8}})', 1), '') AS phone, CASE regexp_extract(t, 'https://([^/]+)', 1) WHEN 'trade.example.com' THEN 'trade centre' WHEN 'bid.example.com' THEN 'bid service' ELSE 'unknown' END AS platform,
CAST(replace(regexp_extract(t, '([0-9][0-9,]*\.[0-9]+)\s*元', 1), ',', '') AS DECIMAL(16,2)) AS budget FROM (SELECT s_suppkey, {_CONTACT} AS t FROM supplier)""")
def notice_contacts(s, d):
    """Buyer, telephone, budget and platform of a notice's text."""
    t = F.expr(_CONTACT)
    grab = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    host = F.parse_url(F.concat(F.lit("https://"), F.regexp_extract(t, r"https://(\S+)", 1)), F.lit("HOST"))
    names = F.create_map(F.lit("trade.example.com"), F.lit("trade centre"), F.lit("bid.example.com"), F.lit("bid service"))
    return table(s, d, "supplier").select("s_suppkey", grab(r"采购人[:：]\s*([^。；，\s]+)").alias("buyer"), grab(r"(0[0-9]{2,3}-[0-9]{7,8})").alias("phone"), F.coalesce(F.try_element_at(names, host), F.lit("unknown")).alias("platform"), T.money(t).alias("budget"))


@query(r"""SELECT doc_id, len(line) AS n_line, CASE WHEN regexp_matches(line, '(\.|!|\?)$') THEN 1 ELSE 0 END AS ends, trim(regexp_replace(regexp_replace(regexp_replace(line, '^\[[^\]]*\]', ''), '^[0-9]{4}-[0-9]{2}-[0-9]{2}\s*', ''), '\s+', ' ', 'g')) AS cleaned
FROM (SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN '[news]' ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN '2024-05-06 ' ELSE '' END, regexp_extract(coalesce(text, ''), '^\s*([^\n]*)', 1)) AS line FROM documents)""")
def cleaned_titles(s, d):
    """Titles of list pages without a bracketed label, a leading date and doubled space."""
    line = F.concat(F.when(F.col("doc_id") % 3 == 0, "[news]").otherwise(""), F.when(F.col("doc_id") % 2 == 0, "2024-05-06 ").otherwise(""), F.regexp_extract(I.text_of(F.col("text")), r"^\s*([^\n]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(line, r"^\[[^\]]*\]", ""), r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\s*", "")
    return table(s, d, "documents").select("doc_id", F.length(line).alias("n_line"), line.rlike(r"(\.|!|\?)$").cast("int").alias("ends"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("cleaned"))


@query(r"""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, least(5, greatest(0, try_cast(json_extract_string(props, '$.k') AS INT))) AS score, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS written FROM events""")
def json_rows(s, d):
    """Fields read leniently and clamped, and rows written as JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(s, d, "events").select("event_id", k.alias("k"), F.least(F.lit(5), F.greatest(F.lit(0), k)).alias("score"), F.to_json(F.struct("event_type", "user_id")).alias("written"))


# Item, kind, base of the cap, ratio, special ratio, whether the excess is carried forward.
RULES = [
    ("entertainment", "cap", "revenue", 0.005, 0.6, False), ("advertising", "cap", "revenue", 0.15, None, True), ("welfare", "cap", "wages", 0.14, None, False), ("education", "cap", "wages", 0.08, None, True),
    ("union", "cap", "wages", 0.02, None, False), ("donation", "cap", "profit", 0.12, None, True), ("fines", "disallow", None, None, None, False), ("provisions", "disallow", None, None, None, False), ("rd_expense", "credit", None, 1.0, None, False),
]
_SQL_RULES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + f", {i})" for i, r in enumerate(RULES))


@query(f"""WITH b AS (SELECT o_custkey, sum(o_totalprice) AS revenue, sum(o_totalprice) * 0.2 AS wages, max(o_totalprice) AS profit, min(o_totalprice) AS least_one FROM orders GROUP BY 1),
x AS (SELECT o_custkey, item, kind, carried, CASE WHEN (o_custkey + pos) % 4 = 0 THEN 0 ELSE least_one * (pos + 1) / 10 END AS book, CASE base WHEN 'revenue' THEN revenue WHEN 'wages' THEN wages ELSE profit END * ratio AS cap, special FROM b, (VALUES {_SQL_RULES}) r(item, kind, base, ratio, special, carried, pos)),
y AS (SELECT *, CASE WHEN special IS NULL THEN cap ELSE least(special * book, cap) END AS allowed FROM x WHERE book <> 0)
SELECT o_custkey, item, round(CASE kind WHEN 'cap' THEN greatest(book - allowed, 0) WHEN 'disallow' THEN book ELSE 0 END, 5) AS increase, round(CASE WHEN kind = 'credit' THEN book ELSE 0 END, 5) AS decrease, round(CASE WHEN kind = 'cap' AND carried THEN greatest(book - allowed, 0) ELSE 0 END, 5) AS carry FROM y""")
def tax_adjustments(s, d):
    """Nine rules of three kinds: caps (one with a second limit), what is not deductible, and what is deducted twice."""
    base = table(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("revenue"), (F.sum("o_totalprice") * 0.2).alias("wages"), F.max("o_totalprice").alias("profit"), F.min("o_totalprice").alias("least_one"))
    rules = s.createDataFrame([(*r, i) for i, r in enumerate(RULES)], "item string, kind string, base string, ratio double, special double, carried boolean, pos int")
    book = F.when((F.col("o_custkey") + F.col("pos")) % 4 == 0, 0).otherwise(F.col("least_one") * (F.col("pos") + 1) / 10)
    rows = base.crossJoin(F.broadcast(rules)).withColumn("book", book).filter("book != 0")  # nine rules
    cap = F.when(F.col("base") == "revenue", F.col("revenue")).when(F.col("base") == "wages", F.col("wages")).otherwise(F.col("profit")) * F.col("ratio")
    over = F.greatest(F.col("book") - F.when(F.col("special").isNull(), cap).otherwise(F.least(F.col("special") * F.col("book"), cap)), F.lit(0.0))
    kind = F.col("kind")
    return rows.select(
        "o_custkey", "item", F.round(F.when(kind == "cap", over).when(kind == "disallow", F.col("book")).otherwise(0.0), 5).alias("increase"),
        F.round(F.when(kind == "credit", F.col("book")).otherwise(0.0), 5).alias("decrease"), F.round(F.when((kind == "cap") & F.col("carried"), over).otherwise(0.0), 5).alias("carry"),
    )


@query("""SELECT label, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS nth FROM (SELECT e.label, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q)) WHERE nth = 1 ORDER BY similarity DESC, label LIMIT 10""")
def best_chunks(s, d):
    """The ten groups of the nearest vectors, each by its best vector; the limit is the feature."""
    rows = table(s, d, "embeddings")
    query_row = rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    scored = rows.crossJoin(F.broadcast(query_row)).select("label", "vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))  # one row
    best = scored.groupBy("label").agg(F.max(F.struct("similarity", (-F.col("vec_id")).alias("v"))).alias("b"))
    return best.select("label", (-F.col("b.v")).alias("vec_id"), "b.similarity").orderBy(F.col("similarity").desc(), "label").limit(10)


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'current' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def stale_index(s, d):
    """What an index must take up: documents that it lacks, and those whose hash is another than it holds."""
    docs = table(s, d, "documents").select("doc_id", F.left(T.content_hash("text"), F.lit(32)).alias("hash"))
    held = table(s, d, "labels").select("doc_id").join(docs, "doc_id").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("hash")).alias("held"))
    return docs.join(held, "doc_id", "left").select("doc_id", F.when(F.col("held").isNull(), "new").when(F.col("held") != F.col("hash"), "stale").otherwise("current").alias("state"))


@query("""SELECT item, lang, round(sum(part), 6) AS score FROM (SELECT item, lang, 1.0 / (60 + row_number() OVER (PARTITION BY item ORDER BY hits DESC, doc_id)) AS part, row_number() OVER (PARTITION BY item ORDER BY hits DESC, doc_id) AS nth FROM (SELECT doc_id, lang, item, len(text) - len(replace(text, item, '')) AS hits FROM documents, (VALUES ('the'), ('der'), ('que')) q(item)) WHERE hits > 0) WHERE nth <= 20 GROUP BY 1, 2""")
def damped_top(s, d):
    """The first 20 of each query, damped by rank and summed up by language; the limit is the feature."""
    queries = F.explode(F.array(*[F.lit(w) for w in ("the", "der", "que")]))
    rows = table(s, d, "documents").filter("text is not null").select("doc_id", "lang", "text", queries.alias("item"))
    hits = rows.select("doc_id", "lang", "item", (F.length("text") - F.length(F.replace("text", F.col("item"), F.lit("")))).alias("hits")).filter("hits > 0")
    top = hits.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.col("hits").desc(), "doc_id"))).filter("nth <= 20")
    return top.groupBy("item", "lang").agg(F.round(F.sum(1 / (60 + F.col("nth"))), 6).alias("score"))


# Words of a query and the terms that stand for them; short ones count as whole words only.
GLOSSARY = [("value-added tax", "增值税"), ("corporate income tax", "企业所得税"), ("stamp duty", "印花税"), ("vat", "增值税"), ("cit", "企业所得税")]
_QUERY = "concat(CASE p_size % 6 WHEN 0 THEN 'Value-Added Tax' WHEN 1 THEN 'VAT' WHEN 2 THEN 'private city' WHEN 3 THEN 'CIT and stamp duty' WHEN 4 THEN 'quantum flux' ELSE 'corporate income tax' END, ' 优惠 ', p_brand)"


def _sql_rewrite(x):
    for word, term in GLOSSARY:
        x = f"regexp_replace({x}, '(^|[^a-z0-9]){word}($|[^a-z0-9])', '\\1{term}\\2', 'g')" if len(word) <= 4 else f"replace({x}, '{word}', '{term}')"
    return x


@query(f"SELECT p_partkey, q AS rewritten, q <> raw AS changed FROM (SELECT p_partkey, lower({_QUERY}) AS raw, {_sql_rewrite(f'lower({_QUERY})')} AS q FROM part)")
def rewritten_queries(s, d):
    """Queries with the words of a glossary replaced, longer words first; what it does not know stays."""
    raw = F.lower(F.expr(_QUERY))
    out = raw
    for word, term in GLOSSARY:
        out = F.regexp_replace(out, f"(^|[^a-z0-9]){word}($|[^a-z0-9])", f"$1{term}$2") if len(word) <= 4 else F.replace(out, F.lit(word), F.lit(term))
    return table(s, d, "part").select("p_partkey", out.alias("rewritten"), (out != raw).alias("changed"))


_BODY = "concat('首页 > 正文 字体：大 中 小', chr(10), '打印本页', chr(10), chr(10), chr(10), '税 务 总 局 公告 第 ', s_suppkey, ' 号', chr(10), 'A Ministry of Finance and the State Taxation Administration notice: an notice of a order', chr(10), s_name)"


@query(rf"""SELECT s_suppkey, regexp_replace(regexp_replace(t, '首页 > 正文|字体：大 中 小|打印本页', '', 'g'), '\n\s*\n+', chr(10), 'g') AS body, regexp_replace(regexp_replace(t, '([一-龥])[ ]+([一-龥])', '\1\2', 'g'), '([一-龥])[ ]+([一-龥])', '\1\2', 'g') AS tight,
regexp_replace(regexp_replace(replace(t, 'Ministry of Finance and the State Taxation Administration', 'State Taxation Administration and the Ministry of Finance'), '\ban ([bcdfghjklmnpqrstvwxyz])', 'a \1', 'g'), '\ba ([aeiou])', 'an \1', 'g') AS fixed FROM (SELECT s_suppkey, {_BODY} AS t FROM supplier)""")
def tidied_bodies(s, d):
    """Texts without a page's own strings and blank lines, without space between Han characters, with names in the usual
    order and articles that fit."""
    t = F.expr(_BODY)
    body = F.regexp_replace(F.regexp_replace(t, "首页 > 正文|字体：大 中 小|打印本页", ""), r"\n\s*\n+", "\n")
    named = F.replace(t, F.lit("Ministry of Finance and the State Taxation Administration"), F.lit("State Taxation Administration and the Ministry of Finance"))
    fixed = F.regexp_replace(F.regexp_replace(named, r"\ban ([bcdfghjklmnpqrstvwxyz])", "a $1"), r"\ba ([aeiou])", "an $1")
    return table(s, d, "supplier").select("s_suppkey", body.alias("body"), F.regexp_replace(t, "(?<=[一-龥]) +(?=[一-龥])", "").alias("tight"), fixed.alias("fixed"))


@query("SELECT doc_id, substring(text, greatest(spot - 40, 1), 160) AS summary FROM (SELECT doc_id, text, coalesce(least(nullif(instr(text, 'tion'), 0), nullif(instr(text, 'heit'), 0)), 1) AS spot FROM documents WHERE text IS NOT NULL)")
def summaries(s, d):
    """160 characters from 40 before the first keyword, or the head."""
    spot = lambda w: F.nullif(F.instr("text", F.lit(w)), F.lit(0))
    at = F.coalesce(F.least(spot("tion"), spot("heit")), F.lit(1))
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.substring(F.col("text"), F.greatest(at - 40, F.lit(1)), F.lit(160)).alias("summary"))


@query(r"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(event_type, '|x') ELSE event_type END AS items FROM events""")
def json_lists(s, d):
    """A list from a JSON array, with a fence and a trailing comma around it, or from a single value; empty items go."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('```json\n["'), "event_type", F.lit('", "", "x",]\n```'))).otherwise(F.col("event_type"))
    bare = F.regexp_replace(F.regexp_replace(raw, r"^```[a-z]*\s*|\s*```$", ""), r",\s*\]", "]")
    items = F.filter(F.coalesce(F.from_json(bare, "array<string>"), F.array(bare)), lambda x: x != "")
    return table(s, d, "events").select("event_id", F.array_join(items, "|").alias("items"))


@query()
def split_pieces(s, d):
    """Texts cut into pieces of at most 1,200 characters at paragraphs, at sentences or, failing both, anywhere."""
    return table(s, d, "documents").select("doc_id", F.posexplode(T.split_pieces(F.col("text"), 1200)).alias("nth", "piece"))
