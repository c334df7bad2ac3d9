"""The registered queries, each beside the SQL that gives the same result in DuckDB."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import documents as D
from lexmill.operators.fuzzy import fuzzy_match
from lexmill.plans.registered import ORACLES, QUERIES, query  # noqa: F401
from lexmill.plans.storage import table
from lexmill.streaming import events as E

_TITLE = r"regexp_extract(coalesce(text, ''), '^\s*([^\n]*)', 1)"


@query(rf"""
SELECT doc_id, lang, CASE WHEN contains(lower({_TITLE}), 'the') THEN 1 ELSE 0 END AS title_hit, n_chars,
  CASE WHEN greatest(hit - 100, 1) > 1 THEN '…' ELSE '' END || substring(flat, greatest(hit - 100, 1), 260) || CASE WHEN greatest(hit - 100, 1) + 260 <= len(flat) THEN '…' ELSE '' END AS snippet
FROM (SELECT *, replace(text, chr(10), ' ') AS flat, least(nullif(instr(lower(replace(text, chr(10), ' ')), 'the'), 0), nullif(instr(lower(replace(text, chr(10), ' ')), 'tion'), 0)) AS hit
  FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')) ORDER BY title_hit DESC, n_chars DESC NULLS LAST, doc_id LIMIT 10""")
def search_and_terms(s, d):
    return D.search(table(s, d, "documents"), ["the", "tion"])


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND coalesce(source, 'src0') = 'src0' AND n_chars BETWEEN 500 AND 5000")
def search_filters_only(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.filter((F.col("lang") == "en") & (F.coalesce("source", F.lit("src0")) == "src0") & F.col("n_chars").between(500, 5000))


@query("""
SELECT doc_id, CASE WHEN hit IS NULL THEN substring(flat, 1, 260) ELSE CASE WHEN greatest(hit - 100, 1) > 1 THEN '…' ELSE '' END || substring(flat, greatest(hit - 100, 1), 260)
  || CASE WHEN greatest(hit - 100, 1) + 260 <= len(flat) THEN '…' ELSE '' END END AS snippet
FROM (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS flat, nullif(instr(lower(replace(coalesce(text, ''), chr(10), ' ')), 'license'), 0) AS hit FROM documents)""")
def search_snippet(s, d):
    return table(s, d, "documents").select("doc_id", T.snippet(F.col("text"), ["license"]).alias("snippet"))


_OCC = "(len(lower({c})) - len(replace(lower({c}), '{t}', ''))) / {n}"


def _bm25_sql() -> str:
    terms = ["license", "ation"]
    tf = [" + ".join(f"{w} * ({_OCC.format(c=c, t=t, n=len(t))})" for c, w in (("title", 12.0), ("body", 1.0))) for t in terms]
    part = "greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))"
    return f"""
WITH b AS (SELECT doc_id, {_TITLE} AS title, coalesce(text, '') AS body FROM documents),
t AS (SELECT doc_id, len(title) + len(body) AS size, {", ".join(f"{x} AS tf{i}" for i, x in enumerate(tf))} FROM b),
g AS (SELECT count(*) AS n, avg(size) AS mean, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(2))} FROM t)
SELECT doc_id, round({" + ".join(part.format(i=i) for i in range(2))}, 6) AS score FROM t, g WHERE tf0 + tf1 > 0"""


@query(_bm25_sql())
def search_bm25(s, d):
    return D.bm25(table(s, d, "documents"), ["license", "ation"]).withColumn("score", F.round("score", 6))


@query("""SELECT coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty, min(n_chars) AS least, max(n_chars) AS most,
count(DISTINCT text) AS texts FROM documents GROUP BY 1, 2""")
def facet_overview(s, d):
    """Counts of each language and source; distinct texts by 128 bits of hash, so no text is shuffled."""
    docs = table(s, d, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"))
    text = F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))
    return docs.agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.countDistinct(text).alias("texts"))


@query("""SELECT label, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN contains(lower(text), 'license') THEN 'license' END, CASE WHEN contains(text, '@') THEN 'address' END,
CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN contains(text, '!!') THEN 'shout' END], lambda x: x IS NOT NULL)) AS label FROM documents) GROUP BY label""")
def multi_label_counts(s, d):
    rules = {"license": F.contains(F.lower("text"), F.lit("license")), "address": F.contains("text", F.lit("@")), "table": F.contains("text", F.lit(" | ")), "shout": F.contains("text", F.lit("!!"))}
    labels = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return table(s, d, "documents").select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 0 WHEN p_type LIKE '%STEEL%' THEN 1 WHEN p_size > 25 THEN 2 ELSE 9 END AS tier FROM part ORDER BY tier, p_retailprice DESC, p_partkey LIMIT 50""")
def substantive_rank(s, d):
    tier = F.when(F.contains("p_type", F.lit("BRASS")), 0).when(F.contains("p_type", F.lit("STEEL")), 1).when(F.col("p_size") > 25, 2).otherwise(9).alias("tier")
    return table(s, d, "part").select("p_partkey", tier, "p_retailprice").orderBy("tier", F.col("p_retailprice").desc(), "p_partkey").limit(50).drop("p_retailprice")


@query("""SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q
ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 10""")
def vector_topk(s, d):
    v = table(s, d, "embeddings")
    q = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    near = v.crossJoin(F.broadcast(q)).select("vec_id", T.cosine(F.col("embedding"), F.col("q")).alias("x"))  # one query row
    return near.orderBy(F.col("x").desc(), "vec_id").limit(10).select("vec_id", F.round("x", 5).alias("similarity"))


@query("""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents WHERE contains(lower(text), 'tion') ORDER BY rank LIMIT 200),
q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings e, q ORDER BY rank LIMIT 200)
SELECT id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def rrf_hybrid(s, d):
    docs = table(s, d, "documents").filter(T.all_terms(F.col("text"), ["tion"])).select(F.col("doc_id").alias("id"), "n_chars").orderBy(F.col("n_chars").desc_nulls_last(), "id").limit(200)
    a = docs.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_chars").desc_nulls_last(), "id"))).select("id", "rank")
    v = table(s, d, "embeddings")
    q = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    near = v.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("id"), T.cosine(F.col("embedding"), F.col("q")).alias("x")).orderBy(F.col("x").desc(), "id").limit(200)
    b = near.withColumn("rank", F.row_number().over(Window.orderBy(F.col("x").desc(), "id"))).select("id", "rank")
    return D.fuse([a, b], "id").withColumn("score", F.round("score", 8))


@query("""SELECT c_custkey, regexp_replace(translate(c_name, '〔〕（）【】()', '[][][][]'), '\\s+', '', 'g') AS plain FROM customer WHERE contains(lower(regexp_replace(c_name, '\\s+', '', 'g')), 'customer#00000001')""".replace("\\\\", "\\"))
def lookup_normalized(s, d):
    plain = T.plain_identifier(F.col("c_name"))
    return table(s, d, "customer").select("c_custkey", plain.alias("plain")).filter(F.contains(F.lower("plain"), F.lit("customer#00000001")))


@query("""SELECT o.o_orderkey, coalesce(n, 0) AS n_lines, coalesce(returned, 0) AS n_returned, round(coalesce(value, 0), 2)::DOUBLE AS value FROM orders o LEFT JOIN
(SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))) AS value FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def dossier_counts(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", zero("n").alias("n_lines"), zero("r").alias("n_returned"), F.round(zero("v"), 2).cast("double").alias("value"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(o_orderdate)::DATE AS last_day FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def usage_summary(s, d):
    used = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"), F.max("o_orderdate").alias("l"))
    joined = table(s, d, "customer").select("c_custkey").join(used, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0)), 2).alias("total"), F.to_date("l").alias("last_day"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def untranslated_anti(s, d):
    return table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def stale_semi(s, d):
    return table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_semi")


@query("""SELECT md5(coalesce(text, '')) AS title_key, lang, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def null_safe_dup(s, d):
    """Rows with equal text and null-safe equal language: group statistics stand for the pairs."""
    rows = table(s, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("title_key"), "lang")
    return rows.groupBy("title_key", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query("""WITH t AS (SELECT p_partkey, p_name FROM part UNION ALL SELECT -1 - p_partkey, concat(p_name, ', with all its annexes') FROM part WHERE p_partkey % 10 = 0)
SELECT a.p_partkey AS short_key, count(*) AS n_longer FROM t a JOIN t b ON starts_with(b.p_name, a.p_name) AND len(b.p_name) > len(a.p_name) AND len(a.p_name) >= 8 GROUP BY 1""")
def prefix_selfjoin(s, d):
    """Titles that others begin with, among the parts' names and names with something added."""
    names = table(s, d, "part").select("p_partkey", "p_name")
    names = names.unionByName(names.filter("p_partkey % 10 = 0").select((-1 - F.col("p_partkey")).alias("p_partkey"), F.concat("p_name", F.lit(", with all its annexes")).alias("p_name")))
    found = D.longer_titles(names.select("p_partkey", F.col("p_name").alias("title")), 8)
    return found.groupBy(F.col("p_partkey").alias("short_key")).agg(F.sum("n_longer").alias("n_longer"))


@query("""WITH f AS (SELECT p_brand, p_type, min(p_retailprice) AS fill FROM part WHERE p_size > 25 GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN p_size > 40 THEN coalesce(fill, p_retailprice) ELSE p_retailprice END AS price FROM part LEFT JOIN f USING (p_brand, p_type)""")
def crossfill_exact(s, d):
    part = table(s, d, "part")
    fill = part.filter("p_size > 25").groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("fill"))
    return part.join(fill, ["p_brand", "p_type"], "left").select("p_partkey", F.when(F.col("p_size") > 40, F.coalesce("fill", "p_retailprice")).otherwise(F.col("p_retailprice")).alias("price"))


@query("""WITH p AS (SELECT item_id, trim(text) AS passage FROM benchmark WHERE len(trim(text)) >= 40), hit AS (SELECT d.doc_id, p.item_id FROM documents d JOIN p ON contains(d.text, p.passage))
SELECT doc_id, min(item_id) AS item_id, count(*) AS n FROM hit GROUP BY 1""")
def crossfill_relaxed(s, d):
    return crossfill_pairs(s, d).groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, doc_id) AS nth FROM documents) WHERE nth = 1""")
def dedupe_exact(s, d):
    rows = table(s, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    first = rows.groupBy("h").agg(F.min(F.struct(F.when(F.col("source") == "src0", 0).otherwise(1).alias("rank"), "doc_id", "source")).alias("m"))
    return first.select("m.doc_id", "m.source")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1""")
def latest_snapshot(s, d):
    last = table(s, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.select("user_id", "event_type", "m.event_id")


@query("""WITH a AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE source = 'src0'), b AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE source <> 'src0')
SELECT count(*) AS n_keys, count(b.k) AS n_shared, round(count(b.k) / count(*), 6) AS ratio, CASE WHEN count(b.k) >= 0.9 * count(*) THEN 'duplicate' ELSE 'distinct' END AS verdict FROM a LEFT JOIN b USING (k)""")
def overlap_ratio(s, d):
    rows = table(s, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("k"), (F.col("source") == "src0").alias("mine")).filter("mine is not null")
    keys = rows.groupBy("k").agg(F.max("mine").alias("here"), F.max(~F.col("mine")).alias("there")).filter("here")
    both = keys.agg(F.count("*").alias("n_keys"), F.count_if("there").alias("n_shared"))
    return both.select("n_keys", "n_shared", F.round(F.col("n_shared") / F.col("n_keys"), 6).alias("ratio"), F.when(F.col("n_shared") >= 0.9 * F.col("n_keys"), "duplicate").otherwise("distinct").alias("verdict"))


@query("""SELECT r_name, n_name, count(s_suppkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1, 2""")
def region_zero_fill(s, d):
    n = table(s, d, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    dims = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed dimension
    return dims.join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT lang, count(*) AS n, count(l.doc_id) * 100 // count(*) AS labelled_pct, count(*) FILTER (WHERE text IS NOT NULL AND text <> '') * 100 // count(*) AS text_pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""")
def coverage_rates(s, d):
    known = table(s, d, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    rows = table(s, d, "documents").select("doc_id", "lang", (F.col("text").isNotNull() & (F.col("text") != "")).alias("full")).join(known, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.expr("count(has) * 100 div count(*)").alias("labelled_pct"), F.expr("count_if(full) * 100 div count(*)").alias("text_pct"))


@query("""SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY quality DESC NULLS LAST, d.doc_id LIMIT 40""")
def doc_sort_nulls_last(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").orderBy(F.col("quality").desc_nulls_last(), "doc_id").limit(40)


@query("""SELECT doc_id, (i // 500)::INT AS chunk_no, substring(text, i + 1, 600) AS chunk FROM (SELECT doc_id, text, unnest(range(0, 500 * CAST(ceil(greatest(len(text) - 600, 0) / 500) AS BIGINT) + 1, 500)) AS i FROM documents WHERE len(text) > 0)""")
def chunk_windows(s, d):
    """All windows of whole texts."""
    return table(s, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
'(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?(p|div|li|h[1-6]|br|tr|article|footer|nav|ul)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' ?(\n ?)+', chr(10), 'g'), ' ') AS text FROM pages""")
def html_to_text(s, d):
    return table(s, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query(r"SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def page_title(s, d):
    return table(s, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))


@query(r"""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def page_links(s, d):
    links = table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, sha256(coalesce(text, '\N') || chr(1) || coalesce(lang, '\N') || chr(1) || coalesce(source, '\N')) AS hash FROM documents""")
def content_hash_changes(s, d):
    return table(s, d, "documents").select("doc_id", T.content_hash("text", "lang", "source").alias("hash"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice,
CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'kept' WHEN coalesce(n.o_orderstatus, o.o_orderstatus) IS DISTINCT FROM o.o_orderstatus OR coalesce(n.o_totalprice, o.o_totalprice) IS DISTINCT FROM o.o_totalprice THEN 'updated' ELSE 'unchanged' END AS change
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def upsert_merge(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = rows.filter("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return D.upsert(rows.filter("o_orderkey % 3 != 0"), new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""SELECT d.doc_id, CASE WHEN coalesce(len(p.html), 0) > coalesce(len(d.text), 0) THEN 'page' ELSE 'document' END AS body_from, greatest(coalesce(len(p.html), 0), coalesce(len(d.text), 0)) AS n_chars FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def enrich_merge(s, d):
    pages = table(s, d, "pages").select("page_id", F.length("html").alias("m"))
    rows = table(s, d, "documents").select("doc_id", F.length("text").alias("n")).join(pages, F.col("doc_id") == F.col("page_id"), "left")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return rows.select("doc_id", F.when(m > n, "page").otherwise("document").alias("body_from"), F.greatest(m, n).alias("n_chars"))


@query("""SELECT ts::DATE AS day, count(*) AS reported, count(*) FILTER (WHERE event_type <> 'error') AS fetched, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0.25 * count(*) THEN 'failed'
WHEN count(*) FILTER (WHERE event_type <> 'error') < count(*) THEN 'incomplete' ELSE 'ok' END AS status FROM events GROUP BY 1""")
def completeness_log(s, d):
    days = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("reported"), F.count_if(F.col("event_type") != "error").alias("fetched"))
    bad = F.col("reported") - F.col("fetched")
    return days.withColumn("status", F.when(bad > 0.25 * F.col("reported"), "failed").when(bad > 0, "incomplete").otherwise("ok"))


@query(r"""WITH p AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, len(text) AS n_source, len(answer) AS n_target, len(answer) < 0.4 * len(text) AS short, NOT regexp_matches(rtrim(answer, ' '), '[.!?…]$') AS cut,
len(list_filter(list_distinct(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?')), lambda x: NOT list_contains(regexp_extract_all(answer, '[0-9][0-9,]*(?:\.[0-9]+)?'), x))) AS numbers_lost FROM p WHERE role = 'user' AND next_role = 'assistant'""")
def audit_pairs(s, d):
    return D.audit_pairs(table(s, d, "conversations").select("conv_id", "turn", "role", "text"))


@query(r"""WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), v AS (SELECT doc_id, n, line, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM u)
SELECT doc_id, count(*) AS n_repeats FROM v WHERE line = prev AND line <> '' GROUP BY 1""")
def adjacent_repeat(s, d):
    lines = F.split("text", "\n", -1)
    pairs = F.zip_with(F.slice(lines, F.lit(2), F.size(lines)), lines, lambda a, b: (a == b) & (a != ""))
    return table(s, d, "documents").select("doc_id", F.size(F.filter(pairs, lambda x: x)).cast("long").alias("n_repeats")).filter("n_repeats > 0")


@query(r"""WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
i AS (SELECT doc_id, n, line, sum(CASE WHEN len(line) < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM u), g AS (SELECT doc_id, island, sum(len(line))::BIGINT AS n_chars FROM i WHERE len(line) >= 100 GROUP BY 1, 2)
SELECT doc_id, max(n_chars) AS longest FROM g GROUP BY 1""")
def longest_block(s, d):
    """Characters of the longest run of lines of 100 or more, within each text, without a shuffle."""
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("best"))

    def step(at, n):
        run = F.when(n >= 100, at["run"] + n).otherwise(F.lit(0)).cast("long")
        return F.struct(run.alias("run"), F.when(run > 0, F.greatest(run, at["best"])).otherwise(at["best"]).alias("best"))

    longest = F.aggregate(F.transform(F.split("text", "\n", -1), F.length), start, step, lambda at: at["best"])
    return table(s, d, "documents").select("doc_id", longest.alias("longest")).filter("longest is not null")


@query("""SELECT user_id, max(n) AS most, count(*) FILTER (WHERE n >= 2) AS over FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') GROUP BY 1""")
def sliding_failures(s, d):
    micro = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(micro).rangeBetween(-86_400_000_000, 0)
    return table(s, d, "events").filter("event_type = 'error'").select("user_id", F.count("*").over(w).alias("n")).groupBy("user_id").agg(F.max("n").alias("most"), F.count_if(F.col("n") >= 2).alias("over"))


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_buckets(s, d):
    events = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.daily_buckets(events).select(F.to_date("day").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, count(DISTINCT no) AS n_sessions, count(*) AS n_events FROM s GROUP BY 1""")
def event_sessions(s, d):
    events = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(events).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


_AMOUNT = "CASE o_orderkey % 4 WHEN 0 THEN concat('预算 ', o_custkey, '.5 万元') WHEN 1 THEN concat(o_custkey % 10, '.25 亿元') WHEN 2 THEN concat(1 + o_custkey % 900, ',', 100 + o_custkey % 900, ' 元') ELSE '无' END"
_DAY = """CASE o_orderkey % 5 WHEN 0 THEN concat(year(o_orderdate), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), ' 00:00:00') WHEN 1 THEN concat(year(o_orderdate), '/', month(o_orderdate), '/', day(o_orderdate))
WHEN 2 THEN concat('于', year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日') WHEN 3 THEN concat(year(o_orderdate), '年', month(o_orderdate), '月') ELSE '无日期' END"""


@query(f"""SELECT o_orderkey, {_AMOUNT} AS raw, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_custkey * 10000 + 5000 WHEN 1 THEN (o_custkey % 10) * 100000000 + 25000000 WHEN 2 THEN (1 + o_custkey % 900) * 1000 + 100 + o_custkey % 900 END AS DECIMAL(16,2)) AS amount FROM orders""")
def money_parse(s, d):
    """Amounts in three units from wording."""
    return table(s, d, "orders").select("o_orderkey", F.expr(_AMOUNT).alias("raw")).withColumn("amount", T.money(F.col("raw")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN o_orderdate::DATE WHEN o_orderkey % 5 = 3 THEN date_trunc('month', o_orderdate)::DATE END AS day FROM orders")
def date_ladder(s, d):
    """Days from four ways of writing them; without a day the first of the month."""
    return table(s, d, "orders").select("o_orderkey", T.iso_date(F.expr(_DAY)).alias("day"))


_RULES = """(VALUES ('entertainment', 0.005, 0.6), ('education', 0.08, 1.0), ('donation', 0.12, 1.0)) r(item, ratio, special)"""
_ITEMS = """SELECT c_custkey, base, item, round(base * ratio, 2) AS cap, amount, least(special * amount, base * ratio) AS allowed FROM (SELECT c_custkey, sum(o_totalprice) AS base, max(o_totalprice) * 0.1 AS amount FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) b, """


@query(f"""SELECT c_custkey, item, cap, round(amount - allowed, 2) AS increase, CASE WHEN item = 'entertainment' THEN 0 ELSE round(amount - allowed, 2) END AS carry FROM ({_ITEMS}{_RULES})""")
def cit_adjustments(s, d):
    return _adjusted(s, d).select("c_custkey", "item", F.round("limit", 2).alias("cap"), F.round("increase", 2).alias("increase"), F.when(F.col("item") == "entertainment", 0.0).otherwise(F.round("increase", 2)).alias("carry"))


def _adjusted(s, d) -> DataFrame:
    rules = F.broadcast(s.createDataFrame([("entertainment", 0.005, 0.6), ("education", 0.08, 1.0), ("donation", 0.12, 1.0)], "item string, ratio double, special double"))  # fixed values
    base = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("base"), (F.max("o_totalprice") * 0.1).alias("amount"))
    limit = F.col("base") * F.col("ratio")
    return base.crossJoin(rules).withColumn("limit", limit).withColumn("increase", F.col("amount") - F.least(F.col("special") * F.col("amount"), limit))


@query(f"""SELECT c_custkey, round(sum(amount - allowed), 2) AS increase, round(greatest(max(base) * 0.1 + sum(amount - allowed), 0) * 0.25, 1) AS tax FROM ({_ITEMS}{_RULES}) GROUP BY 1""")
def cit_totals(s, d):
    total = _adjusted(s, d).groupBy("c_custkey").agg(F.sum("increase").alias("i"), F.max("base").alias("b"))
    return total.select("c_custkey", F.round("i", 2).alias("increase"), F.round(F.greatest(F.col("b") * 0.1 + F.col("i"), F.lit(0.0)) * 0.25, 1).alias("tax"))


@query("""WITH r AS (SELECT event_id, user_id, sum(1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events WHERE event_type <> 'error')
SELECT user_id, count(*) FILTER (WHERE spent <= 100) AS charged, count(*) FILTER (WHERE spent > 100) AS refused, greatest(0, 100 - count(*))::BIGINT AS balance FROM r GROUP BY 1""")
def ledger_replay(s, d):
    spent = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(s, d, "events").filter("event_type != 'error'").select("user_id", spent.alias("spent"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("spent") <= 100).alias("charged"), F.count_if(F.col("spent") > 100).alias("refused"), F.greatest(F.lit(0), F.lit(100) - F.count("*")).cast("long").alias("balance"))


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'repealed' WHEN l.quality = 0 THEN 'pending' WHEN contains(lower(text), 'license') THEN 'repealed' ELSE 'valid' END AS status,
CASE WHEN l.toxic = 1 THEN 'catalog' WHEN l.quality = 0 THEN 'official' WHEN contains(lower(text), 'license') THEN 'inferred' ELSE 'default' END AS source,
coalesce(l.toxic, 0) = 0 AND coalesce(l.quality, 1) = 1 AND contains(lower(text), 'license') AS needs_review FROM documents d LEFT JOIN labels l USING (doc_id)""")
def judge_precedence(s, d):
    """Evidence in order: catalogue, official note, inferred from the text, default."""
    rows = table(s, d, "documents").select("doc_id", T.all_terms(F.col("text"), ["license"]).alias("told")).join(table(s, d, "labels"), "doc_id", "left")
    verdict = lambda a, b, c, e: F.when(F.col("toxic") == 1, a).when(F.col("quality") == 0, b).when(F.col("told"), c).otherwise(e)
    found = rows.select("doc_id", verdict("repealed", "pending", "repealed", "valid").alias("status"), verdict("catalog", "official", "inferred", "default").alias("source"))
    return found.withColumn("needs_review", (F.col("source") == "inferred") & (F.col("status") == "repealed"))


@query("""WITH p AS (SELECT item_id, trim(text) AS passage FROM benchmark WHERE len(trim(text)) >= 40) SELECT item_id, count(DISTINCT d.doc_id) AS n_citing, min(d.doc_id) AS first_id FROM p LEFT JOIN documents d ON contains(d.text, passage) GROUP BY 1""")
def citation_edges(s, d):
    hit = crossfill_pairs(s, d)
    items = table(s, d, "benchmark").filter(F.length(F.trim("text")) >= 40).select("item_id")
    return items.join(hit.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_citing"), "first_id")


def crossfill_pairs(s, d) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that contain a passage, blocked on the passage's longest inner word."""
    items = table(s, d, "benchmark").select("item_id", F.trim("text").alias("passage")).filter(F.length("passage") >= 40)
    inner = F.split("passage", " ")
    inner = F.filter(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(1))), lambda w: ~w.rlike(r"[\n\t\r]"))
    items = items.withColumn("key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    docs = table(s, d, "documents").select("doc_id", "text")
    held = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"[ \n\t\r]+"))).alias("key")).join(items.select("key").distinct(), "key", "left_semi").join(items, "key")
    return held.join(docs, "doc_id").filter(F.contains("text", F.col("passage"))).select("doc_id", "item_id").distinct()


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS nth FROM documents) WHERE nth <= 5""")
def stratified_sample(s, d):
    """Five documents a language by a seeded hash; the limit is the feature, and is taken before the sort per key."""
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    return table(s, d, "documents").select("doc_id", "lang").withColumn("nth", F.row_number().over(w)).filter("nth <= 5").drop("nth")


@query("""WITH o AS (SELECT n_nationkey + 100 AS id, concat('Office of ', substring(n_name, 1, 6), ' affairs') AS title FROM nation), a AS (SELECT DISTINCT n_nationkey AS id, substring(n_name, i, 5) AS gram FROM (SELECT *, unnest(range(1, greatest(len(n_name) - 4, 1) + 1)) AS i FROM nation)),
b AS (SELECT DISTINCT id, substring(title, i, 5) AS gram FROM (SELECT *, unnest(range(1, greatest(len(title) - 4, 1) + 1)) AS i FROM o)) SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM a JOIN b USING (gram)""")
def ngram_candidates(s, d):
    """Nations and offices whose names share five characters in a row."""
    nation = table(s, d, "nation")
    office = nation.select((F.col("n_nationkey") + 100).alias("id"), F.concat(F.lit("Office of "), F.substring("n_name", 1, 6), F.lit(" affairs")).alias("title"))
    return D.ngram_candidates(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")), office)


@query()
def fuzzy_title_match(s, d):
    """Titles of passages as they are cited, with a word left out, against the titles of all documents and passages (these
    with negative ids): best partial match at 88 or more."""
    titles = lambda name, key: table(s, d, name).select(key.alias("id"), T.title_of(F.col("text")).alias("title"))
    passages = titles("benchmark", -1 - F.col("item_id"))
    cited = passages.select((-1 - F.col("id")).alias("id"), F.regexp_replace("title", r"^(\S+ \S+) \S+ ", "$1 ").alias("title"))
    return fuzzy_match(cited, titles("documents", F.col("doc_id")).unionByName(passages))


@query("""WITH o AS (SELECT o_custkey, o_orderdate::DATE AS a, o_orderdate::DATE + 30 AS b FROM orders), m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
i AS (SELECT *, sum(CASE WHEN before >= a THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, first_day, last_day, n FROM (SELECT o_custkey, island, min(a) AS first_day, max(b) AS last_day, count(*) AS n FROM i GROUP BY 1, 2)""")
def merged_spans(s, d):
    """Overlapping 30-day spans of each customer's orders as merged spans."""
    a = F.to_date("o_orderdate")
    spans = table(s, d, "orders").select("o_custkey", a.alias("first_day"), F.date_add(a, 30).alias("last_day"))
    return D.merge_spans(spans, ["o_custkey"], "first_day", "last_day")


@query("""SELECT w.term, count(*) FILTER (WHERE contains(lower(d.text), w.term)) AS n_docs, coalesce(sum((len(lower(d.text)) - len(replace(lower(d.text), w.term, ''))) // len(w.term)), 0)::BIGINT AS n_uses,
count(*) FILTER (WHERE contains(lower(d.text), w.term)) * 100 // greatest(count(*), 1) AS pct FROM (VALUES ('license'), ('licence'), ('ation'), ('zzzz')) w(term), documents d GROUP BY 1""")
def variant_coverage(s, d):
    """Coverage and uses of each variant, in one pass over the texts."""
    terms = ["license", "licence", "ation", "zzzz"]
    each = [F.struct(F.lit(t).alias("term"), F.count_if(F.contains(F.lower("text"), F.lit(t))).alias("n_docs"), F.coalesce(F.sum(T.occurrences(F.col("text"), t).cast("long")), F.lit(0)).alias("n_uses"), F.count("*").alias("n")) for t in terms]
    return table(s, d, "documents").agg(F.array(*each).alias("v")).select(F.inline("v")).select("term", "n_docs", "n_uses", F.expr("n_docs * 100 div greatest(n, 1)").alias("pct"))


@query("""SELECT conv_id, CASE max(CASE WHEN text IS NULL OR len(text) < 20 THEN 2 WHEN len(text) > 400 THEN 1 ELSE 0 END) WHEN 2 THEN 'issue' WHEN 1 THEN 'unsure' ELSE 'ok' END AS verdict, count(*) AS n_chunks FROM conversations GROUP BY 1""")
def verdict_merge(s, d):
    """The worst verdict of a conversation's parts: issue over unsure over ok."""
    worst = F.max(F.when(F.col("text").isNull() | (F.length("text") < 20), 2).when(F.length("text") > 400, 1).otherwise(0))
    rows = table(s, d, "conversations").groupBy("conv_id").agg(worst.alias("w"), F.count("*").alias("n_chunks"))
    return rows.select("conv_id", F.when(F.col("w") == 2, "issue").when(F.col("w") == 1, "unsure").otherwise("ok").alias("verdict"), "n_chunks")


@query("""WITH e AS (SELECT event_type, ts::DATE AS day FROM events GROUP BY 1, 2), l AS (SELECT event_type, day, day - lag(day) OVER (PARTITION BY event_type ORDER BY day) AS gap FROM e)
SELECT event_type, max(day) AS last_day, (DATE '2024-02-01' - max(day))::BIGINT AS days_since, coalesce(max(gap), 0)::BIGINT AS longest_gap, least((DATE '2024-02-01' - max(day)) + 7, 90)::BIGINT AS catch_up FROM l GROUP BY 1""")
def success_gaps(s, d):
    """Days since the last success at a given day, the longest gap, and the catch-up window (gap and 7, at most 90)."""
    days = table(s, d, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
    gap = F.date_diff("day", F.lag("day").over(Window.partitionBy("event_type").orderBy("day")))
    last = days.withColumn("gap", gap).groupBy("event_type").agg(F.max("day").alias("last_day"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("longest_gap"))
    since = F.date_diff(F.lit("2024-02-01").cast("date"), "last_day").cast("long")
    return last.select("event_type", "last_day", since.alias("days_since"), "longest_gap", F.least(since + 7, F.lit(90)).alias("catch_up"))


@query("SELECT doc_id, n_chars FROM documents WHERE (n_chars IS NULL OR n_chars >= 500) AND (lang IS NULL OR lang NOT IN ('de', 'fr'))")
def null_tolerant_range(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars", "lang")
    return docs.filter((F.col("n_chars").isNull() | (F.col("n_chars") >= 500)) & (F.col("lang").isNull() | ~F.col("lang").isin("de", "fr"))).drop("lang")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def clean_set_difference(s, d):
    return table(s, d, "documents").select("doc_id").subtract(table(s, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(s, d):
    return table(s, d, "documents").select("doc_id").intersect(table(s, d, "labels").select("doc_id"))


@query("""SELECT o_custkey, o_orderkey, days_left, days_left BETWEEN 0 AND 3 AS urgent FROM (SELECT o_custkey, o_orderkey, (DATE '1997-01-01' - o_orderdate::DATE)::BIGINT AS days_left,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01') WHERE nth = 1""")
def due_items(s, d):
    """The item next to the due day for each key, with its days left and the urgent flag."""
    rows = table(s, d, "orders").filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    first = rows.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", -F.col("o_orderkey"))).alias("m"))
    left = F.date_diff(F.lit("1997-01-01").cast("date"), F.to_date("m.o_orderdate")).cast("long")
    return first.select("o_custkey", "m.o_orderkey", left.alias("days_left"), left.between(0, 3).alias("urgent"))


@query("""SELECT doc_id, sha256(substring(coalesce(text, ''), 301, 1000)) AS page_hash, len(coalesce(text, '')) > 1300 AS truncated, CASE WHEN len(coalesce(text, '')) > 1300 THEN 1300 END AS next_offset FROM documents""")
def content_page(s, d):
    """One page of each text: 1,000 characters from offset 300."""
    page = T.page(F.col("text"), 300, 1000)
    return table(s, d, "documents").select("doc_id", page.alias("p")).select("doc_id", F.sha2("p.text", 256).alias("page_hash"), "p.truncated", "p.next_offset")


@query(r"""SELECT item_id, regexp_replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(license|ation|the)', '<mark>\1</mark>', 'g') AS marked FROM benchmark""")
def highlight_terms(s, d):
    return table(s, d, "benchmark").select("item_id", T.highlight(F.col("text"), ["license", "ation", "the"]).alias("marked"))


@query("""SELECT event_id, k, least(greatest(k, 0), 5) AS score FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_scores(s, d):
    """A number out of lenient JSON, clamped to 0..5."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(s, d, "events").select("event_id", k.alias("k")).withColumn("score", F.when(F.col("k").isNotNull(), F.least(F.greatest("k", F.lit(0)), F.lit(5))))


@query(r"""SELECT page_id, substring(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) AS file_name, substring(md5(coalesce(url, '')), 1, 16) AS uid FROM pages""")
def safe_names(s, d):
    name = F.substring(F.regexp_replace(F.coalesce("url", F.lit("")), r"[^A-Za-z0-9._-]+", "_"), 1, 80)
    return table(s, d, "pages").select("page_id", name.alias("file_name"), F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 16).alias("uid"))


@query("""SELECT d.doc_id, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 0 WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS priority FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY priority, d.doc_id DESC LIMIT 100""")
def review_queue(s, d):
    """Doubtful rows first, then those never reviewed, then the rest, newest first; the limit is the feature."""
    rows = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    priority = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 0).when(F.col("seen").isNull(), 1).otherwise(2)
    return rows.select("doc_id", priority.alias("priority")).orderBy("priority", F.col("doc_id").desc()).limit(100)


@query("SELECT pos, n_nationkey, n_name FROM (VALUES (0, 7), (1, 3), (2, 21), (3, 999)) k(pos, id) JOIN nation ON n_nationkey = id")
def given_key_order(s, d):
    """Rows in the order of a given list of keys, unknown keys left out."""
    keys = s.createDataFrame([(0, 7), (1, 3), (2, 21), (3, 999)], "pos int, n_nationkey int")
    return table(s, d, "nation").join(F.broadcast(keys), "n_nationkey").select("pos", "n_nationkey", "n_name").orderBy("pos")  # four keys


_KIND = "CASE p_size % 8 WHEN 0 THEN '招标' WHEN 1 THEN '预招标' WHEN 2 THEN '采购意向' WHEN 3 THEN '中标结果' WHEN 4 THEN '中标候选人' WHEN 5 THEN '合同' WHEN 6 THEN '' END"
OVER = ("中标结果", "中标候选人", "合同")  # fixed values: kinds of notices that come after the bids


@query(f"""SELECT p_partkey, {_KIND} AS kind, p_size % 8 NOT IN (3, 4, 5) AS biddable FROM part""")
def biddable_kinds(s, d):
    """Whether a notice can still be bid on; an unknown kind can."""
    rows = table(s, d, "part").select("p_partkey", F.expr(_KIND).alias("kind"))
    return rows.withColumn("biddable", F.coalesce(~F.col("kind").isin(*OVER), F.lit(True)))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority, o_orderstatus)::INT AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def facet_rollup(s, d):
    rows = table(s, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return rows.select("o_orderpriority", "o_orderstatus", "n", "level")

# The other modules of queries register themselves with query().
from lexmill.plans import audits, ingest, policies, records, relations, searches  # noqa: E402, F401
