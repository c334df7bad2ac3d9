"""Queries over pairs of texts, and over what is gathered for several facts."""

from pyspark.sql import functions as F

from lexmill.functions import pairs as P
from lexmill.operators import retrieval as R
from lexmill.plans.registered import query
from lexmill.plans.relations import _HEAD
from lexmill.plans.storage import table

# A source and its translation of each row of documents; every twelfth kind of translation has a fault of its own.
_SOURCE = """concat('共', doc_id % 90 + 5, '万元，自', 2000 + doc_id % 30, '年。', CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), '一、甲', chr(10), '（一）乙', chr(10), '（二）丙', chr(10), '1、x', chr(10), '2. y', chr(10), '3．z', chr(10), '第四条 w', chr(10), '5、v', chr(10), '6、u', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN '10 11 12 13 14 15 16 17 18 &#8203; 19 ' ELSE '' END, replace(coalesce(text, ''), '. ', '。'))"""
_TARGET = """CASE doc_id % 12 WHEN 0 THEN CASE WHEN doc_id % 24 = 0 THEN ' ' END WHEN 1 THEN substring(coalesce(text, ''), 1, CAST(floor(length(coalesce(text, '')) / 5) AS INT)) WHEN 2 THEN concat(text, ' and so on to The') WHEN 3 THEN concat(text, ' 译文') WHEN 4 THEN concat('翻译如下：', text) WHEN 5 THEN concat(text, ' in ', 2000 + doc_id % 30)
  WHEN 6 THEN concat('This very sentence stands here two times over. ', 'This very sentence stands here two times over. ', text) WHEN 7 THEN concat(text, ';') ELSE concat((doc_id % 90 + 5) * 10000, ' yuan from ', 2000 + doc_id % 30, '. ', CASE WHEN doc_id % 2 = 0 THEN '10, 11, 12, 13, 14, 15, 16, 17, 18 and 19. ' ELSE '' END, text) END"""
_PAIRS = f"p AS (SELECT doc_id, {_SOURCE} AS s, {_TARGET} AS t, CASE WHEN doc_id % 9 > 0 THEN 'now' END AS held FROM documents WHERE doc_id IS NOT NULL)"


def _numbers(x):
    got = f"list_transform(regexp_extract_all(regexp_replace({x}, '&[#A-Za-z0-9]+;', ' ', 'g'), '[0-9][0-9,]*(?:[.][0-9]+)?'), lambda n: replace(n, ',', ''))"
    return f"list_distinct({got} || list_transform(list_filter({got}, lambda n: regexp_full_match(n, '[0-9]{{1,2}}[.][0-9]{{4,}}')), lambda n: string_split(n, '.')[2]))"


_UNIT = "[0-9][0-9,]*(?:[.][0-9]+)?[ \\t\\n\\r\\f]*(?:多|余)?[ \\t\\n\\r\\f]*(?:万元|亿元|万|亿)?"
_SQL_FLAGS = rf"""x AS (SELECT doc_id, coalesce(s, '') AS s, coalesce(t, '') AS t, held, {_numbers("coalesce(s, '')")} AS ns, {_numbers("coalesce(t, '')")} AS nt,
    list_transform(regexp_extract_all(regexp_replace(coalesce(s, ''), '&[#A-Za-z0-9]+;', ' ', 'g'), '{_UNIT}'), lambda m: {{'n': regexp_replace(replace(regexp_extract(m, '[0-9][0-9,]*([.][0-9]+)?'), ',', ''), '^[0-9]{{1,2}}[.]([0-9]{{4}})$', '\1'), 'u': regexp_extract(m, '(万|亿)元?$', 1)}}) AS units,
    list_transform(string_split(regexp_replace(coalesce(t, ''), '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda z: trim(z)) AS parts FROM p),
  y AS (SELECT *, list_filter(units, lambda z: NOT list_bool_or(list_transform(list_filter([z.n] || CASE WHEN z.u = '' THEN [] ELSE list_transform([1, 1000000, 1000000000], lambda k: regexp_replace(printf('%.12f', z.n::DOUBLE * CASE z.u WHEN '万' THEN 10000 ELSE 100000000 END / k), '[.]?0+$', '')) END,
    lambda w: w NOT IN ('', '0')), lambda w: coalesce(list_bool_or(list_transform(nt, lambda v: contains(v, w))), false)))) AS gone FROM x)"""


@query(rf"""WITH {_PAIRS}, {_SQL_FLAGS}
SELECT doc_id, trim(t) <> '' AND regexp_matches(t, '[一-鿿]') AS residual, s <> '' AND trim(t) <> '' AND len(t) < 0.4 * len(s) AS short,
  trim(t) <> '' AND (regexp_matches(rtrim(t), '[,;:，、；：]$') OR regexp_matches(rtrim(t), '(^|[^\p{{L}}\p{{N}}_])(and|or|the|of|in|to|with|for|by|as|that|which|shall)$', 'i')) AS cut_off,
  s <> '' AND trim(t) <> '' AND len(list_filter(gone, lambda z: len(z.n) >= 3 OR z.u <> '')) > 0 AS numbers_missing,
  trim(t) <> '' AND len(list_filter(range(1, len(parts)), lambda i: len(parts[i]) >= 40 AND parts[i] = parts[i + 1])) > 0 AS repeats, len(trim(t)) < 10 AS empty,
  s <> '' AND trim(t) <> '' AND len(regexp_extract_all(s, '(?:^|\n)\s*(?:[（(]\s*[一二三四五六七八九十]{{1,3}}\s*[)）]|[0-9]{{1,3}}\s*[.、．]|第[一二三四五六七八九十百]{{1,4}}条)')) >= 8
    AND 2 * len(regexp_extract_all(t, '(?:^|\n)\s*(?:[0-9]{{1,3}}\s*[.、)]|Article\s+[0-9]+|\([0-9]{{1,3}}\)|\([a-z]\))')) < len(regexp_extract_all(s, '(?:^|\n)\s*(?:[（(]\s*[一二三四五六七八九十]{{1,3}}\s*[)）]|[0-9]{{1,3}}\s*[.、．]|第[一二三四五六七八九十百]{{1,4}}条)')) AS items_lost,
  s <> '' AND trim(t) <> '' AND len(ns) >= 8 AND 4 * len(nt) < 3 * len(ns) AS numbers_dropped, trim(t) <> '' AND (contains(t, '翻译如下：') OR contains(t, '翻译结果：')) AS talk, s <> '' AND trim(t) <> '' AND held IS NULL AS out_of_date FROM y""")
def translation_audit(s, d):
    """A row of flags for each pair."""
    rows = table(s, d, "documents").filter("doc_id is not null").select("doc_id", F.expr(_SOURCE).alias("s"), F.expr(_TARGET.replace("concat(text", "concat(coalesce(text, '')").replace(", text)", ", coalesce(text, ''))")).alias("t"))
    held = F.when(F.col("doc_id") % 9 > 0, F.sha2("s", 256))
    return rows.select("doc_id", *[flag.alias(name) for name, flag in P.audit_flags(F.col("s"), F.col("t"), held).items()])


_MOST = 500


@query(rf"""WITH RECURSIVE {_PAIRS}, x AS (SELECT doc_id, coalesce(s, '') AS s, coalesce(t, '') AS t, greatest(1, (len(coalesce(s, '')) + {_MOST - 1}) // {_MOST})::INT AS n FROM p),
w(doc_id, i, s_from, s_to, t_from, t_to) AS (SELECT doc_id, -1, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM x UNION ALL
  SELECT doc_id, i + 1, s_to, CASE WHEN i + 2 < n AND near > 0 AND cut >= 2 THEN s_end - near + cut ELSE s_end END, t_to, CASE WHEN i + 2 = n THEN len(t) ELSE least(len(t), round_even((i + 2) * len(t) / n, 0)::BIGINT) END
  FROM (SELECT *, len(regexp_extract(substring(s, s_end - near + 1, near), '(?s)^.*[。；！？\n]')) AS cut FROM (SELECT *, least(240, greatest(0, s_end - s_to - {_MOST // 2})) AS near FROM
    (SELECT w.*, x.s, x.t, x.n, CASE WHEN w.i + 2 = x.n THEN len(x.s) ELSE least(len(x.s), (w.i + 2) * {_MOST}) END AS s_end FROM w JOIN x USING (doc_id) WHERE w.i + 1 < x.n))))
SELECT doc_id, i AS part, sha256(substring(s, s_from + 1, greatest(s_to - s_from, 0))) AS source_sha256, sha256(substring(t, t_from + 1, greatest(t_to - t_from, 0))) AS target_sha256 FROM w JOIN x USING (doc_id) WHERE i >= 0""")
def paired_splits(s, d):
    """Every pair in parts of some 500 characters of its source, both sides cut alike; whole texts."""
    rows = table(s, d, "documents").filter("doc_id is not null").select("doc_id", F.expr(_SOURCE).alias("s"), F.expr(_TARGET.replace("concat(text", "concat(coalesce(text, '')").replace(", text)", ", coalesce(text, ''))")).alias("t"))
    parts = rows.select("doc_id", F.posexplode(P.split_alike(F.col("s"), F.col("t"), _MOST)).alias("part", "p"))
    return parts.select("doc_id", "part", F.sha2("p.source", 256).alias("source_sha256"), F.sha2("p.target", 256).alias("target_sha256"))


_FACTS = [(0, 0, "license"), (0, 1, "tion"), (0, 2, "en"), (1, 0, "Der"), (1, 1, "sch"), (2, 0, "que"), (2, 1, "zzqqzz")]
_POLICY = {
    "doc_id": "doc_id", "title": _HEAD, "number": "CASE WHEN doc_id % 6 > 0 THEN concat('no ', doc_id % 300) END", "region": "CASE WHEN doc_id % 5 = 0 THEN '全国' ELSE lang END",
    "status": "CASE doc_id % 4 WHEN 0 THEN '现行有效' WHEN 1 THEN '已废止' WHEN 2 THEN '尚未生效' END", "text": "text",
}


@query(f"""WITH d AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _POLICY.items())} FROM documents WHERE doc_id IS NOT NULL), q(fact, place, query) AS (VALUES {", ".join(map(str, _FACTS))}),
h AS (SELECT *, 12 * (len(lower(coalesce(title, ''))) - len(replace(lower(coalesce(title, '')), lower(query), ''))) / len(query) + (len(lower(coalesce(text, ''))) - len(replace(lower(coalesce(text, '')), lower(query), ''))) / len(query) AS weight FROM d, q WHERE contains(lower(coalesce(title, '')), lower(query)) OR contains(lower(coalesce(text, '')), lower(query))),
r AS (SELECT *, row_number() OVER (PARTITION BY fact, place ORDER BY weight DESC, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY fact, place) AS total FROM h),
k AS (SELECT *, coalesce(number, doc_id::VARCHAR) AS key, (1.0 / (place + 1)) / (1.0 + total / 200.0) * CASE WHEN contains(title, query) THEN 20.0 ELSE 1.0 END / (rank + 1) AS part FROM r WHERE rank < 50),
g AS (SELECT fact, key, round(sum(part), 6) AS score, min(place * 1000 + rank) AS seen FROM k GROUP BY 1, 2),
f AS (SELECT fact, key, doc_id, CASE status WHEN '现行有效' THEN 0 WHEN '尚未生效' THEN 1 WHEN '部分失效' THEN 2 WHEN '已废止' THEN 3 ELSE 4 END AS standing, row_number() OVER (PARTITION BY fact, key ORDER BY region IS DISTINCT FROM '全国', place, rank) AS nth FROM k),
o AS (SELECT g.fact, f.doc_id, g.key, g.score, row_number() OVER (PARTITION BY g.fact ORDER BY g.score DESC, f.standing, g.seen) AS nth FROM g JOIN f ON f.fact = g.fact AND f.key = g.key AND f.nth = 1)
SELECT fact, nth, doc_id, key, score FROM o WHERE nth <= 8""")
def gathered_facts(s, d):
    """Eight documents for each of three facts, from the queries of each; the limits are the feature."""
    docs = table(s, d, "documents").filter("doc_id is not null").selectExpr(*[f"{e} AS {c}" for c, e in _POLICY.items()])
    return R.gather(R.ranked_hits(docs, s.createDataFrame(_FACTS, "fact int, place int, query string")))
