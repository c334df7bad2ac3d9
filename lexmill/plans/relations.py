"""Queries over relations between official documents: who names, repeals and lists whom, and what is in force.

`registry` makes an official document of each row of `documents`: its title holds the first words of the text, so copies
have like titles, and its wording names the titles and numbers of the documents before it, some of them shortened.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import identifiers as I
from lexmill.operators import relations as R
from lexmill.plans.registered import query
from lexmill.plans.policies import _sql_number, _sql_tight, _sql_title, listed_documents
from lexmill.plans.storage import materialize, table

AS_OF = "2020-01-01"

_HEAD = r"regexp_extract(coalesce(text, ''), '^[ \n\t\r]*((?:[^ \n\t\r]{1,12}[ \n\t\r]+){0,3}[^ \n\t\r]{1,12})', 1)"
_BASE = {
    "doc_id": "doc_id",
    "title": f"""CASE WHEN doc_id % 23 = 5 THEN concat('关于《', {_HEAD}, '》的解读') WHEN doc_id % 29 = 3 THEN concat('中华人民共和国', substring({_HEAD}, 1, 6), '法')
      WHEN doc_id % 41 = 0 THEN concat('国家税务总局关于公布失效废止文件目录的公告', doc_id)
      ELSE concat(CASE doc_id % 4 WHEN 0 THEN '国家税务总局关于' WHEN 1 THEN '财政部　税务总局关于' WHEN 2 THEN '国务院关于发布《' ELSE '关于' END, {_HEAD}, CASE WHEN doc_id % 4 = 2 THEN '》的公告' WHEN doc_id % 3 = 0 THEN '有关问题的通知' ELSE '的公告' END) END""",
    "number": "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN concat('国家税务总局公告 20', 10 + doc_id % 15, ' 年第', doc_id, '号') ELSE concat('财税〔20', 10 + doc_id % 15, '〕', doc_id, '号') END",
    "aging": "CASE WHEN doc_id % 43 = 0 THEN '尚未生效' WHEN doc_id % 47 = 0 THEN '已废止' WHEN doc_id % 53 = 0 THEN '不详' END",
    "effective": "CASE WHEN doc_id % 5 = 0 THEN CAST(concat(2000 + doc_id % 27, '-01-01') AS DATE) END",
}
#: The rows that the wording names, by how far before they are.
_BEFORE = {"a": 1, "b": 3, "c": 5, "e": 8}
_TEXT = """concat('依据', coalesce(replace(a.number, '财税', '财 税'), '有关文件'), '和《', coalesce(replace(replace(b.title, '《', '〈'), '》', '〉'), '某个文件'), '》执行。',
  CASE WHEN p.doc_id % 6 = 0 THEN concat('参照《', coalesce(concat(substring(b.title, 1, 9), substring(b.title, 12)), '无'), '》。', coalesce(p.number, ''), '。') ELSE '' END,
  CASE WHEN p.doc_id % 11 = 0 THEN concat('《', coalesce(c.title, '某件'), '》同时废止。') WHEN p.doc_id % 11 = 5 THEN concat('废止《', coalesce(concat(substring(c.title, 1, 10), substring(c.title, 12)), '某件'), '》。')
    WHEN p.doc_id % 11 = 7 THEN concat('停止执行《', coalesce(c.number, '某件'), '》；不废止《', coalesce(b.title, '某件'), '》') ELSE '' END,
  CASE WHEN p.doc_id % 13 = 0 THEN '根据《国务院关于清理的决定》（国务院令第319号），全文废止。' WHEN p.doc_id % 13 = 6 THEN '本通知自下月起全文废止。' WHEN p.doc_id % 13 = 8 THEN '《某办法》全文废止。' ELSE '' END,
  CASE WHEN p.doc_id % 9 = 0 THEN concat(chr(10), '附件：《', coalesce(e.title, '某件'), '》') ELSE '' END)"""
_CATALOG = """CASE WHEN p.doc_id % 41 = 0 THEN concat('序号|文件|文号', chr(10), '1|', coalesce(c.title, '无'), '|', coalesce(c.number, ''), chr(10), '2|', coalesce(concat(substring(e.title, 1, 12), substring(e.title, 14)), '无'), '| |', chr(10), coalesce(b.number, ''), '|x') END"""
_SPAN = " ".join(f"LEFT JOIN q {n} ON {n}.doc_id = p.doc_id - {k}" for n, k in _BEFORE.items())
REGISTRY = f"""q AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _BASE.items())} FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT p.doc_id, p.title, p.number, p.aging, p.effective, {_TEXT} AS text, {_CATALOG} AS catalog FROM q p {_SPAN})"""


def registry(s, d):
    """(doc_id, title, number, aging, effective, text, catalog) of each row of documents with a doc_id."""
    base = table(s, d, "documents").filter("doc_id is not null").selectExpr(*[f"{e} AS {c}" for c, e in _BASE.items()])
    out = base.alias("p")
    for name, k in _BEFORE.items():
        out = out.join(base.select((F.col("doc_id") + k).alias("at"), "title", "number").alias(name), F.expr(f"{name}.at = p.doc_id"), "left")
    return out.select("p.*", F.expr(_TEXT).alias("text"), F.when(F.col("p.doc_id") % 41 == 0, listed_documents(F.expr(_CATALOG))).alias("catalog"))


def _relations(s, d):
    docs = materialize(registry(s, d))
    return docs, R.build_relations(docs)


def _sql_score(x, y):
    """Partial ratio of x, the shorter, in y: the common subsequence of x and each window, with the rows of x as bits."""
    masks = f"list_transform(range(1, len({y}) + 1), lambda j: list_sum(list_transform(range(0, len({x})), lambda i: CASE WHEN {x}[i + 1] = {y}[j] THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END)))"
    row = "list_reduce(list_prepend(filled, masks[greatest(w, 0) + 1 : least(w + n, m)]), lambda r, k: ((r + (r & k)) | (r - (r & k))) & filled)"
    windows = f"(SELECT {x} AS x, {y} AS y, len({x}) AS n, len({y}) AS m, (1::HUGEINT << len({x})::INT) - 1 AS filled, {masks} AS masks, a, b FROM near)"
    return f"SELECT a, b, max(floor(200.0 * (n - bit_count({row})) / (n + least(w + n, m) - greatest(w, 0)))) AS score FROM (SELECT *, unnest(range(1 - n, m)) AS w FROM {windows}) GROUP BY a, b"


_GRAM = "SELECT DISTINCT {x}, n, substring({x}, i, n) AS gram FROM (SELECT {x}, n, unnest(range(1, len({x}) - n + 2)) AS i FROM {rows})"
_SHORT, _LONG = "CASE WHEN len(a) <= len(b) THEN a ELSE b END", "CASE WHEN len(a) <= len(b) THEN b ELSE a END"
_BIGRAMS = "list_distinct(list_transform(range(1, len({x})), lambda i: substring({x}, i, 2)))"
_SQL_RELATIONS = rf"""{REGISTRY},
k AS (SELECT *, {_sql_title('title')} AS key, {_sql_number('number')} AS own_no, regexp_matches(title, '^中华人民共和国[^《》]{{1,24}}法$') AS statute, title LIKE '%解读%' OR title LIKE '%答记者问%' AS tells FROM p),
h AS (SELECT own_no AS no_key, max(doc_id) AS holder FROM k WHERE own_no IS NOT NULL GROUP BY 1),
s AS (SELECT doc_id, statute, tells, unnest(string_split_regex(text, '[。；\n]')) AS sentence FROM k),
said AS (SELECT doc_id AS src, trim(unnest(regexp_extract_all(sentence, '废止[ ]*《([^》]+)》', 1) || regexp_extract_all(sentence, '停止执行[ ]*《([^》]+)》', 1) || regexp_extract_all(sentence, '《([^》]+)》[ ]*(?:同时|一并|予以)?[ ]*废止', 1))) AS said FROM s WHERE NOT statute AND NOT regexp_matches(sentence, '(不|不作|未|不再)废止')),
lines AS (SELECT doc_id AS src, list_filter(list_transform(string_split(unnest(string_split(catalog, chr(10))), '|'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM k WHERE catalog IS NOT NULL),
cat AS (SELECT src, list_filter(cells, lambda c: len(c) >= 10 AND contains(c, '关于'))[1] AS t, list_filter(cells, lambda c: regexp_matches(c, '〔[ ]*[0-9]{{4}}[ ]*〕'))[1] AS no FROM lines WHERE len(cells) >= 2),
m0 AS (SELECT DISTINCT src, 'cites' AS kind, key, key AS said, NULL AS no_key, 90 AS least, false AS acts FROM (SELECT doc_id AS src, k.key AS own, {_sql_title('t')} AS key FROM k, unnest(regexp_extract_all(text, '《([^《》]+)》', 1)) u(t)) WHERE key <> own AND len(key) >= 4
  UNION ALL SELECT DISTINCT src, 'repeals', {_sql_title('said')}, said, {_sql_number('said')}, 88, true FROM said WHERE len(said) >= 2 AND NOT regexp_matches(said, '^(本|上述|该|原)')
  UNION ALL SELECT DISTINCT src, 'lists', {_sql_title('t')}, coalesce(no, t), {_sql_number('no')}, 92, true FROM cat WHERE t IS NOT NULL OR no IS NOT NULL),
m AS (SELECT m0.*, h.holder FROM m0 LEFT JOIN h USING (no_key)),
ka AS (SELECT DISTINCT key AS a, unnest([5, 10]) AS n FROM m WHERE holder IS NULL AND key <> ''), kb AS (SELECT DISTINCT key AS b, unnest([5, 10]) AS n FROM k WHERE key <> ''),
ga AS ({_GRAM.format(x='a', rows='ka')}), gb AS ({_GRAM.format(x='b', rows='kb')}),
pairs AS (SELECT DISTINCT a, b FROM ga JOIN gb USING (gram, n) WHERE len(a) >= 6 AND n = CASE WHEN len(a) >= 12 AND len(b) >= 20 THEN 10 ELSE 5 END UNION SELECT DISTINCT ka.a, kb.b FROM ka, kb WHERE len(ka.a) < 6),
near AS (SELECT a, b FROM pairs WHERE len(list_intersect({_BIGRAMS.format(x='a')}, {_BIGRAMS.format(x='b')})) >= len({_BIGRAMS.format(x=f'({_SHORT})')}) - floor(0.4286 * least(len(a), len(b)))),
score AS ({_sql_score(_SHORT, _LONG)}),
cand AS (SELECT m.src, m.kind, m.key, m.said, k.doc_id AS dst, k.number, row_number() OVER (PARTITION BY m.src, m.kind, m.said, m.key ORDER BY score.score DESC, k.doc_id) AS nth
  FROM m JOIN score ON score.a = m.key AND score.score >= m.least JOIN k ON k.key = score.b AND k.doc_id <> m.src WHERE m.holder IS NULL AND NOT (m.acts AND k.statute) AND (NOT k.tells OR contains(m.key, '解读'))),
named AS (SELECT m.src, m.kind, m.said, coalesce(m.holder, cand.dst) AS dst, CASE WHEN m.kind <> 'lists' AND m.holder IS NULL THEN coalesce(cand.number, m.said) ELSE m.said END AS dst_no FROM m LEFT JOIN cand ON cand.nth = 1 AND cand.src = m.src AND cand.kind = m.kind AND cand.said = m.said AND cand.key = m.key),
nums AS (SELECT DISTINCT doc_id AS src, own_no, {_sql_number(f"regexp_replace(u.t, '^(依据|根据|按照|依照|参照|遵照|详见|见)', '')")} AS no_key FROM k, unnest(regexp_extract_all({_sql_tight('text')}, '[一-龥][一-龥、]{{0,60}}(?:公告|通知|令|决定|规定|办法|通告)[ ]*20[0-9][0-9][ ]*年[ ]*第[ ]*[0-9]{{1,6}}[ ]*号') || regexp_extract_all({_sql_tight('text')}, '[一-龥]{{2,24}}[〔\[（(][ ]*20[0-9][0-9][ ]*[〕\]）)][ ]*[0-9]{{1,6}}[ ]*号')) u(t)),
every AS (SELECT src, CASE kind WHEN 'cites' THEN 'cites' ELSE 'repeals' END AS relation, dst, dst_no, CASE kind WHEN 'lists' THEN 'official_catalog' ELSE 'content' END AS origin FROM named
  UNION ALL SELECT src, 'cites', holder, nums.no_key, 'content' FROM nums LEFT JOIN h USING (no_key) WHERE own_no IS NULL OR own_no <> nums.no_key
  UNION ALL SELECT DISTINCT doc_id, 'self_repealed', NULL, NULL, 'content_self' FROM s WHERE NOT tells AND NOT regexp_matches(sentence, '(不|不作|未|不再)废止') AND (regexp_matches(sentence, '本(公告|通知|规定|办法|细则|法规|条例|决定|规则|意见|复函|批复|函|文件).{{0,40}}废止') OR regexp_matches(sentence, '(^|[^》」])(全文|全部|予以)废止'))),
rel AS (SELECT src, relation, dst, dst_no, max(origin) AS origin FROM every GROUP BY ALL)"""


@query(f"WITH {_SQL_RELATIONS} SELECT src, relation, dst, dst_no, origin FROM rel")
def policy_relations(s, d):
    """The relation table: citations, repeals, listings and own repeals, with what they were resolved to."""
    return _relations(s, d)[1].select("src", "relation", "dst", "dst_no", F.col("evidence_source").alias("origin"))


@query(f"""WITH {_SQL_RELATIONS},
f AS (SELECT p.doc_id, aging, coalesce(aging IN ('现行有效', '已废止', '部分失效', '尚未生效'), false) AS noted, effective > DATE '{AS_OF}' AS later, EXISTS (SELECT 1 FROM rel WHERE dst = p.doc_id AND relation = 'repeals' AND origin = 'official_catalog') AS listed,
  EXISTS (SELECT 1 FROM rel WHERE dst = p.doc_id AND relation = 'repeals') AS another, EXISTS (SELECT 1 FROM rel WHERE src = p.doc_id AND relation = 'self_repealed') AS own FROM p),
j AS (SELECT doc_id, CASE WHEN listed THEN '已废止' WHEN noted THEN aging WHEN own OR another THEN '已废止' WHEN later THEN '尚未生效' ELSE '现行有效' END AS status, CASE WHEN listed OR noted THEN 'official' WHEN own OR another OR later THEN 'inferred' ELSE 'default' END AS source FROM f)
SELECT doc_id, status, source, source = 'inferred' AND status = '已废止' AS needs_review FROM j""")
def judged_effects(s, d):
    """What is in force: relations of the whole collection are built and written first, then each document is judged."""
    docs, relations = _relations(s, d)
    return R.judge(docs, relations, AS_OF).drop("reason")


@query(f"""WITH RECURSIVE {_SQL_RELATIONS}, edge AS (SELECT DISTINCT src, dst FROM rel WHERE relation = 'repeals' AND dst IS NOT NULL),
walk(src, dst, steps) AS (SELECT src, dst, 1 FROM edge UNION SELECT w.src, e.dst, w.steps + 1 FROM walk w JOIN edge e ON e.src = w.dst WHERE w.steps < 60)
SELECT src, dst, min(steps)::INT AS steps FROM walk GROUP BY src, dst""")
def repeal_closure(s, d):
    """Who repeals whom, directly or through others, and in how many steps."""
    return R.repeal_closure(_relations(s, d)[1])


@query(f"""WITH {_SQL_RELATIONS} SELECT p.doc_id, count(*) FILTER (WHERE r.src = p.doc_id AND relation = 'cites') AS n_cites, count(*) FILTER (WHERE r.src = p.doc_id AND relation = 'cites' AND r.dst IS NULL) AS n_dangling,
count(*) FILTER (WHERE r.src = p.doc_id AND relation = 'repeals') AS n_repeals, count(DISTINCT r.src) FILTER (WHERE r.dst = p.doc_id AND relation = 'cites') AS n_citing,
min(r.src) FILTER (WHERE r.dst = p.doc_id AND relation = 'repeals') AS repealed_by FROM p LEFT JOIN rel r ON r.src = p.doc_id OR r.dst = p.doc_id GROUP BY p.doc_id""")
def relation_dossiers(s, d):
    """For each document: what it cites, how much of it is not in the collection, what it repeals, who cites it, and the
    first document that repeals it."""
    docs, relations = _relations(s, d)
    kind = lambda r: F.col("relation") == r
    out = relations.groupBy(F.col("src").alias("doc_id")).agg(F.count_if(kind("cites")).alias("n_cites"), F.count_if(kind("cites") & F.col("dst").isNull()).alias("n_dangling"), F.count_if(kind("repeals")).alias("n_repeals"))
    to = relations.filter("dst is not null").groupBy("dst", "relation").agg(F.countDistinct("src").alias("n"), F.min("src").alias("least"))
    to = to.groupBy(F.col("dst").alias("doc_id")).agg(F.max(F.when(kind("cites"), F.col("n"))).alias("n_citing"), F.min(F.when(kind("repeals"), F.col("least"))).alias("repealed_by"))
    return docs.select("doc_id").join(out, "doc_id", "left").join(to, "doc_id", "left").fillna(0, ["n_cites", "n_dangling", "n_repeals", "n_citing"])


@query(f"""WITH {_SQL_RELATIONS} SELECT key, n FROM (SELECT replace(dst_no, ' ', '') AS key, count(DISTINCT src) AS n FROM rel WHERE relation = 'cites' AND dst IS NULL GROUP BY 1) ORDER BY n DESC, key LIMIT 50""")
def dangling_references(s, d):
    """The 50 references that most documents make and the collection lacks; the limit is the feature."""
    missing = _relations(s, d)[1].filter("relation = 'cites' and dst is null")
    return missing.groupBy(F.replace("dst_no", F.lit(" "), F.lit("")).alias("key")).agg(F.countDistinct("src").alias("n")).orderBy(F.desc("n"), "key").limit(50)
