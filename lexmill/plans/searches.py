"""Searches over the posting index, each a page of one envelope: place, total, whether there is more, mode, and hint."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import postings as P
from lexmill.plans.registered import query
from lexmill.plans.relations import _HEAD
from lexmill.plans.storage import new_folder, table

_COLUMNS = {
    "doc_id": "doc_id", "title": _HEAD, "number": "concat('no ', 2010 + doc_id % 15, '-', doc_id)", "issuer": "source", "text": "text", "keywords": "lang", "day": "CAST(concat(2000 + doc_id % 20, '-0', 1 + doc_id % 9, '-1', doc_id % 10) AS DATE)",
    "number_year": "CASE WHEN doc_id % 7 > 0 THEN 2010 + doc_id % 15 END", "in_year": "CAST(doc_id % 1000 AS INT)", "tier": "CAST(doc_id % 3 AS INT)", "is_official": "CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 10 < 5 THEN 1 END",
}
_SELECT = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _COLUMNS.items()) + " FROM documents WHERE doc_id IS NOT NULL"
_CELLS = list(P.WEIGHTS)


def _sql_count(column: str, term: str) -> str:
    return f"(len(lower(coalesce({column}, ''))) - len(replace(lower(coalesce({column}, '')), '{term}', ''))) / {len(term)}"


def _sql_page(label: str, rows: str, order: str, limit: int, offset: int, mode: str) -> str:
    """rows: a query with doc_id, title, day, score and whatever `order` needs."""
    return f"""SELECT '{label}' AS search, g.place, g.doc_id, g.title, g.day, g.score, t.total, coalesce(g.place IS NOT NULL AND t.total > {limit + offset}, false) AS has_more, '{mode}' AS mode,
      CASE WHEN g.place IS NULL THEN 'no_hits' WHEN t.total > {limit + offset} THEN 'more' END AS hint FROM (SELECT count(*) AS total FROM ({rows})) t LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({rows})) WHERE place BETWEEN {offset + 1} AND {offset + limit}) g ON true"""


def _sql_ranked(terms: list[str]) -> str:
    tf = [" + ".join(f"{w} * {_sql_count(c, t)}" for c, w in P.WEIGHTS.items()) for t in terms]
    size = " + ".join(f"greatest(len(coalesce({c}, '')) - 2, 0)" for c in _CELLS)
    part = "greatest(ln((docs - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))"
    return f"""SELECT *, round({" + ".join(part.format(i=i) for i in range(len(terms)))}, 6) AS score FROM (SELECT *, {size} AS size, {", ".join(f"{x} AS tf{i}" for i, x in enumerate(tf))} FROM d) x,
      (SELECT count(*) AS docs, avg({size}) AS mean FROM d) y, (SELECT {", ".join(f"count(*) FILTER (WHERE {x} > 0) AS df{i}" for i, x in enumerate(tf))} FROM d) z WHERE coalesce(is_official, 1) = 1 AND {" AND ".join(f"tf{i} > 0" for i in range(len(terms)))}"""


_BY_SCORE = "score DESC, tier, day DESC, doc_id DESC"
_LIKE = " AND ".join(f"(contains(lower(coalesce(title, '')), '{t}') OR contains(lower(coalesce(text, '')), '{t}'))" for t in ("de", "xa"))
_PAGES = [
    _sql_page("ranked", _sql_ranked(["license", "ation"]), _BY_SCORE, 20, 0, "phrases"),
    _sql_page("across columns", _sql_ranked(["src1", "ation"]), _BY_SCORE, 50, 10, "phrases"),
    _sql_page("short", f"SELECT *, CASE WHEN contains(lower(title), 'de') THEN 1.0 ELSE 0.0 END AS score FROM d WHERE coalesce(is_official, 1) = 1 AND {_LIKE}", _BY_SCORE, 10, 0, "like"),
    _sql_page("browse", "SELECT *, 0.0 AS score FROM d WHERE coalesce(is_official, 1) = 1 AND keywords = 'fr' AND day >= DATE '2005-01-01' AND day < DATE '2012-01-01'", "number_year DESC NULLS LAST, in_year DESC NULLS LAST, doc_id DESC", 15, 5, "filter"),
    _sql_page("none", "SELECT *, 0.0 AS score FROM d WHERE contains(text, 'zzqqzz')", _BY_SCORE, 10, 0, "phrases"),
]


@query(f"WITH d AS ({_SELECT}) " + " UNION ALL ".join(_PAGES))
def posting_searches(s, d):
    """Five searches over one index of all documents: ranked phrases, terms that hit different columns, a short term, browsing
    by filters in the order of numbers, and one that hits nothing. Their limits are the pages'."""
    path = new_folder(s)
    P.append(table(s, d, "documents").filter("doc_id is not null").selectExpr(*[f"{e} AS {c}" for c, e in _COLUMNS.items()]), path, 0)
    browsed = (F.col("keywords") == "fr") & (F.col("day") >= "2005-01-01") & (F.col("day") < "2012-01-01")
    asked = {
        "ranked": P.Search(["License", "ation"], limit=20), "across columns": P.Search(["src1", "ation"], limit=99, offset=10), "short": P.Search(["de", "xa"]),
        "browse": P.Search(where=browsed, sort="number_desc", limit=15, offset=5), "none": P.Search(["zzqqzz"]),
    }
    return reduce(DataFrame.unionByName, [P.search(s, path, q).withColumn("search", F.lit(label)) for label, q in asked.items()])
