"""Queries over files and pages: decoding, office documents, templates, detail pages.

The tables hold no files, so each query first makes one of every row, in a map of its own: what is compared with SQL is
what the readers give back.
"""

import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.plans.registered import query
from lexmill.plans.storage import new_folder, table
from lexmill.sources import pages as P
from lexmill.sources import readers as R
from lexmill.streaming.maintenance import Held

_CLEAN = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
_ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "utf-16-le", "utf-16-be")
_MARKS = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}


def _made(s, d, make):
    """(file_id, content) of each row of documents with a doc_id: make(doc_id, text without control characters)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                raw = [make(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["file_id", "content"])

    docs = table(s, d, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("file_id"), F.regexp_replace(F.coalesce("text", F.lit("")), _CLEAN, " ").alias("text"))
    return docs.mapInArrow(run, "file_id long, content binary")


def _encoded(i, text):
    if i % 6 == 5:
        return b"\x80\xff" + text.encode() + b"\xff" * (1 + len(text.encode()) % 2)
    name = _ENCODINGS[i % 6]
    return _MARKS.get(name, b"") + text.encode(name)


_SQL_TEXT = rf"regexp_replace(coalesce(text, ''), '{_CLEAN}', ' ', 'g')"


@query(f"""SELECT doc_id AS file_id, CASE doc_id % 6 WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN CASE WHEN strlen(t) = len(t) THEN 'utf-8' ELSE 'gb18030' END WHEN 3 THEN 'utf-16-le' WHEN 4 THEN 'utf-16-be' WHEN 5 THEN NULL ELSE 'utf-8' END AS encoding,
CASE WHEN doc_id % 6 < 5 THEN sha256(t) END AS digest, CASE WHEN doc_id % 6 = 5 THEN 'undecodable' END AS error FROM (SELECT doc_id, {_SQL_TEXT} AS t FROM documents WHERE doc_id IS NOT NULL)""")
def decoded_files(s, d):
    """Every text as a file in one of five encodings, or as bytes of none, decoded without being told which."""
    return R.decode_files(_made(s, d, _encoded)).select("file_id", "encoding", F.sha2("text", 256).alias("digest"), "error")


def _office(i, text):
    lines, out = text.split("\n"), BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if i % 2:
            rows = "".join(f'<row r="{n}"><c r="A{n}"><v>{n}</v></c><c r="B{n}" t="inlineStr"><is><t>{escape(x)}</t></is></c></row>' for n, x in enumerate(lines, 1))
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{R._S[1:-1]}"><sheets><sheet name="s"/></sheets></workbook>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{R._S[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
        else:
            body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
            z.writestr("word/document.xml", f'<w:document xmlns:w="{R._W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()[: -30 if i % 17 == 0 else None]


@query(f"""SELECT doc_id AS file_id, len(lines) AS n_rows, sha256(array_to_string(CASE WHEN doc_id % 2 = 0 THEN lines ELSE list_transform(lines, lambda x, i: i || ' | ' || x) END, chr(10))) AS digest, NULL AS error
FROM (SELECT doc_id, string_split({_SQL_TEXT}, chr(10)) AS lines FROM documents WHERE doc_id % 17 <> 0) UNION ALL SELECT doc_id, NULL, NULL, 'broken: BadZipFile' FROM documents WHERE doc_id % 17 = 0""")
def office_files(s, d):
    """Every text as a word document or a sheet, some of them cut off, read by their bytes."""
    rows = R.read_containers(_made(s, d, _office))
    good = R.as_text(rows).select("file_id", "n_rows", F.sha2("text", 256).alias("digest"), F.lit(None).cast("string").alias("error"))
    bad = rows.filter("error is not null").select("file_id", F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("string").alias("digest"), "error")
    return good.unionByName(bad)


# Labels of the template.
FIELDS = {"企业名称": ("company", "text"), "所属年度": ("year", "year"), "营业收入": ("revenue", "number"), "业务招待费": ("entertainment", "number"), "公益性捐赠": ("donation", "number")}
_CELLS = [
    ("企业名称", "c_name"),
    ("所属年度", "CAST(CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 100 ELSE 2000 + c_custkey % 40 END AS {s})"),
    ("营业收入", "CAST(c_acctbal AS {s})"),
    ("业务招待费", "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '100,000元' WHEN 2 THEN '１２３' ELSE CAST(c_custkey * 10 AS {s}) END"),
    ("公益性捐赠", "CAST(c_custkey AS {s})"),
    ("公益性捐赠", "CAST(c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS {s})"),
    ("备注", "'x'"),
]
_SQL_CELLS = "VALUES " + ", ".join(f"('{label}', {value.format(s='VARCHAR')})" for label, value in _CELLS)


@query(f"""WITH c AS (SELECT c_custkey AS file_id, label, value FROM customer, LATERAL ({_SQL_CELLS}) t(label, value)),
k AS (SELECT file_id, CASE label WHEN '企业名称' THEN 'company' WHEN '所属年度' THEN 'year' WHEN '营业收入' THEN 'revenue' WHEN '业务招待费' THEN 'entertainment' WHEN '公益性捐赠' THEN 'donation' END AS field, min(value) AS value, count(DISTINCT value) AS n FROM c WHERE label <> '备注' AND value <> '' GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN field = 'company' THEN NULL WHEN NOT regexp_full_match(value, '[+-]?[0-9]+([.][0-9]*)?') THEN NULL WHEN field = 'year' AND NOT try_cast(value AS DOUBLE) BETWEEN 1900 AND 2999 THEN NULL ELSE try_cast(value AS DOUBLE) END AS number FROM k)
SELECT file_id, field, value, CASE WHEN n = 1 THEN number END AS number, CASE WHEN n > 1 THEN 'stated twice' WHEN field <> 'company' AND number IS NULL THEN CASE field WHEN 'year' THEN 'not a year' ELSE 'not a number' END END AS error FROM v""")
def template_fields(s, d):
    """A filled-in template of each customer: values by field, and errors where a value isn't one."""
    cells = F.array(*[F.array(F.lit(label), F.expr(value.format(s="STRING"))) for label, value in _CELLS])
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("file_id"), F.explode(cells).alias("cells"), F.lit(None).cast("string").alias("error"))
    return R.template_values(rows, FIELDS)


@query()
def page_details(s, d):
    """What detail pages say: each page of the table with an article's number, status and day put into it."""
    own = (("article", "class", ""), ("main", "class", ""), (None, "id", "content"), *P.SELECTORS, ("article", "lang", ""), ("body", "class", ""))
    i = F.col("page_id")
    said = F.concat(F.lit("<h5>财税〔"), 2000 + i % 25, F.lit("〕"), i, F.lit("号</h5><div class='arc_date'>成文日期："), 2000 + i % 20, F.lit("-0"), 1 + i % 9, F.lit("-1"), i % 10, F.when(i % 3 == 0, " 全文废止").otherwise(" 现行有效"), F.lit("</div><div class='article'><p>本办法自"), 2001 + i % 20, F.lit("年1月1日起施行。"))
    rows = table(s, d, "pages").withColumn("html", F.concat(said, F.regexp_replace(F.coalesce("html", F.lit("")), "(?i)</?(html|body|head)[^>]*>", ""), F.lit("</p></div><a href='/f/"), i, F.lit(".pdf'>file</a>")))
    found = P.details(rows, selectors=own)
    return found.select("page_id", "title", F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_sha256"), F.length("body").alias("n_body"), "number", "status", "written", "effective", F.size("attachments").alias("n_files"))


_ARRIVALS = 5


@query(f"""WITH e AS (SELECT event_id, user_id, ts, value, event_id % {_ARRIVALS} AS arrival FROM events), h AS (SELECT arrival, max(ts) AS latest FROM e GROUP BY 1),
j AS (SELECT e.*, e.ts < (SELECT max(latest) FROM h WHERE h.arrival < e.arrival) - INTERVAL 10 DAYS AS late FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM j WHERE late IS NOT TRUE)
SELECT 'held' AS state, event_id, user_id, ts, value FROM k WHERE nth = 1 UNION ALL SELECT 'late', event_id, user_id, ts, value FROM j WHERE late""")
def maintained_events(s, d):
    """The last event of each user, held by a stream that takes in all events in five arrivals, with those that came too late."""
    path = new_folder(s)
    events = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    held = Held(f"{path}/held", events.schema, "user_id", "ts", ("event_id",), "10 days")
    for i in range(_ARRIVALS):
        events.filter(F.col("event_id") % _ARRIVALS == i).write.mode("append").parquet(f"{path}/arrived")
        held.run(s.readStream.schema(events.schema).parquet(f"{path}/arrived"), f"{path}/checkpoint")
    late = held.rejected(s).select(F.lit("late").alias("state"), *events.columns)
    return held.now(s).select(F.lit("held").alias("state"), *events.columns).unionByName(late)
