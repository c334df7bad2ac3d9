"""Readers of files held in a binary column: text in several encodings, word and sheet documents, filled-in templates.

A file that can't be read is a row with an error, never a failed job and never an empty value.
"""

import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds on a container: members, bytes of a member and of all of them when unpacked, and how often unpacking may multiply.
MEMBERS, MEMBER_BYTES, ALL_BYTES, RATIO = 2000, 64_000_000, 256_000_000, 200
#: Rows of a file in one Arrow batch.
ROWS = 512

# ------------------------------------------------------------------ encodings

_BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def _plausible(text: str) -> bool:
    """Without control, unassigned or private characters, which a wrong decoding makes."""
    return all(c.isprintable() or c in "\t\n\r\f\v\x1b　\xa0​﻿\xad" or c.isspace() for c in text)


def decoded(raw: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, error) of one file: by its mark of order if it has one, else as UTF-8, GB18030 or UTF-16, the first
    that decodes without an error to text that may be meant. Empty files are empty texts."""
    if raw is None:
        return None, None, "no content"
    for mark, name in _BOMS:
        if raw.startswith(mark):
            try:
                return raw[len(mark) :].decode("utf-8" if name == "utf-8-sig" else name), name, None
            except UnicodeDecodeError:
                return None, None, f"not {name} in spite of its mark"
    wide = ["utf-16-le", "utf-16-be"] if raw[1:2] == b"\0" or raw[0:1] != b"\0" else ["utf-16-be", "utf-16-le"]
    for name in ["utf-8", "gb18030", *(wide if len(raw) % 2 == 0 else [])]:
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if "\0" not in text and (name == "utf-8" or _plausible(text)):
            return text, name, None
    return None, None, "undecodable"


def decode_files(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, text, encoding, error) of each row. What is valid UTF-8 stays in the JVM; only the rest goes to Python."""
    raw = F.col(content).cast("binary")
    plain = F.is_valid_utf8(raw.cast("string")) & ~F.contains(raw.cast("string"), F.lit("\0")) & ~F.hex(F.substring(raw, 1, 3)).isin("EFBBBF") & raw.isNotNull()
    rows = files.select(key, raw.alias("raw"), F.coalesce(plain, F.lit(False)).alias("plain"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [decoded(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], pa.string()) for i in range(3)]], [key, "text", "encoding", "error"])

    quick = rows.filter("plain").select(key, F.col("raw").cast("string").alias("text"), F.lit("utf-8").alias("encoding"), F.lit(None).cast("string").alias("error"))
    return quick.unionByName(rows.filter("not plain").select(key, "raw").mapInArrow(run, f"{key} {kind}, text string, encoding string, error string"))


# ------------------------------------------------------------------ containers

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Refused(ValueError):
    """A file that is not read, and why."""


def _member(box: zipfile.ZipFile, name: str) -> BytesIO:
    """A member within the bounds. Its stated size is not believed: no more than the bound is unpacked."""
    info = box.getinfo(name)
    with box.open(info) as f:
        data = f.read(MEMBER_BYTES + 1)
    if len(data) > MEMBER_BYTES or len(data) > max(1_000_000, RATIO * max(1, info.compress_size)):
        raise Refused("unpacks to too much")
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise Refused("declares entities")
    return BytesIO(data)


def _elements(data: BytesIO, tag: str):
    """Whole elements of a tag one after the other; what has been read is let go."""
    root = None
    for event, e in ElementTree.iterparse(data, ("start", "end")):
        root = e if root is None else root
        if event == "end" and e.tag == tag:
            yield e
            root.clear()


def _paragraph(e) -> str:
    marks = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda _: "\t", f"{_W}br": lambda _: "\n"}
    return "".join(marks[x.tag](x) for x in e.iter() if x.tag in marks)


def word_rows(box: zipfile.ZipFile):
    """(part, n, cells) of each paragraph of a word document."""
    for n, e in enumerate(_elements(_member(box, "word/document.xml"), f"{_W}p")):
        yield "document", n, [_paragraph(e)]


def _place(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(box: zipfile.ZipFile):
    """(part, n, cells) of each row of each sheet in its order; n is the row's number there, from 0."""
    names = set(box.namelist())
    shared = ["".join(t.text or "" for t in e.iter(f"{_S}t")) for e in _elements(_member(box, "xl/sharedStrings.xml"), f"{_S}si")] if "xl/sharedStrings.xml" in names else []
    book = ElementTree.parse(_member(box, "xl/workbook.xml")).getroot()
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.parse(_member(box, "xl/_rels/workbook.xml.rels")).getroot()}
    for i, sheet in enumerate(book.iter(f"{_S}sheet"), 1):
        target = targets.get(sheet.get(f"{_R}id"), f"worksheets/sheet{i}.xml").lstrip("/")
        for row in _elements(_member(box, target if target.startswith("xl/") else f"xl/{target}"), f"{_S}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{_S}c")):
                at = _place(c.get("r", "")) if c.get("r") else k
                value = c.findtext(f"{_S}v")
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                if not 0 <= at < 16_384:
                    raise Refused("a cell beyond the columns of a sheet")
                cells[at] = value or ""
            yield sheet.get("name", str(i)), int(row.get("r", 0)) - 1, [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]


def container_rows(raw: bytes | None):
    """(kind, part, n, cells, error) of each paragraph or row of a file, told by its bytes and not by its name."""
    if not raw:
        yield None, None, None, None, "no content"
        return
    kind = "ole2" if raw.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1") else "pdf" if raw.startswith(b"%PDF") else "zip" if raw.startswith(b"PK\x03\x04") else "other"
    if kind != "zip":
        yield kind, None, None, None, f"no reader of {kind}"
        return
    try:
        with zipfile.ZipFile(BytesIO(raw)) as box:
            infos = box.infolist()
            if len(infos) > MEMBERS or sum(i.file_size for i in infos) > ALL_BYTES:
                raise Refused("holds too much")
            names = {i.filename for i in infos}
            kind = "docx" if "word/document.xml" in names else "xlsx" if "xl/workbook.xml" in names else kind
            if kind == "zip":
                raise Refused("no document inside")
            for part, n, cells in word_rows(box) if kind == "docx" else sheet_rows(box):
                yield kind, part, n, cells, None
    except (Refused, zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, NotImplementedError, EOFError, OSError, RuntimeError) as e:
        yield kind, None, None, None, str(e) if isinstance(e, Refused) else f"broken: {type(e).__name__}"
    except Exception as e:  # zlib has an error class of its own; anything else about the bytes is the file's fault too
        yield kind, None, None, None, f"broken: {type(e).__name__}"


def read_containers(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, kind, part, n, cells, error): the paragraphs of word documents and the rows of sheets, in files told by their
    bytes. Rows read before an error stand, and the error is a row of its own. Rows are streamed: a task holds one file
    and the member that is read, both within the bounds above. Repeated files give repeated rows."""
    kind = files.schema[key].dataType.simpleString()
    columns = f"{key} {kind}, kind string, part string, n int, cells array<string>, error string"

    def run(batches):
        types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list = []
                one = batch.column(0).slice(i, 1)

                def flush(rows, one=one):
                    keys = pa.concat_arrays([one] * len(rows))
                    return pa.RecordBatch.from_arrays([keys, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], [c.split(" ")[0] for c in columns.split(", ")])

                for row in container_rows(batch.column(1)[i].as_py()):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    return files.select(key, F.col(content).cast("binary").alias("content")).mapInArrow(run, columns)


def as_text(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, n_rows, text): the rows of each file that was read without an error, a line each, cells between bars."""
    good = rows.filter("error is null").withColumn("line", F.array_join("cells", " | "))
    return good.groupBy(key).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("part", "n", "line"))).alias("lines")).select(key, "n_rows", F.array_join("lines.line", "\n").alias("text"))


# ------------------------------------------------------------------ templates


def template_values(rows: DataFrame, fields: dict[str, tuple[str, str]], key: str = "file_id") -> DataFrame:
    """(key, field, value, number, error): the fields that a filled-in template states, and what is wrong with them.

    `fields` maps a label to (field, kind), kind being text, number or year. A label stands in the first cell of a row and
    its value in the second. A field left empty has no row, but one whose value isn't of its kind is a row with an error
    and no number: it is never zero. A label stated twice with different values is an error too; files that could not be
    read give one row with their error. Rows with other labels are passed over.
    """
    known = F.create_map(*[x for label, (name, kind) in fields.items() for x in (F.lit(label), F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind")))])
    label, value = F.trim(F.get("cells", 0)), F.trim(F.get("cells", 1))
    stated = rows.filter("error is null").select(key, known[label].alias("f"), value.alias("value")).filter(F.col("f").isNotNull() & F.col("value").isNotNull() & (F.col("value") != ""))
    one = stated.groupBy(key, F.col("f.field").alias("field"), F.col("f.kind").alias("kind")).agg(F.min("value").alias("value"), F.countDistinct("value").alias("n"))
    number = F.col("value").try_cast("double")
    whole = F.when(F.col("value").rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), number)
    checked = F.when(F.col("kind") == "number", whole).when(F.col("kind") == "year", F.when((whole == F.floor(whole)) & whole.between(1900, 2999), whole))
    error = F.when(F.col("n") > 1, "stated twice").when((F.col("kind") != "text") & checked.isNull(), F.concat(F.lit("not a "), "kind"))
    found = one.select(key, "field", "value", F.when(error.isNull(), checked).alias("number"), error.alias("error"))
    unread = rows.filter("error is not null").select(key, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("number"), "error").distinct()
    return found.unionByName(unread)
