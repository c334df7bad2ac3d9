"""Readers over files made here, good ones and broken ones."""

import io
import zipfile

import pytest
from lexmill.sources import readers as R

TEXT = "根据财税〔2016〕36号，自2016年5月1日起施行。é\n第二行 second line"


def zipped(members: dict[str, str | bytes], method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def word(paragraphs):
    body = "".join("<w:p><w:r><w:t>" + p.replace("&", "&amp;").replace("<", "&lt;") + "</w:t></w:r></w:p>" for p in paragraphs)
    return zipped({"word/document.xml": f'<?xml version="1.0"?><w:document xmlns:w="{R._W[1:-1]}"><w:body>{body}</w:body></w:document>'})


def sheet(rows, shared=("甲", "乙&丙"), name="输入数据"):
    cells = "".join(f'<row r="{n}">' + "".join(f'<c r="{at}" t="{t}">{v}</c>' for at, t, v in row) + "</row>" for n, row in rows)
    strings = "".join(f"<si><t>{s.replace('&', '&amp;')}</t></si>" for s in shared)
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns="{R._S[1:-1]}" xmlns:r="{R._R[1:-1]}"><sheets><sheet name="{name}" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId7" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{R._S[1:-1]}">{strings}</sst>',
        "xl/worksheets/s.xml": f'<worksheet xmlns="{R._S[1:-1]}"><sheetData>{cells}</sheetData></worksheet>',
    })


def files(spark, contents):
    return spark.createDataFrame(list(enumerate(contents)), "file_id int, content binary")


def test_each_encoding(spark):
    names = ["utf-8-sig", "utf-8", "gb18030", "utf-16-le", "utf-16-be"]
    marks = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
    good = [(n, marks.get(n, b"") + TEXT.encode(n)) for n in names] + [("utf-16-le", "plain ascii".encode("utf-16-le")), ("utf-16-be", "plain ascii".encode("utf-16-be")), ("utf-8", b""), ("utf-8", b"x" * 100_000)]
    bad = [b"\xff\xfe\x00\xd8", b"\xef\xbb\xbf\xff", b"\x80\xff\xff", b"a\0b\0\0", bytes(range(256)), None]
    found = {r["file_id"]: r for r in R.decode_files(files(spark, [b for _, b in good] + bad)).collect()}
    want = [TEXT] * 5 + ["plain ascii"] * 2 + ["", "x" * 100_000]
    assert [(found[i]["text"], found[i]["encoding"], found[i]["error"]) for i in range(len(good))] == [(t, n, None) for (n, _), t in zip(good, want, strict=True)]
    assert all(found[len(good) + i]["text"] is None and found[len(good) + i]["error"] for i in range(len(bad)))
    assert R.decode_files(files(spark, [b"x"]).filter("false")).count() == 0


def test_word_and_sheet_documents(spark):
    book = sheet([(1, [("A1", "s", "<v>0</v>"), ("C1", "n", "<v>12.5</v>")]), (3, [("B3", "inlineStr", "<is><t>x</t><t>y</t></is>"), ("A3", "s", "<v>1</v>")]), (4, [])])
    found = R.read_containers(files(spark, [word(["第一段", "", "a < b & c"]), book, word([])])).collect()
    rows = [(r["file_id"], r["kind"], r["part"], r["n"], r["cells"], r["error"]) for r in found]
    assert rows == [(0, "docx", "document", 0, ["第一段"], None), (0, "docx", "document", 1, [""], None), (0, "docx", "document", 2, ["a < b & c"], None), (1, "xlsx", "输入数据", 0, ["甲", "", "12.5"], None), (1, "xlsx", "输入数据", 2, ["乙&丙", "xy"], None), (1, "xlsx", "输入数据", 3, [], None)]
    texts = {r["file_id"]: (r["n_rows"], r["text"]) for r in R.as_text(R.read_containers(files(spark, [word(["甲", "乙"]), book]))).collect()}
    assert texts == {0: (2, "甲\n乙"), 1: (3, "甲 |  | 12.5\n乙&丙 | xy\n")}
    many = R.read_containers(files(spark, [word([f"p{i}" for i in range(1500)])])).collect()
    assert [r["cells"] for r in many] == [[f"p{i}"] for i in range(1500)]


@pytest.mark.parametrize(
    ("raw", "kind", "error"),
    [
        (None, None, "no content"), (b"", None, "no content"), (b"%PDF-1.7", "pdf", "no reader of pdf"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1x", "ole2", "no reader of ole2"), (b"hello", "other", "no reader of other"),
        (b"PK\x03\x04rest", "zip", "broken: BadZipFile"), (zipped({"a.txt": "x"}), "zip", "no document inside"), (zipped({"word/document.xml": "<w:p"}), "docx", "broken: ParseError"), (zipped({"xl/workbook.xml": "<a/>"}), None, None),
        (zipped({"word/document.xml": "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>"}), "docx", "declares entities"), (zipped({"word/document.xml": b"<a>" + b" " * 70_000_000}), "docx", "unpacks to too much"),
        (zipped({"word/document.xml": b"<a>" + b" " * 9_000_000 + b"</a>"}), "docx", "unpacks to too much"), (zipped({f"x{i}": "" for i in range(2500)}), "zip", "holds too much"),
        (sheet([(1, [("A1", "s", "<v>99</v>")])]), "xlsx", "broken: IndexError"), (word(["x" * 50])[:-40], "zip", "broken: BadZipFile"), (sheet([(1, [("ZZZZZ1", "n", "<v>1</v>")])]), "xlsx", "a cell beyond the columns of a sheet"),
    ],
)
def test_broken_and_hostile_files(raw, kind, error):
    found = list(R.container_rows(raw))
    assert found == [] if error is None else found[-1] == (kind, None, None, None, error)


FIELDS = {"收入总额": ("revenue", "number"), "企业名称": ("company", "text"), "年度": ("year", "year"), "业务招待费": ("entertainment", "number")}


def test_templates(spark):
    row = lambda *cells: ("xlsx", "s", 0, list(cells), None)
    rows = [(1, *row("收入总额", "1234.5")), (1, *row(" 企业名称 ", "某公司")), (1, *row("年度", "2024.0")), (1, *row("业务招待费", "")), (1, *row("别的", "7")), (1, *row()), (2, *row("收入总额", "100,000元")), (2, *row("年度", "24")), (2, *row("业务招待费", "1")), (2, *row("业务招待费", "2")), (2, *row("企业名称", None)), (3, "zip", None, None, None, "broken: BadZipFile")]
    frame = spark.createDataFrame(rows, "file_id int, kind string, part string, n int, cells array<string>, error string")
    found = sorted(map(str, map(tuple, R.template_values(frame, FIELDS).collect())))
    assert found == sorted(map(str, [(1, "revenue", "1234.5", 1234.5, None), (1, "company", "某公司", None, None), (1, "year", "2024.0", 2024.0, None), (2, "revenue", "100,000元", None, "not a number"), (2, "year", "24", None, "not a year"), (2, "entertainment", "1", None, "stated twice"), (3, None, None, None, "broken: BadZipFile")]))
