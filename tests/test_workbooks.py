"""Workbooks: reading and writing files, sheets as tables, edits of their shape."""

import io
import struct
import zipfile
from datetime import date, datetime, time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark import workbook
from gridspark.functions import formats
from gridspark.operators import structure
from gridspark.plans.cells import typed
from gridspark.sources import files, sinks, xls, xlsb, xlsx

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def package(sheet: str, extra: dict[str, str] | None = None, book: str = "", shared: str = "", styles: str = "") -> bytes:
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{rel}">{book}<sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets><definedNames><definedName name="Total">Data!$B$2:$B$3</definedName><definedName name="Own" localSheetId="0">Data!$A$1</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="x"><Relationship Id="rId1" Type="{rel}/worksheet" Target="/xl/worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}">{sheet}</worksheet>',
    } | (extra or {})
    if shared:
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">{shared}</sst>'
    if styles:
        parts["xl/styles.xml"] = f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


SHEET = (
    '<dimension ref="A1:D6"/><cols><col min="3" max="4" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>amount</t></is></c></row>'
    '<row r="2" hidden="1" outlineLevel="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>10.5</v></c><c r="C2" s="1"><v>44197.5</v></c><c r="D2"><f t="shared" ref="D2:D5" si="0">B2*2+$B$2</f><v>31.5</v></c></row>'
    '<row r="3"><c r="B3" t="n"><v>4</v></c><c r="D3"><f t="shared" si="0"/><v>18.5</v></c></row>'
    '<row r="5"><c><v>7</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c r="D5"><f t="array" ref="D5:E5">A5:B5</f><v>7</v></c><c r="E5"><v>1</v></c></row>'
    '<row r="6"><c r="A6" t="str" x="&gt;"><f>"a"&amp;"&lt;"</f><v>a&lt;</v></c><c r="B6" s="1"><v>0.25</v></c><c r="C6" s="1"><v>59</v></c></row></sheetData><mergeCells count="1"><mergeCell ref="A7:B8"/></mergeCells>'
)
SHARED = "<si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh sb='0' eb='1'><t>hint</t></rPh></si>"
STYLES = '<numFmts count="1"><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs>'


def test_cells_of_a_package():
    data = package(SHEET, shared=SHARED, styles=STYLES)
    got = {(r, c): (kind, v, f, how) for _, r, c, kind, v, f, how, _ in files.read_cells(data)}
    assert got[2, 1] == ("string", "rich", None, None) and got[1, 2][1] == "amount" and got[2, 2][1] == "10.5"
    assert got[2, 3][:2] == ("datetime", "2021-01-01 12:00:00") and got[6, 2][:2] == ("time", "06:00:00") and got[6, 3][:2] == ("date", "1900-02-28")
    assert got[2, 4][2:] == ("B2*2+$B$2", "shared") and got[3, 4][2:] == ("B3*2+$B$2", "shared") and got[3, 4][1] == "18.5"
    assert got[5, 1][1] == "7" and got[5, 2][:2] == ("bool", "true") and got[5, 3][:2] == ("error", "#N/A") and got[5, 4][3] == "array" and got[5, 5][3] == "spill"
    assert got[6, 1][:3] == ("string", "a<", '"a"&"<"')
    assert {(r, c) for _, r, c, *_ in files.read_cells(data, bounds=(2, 2, 3, 3))} == {(2, 2), (2, 3), (3, 2)}
    rows = dict(files.rows_of(files.read_cells(data), 8, 2))
    assert list(rows) == list(range(1, 9)) and rows[4] == rows[7] == [None, None] and rows[3] == [None, "4"]
    p = xlsx.Package(data)
    d = p.details("Data")
    assert (d.hidden_rows, d.hidden_columns, d.row_levels, d.merged, d.dimension) == ([2], [3, 4], {2: 2}, ["A7:B8"], "A1:D6")
    assert p.defined == {"Total": "Data!$B$2:$B$3", "Data!Own": "Data!$A$1"}
    assert {v for *_, v, _, _, _ in xlsx.Package(package(SHEET, shared=SHARED, styles=STYLES, book='<workbookPr date1904="1"/>')).cells() if v and v.startswith("20")} == {"2025-01-02 12:00:00"}


def test_limits_and_broken_books():
    data = package(SHEET, shared=SHARED)
    with pytest.raises(ValueError):
        list(files.read_cells(data, limits=xlsx.Limits(entries=2)))
    bare = package("<sheetData><row><c><v>1</v></c></row></sheetData>").replace(b'<sheet name="Data" sheetId="1" r:id="rId1"/>', b"")
    lost = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package("<sheetData><row><c><v>1</v></c></row></sheetData>"))) as old, zipfile.ZipFile(lost, "w") as new:
        for i in old.infolist():
            new.writestr(i, old.read(i).replace(b'<sheet name="Data" sheetId="1" r:id="rId1"/>', b""))
    assert bare and not list(files.read_cells(lost.getvalue())) and [c[:5] for c in files.read_cells(lost.getvalue(), permissive=True)] == [("Sheet1", 1, 1, "number", "1")]
    with pytest.raises(files.UnreadableWorkbook):
        list(files.read_cells(b"nothing of the kind"))
    with pytest.raises(files.UnreadableWorkbook):
        files.local("s3://bucket/x.xlsx")


def record(kind: int, body: bytes) -> bytes:
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    return head + bytes([len(body) & 0x7F | 0x80, len(body) >> 7]) + body


def wide(text: str) -> bytes:
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def xlsb_book() -> bytes:
    cell = lambda col, style, body: struct.pack("<II", col, style) + body
    sheet = b"".join([
        record(xlsb.ROW, struct.pack("<I", 0) + bytes(13)), record(xlsb.SHARED, cell(0, 0, struct.pack("<I", 1))), record(xlsb.TEXT, cell(1, 0, wide("plain"))),
        record(xlsb.ROW, struct.pack("<I", 4) + bytes(13)), record(xlsb.REAL, cell(0, 1, struct.pack("<d", 44197.0))), record(xlsb.RK, cell(1, 0, struct.pack("<I", (1234 << 2) | 3))), record(xlsb.BOOL, cell(2, 0, b"\x01")), record(xlsb.ERROR, cell(3, 0, b"\x2a")), record(xlsb.F_REAL, cell(4, 0, struct.pack("<d", 2.5) + bytes(8))),
    ])
    parts = {
        "xl/workbook.bin": record(xlsb.SHEET, struct.pack("<II", 0, 1) + wide("rId1") + wide("Bin")), "xl/_rels/workbook.bin.rels": b'<R xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.bin"/></R>', "xl/worksheets/sheet1.bin": sheet,
        "xl/sharedStrings.bin": record(xlsb.STRING_ITEM, b"\0" + wide("zero")) + record(xlsb.STRING_ITEM, b"\0" + wide("one")),
        "xl/styles.bin": record(xlsb.FORMAT, struct.pack("<H", 165) + wide("yyyy-mm-dd")) + record(xlsb.STYLES_BEGIN, b"") + record(xlsb.CELL_STYLE, struct.pack("<HH", 0, 0) + bytes(12)) + record(xlsb.CELL_STYLE, struct.pack("<HH", 0, 165) + bytes(12)) + record(xlsb.STYLES_END, b""),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_xlsb():
    data = xlsb_book()
    assert files.sniff(data) == "xlsb"
    got = {(r, c): (kind, v, how) for s, r, c, kind, v, _, how, _ in files.read_cells(data) if s == "Bin"}
    assert got == {(1, 1): ("string", "one", None), (1, 2): ("string", "plain", None), (5, 1): ("date", "2021-01-01", None), (5, 2): ("number", "12.34", None), (5, 3): ("bool", "true", None), (5, 4): ("error", "#N/A", None), (5, 5): ("number", "2.5", "cached")}


def xls_book() -> bytes:
    r = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    cell = lambda row, col, style=0: struct.pack("<HHH", row, col, style)
    text = lambda t: struct.pack("<HB", len(t), 0) + t.encode()
    strings = struct.pack("<II", 2, 2) + text("first") + struct.pack("<HB", 6, 0) + b"sec"
    head = r(0x809, bytes(16)) + r(0x41E, struct.pack("<H", 164) + text("dd/mm/yyyy")) + r(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + r(0xE0, struct.pack("<HH", 0, 164) + bytes(16))
    tail = r(0xFC, strings) + r(0x3C, b"\x01" + "ond".encode("utf-16-le")) + r(0x0A, b"")
    bound = lambda at: r(0x85, struct.pack("<IHBB", at, 0, 3, 0) + b"Old")
    at = len(head) + len(bound(0)) + len(tail)
    sheet = b"".join([
        r(0x809, bytes(16)), r(0xFD, cell(0, 0) + struct.pack("<I", 1)), r(0x203, cell(1, 0, 1) + struct.pack("<d", 44198)), r(0x27E, cell(1, 1) + struct.pack("<I", (7 << 2) | 2)), r(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<HIHI", 0, (1 << 2) | 2, 0, (250 << 2) | 3) + struct.pack("<H", 1)),
        r(0x205, cell(3, 0) + b"\x07\x01"), r(0x06, cell(3, 1) + struct.pack("<d", 1.5) + bytes(8)), r(0x06, cell(3, 2) + b"\0\0\0\0\0\0\xff\xff" + bytes(8)), r(0x207, text("said")), r(0x0A, b""),
    ])
    stream = head + bound(at) + tail + sheet
    stream += bytes(max(4096 - len(stream), -len(stream) % 512))
    n = -(-len(stream) // 512)
    entry = lambda name, kind, first, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, 1 if kind == 5 else 0xFFFFFFFF) + bytes(36) + struct.pack("<IQ", first, size)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *[k + 1 for k in range(2, n + 1)], 0xFFFFFFFE]
    header = xls.MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<I", 0) + b"\xff" * (108 * 4)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream))).ljust(512, b"\0")
    return header[:512] + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + directory + stream.ljust(n * 512, b"\0")


def test_xls():
    data = xls_book()
    assert files.sniff(data) == "xls"
    got = {(r, c): (kind, v) for s, r, c, kind, v, *_ in files.read_cells(data) if s == "Old"}
    assert got == {(1, 1): ("string", "second"), (2, 1): ("date", "2021-01-02"), (2, 2): ("number", "7"), (3, 1): ("number", "1"), (3, 2): ("number", "2.5"), (4, 1): ("error", "#DIV/0!"), (4, 2): ("number", "1.5"), (4, 3): ("string", "said")}


def test_ods():
    table = '<table:table table:name="T"><table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="3"/><table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="string" table:number-columns-repeated="2"><text:p>x</text:p></table:table-cell></table:table-row></table:table>'
    spaces = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
        z.writestr("content.xml", f"<office:document-content {spaces}><office:body><office:spreadsheet>{table}</office:spreadsheet></office:body></office:document-content>")
    assert [c[:5] for c in files.read_cells(out.getvalue())] == [("T", r, c, *v) for r in (1, 2) for c, v in ((1, ("number", "3")), (4, ("string", "x")), (5, ("string", "x")))]


def test_writer_keeps_all_partitions(spark, tmp_path):
    spark.dataSource.register(files.XlsxSource)
    path = str(tmp_path / "out.xlsx")
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "concat('n', id) AS name", "IF(id % 3 = 0, NULL, id / 2) AS half", "date_add(DATE'2020-01-01', cast(id AS int)) AS day", "id % 2 = 0 AS even")
    df.write.format("xlsx").mode("append").option("sheet", "All").save(path)
    back = workbook.open_workbook(spark, path)
    table = back["All"].table().orderBy("row").collect()
    assert back.sheetnames == ["All"] and [(r["id"], r["name"], r["half"], r["day"], r["even"]) for r in table] == [(float(i), f"n{i}", None if i % 3 == 0 else i / 2, date.fromordinal(date(2020, 1, 1).toordinal() + i), i % 2 == 0) for i in range(1000)]
    assert [p.name for p in tmp_path.iterdir()] == ["out.xlsx"]
    bad = spark.range(0, 100, 1, 4).selectExpr("IF(id = 77, double('nan'), id) AS v")
    with pytest.raises(Exception, match="can't be written|nan"):
        bad.write.format("xlsx").mode("overwrite").save(path)
    assert [p.name for p in tmp_path.iterdir()] == ["out.xlsx"] and len(list(files.read_cells(path))) == 1000 * 5 - 334 + 5


def test_buffers_and_modified_books(tmp_path):
    path = str(tmp_path / "b.xlsx")
    s = sinks.SheetBuffer("Data")
    s.append(["k", "v"])
    s.append([1, None, "=A2*2"])
    s.write_rows([[True, None], [datetime(2021, 1, 1, 12), time(6)]], 4, 2)
    s.save(path)
    got = {(r, c): (kind, v, f) for _, r, c, kind, v, f, *_ in files.read_cells(path)}
    assert got[2, 3] == ("blank", None, "A2*2") and got[4, 2][:2] == ("bool", "true") and got[5, 2][:2] == ("datetime", "2021-01-01 12:00:00") and got[5, 3][:2] == ("time", "06:00:00") and (3, 1) not in got
    sinks.modify(path, {}, str(tmp_path / "same.xlsx"))
    assert (tmp_path / "same.xlsx").read_bytes() == (tmp_path / "b.xlsx").read_bytes()
    sinks.modify(path, {("Data", 2, 1): 9, ("Data", 1, 2): None, ("Data", 3, 5): "new", ("Data", 5, 2): 44200}, blocks={"Data": {"mergeCells": '<mergeCells count="1"><mergeCell ref="A8:B9"/></mergeCells>'}})
    got = {(r, c): (kind, v) for _, r, c, kind, v, *_ in files.read_cells(path)}
    assert got[2, 1] == ("number", "9") and (1, 2) not in got and got[3, 5] == ("string", "new") and got[5, 2] == ("date", "2021-01-04") and got[4, 2] == ("bool", "true")
    assert xlsx.Package(path).details("Data").merged == ["A8:B9"]
    w = sinks.WriteOnlySheet()
    w.append([1, "a"])
    w.save(path)
    with pytest.raises(sinks.AlreadySaved):
        w.save(path)
    with pytest.raises(TypeError):
        w["A1"]
    assert [c[4] for c in files.read_cells(path)] == ["1", "a"]
    assert sinks.merge_blocks("<worksheet><sheetData/><pageMargins/></worksheet>", {"mergeCells": "<mergeCells/>", "cols": "<cols/>"}) == "<worksheet><cols/><sheetData/><mergeCells/><pageMargins/></worksheet>"
    plain, rest = files.split_typed([[1, True, "=A1"], ["x", None, date(2020, 1, 1)]], 2, 3)
    assert plain == [[1, None, None], ["x", None, None]] and rest == [(2, 4, True), (2, 5, "=A1"), (3, 5, date(2020, 1, 1))]


@pytest.fixture
def book(spark, tmp_path):
    table = '<table xmlns="%s" displayName="Costs" ref="A1:B3"><tableColumns><tableColumn name="name"/><tableColumn name="amount"/></tableColumns></table>' % MAIN
    rels = '<Relationships xmlns="x"><Relationship Id="r1" Type="a/table" Target="../tables/table1.xml"/></Relationships>'
    data = package(SHEET, {"xl/tables/table1.xml": table, "xl/worksheets/_rels/sheet1.xml.rels": rels}, shared=SHARED, styles=STYLES)
    (tmp_path / "w.xlsx").write_bytes(data)
    return workbook.open_workbook(spark, str(tmp_path / "w.xlsx"))


def test_a_workbook_as_a_catalogue(spark, book, tmp_path):
    s = book["Data"]
    assert s.dimension() == "A1:E6" and s.headers() == ["name", "amount", "", "", ""] and not s.is_stream()
    assert {(r["row"], r["values"][1]) for r in s.rows(max_col=2).collect()} == {(1, "amount"), (2, "10.5"), (3, "4"), (4, None), (5, "true"), (6, "06:00:00")}
    assert {r["col"]: r["values"][0] for r in s.columns("A2:B3").collect()} == {1: "rich", 2: "10.5"}
    assert s.within("B:B").count() == 5 and s.within("2:3").count() == 6 and s.within("A1").count() == 1
    assert {(r["coordinate"], r["data_type"]) for r in s.records("C2:D3", include_empty=True).collect()} == {("C2", "datetime"), ("D2", "formula"), ("C3", "blank"), ("D3", "formula")}
    assert s.visible().filter("row = 2 OR col > 2").count() == 2 or {(r["row"], r["col"]) for r in s.visible().collect()} == {(1, 1), (1, 2), (3, 2), (5, 1), (5, 2), (5, 5), (6, 1), (6, 2)}
    assert [r["amount"] for r in book.named("costs").orderBy("row").collect()] == [10.5, 4.0] and {r["value"] for r in book.named("TOTAL").collect()} == {"10.5", "4"}
    assert {r["formula_kind"] for r in s.array_formulas().collect()} == {"array", "spill"} and s.cached_values().count() == 4
    assert book.map()[0]["class"] == "data" or book.map()[0]["class"] == "summary"
    assert list(s.to_pandas("A1:B3")["amount"]) == [10.5, 4.0]
    assert "rich" in book.peek(n=1) and "1 of 5 rows shown" in book.peek(n=1) and book.peek(form="csv").startswith("name,amount,,,\n") and '"headers": ["name"' in book.peek(form="json") and "ERROR: #N/A" in book.peek(form="text")
    long = book.agent(1000)
    assert "Header: name" in long and "First rows:" in long and len(book.agent(20)) <= 80
    assert {r["row"]: r["value"] for r in book.calculate().filter("col = 4 AND row < 5").collect()} == {2: "31.5", 3: "18.5"}
    assert {(r["row"], r["new"]) for r in book.recalculate({"Data!B2": 1}).filter("row < 5").collect()} == {(2, 3.0), (3, 9.0)}
    book.create_sheet("Data")
    assert book.sheetnames == ["Data", "Data1"]
    book.move_sheet("Data1", -5)
    book.copy_worksheet("Data")
    book.rename_sheet("Data", "My Data")
    assert book.sheetnames == ["Data1", "My Data", "Data Copy"] and book.defined["Total"] == "'My Data'!$B$2:$B$3" and book.sheets["Data Copy"].details.tables[0].name != "Costs"
    book.remove_sheet("Data1")
    out = str(tmp_path / "again.xlsx")
    book.save(out)
    again = {(s, r, c): (v, f) for s, r, c, _, v, f, *_ in files.read_cells(out)}
    assert again["My Data", 3, 4][1] == "B3*2+$B$2" and again["Data Copy", 2, 1][0] == "rich"
    profile = {r["name"]: r["format"] for r in s.profile().collect()}
    assert profile["amount"] == "General"


def test_shapes():
    r = structure.Range.parse("B2:D8")
    assert str(r.expand(1, 2)) == "B2:E10" and str(r.shrink(1, 1)) == "B2:C7" and r.contains(2, 4) and not r.contains(9, 2) and str(r.union(structure.Range.parse("F1"))) == "B2:D8 F1"
    m = structure.Ranges("A1:B2 D4 F5:G9")
    assert "A2" in m and "C1" not in m and str(m.moved("row", 4, -1)) == "A1:B2 F4:G8"
    m.remove("D4")
    m.add("A1")
    assert str(m) == "A1:B2 F5:G9"
    assert structure.split_spans([(1, 3, "w"), (5, 9, "x")], 3, 2) == [(1, 2, "w"), (5, 5, "w"), (7, 11, "x")] and structure.split_spans([(1, 3, "w"), (5, 9, "x")], 2, -6) == [(1, 1, "w"), (2, 3, "x")]
    assert structure.shift_table("A1:C4", ["a", "b", "c"], "col", 2, -1) == ("A1:B4", ["a", "c"]) and structure.shift_table("A1:C4", ["a", "b", "Column1"], "col", 2, 1) == ("A1:D4", ["a", "Column2", "b", "Column1"]) and structure.shift_table("A1:C4", ["a"], "row", 1, -1) is None
    assert structure.coordinate_to_tuple("C5") == (5, 3) and structure.absolute_coordinate("a1:B2") == "$A$1:$B$2" and structure.range_to_tuple("'My S'!A1:B2") == ("My S", (1, 1, 2, 2)) and structure.cols_from_range("A1:B2") == [("A1", "A2"), ("B1", "B2")] and structure.column_interval("Y", "AB") == ["Y", "Z", "AA", "AB"]


def test_letters(spark):
    got = spark.range(1, 18279).select(structure.letters(F.col("id")).alias("v")).collect()
    assert [r["v"] for r in got] == [structure.column_letter(n) for n in range(1, 18279)]


def test_merged_cells(spark):
    cells = spark.createDataFrame([(r, c, f"{r}{c}") for r in range(1, 4) for c in range(1, 4)], "row int, col int, value string")
    one = structure.merge(cells, structure.Range(1, 1, 2, 2))
    assert one.count() == 6 and {r["value"] for r in structure.fill_merged(one, [structure.Range(1, 1, 2, 2)]).filter("row < 3 AND col < 3").collect()} == {"11"}


@pytest.mark.parametrize(("code", "kind"), [("General", "general"), ("0", "integer"), ("#,##0.00", "float"), ("0.0%", "percentage"), ('"$"#,##0', "currency"), ("[$€-407] #,##0", "currency"), ("yyyy-mm-dd", "date"), ("h:mm:ss", "time"), ("m/d/yy h:mm", "datetime"), ("0.00E+00", "scientific"), ("@", "text"), ("[h]:mm", "time"), ('0.00" days"', "float")])
def test_categories(code, kind):
    assert formats.category(code) == kind


def test_shown_values():
    assert [formats.display(v, f) for v, f in ((1234567, None), (0.2345, "0.0%"), (-1234.5, '"$"#,##0'), (12345.678, "0.00E+00"), (1.50, "0.00"), (True, None), (None, None), (2.0, None), (date(2020, 1, 2), None), (1e-12, None))] == ["1,234,567", "23.4%", "-$1,234.50", "1.2346e+04", "1.5", "true", "", "2", "2020-01-02", "0"]
    assert formats.from_excel(44197.5) == datetime(2021, 1, 1, 12) and formats.from_excel(0.5) == time(12) and formats.from_excel(1, date1904=True) == datetime(1904, 1, 2) and formats.from_excel(59) == datetime(1900, 2, 28) and formats.to_excel(datetime(1900, 2, 28)) == 59
    assert formats.BUILT_IN_FORMATS[14] == "mm-dd-yy" and typed("number", "2", None) == 2


def test_frames_as_rows():
    df = pd.DataFrame({"a": [1, None], "b": ["x", "y"]})
    assert workbook.dataframe_to_rows(df, index=False) == [["a", "b"], [1.0, "x"], [None, "y"]] and workbook.dataframe_to_rows(df)[:3] == [[None, "a", "b"], [None], [0, 1.0, "x"]]
