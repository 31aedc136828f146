"""Workbook and text sources and sinks as Spark plans around them: which format a file has, scans, and a writer of sheets.

Cells come in long form, a row for each cell that isn't empty. A workbook is one task's, and is read as a stream."""

from __future__ import annotations

import io
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, time
from pathlib import PurePosixPath

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.formats import is_date_format, to_excel
from ..operators.structure import column_letter
from ..plans.syntax import LAST_COL, LAST_ROW, parse_reference
from . import ods, xls, xlsb
from .xlsx import FIELDS, SCHEMA, Limits, Package, serial_to_datetime

__all__ = ["EXTENSIONS", "XlsxSource", "is_date_format", "serial_to_datetime"]

EXTENSIONS = {"xlsx": "xlsx", "xlsm": "xlsx", "xlam": "xlsx", "xls": "xls", "xla": "xls", "xlsb": "xlsb", "ods": "ods", "csv": "csv", "tsv": "csv", "txt": "csv"}


class UnreadableWorkbook(ValueError):
    pass


def sniff(data: bytes) -> str:
    """xls, xlsb, xlsx, ods, encrypted or unknown, by content."""
    if data.startswith(xls.MAGIC):
        try:
            return "encrypted" if "EncryptedPackage" in xls.streams(data) else "xls"
        except Exception:  # a file that only begins like one
            return "xls"
    if data.startswith(b"PK"):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            return "unknown"
        if "xl/workbook.bin" in names:
            return "xlsb"
        if "xl/workbook.xml" in names:
            return "xlsx"
        if {"mimetype", "content.xml"} <= names:
            return "ods"
    return "unknown"


def classify(source) -> tuple[str, bytes | None, str | None]:
    """Format, bytes and path of a path, bytes-like or file object. Content tells; the extension where it doesn't."""
    if isinstance(source, (bytes, bytearray, memoryview)):
        return sniff(bytes(source)), bytes(source), None
    if hasattr(source, "read"):
        data = source.read()
        return sniff(data), data, None
    path = local(os.fspath(source))
    with open(path, "rb") as f:
        head = f.read(8)
        kind = sniff(head + f.read()) if head.startswith((b"PK", xls.MAGIC)) else "unknown"
    return (format_of(path) if kind == "unknown" and format_of(path) == "csv" else kind), None, path


def format_of(path: str) -> str:
    ext = PurePosixPath(path).suffix.lstrip(".").lower()
    if ext not in EXTENSIONS:
        raise UnreadableWorkbook(f"no reader for .{ext} files")
    return EXTENSIONS[ext]


def local(path: str) -> str:
    """A path that this machine can open; other stores are read with read_workbooks()."""
    if re.match(r"^\w[\w+.-]+:", path) and not path.startswith("file:"):
        raise UnreadableWorkbook(f"{path}: only paths that every executor can open; read_workbooks() reads other stores")
    return re.sub("^file:/{0,2}(?=/)", "", path)


def read_cells(source, sheet: str | None = None, bounds: tuple[int, int, int, int] | None = None, limits: Limits | None = None, permissive: bool = False) -> Iterator[tuple]:
    """Cells of a workbook of any format that is read (path, bytes or file object), as FIELDS has them."""
    kind, data, path = classify(source)
    if kind == "xlsx":
        yield from Package(path or data, limits, permissive).cells(sheet, bounds)
        return
    if kind in ("encrypted", "unknown", "csv"):
        raise UnreadableWorkbook({"encrypted": "the workbook is encrypted: decrypt it first", "unknown": "not a workbook"}.get(kind, "text files are read with read_csv()"))
    if path:
        with open(path, "rb") as f:
            data = f.read()
    found = xlsb.Book(io.BytesIO(data), limits).cells(sheet) if kind == "xlsb" else xls.Book(data).cells(sheet) if kind == "xls" else ods.cells(data, sheet, limits)
    top, left, bottom, right = bounds or (1, 1, LAST_ROW, LAST_COL)
    yield from (c for c in found if top <= c[1] <= bottom and left <= c[2] <= right)


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV or TSV file with a header: every cell stays text; types are left to the profile. Fields with line ends keep a file
    in one task; multi_line=False lets Spark split large files where there are none."""
    return spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",", quote='"', escape='"', multiLine=multi_line, inferSchema=False)


def rows_of(cells: Iterator[tuple], max_row: int | None = None, width: int | None = None) -> Iterator[tuple[int, list]]:
    """(row, values) of one sheet's cells, every row from 1 on: missing rows are blank, up to max_row if given."""
    at, held = 1, {}

    def values() -> list:
        n = width or max(held, default=0)
        return [held.get(c) for c in range(1, n + 1)]

    for _, row, col, _, value, *_ in cells:
        while at < row:
            yield at, values()
            held, at = {}, at + 1
        held[col] = value
    if held:
        yield at, values()
        held, at = {}, at + 1
    while max_row and at <= max_row:
        yield at, values()
        at += 1


class _Part(InputPartition):
    def __init__(self, path: str, sheet: str | None):
        super().__init__((path, sheet))
        self.path, self.sheet = path, sheet


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.sheet = [local(p) for p in options["path"].split(",")], options.get("sheet")
        self.bounds = parse_reference(options["range"]).bounds() if options.get("range") else None
        self.permissive = str(options.get("permissive", "")).lower() == "true"
        number = lambda n, default: int(options.get(n, default))
        d = Limits()
        self.limits = Limits(number("maxentries", d.entries), number("maxentrybytes", d.entry_bytes), number("maxbytes", d.total_bytes), number("maxratio", d.ratio))

    def partitions(self) -> list[_Part]:
        """A task for each sheet of each file."""
        out = []
        for p in self.paths:
            names = [self.sheet] if self.sheet else list(Package(p, self.limits, self.permissive).sheets) if classify(p)[0] == "xlsx" else [None]
            out += [_Part(p, n) for n in names or [None]]
        return out

    def read(self, partition: _Part):
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), *(pa.string(),) * 5)
        batch: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*batch, strict=True))
            arrays = [pa.array([partition.path] * len(batch), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds[1:], strict=True))]
            return pa.RecordBatch.from_arrays(arrays, ["file", *FIELDS])

        for c in read_cells(partition.path, partition.sheet, self.bounds, self.limits, self.permissive):
            batch.append(c)
            if len(batch) == 20_000:
                yield made()
                batch.clear()
        if batch:
            yield made()


@dataclass
class _Wrote(WriterCommitMessage):
    part: int
    path: str
    rows: int


class XlsxWriter(DataSourceWriter):
    """Each task writes its rows beside the target; the commit lays the parts end to end, in order of partitions, into one
    workbook, and puts it in place by a rename. Nothing is left where the job fails."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.sheet, self.names = local(options["path"]), options.get("sheet", "Sheet"), schema.names
        self.header = str(options.get("header", "true")).lower() == "true"
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(f"{self.path} exists: mode overwrite replaces it")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        task = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        path, rows = f"{self.folder}/{task.partitionId():08d}-{task.taskAttemptId()}", 0
        with open(path, "wb") as f:
            for row in iterator:
                f.write(row_xml(row).encode())
                rows += 1
        return _Wrote(task.partitionId(), path, rows)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.part)
        total = sum(m.rows for m in parts) + self.header
        if total > LAST_ROW:
            self.abort(messages)
            raise ValueError(f"{total} rows: a sheet has {LAST_ROW}")

        def chunks() -> Iterator[bytes]:
            if self.header:
                yield row_xml(self.names).encode()
            for m in parts:
                with open(m.path, "rb") as f:
                    while data := f.read(1 << 20):
                        yield data

        try:
            write_package(self.path, {self.sheet: chunks()})
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class XlsxSource(DataSource):
    """spark.read.format("xlsx"): the cells of workbooks on a path every executor can open, in long form, a task a sheet.
    Options: sheet, range (A1:B2), permissive, maxEntries, maxEntryBytes, maxBytes, maxRatio.
    df.write.format("xlsx"): one sheet, rows in order of partitions. Options: sheet, header."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return f"file string, {SCHEMA}"

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options, schema, overwrite)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, limits: Limits | None = None, permissive: bool = False) -> DataFrame:
    """Cells of all workbooks (XLSX, XLSB, XLS, ODS) under a path of any store that Spark reads: the long relation."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), *(pa.string(),) * 5)
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for c in read_cells(data.as_buffer().to_pybytes(), sheet, None, limits, permissive):
                    rows.append((p, *c))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", *FIELDS])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", *FIELDS])

    return files.mapInArrow(run, f"file string, {SCHEMA}")


def wide(cells: DataFrame, columns: list[str], header: bool = True) -> DataFrame:
    """One sheet's cells as a table: a row for each row number, one text column for each name, in order of columns."""
    body = cells.filter("row > 1") if header else cells
    picks = [F.max(F.when(F.col("col") == i + 1, F.col("value"))).alias(n) for i, n in enumerate(columns)]
    return body.groupBy("row").agg(*picks)


_ESC = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}
_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|[&<>]")


def _escape(text: str) -> str:
    return _CONTROLS.sub(lambda m: _ESC.get(m[0], ""), text)


def cell_xml(value, ref: str = "") -> str:
    """A cell's XML. Text that begins with = is a formula; dates become serials; a blank has no XML where its place is told."""
    at = f' r="{ref}"' if ref else ""
    if value is None:
        return "" if ref else "<c/>"
    if isinstance(value, str):
        if value.startswith("=") and len(value) > 1:
            return f"<c{at}><f>{_escape(value[1:])}</f></c>"
        return f'<c{at} t="inlineStr"><is><t xml:space="preserve">{_escape(value)}</t></is></c>'
    if isinstance(value, bool):
        return f'<c{at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError(f"{ref or 'a cell'}: {value} can't be written")
        return f"<c{at}><v>{value!r}</v></c>"
    if isinstance(value, (datetime, date, time)):
        return f'<c{at} s="{1 if isinstance(value, datetime) else 2 if isinstance(value, date) else 3}"><v>{to_excel(value)!r}</v></c>'
    return cell_xml(float(value) if hasattr(value, "as_tuple") else str(value), ref)


def row_xml(values, row: int = 0) -> str:
    """A row's XML; without a number it comes after the one before it, and so do its cells."""
    if row:
        return f'<row r="{row}">{"".join(cell_xml(v, f"{column_letter(k)}{row}") for k, v in enumerate(values, 1))}</row>'
    return f"<row>{''.join(map(cell_xml, values))}</row>"


def split_typed(grid: list[list], row: int = 1, col: int = 1) -> tuple[list[list], list[tuple[int, int, object]]]:
    """A grid with only the numbers and plain texts left, and the cells that need care on their own: booleans, formulas, dates
    and others, as (row, col, value)."""
    plain = lambda v: v is None or type(v) in (int, float) or (isinstance(v, str) and not v.startswith("="))
    kept = [[v if plain(v) else None for v in r] for r in grid]
    return kept, [(row + i, col + j, v) for i, r in enumerate(grid) for j, v in enumerate(r) if not plain(v)]


_SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def write_package(path: str, sheets: dict[str, Iterator[bytes]], names: dict[str, str] | None = None) -> None:
    """A workbook of sheets, each given as chunks of row XML; written beside the target and then renamed, so that the target
    is either as before or whole."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    parts = [f"xl/worksheets/sheet{k}.xml" for k in range(1, len(sheets) + 1)]
    override = lambda part, kind: f'<Override PartName="/{part}" ContentType="{_KIND}.{kind}+xml"/>'
    relation = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{_OFFICE}/{kind}" Target="{target}"/>'
    n = len(parts)
    try:
        with zipfile.ZipFile(beside, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{override("xl/workbook.xml", "sheet.main")}{"".join(override(p, "worksheet") for p in parts)}{override("xl/styles.xml", "styles")}</Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{relation(1, "officeDocument", "xl/workbook.xml")}</Relationships>')
            listed = "".join(f'<sheet name="{_escape(s).replace(chr(34), "&quot;")}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1))
            defined = f"<definedNames>{''.join(f'<definedName name={chr(34)}{_escape(k)}{chr(34)}>{_escape(v)}</definedName>' for k, v in names.items())}</definedNames>" if names else ""
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SHEETS}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets>{defined}</workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{"".join(relation(k, "worksheet", p.removeprefix("xl/")) for k, p in enumerate(parts, 1))}{relation(n + 1, "styles", "styles.xml")}</Relationships>')
            styles = "".join(f'<xf numFmtId="{i}"{" applyNumberFormat=" + chr(34) + "1" + chr(34) if i else ""}/>' for i in (0, 22, 14, 21))
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_SHEETS}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4">{styles}</cellXfs></styleSheet>')
            for part, chunks in zip(parts, sheets.values(), strict=True):
                with z.open(part, "w", force_zip64=True) as f:
                    f.write(f'<worksheet xmlns="{_SHEETS}"><sheetData>'.encode())
                    for chunk in chunks:
                        f.write(chunk)
                    f.write(b"</sheetData></worksheet>")
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def write_xlsx(path: str, sheet: str, names: list[str], rows: Iterator) -> None:
    """One sheet with a header, written as a stream: memory doesn't grow with the rows."""
    write_package(path, {sheet: _chunks(names, rows)})


def _chunks(names: list[str], rows: Iterator) -> Iterator[bytes]:
    yield row_xml(names).encode()
    held, size = [], 0
    for row in rows:
        text = row_xml(row)
        held.append(text)
        size += len(text)
        if size > 1 << 20:
            yield "".join(held).encode()
            held, size = [], 0
    yield "".join(held).encode()
