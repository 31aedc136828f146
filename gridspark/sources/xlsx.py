"""XLSX packages: parts, cells as a stream, and what else a sheet says about its cells.

Cells come out as tuples in the order of FIELDS. A sheet's part is unpacked as it's read, some rows at a time; a row whose XML
is of the common shape is taken apart by one regular expression, any other by an XML parser."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from html import unescape
from xml.etree import ElementTree

from ..functions.formats import BUILT_IN_FORMATS, is_date_format
from ..operators.structure import column_number
from ..plans.syntax import Area, parse_reference, translated

FIELDS = ("sheet", "row", "col", "kind", "value", "formula", "formula_kind", "number_format")
SCHEMA = "sheet string, row int, col int, kind string, value string, formula string, formula_kind string, number_format string"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORKSHEET = "/worksheet"
#: Bytes unpacked at once.
_CHUNK = 1 << 20
_KINDS = {"s": "string", "str": "string", "inlineStr": "string", "b": "bool", "e": "error", "d": "datetime", "n": "number", "": "number"}


@dataclass
class Limits:
    """What an archive may unpack to: entries, bytes of one and of all, and how many times its packed size."""

    entries: int = 200_000
    entry_bytes: int = 2 << 30
    total_bytes: int = 4 << 30
    ratio: int = 1000


def check_archive(z: zipfile.ZipFile, limits: Limits) -> None:
    infos = z.infolist()
    if len(infos) > limits.entries or sum(i.file_size for i in infos) > limits.total_bytes:
        raise ValueError("the archive unpacks to more than its limits")
    for i in infos:
        if i.file_size > limits.entry_bytes or (i.file_size > 1 << 20 and i.file_size > limits.ratio * max(i.compress_size, 1)):
            raise ValueError(f"{i.filename} unpacks to more than its limits")


@dataclass
class Table:
    """A named range with a header row."""

    name: str
    ref: str
    columns: list[str]
    header_row: bool = True
    totals_row: bool = False


@dataclass
class Details:
    """What a sheet says beside its cells."""

    hidden_rows: list[int] = field(default_factory=list)
    hidden_columns: list[int] = field(default_factory=list)
    row_levels: dict[int, int] = field(default_factory=dict)
    merged: list[str] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    dimension: str = ""


class Package:
    """A workbook's archive: a path, bytes or a file object."""

    def __init__(self, source, limits: Limits | None = None, permissive: bool = False):
        self.zip = zipfile.ZipFile(io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source)
        check_archive(self.zip, limits or Limits())
        self.names = set(self.zip.namelist())
        self.book_part = next((t for _, kind, t in self.relations("") if kind.endswith("/officeDocument")), "xl/workbook.xml")
        book = ElementTree.fromstring(self.zip.read(self.book_part))
        rels = {i: (kind, t) for i, kind, t in self.relations(self.book_part)}
        #: Sheet names and parts, in order.
        self.sheets = {s.get("name"): rels[s.get(_REL)][1] for s in book.iter(f"{_NS}sheet") if s.get(_REL) in rels and rels[s.get(_REL)][1] in self.names}
        self.states = {s.get("name"): s.get("state", "visible") for s in book.iter(f"{_NS}sheet")}
        if not self.sheets and permissive:
            parts = sorted((t for kind, t in rels.values() if kind.endswith(_WORKSHEET) and t in self.names), key=lambda t: [int(x) for x in re.findall(r"\d+", t)])
            self.sheets = {f"Sheet{k}": t for k, t in enumerate(parts, 1)}
        properties = book.find(f"{_NS}workbookPr")
        self.date1904 = properties is not None and properties.get("date1904", "0") in ("1", "true")
        order = list(self.states)
        #: What each defined name stands for; those of one sheet as Sheet!Name.
        self.defined = {(f"{order[int(d.get('localSheetId'))]}!" if int(d.get("localSheetId") or len(order)) < len(order) else "") + d.get("name"): (d.text or "").strip() for d in book.iter(f"{_NS}definedName")}
        self._strings: list[str] | None = None
        self._formats: list[str] | None = None

    def relations(self, part: str) -> list[tuple[str, str, str]]:
        """id, kind and target part of what a part refers to."""
        folder, name = posixpath.split(part)
        at = posixpath.join(folder, "_rels", f"{name}.rels") if part else "_rels/.rels"
        if at not in self.names:
            return []
        resolve = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return [(r.get("Id"), r.get("Type", ""), r.get("Target") if r.get("TargetMode") == "External" else resolve(r.get("Target"))) for r in ElementTree.fromstring(self.zip.read(at))]

    @property
    def strings(self) -> list[str]:
        """Shared strings as plain text: runs are joined, phonetic hints left out."""
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self.names:
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if e.tag == f"{_NS}si":
                            self._strings.append(_plain(e))
                            e.clear()
        return self._strings

    @property
    def formats(self) -> list[str]:
        """The number format of each cell style."""
        if self._formats is None:
            self._formats = []
            if "xl/styles.xml" in self.names:
                root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
                own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_NS}numFmt")}
                cells = root.find(f"{_NS}cellXfs")
                ids = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
                self._formats = [own.get(i, BUILT_IN_FORMATS.get(i, "General")) for i in ids]
        return self._formats

    def cells(self, sheet: str | None = None, bounds: tuple[int, int, int, int] | None = None) -> Iterator[tuple]:
        """The cells that aren't empty, as FIELDS has them, row by row; bounds: top, left, bottom, right, and reading ends
        with the last row."""
        for name, part in self.sheets.items():
            if sheet is None or name == sheet:
                yield from _Sheet(self, name, bounds).cells(part)

    def details(self, sheet: str) -> Details:
        """Hidden rows and columns, outline levels, merged ranges and tables of a sheet."""
        out, part = Details(), self.sheets[sheet]
        with self.zip.open(part) as f:
            row = 0
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                tag = e.tag.removeprefix(_NS)
                if event == "start" and tag == "row":
                    row = int(e.get("r", row + 1))
                    if e.get("hidden") in ("1", "true"):
                        out.hidden_rows.append(row)
                    if e.get("outlineLevel"):
                        out.row_levels[row] = int(e.get("outlineLevel"))
                elif event == "end":
                    if tag == "col" and e.get("hidden") in ("1", "true"):
                        out.hidden_columns += range(int(e.get("min")), int(e.get("max")) + 1)
                    elif tag == "mergeCell":
                        out.merged.append(e.get("ref"))
                    elif tag == "dimension":
                        out.dimension = e.get("ref", "")
                    elif tag == "row":
                        e.clear()
        for _, kind, target in self.relations(part):
            if kind.endswith("/table") and target in self.names:
                t = ElementTree.fromstring(self.zip.read(target))
                columns = [c.get("name") for c in t.iter(f"{_NS}tableColumn")]
                out.tables.append(Table(t.get("displayName") or t.get("name"), t.get("ref"), columns, t.get("headerRowCount", "1") != "0", t.get("totalsRowCount", "0") != "0"))
        return out

    def external_links(self) -> list[dict]:
        """Linked workbooks: target, sheet names, and the values cached of them by (sheet, A1)."""
        out = []
        for _, kind, part in self.relations(self.book_part):
            if not kind.endswith("/externalLink") or part not in self.names:
                continue
            root = ElementTree.fromstring(self.zip.read(part))
            names = [s.get("val") for s in root.iter(f"{_NS}sheetName")]
            values = {(names[int(d.get("sheetId"))], c.get("r")): c.findtext(f"{_NS}v") for d in root.iter(f"{_NS}sheetData") for c in d.iter(f"{_NS}cell")}
            out.append({"target": next((t for _, _, t in self.relations(part)), None), "sheets": names, "values": values})
        return out


def _plain(e: ElementTree.Element) -> str:
    """The text of a string item: its own and its runs'."""
    return "".join((c.text or "") if c.tag == f"{_NS}t" else "".join(t.text or "" for t in c.findall(f"{_NS}t")) if c.tag == f"{_NS}r" else "" for c in e)


def serial_to_datetime(serial: float, date1904: bool = False) -> datetime:
    """The moment of a serial, to the second; days 1 to 59 of the 1900 system come before its 29 February 1900."""
    days, rest = divmod(round(serial * 86400), 86400)
    base = datetime(1904, 1, 1) if date1904 else datetime(1899, 12, 31) if days < 60 else datetime(1899, 12, 30)
    return base + timedelta(days=days, seconds=rest)


def dated(serial: str, date1904: bool) -> tuple[str, str]:
    """Kind and value of a number that is shown as a date: a time below 1, a date if whole, else both."""
    try:
        number = float(serial)
        moment = serial_to_datetime(number, date1904)
    except (ValueError, OverflowError):
        return "number", serial
    if 0 <= number < 1 and moment.date() == serial_to_datetime(0, date1904).date():
        return "time", moment.time().isoformat()
    return ("date", moment.date().isoformat()) if number == int(number) else ("datetime", moment.isoformat(sep=" "))


_ROW = re.compile(r"<row\b([^>]*?)(/>|>)")
_CELL = re.compile(
    r'<c(?: r="([A-Z]{1,3})(\d+)")?(?: s="(\d+)")?(?: t="(\w+)")?(?:/>|>(?:<f((?: [^>]*?)?)(?:/>|>([^<]*)</f>))?(?:<v(?: [^>]*)?>([^<]*)</v>|<v/>)?(?:<is><t(?: [^>]*)?>([^<]*)</t></is>)?</c>)'
)
_ATTRIBUTE = re.compile(r'([\w:]+)="([^"]*)"')


class _Sheet:
    def __init__(self, package: Package, name: str, bounds: tuple[int, int, int, int] | None):
        self.package, self.name = package, name
        self.top, self.left, self.bottom, self.right = bounds or (1, 1, 1 << 30, 1 << 30)
        self.masters: dict[str, tuple[str, int, int]] = {}
        self.spills: list[tuple[Area, tuple[int, int]]] = []
        formats = package.formats
        self.formats = formats
        self.dates = {k for k, f in enumerate(formats) if is_date_format(f)}
        self.columns: dict[str, int] = {}

    def rows(self, part: str) -> Iterator[str]:
        """The XML of some whole rows at a time."""
        with self.package.zip.open(part) as f:
            rest = b""
            while chunk := f.read(_CHUNK):
                rest += chunk
                cut = rest.rfind(b"</row>")
                if cut >= 0:
                    yield rest[: cut + 6].decode()
                    rest = rest[cut + 6 :]
            yield rest.decode()

    def cells(self, part: str) -> Iterator[tuple]:
        row = 0
        for text in self.rows(part):
            starts = list(_ROW.finditer(text))
            for k, m in enumerate(starts):
                at = m[1].find('r="')
                row = int(m[1][at + 3 : m[1].index('"', at + 3)]) if at >= 0 and (at == 0 or m[1][at - 1] == " ") else row + 1
                if row > self.bottom:
                    return
                if m[2] == "/>" or (row < self.top and not self.masters and "<f" not in text):
                    continue
                body = text[m.end() : starts[k + 1].start() if k + 1 < len(starts) else len(text)]
                found = _CELL.findall(body)
                if len(found) != body.count("<c ") + body.count("<c>") + body.count("<c/>"):
                    found = self.slowly(body)
                yield from self.decoded(row, found)

    def slowly(self, body: str) -> list[tuple]:
        """Cells of a row in any valid shape, as _CELL would give them."""
        end = body.find("</row>")
        root = ElementTree.fromstring(f'<x xmlns="{_NS[1:-1]}" xmlns:r="r" xmlns:x14ac="a" xmlns:xml="http://www.w3.org/XML/1998/namespace">{body[: end if end >= 0 else len(body)]}</x>')
        out = []
        for c in root.iter(f"{_NS}c"):
            ref = re.match(r"([A-Z]*)(\d*)", c.get("r", ""))
            f, v, inner = c.find(f"{_NS}f"), c.findtext(f"{_NS}v"), c.find(f"{_NS}is")
            attributes = "".join(f' {k}="{x}"' for k, x in f.attrib.items()) + " " if f is not None else ""
            quoted = lambda t: (t or "").replace("&", "&amp;").replace("<", "&lt;")
            out.append((ref[1], ref[2], c.get("s", ""), c.get("t", ""), attributes, quoted(f.text) if f is not None else "", quoted(v), quoted(_plain(inner)) if inner is not None else ""))
        return out

    def decoded(self, row: int, found: list[tuple]) -> Iterator[tuple]:
        col, columns, name, dates, formats = 0, self.columns, self.name, self.dates, self.formats
        left, right, plain, spills = self.left, self.right, row >= self.top, self.spills
        general = formats[0] if formats else "General"
        for letters, _, style, kind, attributes, formula, v, inline in found:
            # Numbers and texts without a style or formula, which most cells are.
            if plain and letters and not (style or attributes or formula or spills) and (v if not kind else inline and kind == "inlineStr"):
                col = columns.get(letters) or columns.setdefault(letters, column_number(letters))
                if left <= col <= right:
                    if not kind and 0 not in dates:
                        yield name, row, col, "number", v, None, None, general
                        continue
                    if kind:
                        yield name, row, col, "string", unescape(inline) if "&" in inline else inline, None, None, general
                        continue
                else:
                    continue
            if letters:
                col = columns.get(letters) or columns.setdefault(letters, column_number(letters))
            else:
                col += 1
            formula_kind = None
            if attributes or formula:
                formula, formula_kind = self.formula(row, col, attributes, unescape(formula))
            elif self.spills:
                formula_kind = next(("spill" for area, first in self.spills if _inside(area, row, col) and (row, col) != first), None)
            if row < self.top or not self.left <= col <= self.right:
                continue
            what, style = _KINDS.get(kind, "number"), int(style or 0)
            if kind == "s":
                v = self.package.strings[int(v)] if v else None
            elif kind == "inlineStr":
                v = unescape(inline)
            elif v == "":
                if what != "string" or not formula:
                    v = None
            elif what == "number":
                if style in self.dates:
                    what, v = dated(v, self.package.date1904)
            elif what == "bool":
                v = "true" if v == "1" else "false"
            else:
                v = unescape(v)
            if v is not None or formula or formula_kind:
                shown = self.formats[style] if style < len(self.formats) else "General"
                yield self.name, row, col, what if v is not None else "blank", v, formula or None, formula_kind, shown

    def formula(self, row: int, col: int, attributes: str, text: str) -> tuple[str, str]:
        """A cell's formula and its kind: plain, shared (followers get their master's, moved along), array or data table."""
        found = dict(_ATTRIBUTE.findall(attributes))
        kind = found.get("t", "normal")
        if kind == "shared":
            if text:
                self.masters[found["si"]] = (text, row, col)
            elif found.get("si") in self.masters:
                master, r, c = self.masters[found["si"]]
                text = translated(master, row - r, col - c)
        elif kind in ("array", "dataTable") and ":" in found.get("ref", ""):
            self.spills.append((parse_reference(found["ref"]), (row, col)))
        return text, {"dataTable": "data_table"}.get(kind, kind)


def _inside(area: Area, row: int, col: int) -> bool:
    top, left, bottom, right = area.bounds()
    return top <= row <= bottom and left <= col <= right
