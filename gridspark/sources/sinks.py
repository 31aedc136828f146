"""Sheets built cell by cell, edited in place, and shown as text."""

from __future__ import annotations

import json
import math
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..functions.formats import display
from ..operators.structure import column_letter
from ..plans.cells import kind_of
from .files import cell_xml, local, row_xml, split_typed, write_package
from .xlsx import Package


class AlreadySaved(RuntimeError):
    pass


@contextmanager
def atomic(path: str) -> Iterator[str]:
    """A path beside the target to write to: it takes the target's place at the end, or goes if something fails."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        yield beside
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


class SheetBuffer:
    """A sheet that grows by rows and grids, kept in memory until it's saved or becomes a DataFrame."""

    def __init__(self, name: str = "Sheet"):
        self.name, self.cells, self.last = name, {}, 0

    def append(self, values: Iterable) -> None:
        """A row after the last one."""
        self.last += 1
        self.cells.update({(self.last, c): v for c, v in enumerate(values, 1) if v is not None})

    def write_rows(self, rows: Iterable[Iterable], start_row: int = 1, start_col: int = 1) -> None:
        """A grid at a place; blanks leave what is there. Numbers and texts go in one batch, other values one by one."""
        grid = [list(r) for r in rows]
        plain, rest = split_typed(grid, start_row, start_col)
        self.cells.update({(start_row + i, start_col + j): v for i, r in enumerate(plain) for j, v in enumerate(r) if v is not None})
        self.cells.update({(r, c): v for r, c, v in rest})
        self.last = max(self.last, start_row + len(grid) - 1)

    def rows(self) -> Iterator[tuple[int, list]]:
        by: dict[int, dict[int, object]] = {}
        for (r, c), v in self.cells.items():
            by.setdefault(r, {})[c] = v
        return ((r, [by[r].get(c) for c in range(1, max(by[r]) + 1)]) for r in sorted(by))

    def save(self, path: str) -> None:
        write_package(path, {self.name: (row_xml(v, r).encode() for r, v in self.rows())})

    def to_cells(self, spark: SparkSession, file: str = "") -> DataFrame:
        """The long relation of its cells."""
        formula = lambda v: v if isinstance(v, str) and v.startswith("=") else None
        data = [(file, self.name, r, c, *(("blank", None) if formula(v) else kind_of(v)), formula(v)) for (r, c), v in sorted(self.cells.items())]
        return spark.createDataFrame(data, "file string, sheet string, row int, col int, kind string, value string, formula string")


class WriteOnlySheet:
    """Rows go to a temporary file as they come; save() lays them into a workbook, once."""

    def __init__(self, name: str = "Sheet"):
        self.name, self.rows, self.saved = name, 0, False
        self.file = tempfile.TemporaryFile()

    def append(self, values: Iterable) -> None:
        if self.saved:
            raise AlreadySaved(self.name)
        self.file.write(row_xml(list(values)).encode())
        self.rows += 1

    def __getitem__(self, key):
        raise TypeError("a write-only sheet has no cells to look at")

    def save(self, path: str) -> None:
        if self.saved:
            raise AlreadySaved(self.name)
        self.saved = True
        self.file.seek(0)
        write_package(path, {self.name: iter(lambda: self.file.read(1 << 20), b"")})
        self.file.close()


#: The order of a worksheet's children (fixed values).
WORKSHEET_ORDER = (
    "sheetPr dimension sheetViews sheetFormatPr cols sheetData sheetCalcPr sheetProtection protectedRanges scenarios autoFilter sortState dataConsolidate customSheetViews mergeCells phoneticPr conditionalFormatting dataValidations hyperlinks"
    " printOptions pageMargins pageSetup headerFooter rowBreaks colBreaks customProperties cellWatches ignoredErrors smartTags drawing legacyDrawing legacyDrawingHF drawingHF picture oleObjects controls webPublishItems tableParts extLst"
).split()


def merge_blocks(sheet: str, blocks: dict[str, str]) -> str:
    """A worksheet's XML with some of its children replaced or put in at their place in the order."""
    for tag, xml in blocks.items():
        if tag not in WORKSHEET_ORDER:
            raise ValueError(f"a worksheet has no {tag}")
        old = re.compile(rf"<{tag}\b(?:[^>]*/>|.*?</{tag}>)", re.S)
        places = [m.span() for m in old.finditer(sheet)]
        if places:
            sheet = sheet[: places[0][0]] + xml + old.sub("", sheet[places[0][0] :])
            continue
        later = "|".join(WORKSHEET_ORDER[WORKSHEET_ORDER.index(tag) + 1 :])
        found = re.search(rf"<(?:{later})\b", sheet.split("</sheetData>")[-1]) if WORKSHEET_ORDER.index(tag) > WORKSHEET_ORDER.index("sheetData") and "</sheetData>" in sheet else re.search(rf"<(?:{later})\b", sheet)
        base = len(sheet) - len(sheet.split("</sheetData>")[-1]) if WORKSHEET_ORDER.index(tag) > WORKSHEET_ORDER.index("sheetData") and "</sheetData>" in sheet else 0
        at = base + found.start() if found else sheet.rindex("</worksheet>")
        sheet = sheet[:at] + xml + sheet[at:]
    return sheet


_ROW = re.compile(r"<row\b[^>]*?(?:/>|>.*?</row>)", re.S)
_CELL = re.compile(r"<c\b[^>]*?(?:/>|>.*?</c>)", re.S)


def patch_sheet(sheet: str, edits: dict[tuple[int, int], object]) -> str:
    """A worksheet's XML with some cells changed, put in or (None) taken out; styles of cells stay, all else too."""
    if "<sheetData/>" in sheet:
        sheet = sheet.replace("<sheetData/>", "<sheetData></sheetData>")
    head, body, tail = re.match(r"(.*?<sheetData[^>]*>)(.*)(</sheetData>.*)", sheet, re.S).groups()
    wanted: dict[int, dict[int, object]] = {}
    for (r, c), v in edits.items():
        wanted.setdefault(r, {})[c] = v
    if '<row r="' in body and body.count("<row ") == body.count('<row r="') and "<row>" not in body:
        return head + _numbered(body, wanted) + tail
    out, row = [], 0
    for m in _ROW.finditer(body):
        number = re.search(r'\br="(\d+)"', m[0][: m[0].index(">")])
        row = int(number[1]) if number else row + 1
        for r in sorted(r for r in wanted if r < row):
            out.append(_new_row(r, wanted.pop(r)))
        out.append(_patched(m[0], row, wanted.pop(row)) if row in wanted else m[0])
    out += [_new_row(r, wanted[r]) for r in sorted(wanted)]
    return head + "".join(out) + tail


def _numbered(body: str, wanted: dict[int, dict[int, object]]) -> str:
    """Rows that begin with their number are found without looking into the others."""
    out, at = [], 0
    starts = None
    for r in sorted(wanted):
        here = body.find(f'<row r="{r}"', at)
        if here < 0:
            # The first row after it.
            starts = starts or [(int(m[1]), m.start()) for m in re.finditer(r'<row r="(\d+)"', body)]
            here = next((p for n, p in starts if n > r and p >= at), len(body))
            out += [body[at:here], _new_row(r, wanted[r])]
            at = here
            continue
        m = _ROW.match(body, here)
        out += [body[at:here], _patched(m[0], r, wanted[r])]
        at = m.end()
    return "".join([*out, body[at:]])


def _new_row(row: int, values: dict[int, object]) -> str:
    return f'<row r="{row}">{"".join(cell_xml(v, f"{column_letter(c)}{row}") for c, v in sorted(values.items()))}</row>'


def _patched(xml: str, row: int, values: dict[int, object]) -> str:
    start = re.match(r"<row\b[^>]*?(/?)>", xml)
    cells: dict[int, str] = {}
    col = 0
    for m in _CELL.finditer(xml[start.end() :] if not start[1] else ""):
        ref = re.search(r'\br="([A-Z]+)\d+"', m[0][: m[0].index(">")])
        col = _number(ref[1]) if ref else col + 1
        cells[col] = m[0] if ref else re.sub("^<c", f'<c r="{column_letter(col)}{row}"', m[0])
    for c, v in values.items():
        new, old = cell_xml(v, f"{column_letter(c)}{row}"), cells.pop(c, "")
        style = re.search(r'\bs="\d+"', old[: old.index(">")]) if old else None
        if new and style and " s=" not in new[: new.index(">")]:
            new = new.replace("<c ", f"<c {style[0]} ", 1)
        if new:
            cells[c] = new
    return f"{start[0].rstrip('/>').rstrip()}>{''.join(cells[c] for c in sorted(cells))}</row>"


def _number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def modify(path: str, edits: dict[tuple[str, int, int], object], out: str | None = None, blocks: dict[str, dict[str, str]] | None = None) -> None:
    """A workbook with some cells changed, keyed (sheet, row, col), and children of worksheets replaced; every other part is
    copied as it is, and without changes the whole file. The list of formula cells is made anew if there is one."""
    path, out = local(path), local(out or path)
    package = Package(path)
    by: dict[str, dict[tuple[int, int], object]] = {}
    for (sheet, r, c), v in edits.items():
        if sheet not in package.sheets:
            raise KeyError(f"no sheet {sheet!r}")
        by.setdefault(package.sheets[sheet], {})[r, c] = v
    for sheet in blocks or {}:
        by.setdefault(package.sheets[sheet], {})
    with atomic(out) as beside:
        if not by:
            shutil.copyfile(path, beside)
            return
        changed = {part: merge_blocks(patch_sheet(package.zip.read(part).decode(), cells), next((b for s, b in (blocks or {}).items() if package.sheets[s] == part), {})) for part, cells in by.items()}
        with zipfile.ZipFile(beside, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            for info in package.zip.infolist():
                if info.filename == "xl/calcChain.xml":
                    z.writestr(info.filename, calc_chain([changed.get(p) or package.zip.read(p).decode() for p in package.sheets.values()]))
                else:
                    z.writestr(info, changed[info.filename] if info.filename in changed else package.zip.read(info.filename), compresslevel=1)


def calc_chain(sheets: list[str]) -> str:
    """The list of formula cells of some worksheets' XML."""
    cells = [f'<c r="{ref[1]}" i="{k}"/>' for k, xml in enumerate(sheets, 1) for m in _CELL.finditer(xml) if "<f" in m[0] and (ref := re.search(r'\br="([A-Z]+\d+)"', m[0]))]
    return f'<calcChain xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{"".join(cells)}</calcChain>'


# Previews: a header and rows of values, with a number format for each column or none.


def as_text(header: list[str], rows: Iterable[list], formats: list[str | None] | None = None) -> str:
    """Tab-separated: values as they are shown, errors as ERROR: code."""
    shown = lambda v, f: f"ERROR: {v}" if type(v).__name__ == "Err" else display(v, f)
    formats = formats or [None] * len(header)
    return "\n".join(["\t".join(header), *("\t".join(shown(v, f) for v, f in zip(r, formats, strict=True)) for r in rows)]) + "\n"


def as_csv(header: list[str], rows: Iterable[list], formats: list[str | None] | None = None) -> str:
    """Comma-separated values as they are shown, quoted where they have to be."""
    quoted = lambda t: '"' + t.replace('"', '""') + '"' if re.search(r'[",\r\n]', t) else t
    formats = formats or [None] * len(header)
    return "".join(",".join(map(quoted, line)) + "\n" for line in [header, *([display(v, f) for v, f in zip(r, formats, strict=True)] for r in rows)])


def as_json(sheet: str, header: list[str], rows: list[list]) -> str:
    """Values as machines take them: blanks and NaN are null, dates ISO texts."""
    plain = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v if v is None or isinstance(v, (bool, int, float, str)) else v.isoformat()
    return json.dumps({"sheet": sheet, "rows": len(rows), "columns": len(header), "headers": header, "data": [[plain(v) for v in r] for r in rows]}, ensure_ascii=False)


def boxed(header: list[str], rows: list[list], n: int = 50, width: int = 30, formats: list[str | None] | None = None) -> str:
    """A table drawn with lines: at most n rows (0: all), and texts cut to a width; a last line says what was left out."""
    formats = formats or [None] * len(header)
    cut = lambda t: t if len(t) <= width else t[: width - 1] + "…"
    shown = rows[:n] if n else rows
    table = [[cut(h) for h in header], *([cut(display(v, f)) for v, f in zip(r, formats, strict=True)] for r in shown)]
    sizes = [max(len(r[c]) for r in table) for c in range(len(header))]
    line = lambda a, b, c: a + b.join("─" * (s + 2) for s in sizes) + c
    body = [f"│{'│'.join(f' {t:<{s}} ' for t, s in zip(r, sizes, strict=True))}│" for r in table]
    out = [line("┌", "┬", "┐"), body[0], line("├", "┼", "┤"), *body[1:], line("└", "┴", "┘")]
    if len(shown) < len(rows):
        out.append(f"{len(shown)} of {len(rows)} rows shown")
    return "\n".join(out) + "\n"
