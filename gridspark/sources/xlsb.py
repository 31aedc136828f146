"""XLSB workbooks: records of a number, a size and a body. Values, cached results of formulas and number formats are read;
formulas themselves are stored as compiled tokens and stay unread."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from xml.etree import ElementTree
from zipfile import ZipFile

from ..functions.formats import BUILT_IN_FORMATS, is_date_format
from .xlsx import Limits, check_archive, dated

#: Error codes by number (fixed values).
ERROR_CODES = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
#: Record numbers (fixed values).
ROW, BLANK, RK, ERROR, BOOL, REAL, TEXT, SHARED = 0, 1, 2, 3, 4, 5, 6, 7
F_TEXT, F_REAL, F_BOOL, F_ERROR = 8, 9, 10, 11
STRING_ITEM, FORMAT, CELL_STYLE, BOOK_PROPERTIES, SHEET, STYLES_BEGIN, STYLES_END = 19, 44, 47, 153, 156, 617, 618


def records(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """(number, body) of every record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        kind = data[at]
        at += 1
        if kind & 0x80:
            kind = kind & 0x7F | data[at] << 7
            kind &= 0x3FFF
            at += 1
        size = shift = 0
        for _ in range(4):
            byte = data[at]
            at += 1
            size |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80:
                break
        yield kind, view[at : at + size]
        at += size


def wide(body: memoryview, at: int) -> tuple[str | None, int]:
    """A string of 16-bit characters after its length, and where it ends."""
    (n,) = struct.unpack_from("<I", body, at)
    if n == 0xFFFFFFFF:
        return None, at + 4
    return bytes(body[at + 4 : at + 4 + 2 * n]).decode("utf-16-le", "replace"), at + 4 + 2 * n


def rk_number(raw: int) -> float:
    """The number in 30 bits: whole or the upper part of a double, maybe a hundred times too large."""
    value = (raw - (1 << 32) if raw >> 31 else raw) >> 2 if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & ~3) << 32))[0]
    return value / 100 if raw & 1 else float(value)


class Book:
    def __init__(self, source, limits: Limits | None = None):
        self.zip = ZipFile(source)
        check_archive(self.zip, limits or Limits())
        names = set(self.zip.namelist())
        part = lambda n: self.zip.read(n) if n in names else b""
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(part("xl/_rels/workbook.bin.rels") or b"<x/>")}
        self.sheets, self.date1904 = {}, False
        for kind, body in records(part("xl/workbook.bin")):
            if kind == BOOK_PROPERTIES:
                self.date1904 = bool(body[0] & 1)
            elif kind == SHEET:
                rel, at = wide(body, 8)
                name, _ = wide(body, at)
                target = rels[rel]
                self.sheets[name] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.strings = [wide(b, 1)[0] or "" for k, b in records(part("xl/sharedStrings.bin")) if k == STRING_ITEM]
        own, self.formats, inside = {}, [], False
        for kind, body in records(part("xl/styles.bin")):
            if kind == FORMAT:
                own[struct.unpack_from("<H", body)[0]] = wide(body, 2)[0] or ""
            elif kind in (STYLES_BEGIN, STYLES_END):
                inside = kind == STYLES_BEGIN
            elif kind == CELL_STYLE and inside:
                number = struct.unpack_from("<H", body, 2)[0]
                self.formats.append(own.get(number, BUILT_IN_FORMATS.get(number, "General")))
        self.dates = {k for k, f in enumerate(self.formats) if is_date_format(f)}

    def cells(self, sheet: str | None = None) -> Iterator[tuple]:
        for name, part in self.sheets.items():
            if sheet is not None and sheet != name:
                continue
            row = 0
            for kind, body in records(self.zip.read(part)):
                if kind == ROW:
                    row = struct.unpack_from("<I", body)[0] + 1
                elif BLANK < kind <= F_ERROR:
                    col, style = struct.unpack_from("<II", body)
                    yield name, row, col + 1, *self.value(kind, body, style & 0xFFFFFF)

    def value(self, kind: int, body: memoryview, style: int) -> tuple:
        """kind, value, formula, formula_kind and number_format of a cell."""
        shown = self.formats[style] if style < len(self.formats) else "General"
        if kind in (RK, REAL, F_REAL):
            number = rk_number(struct.unpack_from("<I", body, 8)[0]) if kind == RK else struct.unpack_from("<d", body, 8)[0]
            what, value = dated(repr(number), self.date1904) if style in self.dates else ("number", repr(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number))
        elif kind in (BOOL, F_BOOL):
            what, value = "bool", str(bool(body[8])).lower()
        elif kind in (ERROR, F_ERROR):
            what, value = "error", ERROR_CODES.get(body[8], "#N/A")
        else:
            what, value = "string", self.strings[struct.unpack_from("<I", body, 8)[0]] if kind == SHARED else wide(body, 8)[0]
        return what, value, None, "cached" if kind >= F_TEXT else None, shown
