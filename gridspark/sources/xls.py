"""XLS workbooks: a file system of sectors in one file, and in it a stream of records. Values, cached results of formulas and
number formats are read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..functions.formats import BUILT_IN_FORMATS, is_date_format
from .xlsb import ERROR_CODES, rk_number
from .xlsx import dated

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if not data.startswith(MAGIC):
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, cutoff, mini_start, _, extra, _ = struct.unpack_from("<I4xIIIII", data, 48)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    parts = list(struct.unpack_from("<109I", data, 76))
    seen = set()
    while extra < _END and extra not in seen:  # more sectors of the table's table
        seen.add(extra)
        more = numbers(sector(extra))
        parts += more[:-1]
        extra = more[-1]
    table = [n for k in parts if k < _END for n in numbers(sector(k))]

    def chain(first: int, after: list[int]) -> Iterator[int]:
        met = set()
        while first < _END and first < len(after) and first not in met:
            met.add(first)
            yield first
            first = after[first]

    whole = lambda first: b"".join(map(sector, chain(first, table)))
    entries = whole(directory)
    mini_table, mini, out = numbers(whole(mini_start)), b"", {}
    for at in range(0, len(entries), 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        first, n = struct.unpack_from("<II", entries, at + 116)
        name = entries[at : at + max(length - 2, 0)].decode("utf-16-le", "replace")
        if kind == 5:
            mini = whole(first)[:n]
        elif kind == 2:
            out[name] = (b"".join(mini[k * small : (k + 1) * small] for k in chain(first, mini_table)) if n < cutoff else whole(first))[:n]
    return out


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + n]
        at += 4 + n


class _Strings:
    """The shared strings, which run over several records: at a record's edge a string goes on after a new flag byte."""

    def __init__(self, blocks: list[bytes]):
        self.blocks, self.k, self.at = blocks, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.blocks[self.k]):
                self.k, self.at = self.k + 1, 0
            part = self.blocks[self.k][self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out += part
        return out

    def text(self, n: int, double: bool) -> str:
        out = ""
        while n:
            if self.at >= len(self.blocks[self.k]):
                self.k, self.at = self.k + 1, 0
                double = bool(self.take(1)[0] & 1)
            room = (len(self.blocks[self.k]) - self.at) // (1 + double)
            out += self.take(min(n, room) * (1 + double)).decode("utf-16-le" if double else "latin-1", "replace")
            n -= min(n, room)
        return out

    def all(self) -> list[str]:
        (count,) = struct.unpack("<4xI", self.take(8))
        out = []
        for _ in range(count):
            n, flags = struct.unpack("<HB", self.take(3))
            runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
            phonetic = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
            out.append(self.text(n, bool(flags & 1)))
            self.take(4 * runs + phonetic)
        return out


def _short(body: bytes, at: int, wide_length: bool) -> str:
    n, flags = struct.unpack_from("<HB" if wide_length else "<BB", body, at)
    at += 3 if wide_length else 2
    return body[at : at + n * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


class Book:
    def __init__(self, data: bytes):
        found = streams(data)
        self.stream = next((found[n] for n in ("Workbook", "Book") if n in found), None)
        if self.stream is None:
            raise ValueError("no workbook in this file; it may be encrypted")
        self.sheets: dict[str, int] = {}
        own, ids, blocks, self.date1904, last = {}, [], [], False, 0
        for kind, body in records(self.stream):
            if kind == 0x2F:
                raise ValueError("the workbook is encrypted: decrypt it first")
            if kind == 0x85 and body[5] == 0:
                self.sheets[_short(body, 6, False)] = struct.unpack_from("<I", body)[0]
            elif kind == 0x22:
                self.date1904 = body[:1] == b"\x01"
            elif kind == 0x41E:
                own[struct.unpack_from("<H", body)[0]] = _short(body, 2, True)
            elif kind == 0xE0:
                ids.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == 0xFC or kind == 0x3C and last in (0xFC, 0x3C) and blocks:
                blocks.append(body)
            elif kind == 0x0A:
                break
            last = kind
        self.strings = _Strings(blocks).all() if blocks else []
        self.formats = [own.get(i, BUILT_IN_FORMATS.get(i, "General")) for i in ids]
        self.dates = {k for k, f in enumerate(self.formats) if is_date_format(f)}

    def number(self, style: int, value: float) -> tuple:
        shown = self.formats[style] if style < len(self.formats) else "General"
        if style in self.dates:
            return *dated(repr(value), self.date1904), shown
        return "number", repr(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value), shown

    def cells(self, sheet: str | None = None) -> Iterator[tuple]:
        for name, start in self.sheets.items():
            if sheet is None or sheet == name:
                for row, col, kind, value, cached, shown in self.found(start):
                    yield name, row + 1, col + 1, kind, value, None, "cached" if cached else None, shown

    def found(self, start: int) -> Iterator[tuple]:
        waiting = None  # a formula whose result is a text, in the next record
        for kind, body in records(self.stream, start):
            if kind == 0x0A:
                return
            if kind == 0x207 and waiting:
                yield *waiting[:2], "string", _short(body, 0, True), True, waiting[2]
                waiting = None
            if kind not in (0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x205, 0x06):
                continue
            row, col, style = struct.unpack_from("<HHH", body)
            shown = self.formats[style] if style < len(self.formats) else "General"
            place = (row, col)
            if kind == 0x203:
                what, value, shown = self.number(style, struct.unpack_from("<d", body, 6)[0])
                yield *place, what, value, False, shown
            elif kind == 0x27E:
                what, value, shown = self.number(style, rk_number(struct.unpack_from("<I", body, 6)[0]))
                yield *place, what, value, False, shown
            elif kind == 0xBD:
                for k in range((len(body) - 6) // 6):
                    style, raw = struct.unpack_from("<HI", body, 4 + 6 * k)
                    what, value, shown = self.number(style, rk_number(raw))
                    yield row, col + k, what, value, False, shown
            elif kind == 0xFD:
                yield *place, "string", self.strings[struct.unpack_from("<I", body, 6)[0]], False, shown
            elif kind == 0x204:
                yield *place, "string", _short(body, 6, True), False, shown
            elif kind == 0x205:
                yield *place, *(("error", ERROR_CODES.get(body[6], "#N/A")) if body[7] else ("bool", str(bool(body[6])).lower())), False, shown
            elif body[12:14] == b"\xff\xff" and body[6] in (0, 1, 2, 3):
                if body[6] == 0:
                    waiting = (*place, shown)
                elif body[6] == 1:
                    yield *place, "bool", str(bool(body[8])).lower(), True, shown
                elif body[6] == 2:
                    yield *place, "error", ERROR_CODES.get(body[8], "#N/A"), True, shown
            else:
                what, value, shown = self.number(style, struct.unpack_from("<d", body, 6)[0])
                yield *place, what, value, True, shown
