"""Formulas as text, tokens and trees, and the references in them.

A tree is a tuple whose first item names its kind: num, text, bool, err, ref, area, name, call, op, sign, percent. The
precedences are those of the spreadsheets this engine follows: comparisons bind least, then + - & alike, then * and /, then
powers; operators of one level go from left to right."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

from ..functions.values import ERRORS
from ..operators.structure import column_letter, column_number

LAST_ROW, LAST_COL = 1_048_576, 16_384


class UnsupportedFormula(ValueError):
    pass


@dataclass(frozen=True)
class Cell:
    """One reference: column and row (0: the whole row or column), which of them are fixed, and a sheet ('' for the own)."""

    row: int
    col: int
    row_fixed: bool = False
    col_fixed: bool = False
    sheet: str = ""

    def __str__(self) -> str:
        place = f"{'$' * self.col_fixed}{column_letter(self.col)}" if self.col else ""
        return f"{place}{'$' * self.row_fixed}{self.row}" if self.row else place


@dataclass(frozen=True)
class Area:
    """A range of cells; 0 stands for an open end (whole columns or rows)."""

    first: Cell
    last: Cell
    sheet: str = ""

    def bounds(self) -> tuple[int, int, int, int]:
        """top, left, bottom, right in order, open ends as the sheet's limits."""
        rows = sorted((self.first.row or 1, self.last.row or LAST_ROW))
        cols = sorted((self.first.col or 1, self.last.col or LAST_COL))
        return rows[0], cols[0], rows[1], cols[1]

    @property
    def shape(self) -> tuple[int, int]:
        top, left, bottom, right = self.bounds()
        return bottom - top + 1, right - left + 1

    def cells(self) -> Iterator[tuple[int, int]]:
        """(row, col) of every cell, row by row."""
        top, left, bottom, right = self.bounds()
        return ((r, c) for r in range(top, bottom + 1) for c in range(left, right + 1))

    def __str__(self) -> str:
        return f"{self.first}:{self.last}"


_SHEET = r"""(?:(?P<sheet>'(?:[^']|'')+'|[A-Za-z_\u0080-￿][\w.\u0080-￿]*)!)"""
_A1 = r"\$?[A-Za-z]{1,3}\$?\d{1,7}"
_TOKENS = re.compile(
    rf"""(?P<space>\s+)|(?P<text>"(?:[^"]|"")*")|(?P<err>{"|".join(re.escape(e) for e in sorted(ERRORS, key=len, reverse=True))}|\#NULL!)"""
    rf"""|(?P<area>{_SHEET.replace("sheet", "area_sheet")}?(?P<area_at>{_A1}:{_A1}|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|\$?\d{{1,7}}:\$?\d{{1,7}})(?![\w(]))"""
    rf"""|(?P<ref>{_SHEET}?(?P<ref_at>{_A1})(?![\w(]))"""
    r"""|(?P<table>[A-Za-z_]\w*\[(?:[^\[\]]|\[[^\[\]]*\])*\])"""
    r"""|(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_\\][\w.\\]*)|(?P<op><>|<=|>=|[-+*/^&=<>%])|(?P<punct>[(),;{}:!])"""
)


def tokens(formula: str) -> list[tuple[str, str]]:
    """(kind, text) of every token; their texts make up the formula."""
    out, at = [], 0
    while at < len(formula):
        m = _TOKENS.match(formula, at)
        if not m:
            raise UnsupportedFormula(f"{formula!r} at {at}")
        out.append((m.lastgroup if m.lastgroup in ("space", "text", "err", "table", "num", "name", "op", "punct") else "area" if m["area"] else "ref", m[0]))
        at = m.end()
    return out


def _cell(text: str, sheet: str) -> Cell:
    m = re.fullmatch(r"(\$?)([A-Za-z]{0,3})(\$?)(\d*)", text)
    if m[2]:
        return Cell(int(m[4] or 0), column_number(m[2]), bool(m[3]), bool(m[1]), sheet)
    return Cell(int(m[4]), 0, bool(m[1] or m[3]), False, sheet)


def parse_reference(text: str) -> Cell | Area | str:
    """What a reference means: a cell, an area (also of whole rows or columns), with or without a sheet; an error's code, a
    table's column (Table[Column]) or a defined name come back as text."""
    m = _TOKENS.fullmatch(text.strip())
    if not m or m.lastgroup in ("space", "text", "num", "op", "punct"):
        raise UnsupportedFormula(f"no reference: {text!r}")
    if m["area"] is not None:
        sheet = _unquote(m["area_sheet"])
        first, last = m["area_at"].split(":")
        return Area(_cell(first, sheet), _cell(last, sheet), sheet)
    if m["ref"] is not None:
        return _cell(m["ref_at"], _unquote(m["sheet"]))
    return m[0]


def _unquote(sheet: str | None) -> str:
    return sheet[1:-1].replace("''", "'") if sheet and sheet.startswith("'") else sheet or ""


def quote_sheet(name: str) -> str:
    """A sheet's name as formulas write it."""
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) and not re.fullmatch(_A1, name) else "'" + name.replace("'", "''") + "'"


class _Parser:
    LEVELS = (("=", "<>", "<", "<=", ">", ">="), ("+", "-", "&"), ("*", "/"), ("^",))

    def __init__(self, formula: str):
        self.formula = formula
        self.tokens = [t for t in tokens(formula.removeprefix("=")) if t[0] != "space"] + [("end", "")]
        self.at = 0

    def fail(self, why: str):
        raise UnsupportedFormula(f"{self.formula!r}: {why}")

    def next(self, text: str) -> bool:
        if self.tokens[self.at][0] in ("op", "punct") and self.tokens[self.at][1] == text:
            self.at += 1
            return True
        return False

    def whole(self) -> tuple:
        out = self.level(0)
        return out if self.tokens[self.at][0] == "end" else self.fail(f"unexpected {self.tokens[self.at][1]!r}")

    def level(self, k: int) -> tuple:
        if k == len(self.LEVELS):
            return self.signed()
        left = self.level(k + 1)
        while op := next((x for x in self.LEVELS[k] if self.next(x)), None):
            left = ("op", op, left, self.level(k + 1))
        return left

    def signed(self) -> tuple:
        for op in "-+":
            if self.next(op):
                return ("sign", op, self.signed())
        out = self.atom()
        while self.next("%"):
            out = ("percent", out)
        return out

    def atom(self) -> tuple:
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("num", float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "text":
            return ("text", text[1:-1].replace('""', '"'))
        if kind == "err":
            return ("err", text)
        if kind in ("ref", "area"):
            return (kind, parse_reference(text))
        if kind == "table":
            return ("name", text)
        if kind == "name":
            if self.next("("):
                return ("call", text.upper(), self.arguments())
            return ("bool", text.upper() == "TRUE") if text.upper() in ("TRUE", "FALSE") else ("name", text)
        if kind == "punct" and text == "(":
            inner = self.level(0)
            return inner if self.next(")") else self.fail("missing )")
        return self.fail(f"unexpected {text!r}")

    def arguments(self) -> list[tuple]:
        if self.next(")"):
            return []
        out = []
        while True:
            blank = self.tokens[self.at] in (("punct", ","), ("punct", ")"))
            out.append(("blank",) if blank else self.level(0))
            if self.next(")"):
                return out
            if not self.next(","):
                self.fail("missing )")


@lru_cache(maxsize=100_000)
def parse(formula: str) -> tuple:
    """The tree of a formula."""
    return _Parser(formula).whole()


def references(tree: tuple) -> Iterator[Cell | Area | str]:
    """Cells, areas and names of a tree; areas stay whole."""
    if tree[0] in ("ref", "area", "name"):
        yield tree[1]
    elif tree[0] == "call":
        for x in tree[2]:
            yield from references(x)
    else:
        for x in tree[1:]:
            if isinstance(x, tuple):
                yield from references(x)


def rewrite(formula: str, change) -> str:
    """The formula with each reference's text replaced by change(reference); text in quotes stays as it is."""
    out = []
    body = formula.removeprefix("=")
    for kind, text in tokens(body):
        if kind in ("ref", "area"):
            ref = parse_reference(text)
            new = change(ref)
            prefix = f"{quote_sheet(new.sheet)}!" if not isinstance(new, str) and new.sheet else ""
            text = text if new == ref else f"{prefix}{new}"
        out.append(text)
    return formula[: len(formula) - len(body)] + "".join(out)


def translated(formula: str, rows: int, cols: int) -> str:
    """A formula copied elsewhere: what isn't fixed moves along, and a reference that leaves the sheet is #REF!."""

    def moved(c: Cell) -> Cell | None:
        row = c.row if c.row_fixed or not c.row else c.row + rows
        col = c.col if c.col_fixed or not c.col else c.col + cols
        return replace(c, row=row, col=col) if row >= bool(c.row) and col >= bool(c.col) and row <= LAST_ROW and col <= LAST_COL else None

    def change(ref):
        if isinstance(ref, Cell):
            return moved(ref) or "#REF!"
        first, last = moved(ref.first), moved(ref.last)
        return replace(ref, first=first, last=last) if first and last else "#REF!"

    return rewrite(formula, change)


def template(formula: str, row: int, col: int) -> str:
    """The formula as seen from its own cell: equal for cells that were filled down or across from one."""

    def part(c: Cell) -> str:
        r = (str(c.row) if c.row_fixed else f"[{c.row - row}]") if c.row else ""
        k = (str(c.col) if c.col_fixed else f"[{c.col - col}]") if c.col else ""
        return f"R{r}C{k}"

    body = formula.removeprefix("=")
    out = []
    for kind, text in tokens(body):
        if kind in ("ref", "area"):
            ref = parse_reference(text)
            text = part(ref) if isinstance(ref, Cell) else f"{part(ref.first)}:{part(ref.last)}"
            text = f"{quote_sheet(ref.sheet)}!{text}" if ref.sheet else text
        out.append(text)
    return "".join(out)


#: Text in quotes, or a cell or area of the own sheet: most formulas have nothing else to rewrite.
_OWN = re.compile(r'"[^"]*"|(?<![\w.$!\'\]])(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d{0,6})(?::(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d{0,6}))?(?![\w(.!\[])')
_PLAIN = re.compile(r"^[^!\[{#]*$")
_WHOLE = re.compile(r"[A-Za-z]:\$?[A-Za-z]|(?<![A-Za-z\d])\$?\d+:")


def _after(low: int, high: int, at: int, n: int) -> tuple[int, int] | None:
    """Where rows or columns low to high are after n were inserted at `at` (n < 0: deleted); None if they are all gone."""
    if n >= 0:
        return low + n * (low >= at), high + n * (high >= at)
    end = at - n
    low = at if at <= low < end else low + n * (low >= end)
    high = at - 1 if at <= high < end else high + n * (high >= end)
    return (low, high) if low <= high else None


def shifted(formula: str, sheet: str, axis: str, at: int, n: int, own: str | None = None) -> str:
    """The formula, on sheet `own` (default: the same sheet), after n rows or columns of `sheet` were inserted at `at` (n < 0:
    deleted). Fixed references move too. Areas shrink where they lose cells; what's gone is #REF!."""
    home = sheet if own is None else own
    if _PLAIN.match(formula) and not _WHOLE.search(formula):
        return _shifted_own(formula, axis, at, n) if home.lower() == sheet.lower() else formula

    def change(ref):
        if (ref.sheet or home).lower() != sheet.lower():
            return ref
        first, last = (ref, ref) if isinstance(ref, Cell) else (ref.first, ref.last)
        a, b = getattr(first, axis), getattr(last, axis)
        if not a:
            return ref
        found = _after(min(a, b), max(a, b), at, n)
        if found is None:
            return "#REF!"
        low, high = found if a <= b else found[::-1]
        if isinstance(ref, Cell):
            return replace(ref, **{axis: low})
        return replace(ref, first=replace(first, **{axis: low}), last=replace(last, **{axis: high}))

    return rewrite(formula, change)


def _shifted_own(formula: str, axis: str, at: int, n: int) -> str:
    rows = axis == "row"

    def one(m: re.Match) -> str:
        dc, c, dr, r, dc2, c2, dr2, r2 = m.groups()
        if c is None:
            return m[0]
        if rows:
            a = int(r)
            b = int(r2) if r2 else a
            if max(a, b) < at:
                return m[0]
        else:
            a = column_number(c)
            b = column_number(c2) if c2 else a
        found = _after(a, b, at, n) if a <= b else _after(b, a, at, n)
        if found is None:
            return "#REF!"
        x, y = found if a <= b else found[::-1]
        if rows:
            return f"{dc}{c}{dr}{x}:{dc2}{c2}{dr2}{y}" if c2 else f"{dc}{c}{dr}{x}"
        return f"{dc}{column_letter(x)}{dr}{r}:{dc2}{column_letter(y)}{dr2}{r2}" if c2 else f"{dc}{column_letter(x)}{dr}{r}"

    return _OWN.sub(one, formula)


def renamed(formula: str, old: str, new: str) -> str:
    """The formula after a sheet got another name."""

    def change(ref):
        if ref.sheet.lower() != old.lower() or not ref.sheet:
            return ref
        if isinstance(ref, Cell):
            return replace(ref, sheet=new)
        return Area(replace(ref.first, sheet=new), replace(ref.last, sheet=new), new)

    return rewrite(formula, change)
