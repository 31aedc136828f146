"""Workbooks of single cells: dependencies between formulas, their order, evaluation and recalculation.

A workbook's cells are keyed (sheet, row, col). Ranges stay whole in the graph: a formula is linked to the formula cells that
lie in a range, found by column and sorted rows, not to every cell of it. calculate() and recalculate() deal workbooks out:
each is evaluated by one task, so any number of workbooks spreads over a cluster, and one workbook is what a task holds."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import plain
from ..functions.plain import Err, Grid
from ..operators.structure import column_letter
from .syntax import Area, Cell, UnsupportedFormula, parse, parse_reference, quote_sheet, references

Key = tuple[str, int, int]


class CycleError(ValueError):
    pass


def key_of(text: str, sheet: str = "") -> Key:
    """The key of a cell written as Sheet!A1 or, on a given sheet, A1."""
    ref = parse_reference(text)
    if not isinstance(ref, Cell) or not ref.row or not ref.col:
        raise ValueError(f"not a cell: {text!r}")
    return ref.sheet or sheet, ref.row, ref.col


def name_of(key: Key) -> str:
    return f"{quote_sheet(key[0])}!{column_letter(key[2])}{key[1]}"


class Functions:
    """Functions by name. A raw function gets the evaluator, its sheet and its arguments' trees instead of values."""

    def __init__(self):
        self.plain: dict[str, Callable] = dict(plain.BUILT_IN)
        self.raw: dict[str, Callable] = {"OFFSET": _offset}

    def register(self, name: str, f: Callable, raw: bool = False) -> None:
        (self.raw if raw else self.plain)[name.upper()] = f
        (self.plain if raw else self.raw).pop(name.upper(), None)

    def is_supported(self, name: str) -> bool:
        return name.upper() in self.plain or name.upper() in self.raw


@dataclass(frozen=True)
class Delta:
    cell: Key
    old: object
    new: object
    formula: str


@dataclass(frozen=True)
class Recalculated:
    deltas: tuple[Delta, ...]
    total_formula_cells: int
    propagated_cells: int
    max_chain_depth: int


@runtime_checkable
class Engine(Protocol):
    """What evaluates a workbook."""

    def load(self, cells: Iterable[tuple[str, int, int, object]], names: dict[str, str] | None = None) -> None: ...

    def calculate(self) -> dict[Key, object]: ...

    def recalculate(self, changes: dict, tolerance: float = 1e-10) -> Recalculated: ...


class Graph:
    """Which formulas depend on which cells."""

    def __init__(self, formulas: dict[Key, str], names: dict[str, str] | None = None):
        self.formulas = formulas
        self.names = {k.upper(): v for k, v in (names or {}).items()}
        #: Rows with formulas, sorted, by sheet and column.
        self.rows: dict[tuple[str, int], list[int]] = defaultdict(list)
        for sheet, row, col in formulas:
            self.rows[sheet, col].append(row)
        self.columns: dict[str, list[int]] = defaultdict(list)
        for (sheet, col), rows in self.rows.items():
            rows.sort()
            self.columns[sheet].append(col)
        for cols in self.columns.values():
            cols.sort()
        #: Single cells, and areas as (key, sheet, bounds).
        self.cells: dict[Key, set[Key]] = {}
        self.areas: dict[Key, list[tuple[str, tuple[int, int, int, int]]]] = {}
        for key, text in formulas.items():
            self.cells[key], self.areas[key] = set(), []
            try:
                found = list(references(parse(text)))
            except UnsupportedFormula:
                continue
            for ref in found:
                ref = self.resolved(ref)
                if isinstance(ref, Cell):
                    self.cells[key].add((ref.sheet or key[0], ref.row, ref.col))
                elif isinstance(ref, Area):
                    self.areas[key].append((ref.sheet or key[0], ref.bounds()))

    def resolved(self, ref) -> Cell | Area | None:
        """A reference, or what a defined name stands for."""
        if not isinstance(ref, str):
            return ref
        text = self.names.get(ref.upper())
        found = parse_reference(text.removeprefix("=")) if text else None
        return None if isinstance(found, str) else found

    def formulas_in(self, sheet: str, bounds: tuple[int, int, int, int]) -> Iterator[Key]:
        top, left, bottom, right = bounds
        cols = self.columns.get(sheet, [])
        for col in cols[bisect_left(cols, left) : bisect_right(cols, right)]:
            rows = self.rows[sheet, col]
            yield from ((sheet, r, col) for r in rows[bisect_left(rows, top) : bisect_right(rows, bottom)])

    def precedents(self, key: Key) -> set[Key]:
        """The formula cells that a formula reads."""
        out = {k for k in self.cells[key] if k in self.formulas}
        for sheet, bounds in self.areas[key]:
            out.update(self.formulas_in(sheet, bounds))
        return out

    def _edges(self) -> tuple[dict[Key, list[Key]], dict[Key, int]]:
        after: dict[Key, list[Key]] = defaultdict(list)
        waits = {}
        for key in self.formulas:
            before = self.precedents(key)
            waits[key] = len(before)
            for b in before:
                after[b].append(key)
        return after, waits

    def levels(self) -> dict[Key, int]:
        """Each formula's level: 0 reads no formula, others one more than the highest they read. A cycle raises."""
        after, waits = self._edges()
        level = {k: 0 for k, n in waits.items() if not n}
        ready = deque(sorted(level))
        while ready:
            key = ready.popleft()
            for k in after[key]:
                waits[k] -= 1
                level[k] = max(level.get(k, 0), level[key] + 1)
                if not waits[k]:
                    ready.append(k)
        left = sorted(k for k, n in waits.items() if n)
        if left:
            raise CycleError(f"formulas read each other in a circle: {', '.join(map(name_of, left[:5]))}")
        return level

    def order(self) -> list[Key]:
        """Formulas after all that they read; the same order every time."""
        level = self.levels()
        return sorted(level, key=lambda k: (level[k], k))

    def _direct(self, keys: Iterable[Key]) -> Iterator[tuple[Key, Key]]:
        """(cell, formula that reads it) for the given cells."""
        if not hasattr(self, "_readers"):
            self._readers: dict[Key, list[Key]] = defaultdict(list)
            for key, cells in self.cells.items():
                for c in cells:
                    self._readers[c].append(key)
            self._spans = [(sheet, bounds, key) for key, areas in self.areas.items() for sheet, bounds in areas]
            by: dict[tuple[str, int], list] = defaultdict(list)
            for sheet, (top, left, bottom, right), key in self._spans:
                for col in range(left, min(right, left + 255) + 1):
                    by[sheet, col].append((top, bottom, key))
            self._by_column = by
            self._wide = [s for s in self._spans if s[1][3] - s[1][1] > 255]
        for cell in keys:
            yield from ((cell, k) for k in self._readers.get(cell, ()))
            yield from ((cell, k) for top, bottom, k in self._by_column.get((cell[0], cell[2]), ()) if top <= cell[1] <= bottom)
            yield from ((cell, k) for sheet, (top, left, bottom, right), k in self._wide if sheet == cell[0] and top <= cell[1] <= bottom and left + 255 < cell[2] <= right)

    def affected(self, changed: Iterable[Key]) -> list[Key]:
        """The formulas that depend on changed cells, at any remove, in order of evaluation."""
        seen: set[Key] = set()
        todo = list(changed)
        while todo:
            found = {k for _, k in self._direct(todo)} - seen
            seen |= found
            todo = list(found)
        level = self.levels() if seen else {}
        return sorted(seen, key=lambda k: (level[k], k))

    def max_depth(self, roots: Iterable[Key]) -> int:
        """Formulas on the longest chain that begins at any of the cells."""
        roots = list(roots)
        affected = self.affected(roots)
        depth: dict[Key, int] = dict.fromkeys(roots, 0)
        for key in affected:
            before = [depth[k] for k in self.precedents(key) | self.cells[key] if k in depth]
            inside = [depth[r] for r in roots if any(s == r[0] and b[0] <= r[1] <= b[2] and b[1] <= r[2] <= b[3] for s, b in self.areas[key])]
            depth[key] = 1 + max(before + inside, default=0)
        return max((depth[k] for k in affected), default=0)


@dataclass
class Evaluator:
    """One workbook in memory: load(), calculate() and recalculate()."""

    functions: Functions = field(default_factory=Functions)
    #: Called with (formula, sheet) where the engine has no such function; None leaves the cell blank.
    fallback: Callable[[str, str], object] | None = None

    def load(self, cells: Iterable[tuple[str, int, int, object]], names: dict[str, str] | None = None) -> None:
        """Cells as (sheet, row, col, value); text that begins with = is a formula. names: what defined names stand for."""
        self.values: dict[Key, object] = {}
        self.column_rows: dict[tuple[str, int], list[int]] | None = None
        formulas = {}
        for sheet, row, col, value in cells:
            key = (sheet, row, col)
            if isinstance(value, str) and value.startswith("="):
                formulas[key] = value
                value = None
            self.values[key] = value
        self.graph = Graph(formulas, names)

    def calculate(self) -> dict[Key, object]:
        """The value of every formula cell."""
        order = self.graph.order()
        for key in order:
            self.values[key] = self.evaluate(self.graph.formulas[key], key[0])
        return {k: self.values[k] for k in order}

    def recalculate(self, changes: dict, tolerance: float = 1e-10) -> Recalculated:
        """Change input cells (keys, or text such as Sheet!A1) and evaluate what depends on them, nothing else."""
        changes = {key_of(k) if isinstance(k, str) else k: v for k, v in changes.items()}
        affected = self.graph.affected(changes)
        old = {k: self.values.get(k) for k in affected}
        for k, v in changes.items():
            self.values[k] = v
            self.column_rows = None
        deltas = []
        for key in affected:
            value = self.values[key] = self.evaluate(self.graph.formulas[key], key[0])
            if differs(old[key], value, tolerance):
                deltas.append(Delta(key, old[key], value, self.graph.formulas[key]))
        return Recalculated(tuple(deltas), len(self.graph.formulas), len(deltas), self.graph.max_depth(changes))

    def evaluate(self, formula: str, sheet: str):
        """A formula's value; blank where a function can't use its arguments."""
        try:
            found = self.value(parse(formula), sheet)
        except (UnsupportedFormula, ArithmeticError, ValueError, TypeError, IndexError):
            found = self.fallback(formula, sheet) if self.fallback else None
        return found.values[0] if isinstance(found, Grid) and len(found.values) == 1 else None if isinstance(found, Grid) else found

    def value(self, tree: tuple, sheet: str):
        kind = tree[0]
        if kind in ("num", "text", "bool"):
            return tree[1]
        if kind == "err":
            return Err(tree[1])
        if kind == "blank":
            return None
        if kind in ("ref", "area"):
            return self.read(tree[1], sheet)
        if kind == "name":
            ref = self.graph.resolved(tree[1])
            return self.read(ref, sheet) if ref is not None else plain.NAME
        if kind == "sign":
            v = self.value(tree[2], sheet)
            return -v if tree[1] == "-" and plain.is_number(v) else v
        if kind == "percent":
            return plain.arithmetic("/", self.value(tree[1], sheet), 100)
        if kind == "op":
            a, b = (self.single(self.value(t, sheet)) for t in tree[2:])
            return plain.compare(tree[1], a, b) if tree[1] in ("=", "<>", "<", "<=", ">", ">=") else plain.arithmetic(tree[1], a, b)
        name, args = tree[1], tree[2]
        if name in self.functions.raw:
            return self.functions.raw[name](self, sheet, args)
        if name not in self.functions.plain:
            raise UnsupportedFormula(f"no function {name}")
        return self.functions.plain[name](*(self.value(a, sheet) for a in args))

    @staticmethod
    def single(v):
        return v.values[0] if isinstance(v, Grid) and len(v.values) == 1 else v

    def read(self, ref: Cell | Area, sheet: str):
        """The value of a cell, or the values of an area; open ends reach as far as the sheet has cells."""
        home = ref.sheet or sheet
        if isinstance(ref, Cell):
            return self.values.get((home, ref.row, ref.col))
        top, left, bottom, right = ref.bounds()
        if not (ref.first.row and ref.first.col):
            used = [(r, c) for s, r, c in self.values if s == home]
            bottom, right = min(bottom, max((r for r, _ in used), default=top)), min(right, max((c for _, c in used), default=left))
        cells = [self.values.get((home, r, c)) for r in range(top, bottom + 1) for c in range(left, right + 1)]
        return Grid(cells, max(bottom - top + 1, 0), max(right - left + 1, 0))


def _offset(engine: Evaluator, sheet: str, args: list[tuple]):
    """OFFSET: the cell or area so many rows and columns on from a reference, of another height and width if given."""
    ref = engine.graph.resolved(args[0][1]) if args[0][0] == "name" else args[0][1]
    first = ref if isinstance(ref, Cell) else ref.first
    numbers = [engine.single(engine.value(a, sheet)) for a in args[1:]]
    error = next((v for v in numbers if isinstance(v, Err)), None)
    if error is not None:
        return error
    rows, cols, *size = numbers
    height, width = ([plain.whole(s) if s is not None else None for s in size] + [None, None])[:2]
    own = (1, 1) if isinstance(ref, Cell) else ref.shape
    height, width = own[0] if height is None else height, own[1] if width is None else width
    row, col = first.row + plain.whole(rows), first.col + plain.whole(cols)
    if row < 1 or col < 1 or height < 1 or width < 1:
        return plain.REF
    if height == width == 1:
        return engine.read(Cell(row, col, sheet=first.sheet), sheet)
    return engine.read(Area(Cell(row, col), Cell(row + height - 1, col + width - 1), first.sheet), sheet)


def differs(a, b, tolerance: float) -> bool:
    if plain.is_number(a) and plain.is_number(b):
        return abs(float(a) - float(b)) > tolerance
    return a != b or (a is None) != (b is None)


SCHEMA = "{book} string, sheet string, row int, col int, formula string, kind string, value string, level int"
DELTAS = "{book} string, sheet string, row int, col int, formula string, old double, new double, old_text string, new_text string, total_formula_cells bigint, propagated_cells bigint, max_chain_depth bigint"


def typed(kind: str | None, value: str | None, formula: str | None):
    """A stored cell as a value: (kind, value) as the readers give them; a formula wins."""
    if formula:
        return formula if formula.startswith("=") else f"={formula}"
    if value is None:
        return None
    if kind == "number":
        return float(value) if any(ch in value for ch in ".eEnN") else int(value)
    return value == "true" if kind == "bool" else Err(value) if kind == "error" else value


def kind_of(v) -> tuple[str, str | None]:
    if v is None:
        return "blank", None
    if isinstance(v, bool):
        return "bool", str(v).lower()
    if isinstance(v, Err):
        return "error", str(v)
    return ("number", repr(float(v))) if plain.is_number(v) else ("string", v)


def _loaded(rows: pa.Table, names: dict[str, str], make: Callable[[], Evaluator]) -> Evaluator:
    engine = make()
    columns = (rows[c].to_pylist() for c in ("sheet", "row", "col", "kind", "value", "formula"))
    engine.load([(s, r, c, typed(k, v, f)) for s, r, c, k, v, f in zip(*columns, strict=True)], names)
    return engine


def calculate(cells: DataFrame, book: str = "file", names: dict[str, str] | None = None, make: Callable[[], Evaluator] = Evaluator) -> DataFrame:
    """book, sheet, row, col, formula, kind, value, level of every formula cell of every workbook.

    cells: book, sheet, row, col, kind, value, formula, as the readers give them. A workbook whose formulas read each other
    in a circle raises. Workbooks are dealt over tasks by name; a task holds one at a time."""
    held = names or {}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        engine = _loaded(rows, held, make)
        found = engine.calculate()
        level = engine.graph.levels()
        out = [(key[0].as_py(), *k, engine.graph.formulas[k], *kind_of(v), level[k]) for k, v in found.items()]
        return _table(out, (book, "sheet", "row", "col", "formula", "kind", "value", "level"), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()))

    return cells.groupBy(book).applyInArrow(run, SCHEMA.format(book=book))


def recalculate(cells: DataFrame, changes: DataFrame, book: str = "file", tolerance: float = 1e-10, names: dict[str, str] | None = None, make: Callable[[], Evaluator] = Evaluator) -> DataFrame:
    """What changes in every workbook when cells do: a row for each formula cell whose value differs by more than the
    tolerance, with counts for its workbook. changes: book, sheet, row, col, value (double). Only formulas that depend on a
    changed cell are evaluated a second time; workbooks without a change aren't read at all."""
    held = names or {}

    def run(rows: pa.Table, edits: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and edits.num_rows:
            engine = _loaded(rows, held, make)
            engine.calculate()
            columns = (edits[c].to_pylist() for c in ("sheet", "row", "col", "value"))
            got = engine.recalculate({(s, r, c): v for s, r, c, v in zip(*columns, strict=True)}, tolerance)
            number = lambda v: float(v) if plain.is_number(v) else None
            label = lambda v: None if v is None or plain.is_number(v) else str(v)
            counts = (got.total_formula_cells, got.propagated_cells, got.max_chain_depth)
            out = [(rows[book][0].as_py(), *d.cell, d.formula, number(d.old), number(d.new), label(d.old), label(d.new), *counts) for d in got.deltas]
        names_ = (book, "sheet", "row", "col", "formula", "old", "new", "old_text", "new_text", "total_formula_cells", "propagated_cells", "max_chain_depth")
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return _table(out, names_, kinds)

    touched = cells.join(changes.select(book).distinct(), book, "left_semi")
    return touched.groupBy(book).cogroup(changes.groupBy(book)).applyInArrow(run, DELTAS.format(book=book))


def _table(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(names))
