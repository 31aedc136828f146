"""Row and column edits of sheets in long form (row, col, ...), references and range algebra."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_letter(n: int) -> str:
    """1 is A, 27 is AA; up to ZZZ."""
    if not 1 <= n <= 18278:
        raise ValueError(f"no such column: {n}")
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        if not "A" <= ch <= "Z":
            raise ValueError(f"no such column: {letters}")
        n = n * 26 + ord(ch) - 64
    return n


@dataclass(frozen=True)
class Range:
    """A rectangle of cells, 1-based and inclusive."""

    top: int
    left: int
    bottom: int
    right: int

    @classmethod
    def parse(cls, text: str) -> Range:
        found = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?", text)
        if not found:
            raise ValueError(f"no such range: {text}")
        c1, r1, c2, r2 = found[1], int(found[2]), found[3] or found[1], int(found[4] or found[2])
        a, b = sorted((column_number(c1), column_number(c2)))
        return cls(min(r1, r2), a, max(r1, r2), b)

    def __str__(self) -> str:
        first, last = (f"{column_letter(c)}{r}" for c, r in ((self.left, self.top), (self.right, self.bottom)))
        return first if first == last else f"{first}:{last}"

    def intersection(self, o: Range) -> Range | None:
        t, l, b, r = max(self.top, o.top), max(self.left, o.left), min(self.bottom, o.bottom), min(self.right, o.right)  # noqa: E741
        return Range(t, l, b, r) if t <= b and l <= r else None

    def union(self, o: Range) -> Ranges:
        return Ranges([self, o])

    def disjoint(self, o: Range) -> bool:
        return self.intersection(o) is None

    def subset(self, o: Range) -> bool:
        return self.intersection(o) == self

    def contains(self, row: int, col: int) -> bool:
        return self.top <= row <= self.bottom and self.left <= col <= self.right

    def grown(self, up: int = 0, left: int = 0, down: int = 0, right: int = 0) -> Range:
        """The range with its edges moved outwards; negative numbers shrink it."""
        r = Range(self.top - up, self.left - left, self.bottom + down, self.right + right)
        if r.top < 1 or r.left < 1 or r.top > r.bottom or r.left > r.right:
            raise ValueError("no such range")
        return r

    def expand(self, right: int = 0, down: int = 0, left: int = 0, up: int = 0) -> Range:
        return self.grown(up, left, down, right)

    def shrink(self, right: int = 0, down: int = 0, left: int = 0, up: int = 0) -> Range:
        return self.grown(-up, -left, -down, -right)

    def shift(self, rows: int, cols: int) -> Range:
        r = Range(self.top + rows, self.left + cols, self.bottom + rows, self.right + cols)
        if r.top < 1 or r.left < 1:
            raise ValueError("a range leaves the sheet")
        return r

    def moved(self, axis: str, at: int, n: int) -> Range | None:
        """The range after n rows or columns are inserted at `at` (n < 0: deleted); None if nothing is left of it."""
        low, high = (self.top, self.bottom) if axis == "row" else (self.left, self.right)
        if n >= 0:
            low, high = low + n * (low >= at), high + n * (high >= at)
        else:
            end = at - n
            low = at if at <= low < end else low + n * (low >= end)
            high = at - 1 if at <= high < end else high + n * (high >= end)
        if low > high:
            return None
        return Range(low, self.left, high, self.right) if axis == "row" else Range(self.top, low, self.bottom, high)


class Ranges:
    """Several ranges, as a sheet's validations and formats have them: in order, each once."""

    def __init__(self, ranges: list[Range] | str = ()):
        self.ranges: list[Range] = []
        for r in ranges.split() if isinstance(ranges, str) else ranges:
            self.add(r)

    def add(self, r: Range | str) -> None:
        r = Range.parse(r) if isinstance(r, str) else r
        if not any(r.subset(x) for x in self.ranges):
            self.ranges.append(r)

    def remove(self, r: Range | str) -> None:
        self.ranges.remove(Range.parse(r) if isinstance(r, str) else r)

    def __contains__(self, r: Range | str) -> bool:
        r = Range.parse(r) if isinstance(r, str) else r
        return any(r.subset(x) for x in self.ranges)

    def __str__(self) -> str:
        return " ".join(map(str, self.ranges))

    def moved(self, axis: str, at: int, n: int) -> Ranges:
        """After rows or columns are inserted or deleted; ranges of which nothing is left go."""
        return Ranges([m for r in self.ranges if (m := r.moved(axis, at, n))])


def box(top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """A range in each row, as a struct."""
    return F.struct(top.alias("top"), left.alias("left"), bottom.alias("bottom"), right.alias("right"))


def overlaps(df: DataFrame, column: str, other: Range) -> DataFrame:
    """df with what a range in each row (see box) has to do with another: common cells, disjoint, inside, and shared (their
    intersection, null if disjoint)."""
    b = F.col(column)
    top, left = F.greatest(b.top, F.lit(other.top)), F.greatest(b.left, F.lit(other.left))
    bottom, right = F.least(b.bottom, F.lit(other.bottom)), F.least(b.right, F.lit(other.right))
    disjoint = (top > bottom) | (left > right)
    inside = (b.top >= other.top) & (b.left >= other.left) & (b.bottom <= other.bottom) & (b.right <= other.right)
    cells = F.when(disjoint, F.lit(0)).otherwise((bottom - top + 1) * (right - left + 1)).cast("bigint")
    return df.withColumns({"common": cells, "disjoint": disjoint, "inside": inside, "shared": F.when(~disjoint, box(top, left, bottom, right))})


# Names of cells


def letters(n: Column) -> Column:
    """column_letter() of a column of numbers."""
    k = n.cast("int") - 1
    digit = lambda v: F.char(F.lit(65) + v)
    one, two = digit(k % 26), digit(F.floor((k - 26) / 26).cast("int") % 26)
    three = digit(F.floor((k - 702) / 676).cast("int"))
    return F.when(k < 26, one).when(k < 702, F.concat(two, one)).otherwise(F.concat(three, digit(F.floor((k - 702) / 26).cast("int") % 26), one))


def coordinate_to_tuple(text: str) -> tuple[int, int]:
    """(row, column) of A1."""
    r = Range.parse(text)
    if (r.top, r.left) != (r.bottom, r.right):
        raise ValueError(f"not a cell: {text}")
    return r.top, r.left


def absolute_coordinate(text: str) -> str:
    """$A$1 of A1, $A$1:$B$2 of A1:B2."""
    return re.sub(r"\$?([A-Za-z]{1,3})\$?(\d+)", r"$\1$\2", text.upper())


def range_boundaries(text: str) -> tuple[int, int, int, int]:
    """(first column, first row, last column, last row)."""
    r = Range.parse(text)
    return r.left, r.top, r.right, r.bottom


def range_to_tuple(text: str) -> tuple[str, tuple[int, int, int, int]]:
    """The sheet and the boundaries of Sheet!A1:B2."""
    sheet, _, area = text.rpartition("!")
    return sheet.removeprefix("'").removesuffix("'").replace("''", "'"), range_boundaries(area)


def rows_from_range(text: str) -> list[tuple[str, ...]]:
    """The names of a range's cells, row by row."""
    r = Range.parse(text)
    return [tuple(f"{column_letter(c)}{k}" for c in range(r.left, r.right + 1)) for k in range(r.top, r.bottom + 1)]


def cols_from_range(text: str) -> list[tuple[str, ...]]:
    return list(zip(*rows_from_range(text), strict=True))


def column_interval(first: str | int, last: str | int) -> list[str]:
    """The letters from one column to another."""
    a, b = (column_number(x) if isinstance(x, str) else x for x in (first, last))
    return [column_letter(n) for n in range(a, b + 1)]


def to_long(df: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """Cells of a wide sheet: row, col, value as text; blanks have no row."""
    cells = F.array(*(F.struct(F.lit(i + 1).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    return df.select(F.col(position).cast("bigint").alias("row"), F.explode(cells).alias("c")).select("row", "c.col", "c.value").filter("value IS NOT NULL")


def rewritten(cells: DataFrame, change) -> DataFrame:
    """cells with change(formula, own sheet) for each formula; cells without one don't leave the JVM for it."""
    if "formula" not in cells.columns:
        return cells
    own = F.col("sheet") if "sheet" in cells.columns else F.lit("")

    @F.pandas_udf("string")
    def run(formula: pd.Series, sheet: pd.Series) -> pd.Series:
        return pd.Series([change(f, s) if f else f for f, s in zip(formula, sheet, strict=True)], dtype=object)

    return cells.withColumn("formula", F.when(F.col("formula").isNotNull(), run(F.col("formula"), own)))


def _own(cells: DataFrame, sheet: str | None) -> Column:
    return F.col("sheet") == sheet if sheet is not None and "sheet" in cells.columns else F.lit(True)


def insert(cells: DataFrame, axis: str, at: int, n: int, sheet: str | None = None) -> DataFrame:
    """Insert n rows (axis 'row') or columns ('col') before `at`, on one sheet if given; formulas on all sheets follow, fixed
    references too."""
    if n < (axis == "row") or at < 1:
        raise ValueError("at least one row, from row 1 on")
    from ..plans.syntax import shifted

    out = cells.withColumn(axis, F.when(_own(cells, sheet) & (F.col(axis) >= at), F.col(axis) + n).otherwise(F.col(axis)))
    return rewritten(out, lambda f, s: shifted(f, sheet or s, axis, at, n, own=s))


def delete(cells: DataFrame, axis: str, at: int, n: int, sheet: str | None = None) -> DataFrame:
    """Delete rows or columns [at, at + n); references into them are #REF!, ranges that lose cells shrink."""
    from ..plans.syntax import shifted

    own = _own(cells, sheet)
    left = cells.filter(~own | (F.col(axis) < at) | (F.col(axis) >= at + n))
    left = left.withColumn(axis, F.when(own & (F.col(axis) >= at + n), F.col(axis) - n).otherwise(F.col(axis)))
    return rewritten(left, lambda f, s: shifted(f, sheet or s, axis, at, -n, own=s))


def move(cells: DataFrame, source: Range, rows: int, cols: int, translate: bool = False) -> DataFrame:
    """Move a range; what lies at its new place is overwritten. Formulas inside move with it, but for what is fixed; translate:
    formulas outside that read the range follow it."""
    from ..plans.syntax import Area, Cell, rewrite, translated

    target = source.shift(rows, cols)
    inside = lambda r: F.col("row").between(r.top, r.bottom) & F.col("col").between(r.left, r.right)
    moving = inside(source)
    kept = cells.filter(moving | ~inside(target)).withColumn("_moving", moving)
    if "formula" in cells.columns:
        def follow(ref):
            within = lambda c: source.contains(c.row, c.col)
            go = lambda c: Cell(c.row + rows, c.col + cols, c.row_fixed, c.col_fixed, c.sheet)
            if isinstance(ref, Cell):
                return go(ref) if within(ref) else ref
            return Area(go(ref.first), go(ref.last), ref.sheet) if within(ref.first) and within(ref.last) else ref

        @F.pandas_udf("string")
        def run(formula: pd.Series, inside: pd.Series) -> pd.Series:
            return pd.Series([f if not f else translated(f, rows, cols) if i else rewrite(f, follow) if translate else f for f, i in zip(formula, inside, strict=True)], dtype=object)

        kept = kept.withColumn("formula", F.when(F.col("formula").isNotNull(), run(F.col("formula"), F.col("_moving"))))
    return kept.withColumns({"row": F.when(F.col("_moving"), F.col("row") + rows).otherwise(F.col("row")), "col": F.when(F.col("_moving"), F.col("col") + cols).otherwise(F.col("col"))}).drop("_moving")


def copy_sheet(cells: DataFrame, sheet: str, new: str) -> DataFrame:
    """All cells, and those of one sheet once more under another name."""
    return cells.unionByName(cells.filter(F.col("sheet") == sheet).withColumn("sheet", F.lit(new)))


def merge(cells: DataFrame, area: Range) -> DataFrame:
    """The cells after a range is merged: all but its first are blank."""
    first = (F.col("row") == area.top) & (F.col("col") == area.left)
    return cells.filter(first | ~(F.col("row").between(area.top, area.bottom) & F.col("col").between(area.left, area.right)))


def unmerge(merged: Ranges, area: Range) -> Ranges:
    return Ranges([r for r in merged.ranges if r != area])


def fill_merged(cells: DataFrame, merged: list[Range]) -> DataFrame:
    """Every cell of merged ranges with the value of its first one."""
    if not merged:
        return cells
    spots = cells.sparkSession.createDataFrame([(m.top, m.left, m.bottom, m.right) for m in merged], "t int, l int, b int, r int")
    first = cells.join(F.broadcast(spots), (F.col("row") == F.col("t")) & (F.col("col") == F.col("l")))
    spread = first.withColumn("row", F.explode(F.sequence("t", "b"))).withColumn("col", F.explode(F.sequence("l", "r"))).select(*cells.columns)
    apart = cells.join(F.broadcast(spots), F.col("row").between(F.col("t"), F.col("b")) & F.col("col").between(F.col("l"), F.col("r")), "left_anti")
    return apart.unionByName(spread)


def split_spans(spans: list[tuple[int, int, object]], at: int, n: int) -> list[tuple[int, int, object]]:
    """Column spans (first, last, what holds for them) after n columns are inserted at `at` (n < 0: deleted). A span that is
    parted by an insertion becomes two."""
    out = []
    for low, high, what in spans:
        if n >= 0 and low < at <= high:
            out += [(low, at - 1, what), (at + n, high + n, what)]
        elif m := Range(1, low, 1, high).moved("col", at, n):
            out.append((m.left, m.right, what))
    return out


def shift_table(ref: str, columns: list[str], axis: str, at: int, n: int) -> tuple[str, list[str]] | None:
    """A table's range and column names after rows or columns are inserted or deleted: new columns get names, deleted ones go.
    None if its header is gone."""
    old = Range.parse(ref)
    new = old.moved(axis, at, n)
    if new is None or (axis == "row" and n < 0 and at <= old.top < at - n):
        return None
    if axis == "col":
        if n < 0:
            columns = [c for k, c in enumerate(columns, old.left) if not at <= k < at - n]
        elif old.left < at <= old.right:
            taken, made, k = {c.lower() for c in columns}, [], 1
            while len(made) < n:
                if f"column{k}" not in taken:
                    made.append(f"Column{k}")
                k += 1
            columns = [*columns[: at - old.left], *made, *columns[at - old.left :]]
    return str(new), columns


def shift_formula(formula: str, axis: str, at: int, n: int) -> str:
    """References of a formula after n rows or columns are inserted at `at` (n < 0: deleted); a deleted cell is #REF!."""
    from ..plans.syntax import shifted

    return shifted(formula, "", axis, at, n)


def translate_formula(formula: str, rows: int, cols: int) -> str:
    """References of a formula copied elsewhere: those without $ move along."""
    from ..plans.syntax import translated

    return translated(formula, rows, cols)


# Ordered lists without repeats


def ordered_distinct(df: DataFrame, c: str, position: str) -> DataFrame:
    """Different values of a column in order of their first place: value, first, and index (from 0) by ranges of places."""
    from .ordered import running

    firsts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.min(position).alias("first"))
    return running(firsts, {"index": ("count", F.lit(1))}, "first").withColumn("index", F.col("index") - 1)
