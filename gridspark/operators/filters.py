"""AutoFilter: each kind of filter is a predicate on one column; a filter over columns is their AND.

Statistics that a filter needs (a mean, an n-th value) come from the whole, unfiltered column, as one row that is joined."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import glob_regex, is_error, num, txt
from .ordered import nth


@dataclass
class Custom:
    """(operator, operand) terms: = <> < <= > >=; numeric if both sides are numbers, else lower-case text with * and ?."""

    terms: list[tuple[str, object]]
    both: bool = False


@dataclass
class Values:
    """A list of numbers or of texts; blanks only if asked for."""

    values: list
    blank: bool = False


@dataclass
class Blank:
    pass


@dataclass
class AcceptAll:
    """Filters by colour or icon, which have no values to go by."""


@dataclass
class Top:
    """The n top (or bottom) numbers, or n percent of the rows; ties are kept."""

    n: float
    percent: bool = False
    bottom: bool = False


@dataclass
class Dynamic:
    """aboveAverage, belowAverage; today, tomorrow, yesterday; this/last/next Week, Month, Quarter, Year; yearToDate;
    Q1 to Q4, M1 to M12; null. Weeks begin on Sunday."""

    kind: str
    reference: date | None = None


@dataclass
class DateParts:
    """Any of some (year, month, day) tuples, each as long as it needs to be."""

    items: list[tuple[int, ...]] = field(default_factory=list)


def _compare(c: Column, kind: str, op: str, operand) -> Column:
    n = num(c, kind)
    try:
        value = float(operand)
    except (TypeError, ValueError):
        value = None
    t, low = txt(c), str(operand).lower()
    same = t.rlike(glob_regex(low))
    text = {"=": same, "<>": ~same, "<": t < low, "<=": t <= low, ">": t > low, ">=": t >= low}[op]
    if value is None:
        return text
    return F.when(n.isNotNull(), {"=": n == value, "<>": n != value, "<": n < value, "<=": n <= value, ">": n > value, ">=": n >= value}[op]).otherwise(text)


def _period(d: Column, kind: str, ref: date) -> Column:
    r = F.lit(ref.isoformat()).cast("date")
    step = {"this": 0, "last": -1, "next": 1}.get(kind[:4], 0)
    unit = kind[4:].lower()
    if kind in ("today", "tomorrow", "yesterday"):
        return d == F.date_add(r, {"today": 0, "tomorrow": 1, "yesterday": -1}[kind])
    if kind == "yearToDate":
        return (d >= F.trunc(r, "YYYY")) & (d <= r)
    if kind[0] == "Q" and kind[1:].isdigit():
        return F.quarter(d) == int(kind[1:])
    if kind[0] == "M" and kind[1:].isdigit():
        return F.month(d) == int(kind[1:])
    if unit == "week":
        start = F.date_add(r, 1 - F.dayofweek(r) + 7 * step)
        return (d >= start) & (d < F.date_add(start, 7))
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    start = F.add_months(F.trunc(r, {"month": "MM", "quarter": "QUARTER", "year": "YYYY"}[unit]), months * step)
    return (d >= start) & (d < F.add_months(start, months))


def auto_filter(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that every column's filter keeps."""
    kinds = dict(df.dtypes)
    columns, out, keep = df.columns, df, F.lit(True)
    for k, (name, f) in enumerate(filters.items()):
        c, n = F.col(name), num(F.col(name), kinds[name])
        if isinstance(f, Blank):
            hit = c.isNull()
        elif isinstance(f, AcceptAll) or (isinstance(f, Dynamic) and f.kind == "null"):
            hit = F.lit(True)
        elif isinstance(f, Custom):
            terms = [_compare(c, kinds[name], op, x) for op, x in f.terms]
            hit = reduce(lambda a, b: a & b if f.both else a | b, terms) if terms else F.lit(True)
        elif isinstance(f, Values):
            numbers = [v for v in f.values if isinstance(v, (int, float))]
            texts = [str(v).lower() for v in f.values if not isinstance(v, (int, float))]
            hit = reduce(lambda a, b: a | b, [F.abs(n - float(v)) < 1e-9 for v in numbers], F.lit(False)) | (F.lower(c.cast("string")).isin(texts) if texts else F.lit(False))
            hit = F.coalesce(hit, F.lit(False)) | (c.isNull() & F.lit(f.blank))
        elif isinstance(f, DateParts):
            parts = (F.year(c), F.month(c), F.day(c))
            hit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [p == v for p, v in zip(parts, item, strict=False)]) for item in f.items], F.lit(False))
        elif isinstance(f, Dynamic) and f.kind in ("aboveAverage", "belowAverage"):
            out = out.join(F.broadcast(df.agg(F.coalesce(F.avg(n), F.lit(0.0)).alias(f"_mean{k}"))))  # one row
            hit = n > F.col(f"_mean{k}") if f.kind == "aboveAverage" else n < F.col(f"_mean{k}")
        elif isinstance(f, Dynamic):
            hit = _period(c.cast("date"), f.kind, f.reference or date.today())
        elif isinstance(f, Top):
            out = out.join(F.broadcast(_nth(df, n, f).withColumnRenamed("nth", f"_nth{k}")))  # one row
            hit = n <= F.col(f"_nth{k}") if f.bottom else n >= F.col(f"_nth{k}")
        else:
            raise TypeError(f"no such filter: {f!r}")
        keep = keep & F.coalesce(hit, F.lit(False))
    return out.filter(keep).select(*columns)


def _nth(df: DataFrame, n: Column, f: Top) -> DataFrame:
    """The n-th value of the whole column: a top-k where n is small, else by counts of buckets."""
    if f.percent:
        total = df.select(n.alias("v")).filter("v IS NOT NULL").count()
        want = -(-f.n * total // 100)
    else:
        want = f.n
    return nth(df, n, int(want), descending=not f.bottom)


def hidden(df: DataFrame, filters: dict[str, object], position: str, header: bool = True) -> DataFrame:
    """df with `hidden`, for a range whose first row by position is a header (never hidden, and no value) unless header is
    false."""
    first = df.agg(F.min(position)).first()[0] if header else None
    body = df.filter(F.col(position) != first) if first is not None else df
    seen = auto_filter(body, filters).select(F.col(position).alias("_kept")).distinct()
    joined = df.join(seen, F.col(position) == F.col("_kept"), "left")
    shown = F.col("_kept").isNotNull() if first is None else F.col("_kept").isNotNull() | (F.col(position) == first)
    return joined.withColumn("hidden", ~shown).drop("_kept")


def above_group_mean(df: DataFrame, column: str, group: str, below: bool = False) -> DataFrame:
    """Rows whose number is above (below) the mean of their group: means are one aggregate, joined back."""
    n = num(F.col(column), dict(df.dtypes)[column])
    means = df.groupBy(F.col(group).alias("_g")).agg(F.avg(n).alias("_mean"))
    joined = df.join(means, F.col(group).eqNullSafe(F.col("_g")))
    return joined.filter(n < F.col("_mean") if below else n > F.col("_mean")).select(*df.columns)


def project(df: DataFrame, columns: list[str] | None = None, position: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Some columns and rows of a sheet: what isn't wanted isn't read."""
    if position and first is not None:
        df = df.filter(F.col(position) >= first)
    if position and last is not None:
        df = df.filter(F.col(position) <= last)
    return df.select(*columns) if columns else df


@dataclass
class Slicer:
    """Items of a field that are shown, in ascending, descending or data order; an item not listed is hidden."""

    column: str
    items: list
    order: str = "ascending"

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.column).isin(self.items)) if self.items else df.limit(0)

    def listed(self, df: DataFrame, position: str | None = None) -> DataFrame:
        """The field's items: item, shown, and place (from 1) in the slicer's order."""
        seen = df.filter(F.col(self.column).isNotNull()).groupBy(F.col(self.column).alias("item")).agg(F.min(position or self.column).alias("_at"))
        by = {"ascending": F.asc("item"), "descending": F.desc("item"), "none": F.asc("_at")}[self.order]
        return seen.select("item", F.col("item").isin(self.items).alias("shown"), F.row_number().over(W.orderBy(by)).alias("place"))


# Rules of formats and validations, as columns that say whether a cell meets them.

_BETWEEN = {"between": lambda c, a, b: c.between(a, b), "notBetween": lambda c, a, b: ~c.between(a, b)}
_COMPARE = {
    "equal": lambda c, a: c == a, "notEqual": lambda c, a: c != a, "greaterThan": lambda c, a: c > a, "lessThan": lambda c, a: c < a, "greaterThanOrEqual": lambda c, a: c >= a, "lessThanOrEqual": lambda c, a: c <= a,
}


def compared(c: Column, operator: str, first, second=None) -> Column:
    """A comparison by the name that rules use."""
    low = F.lit(first) if not isinstance(first, Column) else first
    return _BETWEEN[operator](c, low, F.lit(second) if not isinstance(second, Column) else second) if operator in _BETWEEN else _COMPARE[operator](c, low)


def flagged(df: DataFrame, column: str, rule: str, out: str, operator: str = "equal", first=None, second=None, rank: float = 10, percent: bool = False, bottom: bool = False, reference: date | None = None) -> DataFrame:
    """df with a flag: whether a cell meets a conditional format's rule. cellIs, expression (first: a Column), top10,
    aboveAverage (bottom: below), duplicateValues, uniqueValues, containsText, notContainsText, beginsWith, endsWith,
    containsBlanks, notContainsBlanks, containsErrors, notContainsErrors, timePeriod (first: the period of Dynamic). A
    colorScale, dataBar or iconSet gives each number's place between the least and the greatest, 0 to 1."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    n, t = num(c, kind), F.lower(c.cast("string"))
    blank = c.isNull() | (F.trim(c.cast("string")) == "")
    text = F.lit(str(first).lower())
    simple = {
        "cellIs": lambda: compared(c, operator, first, second), "expression": lambda: first, "containsText": lambda: F.contains(t, text), "notContainsText": lambda: ~F.contains(t, text), "beginsWith": lambda: F.startswith(t, text), "endsWith": lambda: F.endswith(t, text),
        "containsBlanks": lambda: blank, "notContainsBlanks": lambda: ~blank, "containsErrors": lambda: is_error(c.cast("string")), "notContainsErrors": lambda: ~is_error(c.cast("string")), "timePeriod": lambda: _period(c.cast("date"), first, reference or date.today()),
    }
    if rule in simple:
        return df.withColumn(out, F.coalesce(simple[rule](), F.lit(rule in ("notContainsText",))))
    if rule in ("top10", "aboveAverage"):
        f = Top(rank, percent, bottom) if rule == "top10" else Dynamic("belowAverage" if bottom else "aboveAverage")
        if rule == "top10":
            one = _nth(df, n, f).withColumnRenamed("nth", "_one")
            hit = n <= F.col("_one") if bottom else n >= F.col("_one")
        else:
            one = df.agg(F.avg(n).alias("_one"))
            hit = n < F.col("_one") if bottom else n > F.col("_one")
        return df.join(F.broadcast(one)).withColumn(out, F.coalesce(hit, F.lit(False))).drop("_one")
    if rule in ("duplicateValues", "uniqueValues"):
        # Values that occur again, found by one aggregate; a blank is neither.
        again = df.filter(c.isNotNull()).groupBy(t.alias("_v")).agg(F.count("*").alias("_n")).filter("_n > 1")
        hit = F.col("_v").isNotNull() if rule == "duplicateValues" else F.col("_v").isNull() & c.isNotNull()
        return df.join(again, t == F.col("_v"), "left").withColumn(out, hit).drop("_v", "_n")
    if rule in ("colorScale", "dataBar", "iconSet"):
        ends = df.agg(F.min(n).alias("_low"), F.max(n).alias("_high"))
        return df.join(F.broadcast(ends)).withColumn(out, F.when(F.col("_high") > F.col("_low"), (n - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.when(n.isNotNull(), F.lit(0.0)))).drop("_low", "_high")
    raise ValueError(f"no such rule: {rule}")


def valid(c: Column, kind: str, rule: str, operator: str = "between", first=None, second=None, allow_blank: bool = True) -> Column:
    """Whether a cell meets a validation: list (first: the values), whole, decimal, date, time, textLength or custom (first: a
    Column). kind: the column's Spark type."""
    n = num(c, kind) if kind not in ("date", "timestamp", "timestamp_ntz") else None
    if rule == "list":
        hit = F.lower(c.cast("string")).isin([str(v).lower() for v in first])
    elif rule == "custom":
        hit = first
    elif rule == "textLength":
        hit = compared(F.length(c.cast("string")), operator, first, second)
    elif rule in ("whole", "decimal"):
        hit = compared(n, operator, first, second) & ((n == F.floor(n)) if rule == "whole" else F.lit(True))
    elif rule in ("date", "time"):
        hit = compared(c.cast("date") if rule == "date" else F.date_format(c, "HH:mm:ss"), operator, first, second)
    else:
        raise ValueError(f"no such validation: {rule}")
    return F.when(c.isNull(), F.lit(allow_blank)).otherwise(F.coalesce(hit, F.lit(False)))


@dataclass
class SortState:
    """What a sheet is sorted by: conditions in order, each a column, descending or not, and maybe a list of texts that come
    first in that order. Colours and icons have no values to sort by and keep rows as they are. Columns may be sorted
    instead of rows."""

    ref: str = ""
    conditions: list[tuple[str, bool, list | None]] = field(default_factory=list)
    case_sensitive: bool = False
    column_sort: bool = False

    def add(self, column: str, descending: bool = False, sort_by: str = "value", custom: list | None = None, ref: str = "") -> SortState:
        self.ref = self.ref or ref or column
        if sort_by == "value":
            self.conditions.append((column, descending, custom))
        return self

    def apply(self, df: DataFrame, position: str) -> DataFrame:
        """df in order; sorted by columns, the columns other than the position go by the first condition's row."""
        if self.column_sort:
            at, descending, _ = self.conditions[0]
            row = df.filter(F.col(position).cast("string") == at).drop(position).first()
            names = sorted(row.asDict(), key=lambda c: (row[c] is None, row[c] if not isinstance(row[c], str) else row[c].lower()), reverse=descending) if row else []
            return df.select(position, *names)
        return sort_rows(df, [(c, d) for c, d, _ in self.conditions], self.case_sensitive, position, {c: x for c, _, x in self.conditions if x})


def sort_keys(df: DataFrame, keys: list[tuple[str, bool]], case_sensitive: bool = False, position: str | None = None, custom: dict[str, list] | None = None) -> list[Column]:
    """What rows are ordered by: see sort_rows()."""
    order = []
    for name, desc in keys:
        c, kind = F.col(name), dict(df.dtypes)[name]
        if custom and name in custom:
            place = F.array_position(F.array(*(F.lit(str(v).lower()) for v in custom[name])), F.lower(c.cast("string")))
            listed = F.when(place > 0, place)
            order.append(listed.desc_nulls_first() if desc else listed.asc_nulls_last())
        parts = [num(c, "string"), c if case_sensitive else F.lower(c)] if kind == "string" else [c]
        # A number that is text too is sorted as a number; all numbers come before texts, texts before blanks.
        order += [p.desc_nulls_first() if desc else p.asc_nulls_last() for p in parts]
    return [*order, *([F.col(position)] if position else [])]


def sort_rows(df: DataFrame, keys: list[tuple[str, bool]], case_sensitive: bool = False, position: str | None = None, custom: dict[str, list] | None = None) -> DataFrame:
    """Rows by several (column, descending) keys: numbers before text, blanks last if ascending and first if descending.
    position: a column that keeps ties in their old order. custom: texts of a column that come first, in their order."""
    return df.orderBy(*sort_keys(df, keys, case_sensitive, position, custom))


def first_rows(df: DataFrame, n: int, keys: list[tuple[str, bool]], position: str | None = None) -> DataFrame:
    """The first n rows in order (0: all), with their place from 1: each task keeps its own first n."""
    order = sort_keys(df, keys, position=position)
    some = df.orderBy(*order).limit(n) if n else df
    return some.withColumn("place", F.row_number().over(W.orderBy(*order)))
