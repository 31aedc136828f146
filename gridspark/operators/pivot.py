"""Pivot tables: a specification compiled to one groupBy, with grouping of dates and ranges, totals and show-as."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import num


def _n(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.lit(None).cast("double") if kind == "string" else num(F.col(c), kind)


def aggregate(df: DataFrame, c: str, fn: str) -> Column:
    """One of the eleven data functions over numeric cells; a deviation or variance of one value is 0."""
    n = _n(df, c)
    one = lambda x: F.when(F.count(n) == 1, F.lit(0.0)).otherwise(x)
    return {
        "sum": lambda: F.sum(n), "count": lambda: F.count(n), "countNums": lambda: F.count(n), "average": lambda: F.avg(n), "max": lambda: F.max(n), "min": lambda: F.min(n),
        "product": lambda: F.product(n), "stdDev": lambda: one(F.stddev_samp(n)), "var": lambda: one(F.var_samp(n)), "stdDevp": lambda: F.stddev_pop(n), "varp": lambda: F.var_pop(n),
    }[fn]()


@dataclass
class PivotSpec:
    rows: list[str]
    data: list[tuple[str, str]]
    cols: list[str] = field(default_factory=list)
    #: Page filters and slicers: only rows with these values are aggregated.
    pages: dict[str, list] = field(default_factory=dict)
    #: name -> SQL over the data columns' names (<column>_<function>).
    calculated: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.data:
            raise ValueError("a pivot needs a data field")
        if set(self.rows) & set(self.cols):
            raise ValueError("a field is on two axes")


def _filtered(df: DataFrame, spec: PivotSpec) -> DataFrame:
    for c, values in spec.pages.items():
        df = df.filter(F.col(c).isin(values))
    return df


def _data(df: DataFrame, spec: PivotSpec) -> list[Column]:
    return [aggregate(df, c, fn).alias(f"{c}_{fn}") for c, fn in spec.data]


def pivot(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """Long form: a row for each row key and column key. Aggregates are combined before the shuffle."""
    df = _filtered(df, spec)
    out = df.groupBy(*spec.rows, *spec.cols).agg(*_data(df, spec))
    return out.withColumns({k: F.expr(e) for k, e in spec.calculated.items()}) if spec.calculated else out


def pivot_wide(df: DataFrame, spec: PivotSpec, values: list) -> DataFrame:
    """Wide form over one column field with the given values, so that no pass is needed to find them."""
    (col,) = spec.cols
    df = _filtered(df, spec)
    return df.groupBy(*spec.rows).pivot(col, values).agg(*_data(df, spec))


def pivot_totals(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """Cells, subtotals and the grand total; `level` has a bit set for each key that is totalled away."""
    df = _filtered(df, spec)
    return df.cube(*spec.rows, *spec.cols).agg(F.grouping_id().cast("bigint").alias("level"), *_data(df, spec))


DATE_PARTS = {
    "years": F.year, "quarters": F.quarter, "months": F.month, "days": F.day, "hours": F.hour, "minutes": F.minute, "seconds": lambda c: F.floor(F.second(c)),
}
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def group_dates(c: Column, by: str) -> Column:
    """The part of a date that a date grouping goes by, as a number."""
    return DATE_PARTS[by](c).cast("bigint")


def date_labels(by: str, start: str, end: str, years: tuple[int, int] = (1900, 1900)) -> list[str]:
    """Labels of a date grouping, with one for dates before its start and one for those after its end."""
    inner = {
        "years": [str(y) for y in range(years[0], years[1] + 1)], "quarters": [f"Qtr{q}" for q in range(1, 5)], "months": _MONTHS, "days": [f"{d}-day" for d in range(1, 32)],
        "hours": [f"{h}-hour" for h in range(24)], "minutes": [f"{m}-min" for m in range(60)], "seconds": [f"{s}-sec" for s in range(60)],
    }[by]
    return [f"<{start}", *inner, f">{end}"]


def group_range(c: Column, start: float, end: float, interval: float) -> Column:
    """The label of a number's range, or one of the two labels for what lies outside: start-(start+interval-1) for intervals of
    1 or more, start-(start+interval) below; the last range ends at `end`, which belongs to it."""
    if interval <= 0:
        raise ValueError("an interval is more than 0")
    last = max(0, math.ceil((end - start) / interval - 1e-9) - 1)
    k = F.least(F.floor((c - start) / interval + 1e-9), F.lit(last))
    low = F.lit(float(start)) + k * interval
    high = F.least(low + interval - (1 if interval >= 1 else 0), F.lit(float(end)))
    return F.when(c.isNull(), F.lit(None)).when(c < start, F.lit(f"<{start:g}")).when(c > end, F.lit(f">{end:g}")).otherwise(F.concat_ws("-", _short(low), _short(high)))


def _short(x: Column) -> Column:
    """A number as labels have it: six digits at most, no trailing zeros."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", F.bround(x, 6)), r"\.?0+$", ""))


def range_labels(start: float, end: float, interval: float) -> list[str]:
    """All labels of a range grouping, with those for what lies outside."""
    out, low, step = [f"<{start:g}"], float(start), 0
    while low < end:
        high = min(low + interval - (1 if interval >= 1 else 0), end)
        out.append(f"{low:g}-{high:g}")
        step += 1
        low = start + step * interval
    return [*out, f">{end:g}"]


def group_items(c: Column, groups: dict[str, list]) -> Column:
    """A discrete grouping: the name of the group that lists an item; an item in no group stands for itself."""
    out = c.cast("string")
    for name, items in groups.items():
        out = F.when(c.isin(items), F.lit(name)).otherwise(out)
    return out


def show_as(cells: DataFrame, value: str, kind: str, rows: list[str], cols: list[str], base: str | None = None) -> DataFrame:
    """`shown`: cells (a pivot in long form) shown as normal, percentOfTotal, percentOfRow, percentOfCol, index, runTotal,
    difference, percent or percentDiff (the last three against the previous item of `base`). Totals are aggregates that are
    joined back, windows run along one axis, both over cells, not over data."""
    v = F.col(value)
    if kind == "normal":
        return cells.withColumn("shown", v)
    if kind in ("percentOfTotal", "percentOfRow", "percentOfCol", "index"):
        out = cells
        for name, keys in {"_all": [], "_row": rows, "_col": cols}.items():
            if kind not in ("index", {"_all": "percentOfTotal", "_row": "percentOfRow", "_col": "percentOfCol"}[name]):
                continue
            sums = cells.groupBy(*(F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys))).agg(F.sum(v).alias(name))
            same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{name}{i}")) for i, k in enumerate(keys)), F.lit(True))
            out = (out.join(sums, same) if keys else out.join(F.broadcast(sums))).drop(*(f"{name}{i}" for i in range(len(keys))))
        shown = {"percentOfTotal": lambda: v / F.col("_all"), "percentOfRow": lambda: v / F.col("_row"), "percentOfCol": lambda: v / F.col("_col"), "index": lambda: v * F.col("_all") / (F.col("_row") * F.col("_col"))}[kind]()
        return out.withColumn("shown", shown).drop("_all", "_row", "_col")
    along = W.partitionBy(*(c for c in [*rows, *cols] if c != base)).orderBy(base)
    before = F.lag(v).over(along)
    shown = {"runTotal": lambda: F.sum(v).over(along.rowsBetween(W.unboundedPreceding, 0)), "difference": lambda: v - before, "percent": lambda: v / before, "percentDiff": lambda: (v - before) / before}[kind]()
    return cells.withColumn("shown", shown)


#: Different numbers and texts up to which a field's items are listed (fixed values).
NUMBERS, TEXTS, LONG_TEXT = 200, 2000, 256


def shared_items(df: DataFrame, c: str, position: str | None = None, limit: int | None = None) -> DataFrame:
    """A field's different values with their index: numbers and dates in order, texts by their first place (or in order without
    a position). No rows if there are more than the limit, as such a field isn't listed."""
    kind = dict(df.dtypes)[c]
    text = kind == "string"
    limit = (TEXTS if text else NUMBERS if kind not in ("boolean", "date", "timestamp", "timestamp_ntz") else 1 << 20) if limit is None else limit
    place = F.min(position) if text and position else F.min(c)
    items = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("item")).agg(place.alias("_at"))
    # Never more than one beyond the limit meet.
    some = items.orderBy("_at", "item").limit(limit + 1)
    few = some.filter(F.lit(limit) >= F.lit(some.count()))
    return few.select("item", (F.row_number().over(W.orderBy("_at", "item")).cast("bigint") - 1).alias("index"))


def field_facts(df: DataFrame, c: str) -> DataFrame:
    """One row about a field: how many different values, least and greatest, whether it has blanks, texts, numbers or long texts."""
    kind = dict(df.dtypes)[c]
    number, text = F.lit(kind not in ("string", "boolean", "date", "timestamp", "timestamp_ntz")), F.lit(kind == "string")
    some = F.count(F.col(c)) > 0
    return df.agg(
        F.count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest"), (F.count("*") > F.count(c)).alias("contains_blank"),
        (some & number).alias("contains_number"), (some & text).alias("contains_string"), F.coalesce(F.max(F.length(F.col(c).cast("string"))) > LONG_TEXT, F.lit(False)).alias("long_text"),
    )


def indexed(df: DataFrame, fields: list[str], position: str | None = None) -> DataFrame:
    """df with each listed field replaced by its item's index: the records of a pivot's cache. A field that isn't listed stays."""
    out = df
    for f in fields:
        items = shared_items(df, f, position)
        if items.limit(1).count():
            known = items.select(F.col("item").alias("_item"), F.col("index").alias("_index"))
            out = out.join(F.broadcast(known), F.col(f) == F.col("_item"), "left").withColumn(f, F.col("_index")).drop("_item", "_index")
    return out


def axis_order(df: DataFrame, c: str, position: str) -> DataFrame:
    """key, place (from 1): a field's keys in the order of an axis: blanks first, then numbers in order, or texts by their first
    row. A join puts a pivot's rows in it."""
    text = dict(df.dtypes)[c] == "string"
    keys = df.groupBy(F.col(c).alias("key")).agg(F.min(position).alias("_at"))
    by = [F.col("key").isNotNull(), F.col("_at") if text else F.col("key")]
    return keys.select("key", F.row_number().over(W.orderBy(*by)).cast("bigint").alias("place"))


def calculated_item(cells: DataFrame, column: str, name: str, value: str, terms: dict) -> DataFrame:
    """A pivot in long form with one more item of a field: a sum of others' values, each times its factor; a missing item
    counts as 0."""
    rest = [c for c in cells.columns if c not in (column, value)]
    weights = F.create_map(*(F.lit(x) for kv in terms.items() for x in (kv[0], float(kv[1]))))
    made = cells.filter(F.col(column).isin(list(terms))).groupBy(*rest).agg(F.sum(F.col(value) * F.element_at(weights, F.col(column))).alias(value))
    return cells.unionByName(made.withColumn(column, F.lit(name).cast(dict(cells.dtypes)[column])))


@dataclass
class PivotTable:
    """A pivot over a source, whose parts can be changed; each change is another plan over the same source."""

    source: DataFrame
    spec: PivotSpec

    def cells(self) -> DataFrame:
        return pivot(self.source, self.spec)

    def set_aggregation(self, column: str, fn: str) -> None:
        if column not in {c for c, _ in self.spec.data}:
            raise KeyError(f"no data field {column!r}")
        self.spec = replace(self.spec, data=[(c, fn if c == column else f) for c, f in self.spec.data])

    def set_layout(self, rows: list[str] | None = None, cols: list[str] | None = None, data: list[tuple[str, str]] | None = None) -> None:
        self.spec = replace(self.spec, rows=self.spec.rows if rows is None else rows, cols=self.spec.cols if cols is None else cols, data=self.spec.data if data is None else data)

    def set_filter(self, column: str, values: list | None) -> None:
        """Only rows with these values; None: all."""
        pages = {c: v for c, v in self.spec.pages.items() if c != column}
        self.spec = replace(self.spec, pages=pages | ({column: values} if values is not None else {}))

    def set_source(self, source: DataFrame) -> None:
        missing = {*self.spec.rows, *self.spec.cols, *self.spec.pages, *(c for c, _ in self.spec.data)} - set(source.columns)
        if missing:
            raise KeyError(f"the source has no {sorted(missing)}")
        self.source = source
