"""Formulas of a column as one Column expression: a template that is filled down a sheet.

Letters are columns of the sheet in order. A reference in the template's own row is a plain column; another row is the value
so many rows before or after; `B$1:B2` (from a fixed row to this one) is a running aggregate; `$B$1:$B$9` and `B:B` are
aggregates of the whole column. Rows are ordered by a position column. With partitions, windows split over tasks by them;
without, running and neighbouring values go over buckets of rows (operators/ordered.py), and whole columns are one row joined
to all. Lookups and conditional aggregates over columns become joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar
from ..functions.values import num
from ..operators import criteria, lookup, ordered
from .syntax import Area, Cell, UnsupportedFormula, parse, references

__all__ = ["UnsupportedFormula", "changed", "fill_down"]


@dataclass
class Value:
    """A compiled part: its column, its kind (number, text, bool or any), the column of its error code if it can fail, and its
    plain value if it is a literal."""

    column: Column
    kind: str = "number"
    error: Column | None = None
    literal: object = None


@dataclass
class Span:
    """Cells of one column: all rows (low and high None), or rows from low to high relative to the own one; low "first" begins
    at the first row."""

    name: str
    low: object = None
    high: object = None


_KINDS = {"string": "text", "boolean": "bool"}
#: Kinds of results that aren't numbers.
_TEXTS = {"LEFT", "RIGHT", "MID", "CONCATENATE", "UPPER", "LOWER", "TRIM", "SUBSTITUTE", "REPT", "TEXT"}
_BOOLS = {"AND", "OR", "NOT", "EXACT"}
_AGGREGATES = ("SUM", "COUNT", "COUNTA", "AVERAGE", "MIN", "MAX", "AND", "OR")
#: Arguments that builders take as plain values, by place.
_PLAIN = {"SUBSTITUTE": (1, 2, 3), "TEXT": (1,), "FIND": (), "ROUND": (1,), "ROUNDUP": (1,), "ROUNDDOWN": (1,), "LEFT": (1,), "RIGHT": (1,), "MID": (1, 2), "REPT": (1,), "EDATE": (1,), "EOMONTH": (1,)}
_CONDITIONAL = {"SUMIF": "sum", "SUMIFS": "sum", "COUNTIF": "count", "COUNTIFS": "count", "AVERAGEIF": "avg", "AVERAGEIFS": "avg", "MINIFS": "min", "MAXIFS": "max"}


def alike(*values: Value) -> tuple[list[Column], str]:
    """The values as columns of one type, and its kind: text if any is, else numbers, with TRUE and FALSE as 1 and 0."""
    kinds = {v.kind for v in values}
    if len(kinds) == 1:
        return [v.column for v in values], values[0].kind
    to, kind = ("string", "text") if "text" in kinds else ("double", "number")
    return [v.column.cast(to) for v in values], kind


def _first(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    return F.coalesce(*found) if len(found) > 1 else found[0] if found else None


class Compiler:
    def __init__(self, df: DataFrame, row: int, position: str, partition: list[str], sheets: dict[str, DataFrame], own: str):
        self.df, self.row, self.position, self.partition, self.own = df, row, position, partition, own
        self.columns, self.kinds = list(df.columns), dict(df.dtypes)
        self.sheets = {k.lower(): v for k, v in sheets.items()}
        self.added: list[str] = []

    def compile(self, formula: str) -> Value:
        tree = parse(formula)
        self.prepare(tree)
        return self.value(tree)

    def new(self) -> str:
        self.added.append(f"_f{len(self.added)}")
        return self.added[-1]

    # What a formula reads of other rows is put beside each row first.

    def prepare(self, tree: tuple) -> None:
        """Neighbours of all references at once: one pass over the buckets."""
        self.near: dict[tuple[str, int], str] = {}
        if self.partition:
            return
        for ref in references(tree):
            if isinstance(ref, Cell) and not ref.row_fixed and not ref.sheet and ref.row != self.row:
                self.near.setdefault((self.named(ref), ref.row - self.row), "")
        if self.near:
            self.near = {k: self.new() for k in self.near}
            rows = {out: (F.first, F.col(f"`{name}`"), delta, delta) for (name, delta), out in self.near.items()}
            self.df = ordered.around(self.df, rows, self.position)

    def named(self, ref: Cell) -> str:
        if not 1 <= ref.col <= len(self.columns):
            raise UnsupportedFormula(f"{ref}: the sheet has {len(self.columns)} columns")
        return self.columns[ref.col - 1]

    def kind(self, name: str) -> str:
        return _KINDS.get(self.kinds[name], "number" if self.kinds[name] not in ("date", "timestamp", "timestamp_ntz") else "any")

    def reference(self, ref: Cell) -> Value:
        if ref.sheet and ref.sheet.lower() != self.own.lower():
            return self.elsewhere(ref)
        name = self.named(ref)
        if ref.row_fixed:
            raise UnsupportedFormula(f"{ref}: a fixed cell of the sheet itself needs its row: give it as a sheet")
        delta = ref.row - self.row
        c = F.col(f"`{name}`")
        if delta and self.partition:
            order = W.partitionBy(*self.partition).orderBy(self.position)
            c = F.lag(c, -delta).over(order) if delta < 0 else F.lead(c, delta).over(order)
        elif delta:
            c = F.col(self.near[name, delta])
        return Value(c, self.kind(name))

    def elsewhere(self, ref: Cell) -> Value:
        """A cell of another sheet, a DataFrame with `row` and its columns: a fixed one is one value, joined to all rows; one
        that moves along is the value in the same row of that sheet."""
        sheet = self.sheet(ref.sheet)
        names = [c for c in sheet.columns if c != "row"]
        name, out = names[ref.col - 1], self.new()
        if ref.row_fixed:
            self.df = self.df.join(F.broadcast(sheet.filter(F.col("row") == ref.row).agg(F.first(name).alias(out))))
        else:
            self.df = self.df.join(sheet.select((F.col("row") - (ref.row - self.row)).alias(f"{out}_row"), F.col(name).alias(out)), F.col(self.position) == F.col(f"{out}_row"), "left").drop(f"{out}_row")
        return Value(F.col(out), _KINDS.get(dict(sheet.dtypes)[name], "number"))

    def sheet(self, name: str) -> DataFrame:
        if name.lower() not in self.sheets:
            raise UnsupportedFormula(f"no sheet {name!r}")
        return self.sheets[name.lower()]

    def spans(self, area: Area) -> list[Span]:
        """The columns of an area of the own sheet."""
        if area.sheet and area.sheet.lower() != self.own.lower():
            raise UnsupportedFormula(f"{area}: aggregates over other sheets aren't compiled")
        first, last = area.first, area.last
        _, left, _, right = area.bounds()
        if not first.row or (first.row_fixed and last.row_fixed):
            low, high = None, None
        elif first.row_fixed:
            low, high = "first", last.row - self.row
        elif last.row_fixed:
            raise UnsupportedFormula(f"{area}: a range down to a fixed row")
        else:
            low, high = first.row - self.row, last.row - self.row
        return [Span(self.named(Cell(1, c)), low, high) for c in range(left, right + 1)]

    def over(self, span: Span, how: str, c: Column) -> Column:
        """sum, count, min, max of a column over a span."""
        fold = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[how]
        if span.low is None:
            if self.partition:
                return fold(c).over(W.partitionBy(*self.partition))
            out = self.new()
            self.df = ordered.totals(self.df, {out: fold(c)})
            return F.col(out)
        if span.low == span.high == 0:
            return F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)) if how == "count" else c
        if self.partition:
            order = W.partitionBy(*self.partition).orderBy(self.position)
            return fold(c).over(order.rowsBetween(W.unboundedPreceding if span.low == "first" else span.low, span.high))
        out = self.new()
        if span.low == "first":
            if span.high:
                raise UnsupportedFormula("a growing range that doesn't end in the own row needs partitions")
            self.df = ordered.running(self.df, {out: (how, c)}, self.position)
        else:
            self.df = ordered.around(self.df, {out: (fold, c, span.low, span.high)}, self.position)
        return F.col(out)

    # Trees

    def value(self, tree: tuple) -> Value:
        kind = tree[0]
        if kind == "num":
            return Value(F.lit(float(tree[1])), "number", literal=tree[1])
        if kind == "text":
            return Value(F.lit(tree[1]), "text", literal=tree[1])
        if kind == "bool":
            return Value(F.lit(tree[1]), "bool", literal=tree[1])
        if kind == "err":
            return Value(F.lit(None).cast("double"), "number", F.lit(tree[1]))
        if kind == "blank":
            return Value(F.lit(None).cast("double"), "any")
        if kind == "ref":
            return self.reference(tree[1])
        if kind == "sign":
            v = self.value(tree[2])
            return Value(-self.number(v), "number", v.error, -v.literal if isinstance(v.literal, (int, float)) else None) if tree[1] == "-" else v
        if kind == "percent":
            v = self.value(tree[1])
            return Value(self.number(v) / 100, "number", v.error)
        if kind == "op":
            return self.operator(tree[1], self.value(tree[2]), self.value(tree[3]))
        if kind == "call":
            return self.call(tree[1], tree[2])
        raise UnsupportedFormula(f"{tree[1]} stands alone")

    @staticmethod
    def number(v: Value) -> Column:
        """An operand of arithmetic: text is none, whatever it looks like."""
        return F.lit(None).cast("double") if v.kind == "text" else v.column.cast("double")

    @staticmethod
    def coerced(v: Value) -> Column:
        return num(v.column) if v.kind == "text" else v.column.cast("double")

    def operator(self, op: str, a: Value, b: Value) -> Value:
        error = _first(a.error, b.error)
        if op == "&":
            return self.guarded(Value(scalar.concatenate(a.column, b.column), "text"), error)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return self.guarded(Value(self.compared(op, a, b), "bool"), error)
        x, y = self.number(a), self.number(b)
        if op == "/":
            return self.guarded(Value(scalar.div(x, y)), _first(error, scalar.ERRORS["/"](x, y)))
        if op == "^":
            return self.guarded(Value(scalar.power(x, y)), _first(error, scalar.ERRORS["POWER"](x, y)))
        return self.guarded(Value({"+": x + y, "-": x - y, "*": x * y}[op]), error)

    def compared(self, op: str, a: Value, b: Value) -> Column:
        by = lambda x, y: {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        x, y = self.coerced(a), self.coerced(b)
        lower = lambda v: F.lower(F.coalesce(v.column.cast("string"), F.lit("")))
        texts = by(lower(a), lower(b))
        if a.literal is not None and a.kind == "text" and b.kind == "text":
            return texts
        return F.when(x.isNotNull() & y.isNotNull(), by(x, y)).otherwise(texts)

    @staticmethod
    def guarded(v: Value, error: Column | None) -> Value:
        """The value with its error; an error leaves a blank."""
        return Value(F.when(error.isNull(), v.column), v.kind, error) if error is not None else v

    def call(self, name: str, args: list[tuple]) -> Value:
        if name in _AGGREGATES and (name not in ("AND", "OR") or any(a[0] == "area" for a in args)):
            return self.aggregate(name, args)
        if name in _CONDITIONAL:
            return self.conditional(name, args)
        if name in ("VLOOKUP", "XLOOKUP", "MATCH"):
            return self.looked_up(name, args)
        if name == "IFERROR":
            v, other = map(self.value, args)
            bad = F.lit(False) if v.error is None else v.error.isNotNull()
            if v.kind == "text":
                bad = bad | F.coalesce(v.column.startswith("#"), F.lit(False))
            (column, replaced), kind = alike(v, other)
            return Value(F.when(bad, replaced).otherwise(column), kind, None if other.error is None else F.when(bad, other.error))
        if name == "IF":
            test, *rest = map(self.value, args)
            yes, no = rest if len(rest) > 1 else (rest[0], Value(F.lit(False), "bool"))
            hit = self.truth(test)
            (one, two), kind = alike(yes, no)
            error = _first(test.error, F.when(hit, yes.error) if yes.error is not None else None, F.when(~hit, no.error) if no.error is not None else None)
            return self.guarded(Value(F.when(hit, one).otherwise(two), kind), error)
        if name == "NPV":
            rate, *flows = map(self.value, args)
            return Value(scalar.npv(rate.column, F.array(*(self.number(v) for v in flows))), "number", _first(*(v.error for v in (rate, *flows))))
        if name == "IRR":
            (area, *guess) = args
            flows = F.array(*(F.col(f"`{s.name}`").cast("double") for s in self.spans(area[1])))
            rate = scalar.irr(flows, *(self.value(g).literal for g in guess))
            return Value(rate, "number", F.when(rate.isNull(), F.lit("#NUM!")))
        if name not in scalar.FUNCTIONS:
            raise UnsupportedFormula(f"#NAME? {name}")
        values = [self.value(a) for a in args]
        if name == "CHOOSE":
            columns, kind = alike(*values[1:])
            values[1:] = [Value(c, kind, v.error) for c, v in zip(columns, values[1:], strict=True)]
        plain = _PLAIN.get(name, ())
        if name in ("SUBSTITUTE", "TEXT") and any(values[k].literal is None for k in plain if k < len(values)):
            raise UnsupportedFormula(f"{name}: only the first argument may be a reference")
        taken = [int(v.literal) if k in plain and isinstance(v.literal, float) and v.literal.is_integer() else v.literal if k in plain and v.literal is not None else self.truth(v) if name in _BOOLS - {"EXACT"} else v.column for k, v in enumerate(values)]
        error = _first(*(v.error for v in values), scalar.ERRORS[name](*taken) if name in scalar.ERRORS else None)
        kind = "text" if name in _TEXTS else "bool" if name in _BOOLS else values[1].kind if name == "CHOOSE" else "number"
        return self.guarded(Value(scalar.FUNCTIONS[name](*taken), kind), error)

    @staticmethod
    def truth(v: Value) -> Column:
        """Numbers but 0, TRUE, and texts but the empty one; a blank isn't."""
        c = v.column if v.kind == "bool" else v.column != "" if v.kind == "text" else v.column.cast("double") != 0
        return F.coalesce(c, F.lit(False))

    def aggregate(self, name: str, args: list[tuple]) -> Value:
        """SUM and its kin over ranges and single values: partial results of every part, put together."""
        errors, parts = [], []  # parts: (sum, count, min, max, filled, all true, any true)
        for a in args:
            if a[0] == "area":
                for span in self.spans(a[1]):
                    kind, c = self.kind(span.name), F.col(f"`{span.name}`")
                    n = F.lit(None).cast("double") if kind == "text" else c.cast("double")
                    parts.append(self.pieces(name, n, c, kind, lambda how, x, s=span: self.over(s, how, x)))
            else:
                v = self.value(a)
                errors.append(v.error)
                alone = lambda how, x: F.when(x.isNotNull(), F.lit(1)).otherwise(F.lit(0)) if how == "count" else x
                parts.append(self.pieces(name, self.number(v), v.column, v.kind, alone))
        error = _first(*errors)
        total = lambda k: reduce(lambda a, b: a + b, (F.coalesce(p[k], F.lit(0.0)) for p in parts))
        pick = lambda f: f(*(p["pick"] for p in parts)) if len(parts) > 1 else parts[0]["pick"]
        if name == "SUM":
            out = total("sum")
        elif name in ("COUNT", "COUNTA"):
            out = total("count").cast("double")
        elif name == "AVERAGE":
            out = F.try_divide(total("sum"), total("count").cast("double"))
        elif name in ("MIN", "MAX"):
            out = F.coalesce(pick(F.least if name == "MIN" else F.greatest), F.lit(0.0))
        else:
            return self.guarded(Value(reduce(lambda a, b: a & b if name == "AND" else a | b, (p["pick"] for p in parts)), "bool"), error)
        return self.guarded(Value(out), error)

    def pieces(self, name: str, n: Column, c: Column, kind: str, over: Callable[[str, Column], Column]) -> dict[str, Column]:
        out = {}
        if name in ("SUM", "AVERAGE"):
            out["sum"] = over("sum", n)
        if name in ("COUNT", "AVERAGE"):
            out["count"] = over("count", n)
        if name == "COUNTA":
            out["count"] = over("count", c)
        if name in ("MIN", "MAX"):
            out["pick"] = over(name.lower(), n)
        if name in ("AND", "OR"):
            flag = F.when(c.isNotNull(), self.truth(Value(c, kind)).cast("int"))
            out["pick"] = F.coalesce(over("min" if name == "AND" else "max", flag), F.lit(1 if name == "AND" else 0)) == 1
        return out

    def whole(self, tree: tuple) -> str:
        """The column of a range that is a whole column."""
        spans = self.spans(tree[1]) if tree[0] == "area" else []
        if len(spans) != 1 or spans[0].low is not None:
            raise UnsupportedFormula("only whole columns may be looked through")
        return spans[0].name

    def conditional(self, name: str, args: list[tuple]) -> Value:
        """SUMIF and its kin over whole columns: literal criteria are one aggregate for all rows; criteria that are cells of the
        own row are equalities, so the aggregate is grouped by them and joined back."""
        if name in ("SUMIF", "AVERAGEIF", "COUNTIF"):
            pairs, over = [(args[0], args[1])], args[2] if len(args) > 2 else args[0]
        elif name == "COUNTIFS":
            pairs, over = list(zip(args[::2], args[1::2], strict=True)), args[0]
        else:
            pairs, over = list(zip(args[1::2], args[2::2], strict=True)), args[0]
        value = self.whole(over)
        n = F.lit(None).cast("double") if self.kind(value) == "text" else F.col(f"`{value}`").cast("double")
        tests, keys = [], []
        for area, wanted in pairs:
            tested, v = self.whole(area), self.value(wanted)
            if v.literal is not None:
                tests.append(criteria.matches(F.col(f"`{tested}`"), self.kinds[tested], v.literal))
            else:
                keys.append((tested, v))
        hit = reduce(lambda a, b: a & b, tests, F.lit(True))
        how = _CONDITIONAL[name]
        agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}.get(how)
        out = self.new()
        measured = F.count(F.when(hit, 1)).cast("double") if how == "count" else agg(F.when(hit, n))
        same = lambda c, text: F.lower(c.cast("string")) if text else c.cast("double")
        if keys or self.partition:
            texts = [self.kind(t) == "text" for t, _ in keys]
            groups = [same(F.col(f"`{t}`"), x).alias(f"{out}_k{k}") for k, ((t, _), x) in enumerate(zip(keys, texts, strict=True))]
            groups += [F.col(p).alias(f"{out}_p{k}") for k, p in enumerate(self.partition)]
            asked = [same(v.column, x) for (_, v), x in zip(keys, texts, strict=True)]
            grouped = self.df.groupBy(*groups).agg(measured.alias(out))
            # A blank criterion meets nothing, so null keys stay apart; null partitions are partitions.
            on = [a == F.col(f"{out}_k{k}") for k, a in enumerate(asked)] + [F.col(p).eqNullSafe(F.col(f"{out}_p{k}")) for k, p in enumerate(self.partition)]
            self.df = self.df.join(grouped, reduce(lambda a, b: a & b, on), "left").drop(*(f"{out}_k{k}" for k in range(len(keys))), *(f"{out}_p{k}" for k in range(len(self.partition))))
        else:
            self.df = ordered.totals(self.df, {out: measured})
        c = F.col(out)
        return Value(c, "number", F.when(c.isNull(), F.lit("#DIV/0!"))) if how == "avg" else Value(F.coalesce(c, F.lit(0.0)))

    def looked_up(self, name: str, args: list[tuple]) -> Value:
        """VLOOKUP, XLOOKUP and MATCH through whole columns of the own or of another sheet (a DataFrame with `row`)."""
        v = self.value(args[0])
        key, out = self.new(), self.new()
        self.df = self.df.withColumn(key, v.column)

        def table(area: Area) -> tuple[DataFrame, list[str], str]:
            other = area.sheet and area.sheet.lower() != self.own.lower()
            sheet = self.sheet(area.sheet) if other else self.df.select(*(f"`{c}`" for c in self.columns))
            names = [c for c in sheet.columns if not other or c != "row"]
            _, left, _, right = area.bounds()
            return sheet, names[left - 1 : min(right, len(names))], "row" if other else self.position

        literals = [self.value(a).literal if a[0] != "area" else None for a in args]
        if name == "VLOOKUP":
            sheet, names, place = table(args[1][1])
            k = int(literals[2])
            if not 1 <= k <= len(names):
                return Value(F.lit(None).cast("double"), "number", F.lit("#VALUE!" if k < 1 else "#REF!"))
            near, searched, value = len(args) < 4 or bool(literals[3]), names[0], names[k - 1]
            larger, last = False, False
        elif name == "XLOOKUP":
            sheet, (searched, *_), place = table(args[1][1])
            value = table(args[2][1])[1][0]
            mode, search = (int(literals[k]) if len(args) > k and literals[k] is not None else d for k, d in ((4, 0), (5, 1)))
            near, larger, last = mode in (-1, 1), mode == 1, search < 0
        else:
            sheet, (searched, *_), place = table(args[1][1])
            kind = int(literals[2]) if len(args) > 2 and literals[2] is not None else 0
            value, near, larger, last = place, kind != 0, kind < 0, False
        slim = sheet.select(F.col(f"`{searched}`").alias("_lk"), F.col(f"`{value}`").alias("_lv"), F.col(f"`{place}`").alias("_lp"))
        by_place = name != "XLOOKUP"
        self.df = lookup.nearest(self.df, key, slim, "_lk", "_lv", "_lp", out, larger=larger, by_position=by_place) if near else lookup.exact(self.df, key, slim, "_lk", "_lv", "_lp", out, last=last)
        self.added += [f"{out}_found", f"{out}_position"]
        kind = _KINDS.get(dict(slim.dtypes)["_lv"], "number")
        found = F.col(f"{out}_found")
        if name == "XLOOKUP" and len(args) > 3 and args[3][0] != "blank":
            other = self.value(args[3])
            (column, replaced), kind = alike(Value(F.col(out), kind), other)
            return Value(F.when(found, column).otherwise(replaced), kind, v.error)
        return self.guarded(Value(F.col(out), kind), _first(v.error, F.when(~found, F.lit("#N/A"))))


def fill_down(df: DataFrame, out: str, formula: str, position: str, row: int = 2, partition: list[str] | None = None, sheets: dict[str, DataFrame] | None = None, own: str = "Sheet", error: str | None = None) -> DataFrame:
    """df with a column of the formula's values; `row` is the row that the template is written for. error: a column for the
    codes of failed cells, whose value is blank. sheets: other sheets by name, with a column `row`; own: this sheet's name."""
    compiler = Compiler(df, row, position, partition or [], sheets or {}, own)
    found = compiler.compile(formula)
    columns = {out: found.column} | ({error: F.lit(None).cast("string") if found.error is None else found.error} if error else {})
    return compiler.df.withColumns(columns).drop(*(c for c in compiler.added if c not in columns))


def changed(before: DataFrame, after: DataFrame, keys: list[str], column: str, tolerance: float = 0.0) -> DataFrame:
    """Cells whose value a recalculation changed by more than the tolerance: keys, old, new."""
    a, b = before.select(*keys, F.col(column).alias("old")), after.select(*keys, F.col(column).alias("new"))
    same = F.col("old").eqNullSafe(F.col("new"))
    if tolerance:
        same |= F.abs(F.col("old") - F.col("new")) <= tolerance
    return a.join(b, keys, "full").filter(~F.coalesce(same, F.lit(False)))
