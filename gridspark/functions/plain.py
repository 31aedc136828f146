"""Spreadsheet functions on plain values, for cells whose formulas stand alone: what scalar.py says in Columns.

A blank is None, an error an Err, a range a Grid. A function that can't use its arguments raises; its cell is then blank."""

from __future__ import annotations

import math
import re
from calendar import monthrange
from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime, timedelta

from ..operators.criteria import split_criterion
from .values import glob_regex

BUILT_IN: dict[str, Callable] = {}


class Err(str):
    """An error value: its code."""


NA, VALUE, REF, DIV0, NUM, NAME = (Err(e) for e in ("#N/A", "#VALUE!", "#REF!", "#DIV/0!", "#NUM!", "#NAME?"))


class Grid:
    """The values of a range, row by row."""

    def __init__(self, values: list, rows: int, cols: int):
        self.values, self.rows, self.cols = values, rows, cols

    def at(self, row: int, col: int):
        return self.values[(row - 1) * self.cols + col - 1]

    def column(self, k: int) -> list:
        return self.values[k - 1 :: self.cols]

    def row(self, k: int) -> list:
        return self.values[(k - 1) * self.cols : k * self.cols]


def function(name: str):
    def keep(f: Callable) -> Callable:
        BUILT_IN[name] = f
        return f

    return keep


def is_number(v) -> bool:
    return isinstance(v, (int, float))


def text_of(v) -> str:
    return "" if v is None else str(v)


def flat(values: Iterable) -> Iterator:
    for v in values:
        if isinstance(v, Grid):
            yield from v.values
        else:
            yield v


def numbers(values: Iterable) -> list[float]:
    """Numbers and booleans; texts, blanks and errors are passed over."""
    return [float(v) for v in flat(values) if is_number(v)]


def one(v) -> float:
    found = numbers([v])
    if not found:
        raise ValueError("not a number")
    return found[0]


def whole(v) -> int:
    return int(float(v))


def truth(v) -> bool:
    return bool(v)


def listed(v) -> list:
    return v.values if isinstance(v, Grid) else [v]


# Operators
def arithmetic(op: str, a, b):
    for v in (a, b):
        if isinstance(v, Err):
            return v
    if op == "&":
        return text_of(a) + text_of(b)
    if not (is_number(a) and is_number(b)):
        return None
    if op == "/":
        return DIV0 if b == 0 else a / b
    if op == "^":
        return BUILT_IN["POWER"](a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def compare(op: str, a, b):
    for v in (a, b):
        if isinstance(v, Err):
            return v
    try:
        x, y = (v if is_number(v) else float(v) for v in (a, b))
    except (TypeError, ValueError):
        x, y = text_of(a).lower(), text_of(b).lower()
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


# Aggregates
BUILT_IN |= {
    "SUM": lambda *a: sum(numbers(a)), "COUNT": lambda *a: float(len(numbers(a))), "COUNTA": lambda *a: float(sum(v is not None for v in flat(a))),
    "MIN": lambda *a: min(numbers(a), default=0.0), "MAX": lambda *a: max(numbers(a), default=0.0), "AVERAGE": lambda *a: sum(numbers(a)) / len(numbers(a)),
}


def criterion(c) -> Callable[[object], bool]:
    """Whether a value fits a criterion: see criteria.matches."""
    if is_number(c):
        return lambda v: is_number(v) and float(v) == float(c)
    op, operand = split_criterion(text_of(c) if c is not None else "None")
    try:
        number = float(operand)
    except ValueError:
        number = None
    if number is not None and op:
        hit = {"=": lambda x: x == number, "<>": lambda x: x == number, ">": lambda x: x > number, "<": lambda x: x < number, ">=": lambda x: x >= number, "<=": lambda x: x <= number}[op]
        return (lambda v: not (is_number(v) and hit(float(v)))) if op == "<>" else (lambda v: is_number(v) and hit(float(v)))
    low = operand.lower()
    if not op and re.search(r"[*?]", low):
        shape = re.compile(glob_regex(low, tilde=False, sets=True))
        return lambda v: v is not None and bool(shape.match(str(v).lower()))
    same = {"": lambda t: t == low, "=": lambda t: t == low, "<>": lambda t: t != low, ">": lambda t: t > low, "<": lambda t: t < low, ">=": lambda t: t >= low, "<=": lambda t: t <= low}[op]
    return lambda v: same(str(v).lower()) if v is not None else op == "<>"


def _hits(pairs: tuple) -> list[bool]:
    """For each place of the first range, whether it meets every criterion; a shorter range meets none."""
    ranges, tests = [listed(r) for r in pairs[::2]], [criterion(c) for c in pairs[1::2]]
    return [all(k < len(r) and t(r[k]) for r, t in zip(ranges, tests, strict=True)) for k in range(len(ranges[0]))]


def _picked(values, pairs: tuple) -> list:
    held = listed(values)
    return [held[k] if k < len(held) else None for k, hit in enumerate(_hits(pairs)) if hit]


BUILT_IN |= {
    "SUMIF": lambda r, c, s=None: sum(numbers(_picked(r if s is None else s, (r, c)))), "SUMIFS": lambda s, *p: sum(numbers(_picked(s, p))),
    "COUNTIF": lambda r, c: float(sum(_hits((r, c)))), "COUNTIFS": lambda *p: float(sum(_hits(p))),
    "MINIFS": lambda s, *p: min(numbers(_picked(s, p)), default=0.0), "MAXIFS": lambda s, *p: max(numbers(_picked(s, p)), default=0.0),
}


@function("AVERAGEIF")
def averageif(r, c, s=None):
    found = [one(v) if is_number(v) else 0.0 if v is None and s is not None else None for v in _picked(r if s is None else s, (r, c))]
    found = [v for v in found if v is not None]
    return sum(found) / len(found) if found else DIV0


@function("AVERAGEIFS")
def averageifs(s, *pairs):
    found = numbers(_picked(s, pairs))
    return sum(found) / len(found) if found else DIV0


# Logic
@function("IF")
def if_(condition, yes, no=False):
    if isinstance(condition, Err):
        return condition
    return yes if truth(condition) else no


BUILT_IN |= {
    "IFERROR": lambda v, other: other if isinstance(v, Err) or isinstance(v, str) and v.startswith("#") else v, "NOT": lambda v: v if isinstance(v, Err) else not truth(v),
}


def _logic(name: str, join: Callable[[Iterable], bool]) -> None:
    def f(*args):
        if not args:
            raise ValueError(f"{name} needs an argument")
        seen = [v for a in args for v in ([x for x in a.values if x is not None] if isinstance(a, Grid) else [a])]
        return next((v for v in seen if isinstance(v, Err)), None) or join(truth(v) for v in seen)

    BUILT_IN[name] = f


_logic("AND", all)
_logic("OR", any)


# Numbers
def _rounded(name: str, f: Callable[[float], float]) -> None:
    def g(x, digits=0):
        scale = 10 ** whole(digits)
        return float(f(one(x) * scale) / scale)

    BUILT_IN[name] = g


_rounded("ROUNDUP", math.ceil)
_rounded("ROUNDDOWN", math.trunc)
BUILT_IN |= {
    "ABS": lambda x: abs(one(x)), "ROUND": lambda x, d=0: float(round(one(x), whole(d))), "INT": lambda x: float(math.floor(one(x))), "SIGN": lambda x: float((one(x) > 0) - (one(x) < 0)),
    "SQRT": lambda x: math.sqrt(one(x)) if one(x) >= 0 else None, "MOD": lambda a, b: one(a) - one(b) * math.floor(one(a) / one(b)) if one(b) else None,
}


@function("POWER")
def power(a, b):
    found = one(a) ** one(b)
    return NUM if isinstance(found, complex) else found


# Texts
def _position(what, s, start=1):
    at = text_of(s).find(text_of(what), whole(start) - 1)
    return VALUE if at < 0 else float(at + 1)


BUILT_IN |= {
    "LEFT": lambda s, n=1: VALUE if whole(n) < 0 else text_of(s)[: whole(n)], "RIGHT": lambda s, n=1: text_of(s)[-whole(n) :] if whole(n) > 0 else "",
    "MID": lambda s, a, n: VALUE if whole(a) < 1 or whole(n) < 0 else text_of(s)[whole(a) - 1 :][: whole(n)], "LEN": lambda s: float(len(text_of(s))), "CONCATENATE": lambda *a: "".join(map(text_of, a)),
    "UPPER": lambda s: text_of(s).upper(), "LOWER": lambda s: text_of(s).lower(), "TRIM": lambda s: " ".join(text_of(s).split()), "REPT": lambda s, n: text_of(s) * max(whole(n), 0),
    "EXACT": lambda a, b: text_of(a) == text_of(b), "FIND": _position,
}


@function("SUBSTITUTE")
def substitute(s, old, new, nth=None):
    s, old, new = text_of(s), text_of(old), text_of(new)
    if nth is None or not old:
        return s.replace(old, new) if old else s
    at = -1
    for _ in range(whole(nth)):
        at = s.find(old, at + 1)
        if at < 0:
            return s
    return s[:at] + new + s[at + len(old) :]


_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


@function("TEXT")
def text(v, pattern):
    if not is_number(v):
        return text_of(v)
    x, p = float(v), text_of(pattern).replace('"', "").lower()
    places = len(p.split(".")[1].rstrip("%)_").split("_")[0].rstrip(")")) if "." in p else 0
    if p in ("0%", "0.0%", "0.00%"):
        return f"{x * 100:.{places}f}%"
    if re.fullmatch(r"\$?#,##0(\.0{1,2})?", p):
        return f"{'$' * p.startswith('$')}{x:,.{places}f}"
    if p in ("#,##0_);(#,##0)", "#,##0.00_);(#,##0.00)"):
        places = 2 * (".00" in p)
        return f"({abs(x):,.{places}f})" if x < 0 else f"{x:,.{places}f} "
    if p == "0.00e+00":
        return f"{x:.2E}"
    if p in ("yyyy-mm-dd", "yyyy/mm/dd", "mm/dd/yyyy", "d-mmm-yy", "d-mmm-yyyy", "mmm-yy"):
        y, m, d = calendar(x)
        name = _MONTHS[m - 1]
        return {"yyyy-mm-dd": f"{y:04d}-{m:02d}-{d:02d}", "yyyy/mm/dd": f"{y:04d}/{m:02d}/{d:02d}", "mm/dd/yyyy": f"{m:02d}/{d:02d}/{y:04d}", "d-mmm-yy": f"{d}-{name}-{y % 100:02d}", "d-mmm-yyyy": f"{d}-{name}-{y:04d}", "mmm-yy": f"{name}-{y % 100:02d}"}[p]
    if re.fullmatch(r"0+(\.0*)?", p):
        return f"{x:.{places}f}"
    if p == "general":
        return str(int(x)) if x == int(x) else str(x)
    return str(v)


# Dates: serials of the 1900 system, in which 1900 is a leap year.
def serial(d: date) -> int:
    days = (d - date(1899, 12, 31)).days
    return days + (days >= 60)


def calendar(s: float) -> tuple[int, int, int]:
    """Year, month and day of a serial; 60 is 1900-02-29."""
    n = int(s)
    if n == 60:
        return 1900, 2, 29
    d = date(1899, 12, 31) + timedelta(days=n - (n > 60))
    return d.year, d.month, d.day


def _held(y: int, m: int, d: int) -> date:
    """The date with the day held within its month; months wrap."""
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    return date(y, m, max(1, min(d, monthrange(y, m)[1])))


@function("DATE")
def date_(y, m, d):
    year = whole(y) + (1900 if 0 <= whole(y) < 100 else 0)
    found = serial(_held(year, whole(m), whole(d)))
    return float(found) if found >= 1 else NUM


def _moved(s, months, last: bool = False) -> float:
    y, m, d = calendar(one(s))
    return float(serial(_held(y, m + whole(months), 31 if last else d)))


def _seconds(s) -> int:
    return round((one(s) - math.floor(one(s))) * 86400)


BUILT_IN |= {
    "YEAR": lambda s: float(calendar(one(s))[0]), "MONTH": lambda s: float(calendar(one(s))[1]), "DAY": lambda s: float(calendar(one(s))[2]), "EDATE": _moved, "EOMONTH": lambda s, n: _moved(s, n, True),
    "DAYS": lambda a, b: float(int(one(a)) - int(one(b))), "HOUR": lambda s: float(_seconds(s) // 3600), "MINUTE": lambda s: float(_seconds(s) // 60 % 60), "SECOND": lambda s: float(_seconds(s) % 60),
    "TODAY": lambda: float(serial(date.today())), "NOW": lambda: serial(date.today()) + (datetime.now() - datetime.combine(date.today(), datetime.min.time())).seconds / 86400,
}


# Lookups
def same(a, b) -> bool:
    if isinstance(a, str) and isinstance(b, str):
        return a.lower() == b.lower()
    return float(a) == float(b) if is_number(a) and is_number(b) else a == b


def _first(v, values: list, order: Iterable[int] | None = None, like: bool = False) -> int | None:
    shape = re.compile(glob_regex(v.lower())) if like and isinstance(v, str) else None
    fits = lambda x: bool(shape.match(x.lower())) if shape and isinstance(x, str) else same(v, x)
    return next((k for k in (range(len(values)) if order is None else order) if values[k] is not None and fits(values[k])), None)


def _last(v, values: list, larger: bool = False, texts: bool = True) -> int | None:
    """The last place, in scan order, with a value at or below v (larger: at or above)."""
    out = None
    for k, x in enumerate(values):
        if is_number(v) and is_number(x):
            a, b = float(x), float(v)
        elif texts and isinstance(v, str) and isinstance(x, str):
            a, b = x.lower(), v.lower()
        else:
            continue
        out = k if (a >= b if larger else a <= b) else out
    return out


def _exactly(v) -> bool:
    """Whether a lookup's last argument asks for an exact match."""
    return v.upper() == "FALSE" if isinstance(v, str) else v is not None and not v


def _table(name: str, keys: Callable[[Grid], list], size: Callable[[Grid], int], pick: Callable) -> None:
    def f(v, table, index, near=True):
        if isinstance(v, Err):
            return v
        index = whole(index)
        if index < 1:
            return VALUE
        if index > size(table):
            return REF
        at = _first(v, keys(table)) if _exactly(near) else _last(v, keys(table))
        return NA if at is None else pick(table, at + 1, index)

    BUILT_IN[name] = f


_table("VLOOKUP", lambda t: t.column(1), lambda t: t.cols, lambda t, at, k: t.at(at, k))
_table("HLOOKUP", lambda t: t.row(1), lambda t: t.rows, lambda t, at, k: t.at(k, at))


@function("XLOOKUP")
def xlookup(v, keys, values, missing=None, mode=0, search=1):
    if isinstance(v, Err):
        return v
    held, out = listed(keys), listed(values)
    mode, search = whole(mode or 0), whole(search or 1)
    order = range(len(held)) if search >= 0 else range(len(held) - 1, -1, -1)
    at = _first(v, held, order, like=mode == 2)
    if at is None and mode in (-1, 1) and is_number(v):
        able = [k for k in order if is_number(held[k]) and (held[k] <= v if mode < 0 else held[k] >= v)]
        best = (max if mode < 0 else min)((held[k] for k in able), default=None)
        at = next((k for k in able if held[k] == best), None)
    if at is None or at >= len(out):
        return NA if missing is None else missing
    return out[at]


@function("MATCH")
def match(v, keys, kind=0):
    if isinstance(v, Err):
        return v
    kind = whole(kind or 0)
    values = listed(keys)
    at = _first(v, values) if kind == 0 else _last(v, values, larger=kind < 0, texts=False)
    return NA if at is None else at + 1


@function("INDEX")
def index(area, row, col=None):
    if row is None:
        return None
    row = whole(row)
    grid = area if isinstance(area, Grid) else Grid([area], 1, 1)
    if col is None:
        row, col = (1, row) if grid.rows == 1 else (row, 1)
    col = whole(col)
    return grid.at(row, col) if 1 <= row <= grid.rows and 1 <= col <= grid.cols else REF


@function("CHOOSE")
def choose(k, *options):
    return options[whole(k) - 1] if 1 <= whole(k) <= len(options) else VALUE


# Finance
def _growth(rate, n) -> float:
    return (1 + rate) ** n


@function("PV")
def pv(rate, nper, pmt, fv=0, due=0):
    r, n, p, f = map(one, (rate, nper, pmt, fv or 0))
    return -(f + p * n) if r == 0 else -(f + p * (1 + r * one(due or 0)) * (_growth(r, n) - 1) / r) / _growth(r, n)


@function("FV")
def fv(rate, nper, pmt, pv=0, due=0):
    r, n, p, v = map(one, (rate, nper, pmt, pv or 0))
    return -(v + p * n) if r == 0 else -(v * _growth(r, n) + p * (1 + r * one(due or 0)) * (_growth(r, n) - 1) / r)


@function("PMT")
def pmt(rate, nper, pv, fv=0, due=0):
    r, n, v, f = map(one, (rate, nper, pv, fv or 0))
    return -(v + f) / n if r == 0 else -(v * _growth(r, n) + f) * r / ((1 + r * one(due or 0)) * (_growth(r, n) - 1))


@function("NPV")
def npv(rate, *values):
    return sum(v / (1 + one(rate)) ** k for k, v in enumerate(numbers(values), 1))


@function("IRR")
def irr(values, guess=0.1):
    flows = numbers([values]) if isinstance(values, Grid) else []
    if len(flows) < 2 or min(flows) >= 0 or max(flows) <= 0:
        return NUM
    found = rate_of_return(flows, 0.1 if guess is None else float(guess))
    return NUM if found is None else found


def rate_of_return(flows: list[float], guess: float = 0.1) -> float | None:
    """The rate at which flows, the first at period 0, are worth nothing: Newton's steps from a guess, else, or if they end
    at -1 or below, where no rate lies, halving of [-0.999, 10]."""

    def worth(r: float) -> tuple[float, float]:
        value = slope = 0.0
        for f in reversed(flows):  # Horner's rule, with the slope
            slope = slope / (1 + r) - value / (1 + r) ** 2
            value = value / (1 + r) + f
        return value, slope

    r = guess
    try:
        for _ in range(100):
            value, slope = worth(r)
            done = abs(value) < 1e-10
            if not done:
                if abs(slope) < 1e-14:
                    break
                step = value / slope
                r -= step
                done = abs(step) < 1e-10
            if done:
                if r > -1:
                    return r
                break
    except (ZeroDivisionError, OverflowError):
        pass
    low, high = -0.999, 10.0
    if worth(low)[0] * worth(high)[0] > 0:
        return None
    sign = worth(low)[0]
    for _ in range(200):
        middle = (low + high) / 2
        value = worth(middle)[0]
        if abs(value) < 1e-10 or high - low < 1e-12:
            return middle
        low, high = (middle, high) if value * sign > 0 else (low, middle)
    return None


@function("SLN")
def sln(cost, salvage, life):
    return (one(cost) - one(salvage)) / one(life) if one(life) else None


@function("DB")
def db(cost, salvage, life, period, month=12):
    cost, salvage, life, period, month = one(cost), one(salvage), whole(life), whole(period), whole(month or 12)
    if life <= 0 or period <= 0:
        return NUM
    if cost <= 0:
        return 0.0
    rate = round(1 - (salvage / cost) ** (1 / life), 3)
    first = cost * rate * month / 12
    if period == 1:
        return first
    left = (cost - first) * (1 - rate) ** (period - 2)
    return left * rate * ((12 - month) / 12 if period == life + 1 else 1)
