"""Spreadsheet functions as Column builders: no UDF, so expressions stay in generated code.

`FUNCTIONS` maps upper-case names to builders. A builder whose spreadsheet function can fail gives NULL on failure; its
error code, if any, is in `errors(name)(args)`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .plain import rate_of_return
from .values import date_of_serial, serial_of_date

FUNCTIONS: dict[str, Callable[..., Column]] = {}
ERRORS: dict[str, Callable[..., Column]] = {}


def function(f: Callable[..., Column]) -> Callable[..., Column]:
    FUNCTIONS[f.__name__.rstrip("_").upper()] = f
    return f


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


def _double(x) -> Column:
    return _lit(x).cast("double")


# Arithmetic: an operand that is blank gives a blank; x / 0 is an error, here NULL.
def div(a, b) -> Column:
    return F.when(_double(b) != 0, F.try_divide(_double(a), _double(b)))


ERRORS["/"] = lambda a, b: F.when(_double(b) == 0, F.lit("#DIV/0!"))


@function
def abs_(x):
    return F.abs(_double(x))


def _scale(digits) -> Column:
    return F.lit(10.0**digits) if isinstance(digits, int) else F.pow(F.lit(10.0), digits)


@function
def round_(x, digits=0):
    """Half to even."""
    return F.bround(_double(x), digits if isinstance(digits, int) else digits.cast("int"))


@function
def roundup(x, digits=0):
    """Towards plus infinity."""
    p = _scale(digits)
    return F.ceil(_double(x) * p).cast("double") / p


@function
def rounddown(x, digits=0):
    p = _scale(digits)
    y = _double(x) * p
    return F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)).cast("double") / p


@function
def int_(x):
    return F.floor(_double(x)).cast("double")


@function
def mod(a, b):
    """The sign is the divisor's; a zero divisor gives a blank."""
    a, b = _double(a), _double(b)
    return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))


@function
def power(a, b):
    out = F.pow(_double(a), _double(b))
    return F.when(~F.isnan(out), out)


ERRORS["POWER"] = lambda a, b: F.when((_double(a) < 0) & (_double(b) != F.floor(_double(b))), F.lit("#NUM!"))


@function
def sqrt(x):
    return F.when(_double(x) >= 0, F.sqrt(_double(x)))


@function
def sign(x):
    return F.signum(_double(x))


@function
def if_(condition, yes, no=False):
    return F.when(F.coalesce(condition, F.lit(False)), _lit(yes)).otherwise(_lit(no))


@function
def iferror(value, other, error=None):
    """`other` where `error` (a column of codes) isn't NULL, or where the value is text that begins with #."""
    bad = F.coalesce(_lit(value).cast("string").startswith("#"), F.lit(False))
    return F.when(bad if error is None else bad | error.isNotNull(), _lit(other)).otherwise(value)


@function
def and_(*xs):
    return reduce(lambda a, b: a & b, (F.coalesce(x, F.lit(True)) for x in xs))


@function
def or_(*xs):
    return reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in xs))


@function
def not_(x):
    return ~F.coalesce(x, F.lit(False))


@function
def choose(index, *options):
    i = _lit(index).cast("int")
    return reduce(lambda acc, k: F.when(i == k + 1, _lit(options[k])).otherwise(acc), range(len(options)), F.lit(None))


ERRORS["CHOOSE"] = lambda i, *o: F.when((i < 1) | (i > len(o)), F.lit("#VALUE!"))


# Text
def _text(x) -> Column:
    return F.coalesce(_lit(x).cast("string"), F.lit(""))


@function
def left(s, n=1):
    return F.when(_lit(n) >= 0, F.substring(_text(s), 1, n if isinstance(n, int) else F.greatest(n, F.lit(0))))


@function
def right(s, n=1):
    return F.when(_lit(n) <= 0, F.lit("")).otherwise(F.right(_text(s), _lit(n)))


@function
def mid(s, start, n):
    start, n = _lit(start), _lit(n)
    return F.when((start >= 1) & (n >= 0), F.substr(_text(s), start, n))


ERRORS["MID"] = lambda s, a, n: F.when((_lit(a) < 1) | (_lit(n) < 0), F.lit("#VALUE!"))


@function
def len_(s):
    return F.length(_text(s)).cast("double")


@function
def concatenate(*xs):
    return F.concat(*map(_text, xs))


@function
def upper(s):
    return F.upper(_text(s))


@function
def lower(s):
    return F.lower(_text(s))


@function
def trim(s):
    """White space at the ends goes, and runs of it become one space."""
    return F.trim(F.regexp_replace(_text(s), r"(?U)\s+", " "))


@function
def substitute(s, old, new, nth=None):
    """All places, or the nth (places may overlap)."""
    s = _text(s)
    if not old:
        return s
    if nth is None:
        return F.replace(s, F.lit(old), F.lit(new))
    at = F.lit(0)
    for _ in range(nth):
        at = _next(s, old, at)
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), F.lit(new), F.substr(s, at + len(old)))).otherwise(s)


def _next(s: Column, old: str, after: Column) -> Column:
    found = F.position(F.lit(old), s, (F.greatest(after, F.lit(0)) + 1).cast("int"))
    return F.when((after >= 0) & (found > 0), found).otherwise(F.lit(-1))


@function
def rept(s, n):
    return F.when(_lit(n) > 0, F.repeat(_text(s), _lit(n).cast("int"))).otherwise(F.lit(""))


@function
def exact(a, b):
    return _text(a) == _text(b)


@function
def find(what, s, start=1):
    at = F.position(_lit(what), _text(s), _lit(start).cast("int"))
    return F.when(at > 0, at.cast("double"))


ERRORS["FIND"] = lambda w, s, a=1: F.when(F.position(_lit(w), _text(s), _lit(a).cast("int")) == 0, F.lit("#VALUE!"))

#: Date patterns of TEXT (fixed values), as Spark writes them.
DATE_PATTERNS = {"yyyy-mm-dd": "yyyy-MM-dd", "yyyy/mm/dd": "yyyy/MM/dd", "mm/dd/yyyy": "MM/dd/yyyy", "d-mmm-yy": "d-MMM-yy", "d-mmm-yyyy": "d-MMM-yyyy", "mmm-yy": "MMM-yy"}


@function
def text(x, pattern):
    """Text of a number by a pattern: see formatted(). A blank is ''."""
    return F.when(_double(x).isNotNull(), formatted(x, pattern)).otherwise(F.lit(""))


def formatted(x, pattern):
    """A number (or the serial of a date) by a pattern: 0, 0.0.., #,##0.., $#,##0.., 0%, 0.0%.., 0.00E+00, dates, General."""
    x = _double(x)
    pattern = pattern.replace('"', "")
    low = pattern.lower()
    if low in DATE_PATTERNS:
        return F.date_format(date_of_serial(x), DATE_PATTERNS[low])
    places = len(pattern.partition(".")[2].rstrip("%").split("E")[0])
    if pattern.endswith("%"):
        return F.concat(F.format_string(f"%.{places}f", x * 100), F.lit("%"))
    if "E+" in pattern:
        return F.format_string(f"%.{places}E", x)
    if "#,##0" in pattern:
        if "_)" in pattern:  # negative numbers in parentheses, room for one after the others
            body = F.format_number(F.abs(x), 2 if ".00" in pattern else 0)
            return F.when(x < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(F.concat(body, F.lit(" ")))
        body = F.format_number(x, places)
        return F.concat(F.lit("$"), body) if pattern.startswith("$") else body
    if set(pattern) <= set("0."):
        return F.format_string(f"%.{places}f", x)
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


# Dates: serials of the 1900 system.
@function
def date(y, m, d):
    """Months wrap; the day is held within the month."""
    y, m, d = (_lit(v).cast("int") for v in (y, m, d))
    y = F.when((y >= 0) & (y < 100), y + 1900).otherwise(y)
    first = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1)
    return serial_of_date(F.date_add(first, F.least(F.greatest(d, F.lit(1)), F.day(F.last_day(first))) - 1))


def _calendar(name: str, part: Callable[[Column], Column], sixty: int):
    def f(s):
        s = _lit(s)
        return F.when(F.floor(s) == 60, F.lit(float(sixty))).otherwise(part(date_of_serial(s)).cast("double"))

    FUNCTIONS[name] = f
    return f


year = _calendar("YEAR", F.year, 1900)
month = _calendar("MONTH", F.month, 2)
day = _calendar("DAY", F.day, 29)


@function
def edate(s, months):
    d = date_of_serial(_lit(s))
    first = F.add_months(F.trunc(d, "MM"), _lit(months).cast("int"))
    return serial_of_date(F.date_add(first, F.least(F.day(d), F.day(F.last_day(first))) - 1))


@function
def eomonth(s, months):
    return serial_of_date(F.last_day(F.add_months(F.trunc(date_of_serial(_lit(s)), "MM"), _lit(months).cast("int"))))


@function
def days(end, start):
    return (F.floor(_lit(end)) - F.floor(_lit(start))).cast("double")


def _seconds(s) -> Column:
    s = _double(s)
    return F.bround((s - F.floor(s)) * 86400, 0).cast("bigint")


@function
def hour(s):
    return F.expr("0D") + F.floor(_seconds(s) / 3600)


@function
def minute(s):
    return F.expr("0D") + F.floor(_seconds(s) / 60) % 60


@function
def second(s):
    return F.expr("0D") + _seconds(s) % 60


@function
def today():
    return serial_of_date(F.current_date())


@function
def now():
    t = F.current_timestamp()
    return serial_of_date(t) + (F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))) / F.lit(86400.0)


# Finance
@function
def pv(rate, nper, pmt, fv=0.0, due=0):
    r, n, p, f = map(_double, (rate, nper, pmt, fv))
    grow = F.pow(1 + r, n)
    return F.when(r == 0, -(f + p * n)).otherwise(-(f + p * (1 + r * due) * F.try_divide(grow - 1, r)) / grow)


@function
def fv(rate, nper, pmt, pv=0.0, due=0):
    r, n, p, v = map(_double, (rate, nper, pmt, pv))
    grow = F.pow(1 + r, n)
    return F.when(r == 0, -(v + p * n)).otherwise(-(v * grow + p * (1 + r * due) * F.try_divide(grow - 1, r)))


@function
def pmt(rate, nper, pv, fv=0.0, due=0):
    r, n, v, f = map(_double, (rate, nper, pv, fv))
    grow = F.pow(1 + r, n)
    return F.when(r == 0, -(v + f) / n).otherwise(-(v * grow + f) * r / ((1 + r * due) * (grow - 1)))


@function
def npv(rate, values: Column):
    """values: an array in order; its first value is at period 1."""
    r = _double(rate)
    values = F.array_compact(values)
    return F.aggregate(F.transform(values, lambda v, i: v / F.pow(1 + r, i + 1)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


@function
def irr(values: Column, guess: float | None = None):
    """The rate at which an array of values, the first at period 0, is worth nothing; NULL if there is none (a spreadsheet says
    #NUM!). Newton's steps go over all rows of a batch at once; rows where they don't end above -1 are halved one by one."""
    start = 0.1 if guess is None else float(guess)

    @F.pandas_udf("double")
    def solved(flows: pd.Series) -> pd.Series:
        return pd.Series(rates_of_return([np.asarray([v for v in f if v is not None], float) if f is not None else np.zeros(0) for f in flows], start))

    return solved(values)


def rates_of_return(flows: list[np.ndarray], guess: float = 0.1) -> np.ndarray:
    """IRR of each of some arrays; NaN for none."""
    out = np.full(len(flows), np.nan)
    able = np.array([k for k, f in enumerate(flows) if len(f) > 1 and f.min() < 0 < f.max()], np.int64)
    if not len(able):
        return out
    width = max(len(flows[k]) for k in able)
    table = np.zeros((len(able), width))
    for i, k in enumerate(able):
        table[i, : len(flows[k])] = flows[k]
    rate, open_ = np.full(len(able), guess), np.ones(len(able), bool)
    with np.errstate(all="ignore"):
        for _ in range(100):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            r, value, slope = rate[at], np.zeros(len(at)), np.zeros(len(at))
            for c in range(width - 1, -1, -1):  # Horner's rule, with the slope
                slope = slope / (1 + r) - value / (1 + r) ** 2
                value = value / (1 + r) + table[at, c]
            step = value / slope
            done = np.abs(value) < 1e-10
            rate[at] = np.where(done, r, r - step)
            open_[at] = ~(done | (np.abs(step) < 1e-10))
            open_[at] &= np.isfinite(rate[at])
    good = ~open_ & np.isfinite(rate) & (rate > -1)
    out[able[good]] = rate[good]
    for k in able[~good].tolist():
        found = rate_of_return(flows[k].tolist(), guess)
        out[k] = np.nan if found is None or isinstance(found, complex) else found
    return out


@function
def sln(cost, salvage, life):
    return F.when(_double(life) != 0, F.try_divide(_double(cost) - _double(salvage), _double(life)))


@function
def db(cost, salvage, life, period, month=12):
    """Fixed declining balance: the rate is rounded to three places."""
    c, s, n, p = map(_double, (cost, salvage, life, period))
    rate = F.bround(1 - F.pow(F.try_divide(s, c), 1 / n), 3)
    first = c * rate * month / 12
    left = (c - first) * F.pow(1 - rate, F.greatest(p - 2, F.lit(0.0)))
    last = F.when(p == n + 1, left * rate * (12 - month) / 12).otherwise(left * rate)
    return F.when(c <= 0, F.lit(0.0)).when(p == 1, first).otherwise(last)
