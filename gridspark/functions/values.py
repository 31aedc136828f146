"""Cell values as Columns: coercion, comparison, wildcards and serial dates.

A blank is NULL; an error is its code (such as #N/A) in a string column. Numbers in text are read strictly: Spark's own
casts trim, and take '1d' and 'NaN'."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ERRORS = ("#N/A", "#VALUE!", "#REF!", "#DIV/0!", "#NUM!", "#NAME?")
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def num(c: Column, kind: str = "string") -> Column:
    """The number a cell stands for, or NULL: numbers themselves, TRUE and FALSE as 1 and 0, text if it is a number."""
    if kind == "string":
        return F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return c.cast("double")


def is_error(c: Column) -> Column:
    return F.coalesce(c.isin(*ERRORS), F.lit(False))


def txt(c: Column) -> Column:
    """A cell as text for comparison: lower case, a blank as ''."""
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def glob_regex(pattern: str, tilde: bool = True, sets: bool = False) -> str:
    """A regular expression for a pattern with * and ?; ~ takes the next one literally, [...] is any of its characters if
    sets is true ([!...]: any other)."""
    out, k = "", 0
    while k < len(pattern):
        ch = pattern[k]
        close = pattern.find("]", k + 2) if sets and ch == "[" else -1
        if tilde and ch == "~" and k + 1 < len(pattern) and pattern[k + 1] in "*?~":
            k += 1
            out += "\\" + pattern[k]
        elif close > 0:
            inner = re.sub(r"([\\\[&~|^])", r"\\\1", pattern[k + 1 : close])
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            k = close
        else:
            out += {"*": ".*", "?": "."}.get(ch) or ("\\" + ch if ch in r"\.[]{}()+-^$|*?" else ch)
        k += 1
    return f"(?s)^{out}$"


def glob(c: Column, pattern: str) -> Column:
    return txt(c).rlike(glob_regex(pattern.lower()))


def serial_of_date(d: Column) -> Column:
    """The 1900-system serial of a date: 1900 counts as a leap year, so days from 1900-03-01 on are one more."""
    days = F.datediff(d.cast("date"), F.lit("1899-12-31").cast("date"))
    return F.when(days >= 60, days + 1).otherwise(days).cast("double")


def date_of_serial(s: Column) -> Column:
    """The date of a serial; 60, which isn't one, gives 1900-02-28."""
    n = F.floor(s).cast("int")
    return F.date_add(F.lit("1899-12-31").cast("date"), F.when(n >= 60, n - 1).otherwise(n))
