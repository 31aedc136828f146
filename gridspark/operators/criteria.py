"""The criteria language of SUMIF and its kin, and conditional aggregates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import glob_regex, num

#: Operators of a criterion; of those that fit, the longest counts.
OPERATORS = ("<=", ">=", "<>", "<", ">", "=")


def split_criterion(text: str) -> tuple[str, str]:
    """The operator that a criterion begins with ('' for none), and its operand."""
    op = next((o for o in OPERATORS if text.startswith(o)), "")
    return op, text[len(op) :].strip() if op else text


def matches(c: Column, kind: str, criterion) -> Column:
    """Whether a cell fits a criterion: a number (numeric equality), None (blank), or text with an optional operator. A number
    after an operator compares numeric cells only, but <> takes all others; other text compares in lower case. A blank fits
    <> and nothing else. Only text without an operator may have the wildcards * ? and [ ]."""
    if criterion is None:
        return c.isNull()
    n = num(c, kind)
    if isinstance(criterion, (int, float)):
        return F.coalesce(n == float(criterion), F.lit(False))
    op, operand = split_criterion(criterion)
    try:
        value = float(operand) if op else None
    except ValueError:
        value = None
    if value is not None:
        if op == "<>":
            return F.coalesce(n != value, F.lit(True))
        return F.coalesce({"=": n == value, ">": n > value, "<": n < value, ">=": n >= value, "<=": n <= value}[op], F.lit(False))
    t, low = F.lower(c.cast("string")), operand.lower()
    if not op:
        hit = t.rlike(glob_regex(low, tilde=False, sets=True)) if re.search(r"[*?]", low) else t == low
    else:
        hit = {"=": t == low, "<>": t != low, ">": t > low, "<": t < low, ">=": t >= low, "<=": t <= low}[op]
    return F.coalesce(hit, F.lit(op == "<>"))


def _all(df: DataFrame, criteria: dict[str, object]) -> Column:
    kinds = dict(df.dtypes)
    return reduce(lambda a, b: a & b, (matches(F.col(c), kinds[c], x) for c, x in criteria.items()), F.lit(True))


def sumifs(df: DataFrame, value: str, criteria: dict) -> Column:
    return F.coalesce(F.sum(F.when(_all(df, criteria), num(F.col(value), dict(df.dtypes)[value]))), F.lit(0.0))


def countifs(df: DataFrame, criteria: dict) -> Column:
    return F.count(F.when(_all(df, criteria), 1))


def averageifs(df: DataFrame, value: str, criteria: dict) -> Column:
    """NULL without a match (a spreadsheet says #DIV/0!)."""
    return F.avg(F.when(_all(df, criteria), num(F.col(value), dict(df.dtypes)[value])))


def minifs(df: DataFrame, value: str, criteria: dict) -> Column:
    return F.coalesce(F.min(F.when(_all(df, criteria), num(F.col(value), dict(df.dtypes)[value]))), F.lit(0.0))


def maxifs(df: DataFrame, value: str, criteria: dict) -> Column:
    return F.coalesce(F.max(F.when(_all(df, criteria), num(F.col(value), dict(df.dtypes)[value]))), F.lit(0.0))


def per_row(df: DataFrame, keys: list[str], out: str, agg: Column) -> DataFrame:
    """SUMIFS filled down: the aggregate of all rows with this row's keys, by one aggregate and a join, with no window over
    whole groups; null keys meet each other."""
    sums = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(agg.alias(out))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return df.join(sums, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def numeric_aggregates(df: DataFrame, c: str) -> dict[str, Column]:
    """SUM, COUNT, COUNTA, AVERAGE, MIN and MAX over a column of cells: text and errors are passed over."""
    n = num(F.col(c), dict(df.dtypes)[c])
    if dict(df.dtypes)[c] == "string":  # text in a range is no number, even if it looks like one
        n = F.lit(None).cast("double")
    return {
        "SUM": F.coalesce(F.sum(n), F.lit(0.0)), "COUNT": F.count(n).cast("double"), "COUNTA": F.count(F.col(c)).cast("double"), "AVERAGE": F.avg(n),
        "MIN": F.coalesce(F.min(n), F.lit(0.0)), "MAX": F.coalesce(F.max(n), F.lit(0.0)),
    }


def all_of(c: Column) -> Column:
    """AND over a range: whether all its values are true, blanks passed over."""
    return F.coalesce(F.bool_and(c), F.lit(True))


def any_of(c: Column) -> Column:
    """OR over a range."""
    return F.coalesce(F.bool_or(c), F.lit(False))
