"""Lookups as joins. The table side is reduced to one row for each key first, so a lookup never multiplies rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import glob_regex, txt
from .ordered import bounds, bucket

#: Rows of a lookup table that is broadcast and searched where the rows are; larger ones are dealt out by key.
SMALL = 200_000


def _key(c: Column, kind: str) -> Column:
    return F.lower(c) if kind == "string" else c.cast("double")


def _once(table: DataFrame, key: Column, value: str, position: str, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    return table.groupBy(key.alias("_t_key")).agg(pick(F.struct(F.col(value).alias("v"), F.col(position).alias("p")), F.col(position)).alias("_t"))


def exact(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, position: str, out: str, last: bool = False, default=None) -> DataFrame:
    """VLOOKUP, XLOOKUP and MATCH with an exact match: the value of the first row (or last) with the key; text in any case.
    `out`_found tells a missing key (#N/A) from a blank value. Spark picks a broadcast by the table's size."""
    once = _once(table, _key(F.col(table_key), dict(table.dtypes)[table_key]), value, position, last)
    joined = df.join(once, _key(F.col(key), dict(df.dtypes)[key]) == F.col("_t_key"), "left")
    found = F.col("_t").isNotNull()
    return joined.withColumn(out, F.when(found, F.col("_t.v")).otherwise(F.lit(default))).withColumn(f"{out}_found", found).withColumn(f"{out}_position", F.col("_t.p")).drop("_t_key", "_t")


def turned(table: DataFrame, key_row: int, value_row: int, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """Two rows of a sheet in long form as a table: position (the column), key, value. HLOOKUP is a lookup in it."""
    picked = table.filter(F.col(row).isin(key_row, value_row)).groupBy(F.col(col).alias("position"))
    return picked.agg(F.max(F.when(F.col(row) == key_row, F.col(value))).alias("key"), F.max(F.when(F.col(row) == value_row, F.col(value))).alias("value"))


def hlookup(df: DataFrame, key: str, table: DataFrame, index: int, out: str, near: bool = False, **names) -> DataFrame:
    """HLOOKUP: the key is looked for in row 1 of a sheet in long form, the value comes from row `index`. near: the last column
    with a number at or below the key."""
    across = turned(table, 1, index, **names)
    if not near:
        return exact(df, key, across, "key", "value", "position", out)
    numbers = across.withColumn("key", F.try_to_number("key", F.lit("999999999999.999999")).cast("double") if dict(across.dtypes)["key"] == "string" else F.col("key"))
    return nearest(df, key, numbers, "key", "value", "position", out, by_position=True)


def nearest(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, position: str, out: str, larger: bool = False, by_position: bool = False, small: int = SMALL) -> DataFrame:
    """Approximate lookups, numbers with numbers or text with text in any case: the table row with the largest key <= the key
    (larger: the smallest >= it), the first of ties; by_position: the last row in scan order with such a key, as an
    approximate VLOOKUP or MATCH has it. Adds out, out_found and out_position.

    A table of at most `small` different keys is broadcast as sorted keys and searched where the rows lie. Beyond that, keys of
    both sides are dealt into buckets by fixed bounds, and one running maximum fills them in; buckets hand on one row each."""
    text = dict(table.dtypes)[table_key] == "string"
    shape = (lambda c: F.lower(c)) if text else (lambda c: c.cast("double"))
    t = table.filter(F.col(table_key).isNotNull()).select(shape(F.col(table_key)).alias("_k"), F.struct(F.col(value).alias("v"), F.col(position).alias("p")).alias("_t"))
    # Of rows with one key: the last in scan order by position, else the first.
    t = t.groupBy("_k").agg((F.max_by if by_position else F.min_by)("_t", F.col("_t.p")).alias("_t"))
    left = df.withColumn("_k", shape(F.col(key)))
    few = t.select("_k", F.col("_t.p").cast("double").alias("p")).limit(small + 1).toPandas()
    if len(few) <= small:
        joined = _searched(left, t, few, larger, by_position, text)
    else:
        joined = _dealt(left, t, larger, by_position)
    return joined.withColumn(out, F.col("_a.v")).withColumn(f"{out}_found", F.col("_a").isNotNull()).withColumn(f"{out}_position", F.col("_a.p")).drop("_k", "_a_key", "_a")


def _searched(left: DataFrame, t: DataFrame, few: pd.DataFrame, larger: bool, by_position: bool, text: bool) -> DataFrame:
    few = few.sort_values("_k", ignore_index=True)
    keys, places = few["_k"].to_numpy(), few["p"].to_numpy()
    if by_position and len(few):
        # The best row at each key is the one furthest on of those up to it (larger: from it on).
        order = np.arange(len(few))
        best = lambda p: np.maximum.accumulate(np.where(p == np.maximum.accumulate(p), np.arange(len(p)), 0))
        order = len(few) - 1 - best(places[::-1])[::-1] if larger else best(places)
    else:
        order = np.arange(len(few))

    @F.pandas_udf("string" if text else "double")
    def found(k: pd.Series) -> pd.Series:
        known = k.notna().to_numpy()
        own = k[known].to_numpy(dtype=object if text else float)
        at = np.searchsorted(keys, own, side="left") if larger else np.searchsorted(keys, own, side="right") - 1
        inside = (at >= 0) & (at < len(keys)) & (np.ones(len(own), bool) if text else ~np.isnan(own.astype(float)))
        out = np.full(len(k), None, object)
        out[np.flatnonzero(known)[inside]] = keys[order[at[inside]]] if len(keys) else None
        return pd.Series(out, dtype=object if text else float)

    return left.withColumn("_hit", found("_k")).join(F.broadcast(t.select(F.col("_k").alias("_a_key"), F.col("_t").alias("_a"))), F.col("_hit") == F.col("_a_key"), "left").drop("_hit")


def _dealt(left: DataFrame, t: DataFrame, larger: bool, by_position: bool) -> DataFrame:
    kind = t.schema["_t"].dataType
    probe = left.select("_k").filter("_k IS NOT NULL").distinct().withColumn("_t", F.lit(None).cast(kind))
    cuts = bounds(t, F.col("_k"))
    both = t.unionByName(probe).withColumn("_probe", F.col("_t").isNull().cast("int")).withColumn("_part", bucket(F.col("_k"), cuts))
    # The best so far is the nearest key, or the row furthest on; larger looks from the other end.
    rank = F.col("_t.p").cast("double") if by_position else F.struct(F.lit(0))
    order = F.when(F.col("_probe") == 0, F.struct(rank.alias("o"), F.col("_t").alias("t")))
    along = [F.desc("_k") if larger else F.asc("_k"), "_probe"]
    pick = (lambda c, w: F.max(c).over(w)) if by_position else (lambda c, w: F.last(c, ignorenulls=True).over(w))
    inner = W.partitionBy("_part").orderBy(*along).rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumn("_best", pick(order, inner))
    # What each bucket hands to the next ones: its own best, one row a bucket.
    own = both.filter("_probe = 0")
    end = F.max(order) if by_position else (F.min_by if larger else F.max_by)(order, "_k")
    ends = own.groupBy(F.col("_part").alias("_p")).agg(end.alias("_b"))
    spine = left.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_n"))
    across = W.orderBy(F.desc("_n") if larger else F.asc("_n")).rowsBetween(W.unboundedPreceding, -1)
    hand = spine.join(ends, F.col("_n") == F.col("_p"), "left").select("_n", pick(F.col("_b"), across).alias("_before"))
    solved = filled.filter("_probe = 1").join(F.broadcast(hand), F.col("_part") == F.col("_n"), "left")
    best = F.greatest("_best", "_before") if by_position else F.coalesce("_best", "_before")
    answers = solved.select(F.col("_k").alias("_a_key"), best.t.alias("_a"))
    return left.join(answers, F.col("_k") == F.col("_a_key"), "left")


def match(df: DataFrame, key: str, table: DataFrame, table_key: str, position: str, out: str, kind: int = 0) -> DataFrame:
    """MATCH: the position of the first equal key (0), of the last number <= the key (1) or of the last >= it (-1); blank is #N/A."""
    if kind == 0:
        return exact(df, key, table, table_key, position, position, out).drop(f"{out}_found", f"{out}_position")
    return nearest(df, key, table, table_key, position, position, out, larger=kind < 0, by_position=True).drop(f"{out}_found", f"{out}_position")


def wildcard(df: DataFrame, table_key: str, value: str, position: str, pattern: str) -> DataFrame:
    """XLOOKUP in wildcard mode for one pattern (* ? and ~): one row with the value of the first row that fits, if any."""
    hit = df.filter(txt(F.col(table_key)).rlike(glob_regex(pattern.lower())))
    return hit.agg(F.min_by(value, position).alias("value"), F.min(position).alias("position"))


def wildcards(df: DataFrame, patterns: str, table: DataFrame, table_key: str, value: str, position: str, out: str) -> DataFrame:
    """XLOOKUP in wildcard mode, a pattern in each row: the value of the first table row that fits. Different patterns are few
    (at most SMALL, checked) and broadcast; a pattern without a wildcard is an exact lookup."""
    asked = df.select(F.col(patterns).alias("_w")).filter("_w IS NOT NULL").distinct()
    held = [r[0] for r in asked.limit(SMALL + 1).collect()]
    if len(held) > SMALL:
        raise ValueError(f"more than {SMALL} different patterns")
    shapes = df.sparkSession.createDataFrame([(p, glob_regex(p.lower())) for p in held] or [("", "$^")], "_w string, _shape string")
    hits = table.join(F.broadcast(shapes), F.rlike(txt(F.col(table_key)), F.col("_shape"))).groupBy("_w").agg(F.min_by(value, position).alias(out))
    return df.join(hits, F.col(patterns) == F.col("_w"), "left").drop("_w")


def index(df: DataFrame, position: str, at: int, column: str) -> DataFrame:
    """INDEX: the value of one column at a 1-based position; no row is #REF!."""
    return df.filter(F.col(position) == at).select(F.col(column).alias("value"))


def index_2d(df: DataFrame, row: str, col: str, cells: DataFrame, out: str, height: int, width: int) -> DataFrame:
    """INDEX over a block in long form (row, col, value, from 1), a row and column number in each row of df; out_error is
    #REF! outside height x width."""
    grid = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias(out))
    joined = df.join(grid, (F.col(row) == F.col("_r")) & (F.col(col) == F.col("_c")), "left").drop("_r", "_c")
    inside = F.col(row).between(1, height) & F.col(col).between(1, width)
    return joined.withColumn(f"{out}_error", F.when(~F.coalesce(inside, F.lit(True)), F.lit("#REF!")))


def offset(df: DataFrame, column: str, rows: int, out: str, partition: list[str], order: list[str]) -> DataFrame:
    """OFFSET by a fixed number of rows, filled down: the value that many rows on (or back) within each partition."""
    return df.withColumn(out, F.lead(column, rows).over(W.partitionBy(*partition).orderBy(*order)))


def offset_area(cells: DataFrame, row: int, col: int, rows: int, cols: int, height: int = 1, width: int = 1) -> DataFrame:
    """OFFSET with a height and width: the block of a sheet in long form that lies so far from a cell, numbered from 1. A block
    that begins outside the sheet or has no cells raises."""
    top, left = row + rows, col + cols
    if top < 1 or left < 1 or height < 1 or width < 1:
        raise ValueError("#REF!")
    inside = F.col("row").between(top, top + height - 1) & F.col("col").between(left, left + width - 1)
    return cells.filter(inside).withColumns({"row": F.col("row") - top + 1, "col": F.col("col") - left + 1})
