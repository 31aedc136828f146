"""Ordered columns without one task for all rows: buckets by bounds, running values, rows around and n-th values.

A bucket is a function of the value alone, against bounds that are fixed in the plan, so every use of it agrees. What a bucket
hands to the next ones is one row a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bounds, as a power of two, that are looked for by halving; and the sample they are taken from.
STEPS, SAMPLED = 12, 1 << 15


def bounds(df: DataFrame, c: Column, most: int = (1 << STEPS) - 1) -> list:
    """At most `most` values of a column that cut its distinct values evenly, from a sample of bounded size."""
    values = df.select(c.alias("v")).filter("v IS NOT NULL").distinct()
    # Each task keeps the values with the least hashes.
    found = sorted(r[0] for r in values.orderBy(F.xxhash64("v")).limit(SAMPLED).collect())
    if len(found) <= 64:
        return []
    parts = max(1, min(most + 1, len(found) // 8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return sorted({found[len(found) * k // parts] for k in range(1, parts)})


def bucket(c: Column, cuts: list) -> Column:
    """How many of the sorted cuts are not greater than a value: 0 to len(cuts), found by halving."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    held = F.lit(cuts) if not isinstance(cuts[0], str) else F.array(*map(F.lit, cuts))

    def halve(low: Column, size: Column) -> Column:
        at = F.get(held, low + size - 1)
        return F.when(at <= c, low + size).otherwise(low)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(steps)))), F.lit(0), halve)


def running(df: DataFrame, wanted: dict[str, tuple[str, Column]], position: str) -> DataFrame:
    """df with running aggregates up to each row, in order of position (different in every row). wanted: out -> (sum, count,
    min or max, column)."""
    cuts = bounds(df, F.col(position))
    fold = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    join = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "count": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    cut = df.withColumn("_b", bucket(F.col(position), cuts))
    inner = W.partitionBy("_b").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    out = cut.withColumns({f"_r{k}": fold[f](c).over(inner) for k, (f, c) in enumerate(wanted.values())})
    names = list(wanted)
    if cuts:
        ends = cut.groupBy(F.col("_b").alias("_e")).agg(*(fold[f](c).alias(f"_s{k}") for k, (f, c) in enumerate(wanted.values())))
        before = W.orderBy("_e").rowsBetween(W.unboundedPreceding, -1)  # one row a bucket
        again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        carried = ends.select("_e", *(again[wanted[n][0]](f"_s{k}").over(before).alias(f"_c{k}") for k, n in enumerate(names)))
        out = out.join(F.broadcast(carried), F.col("_b") == F.col("_e"))
        out = out.withColumns({n: join[wanted[n][0]](F.col(f"_r{k}"), F.col(f"_c{k}")) for k, n in enumerate(names)}).drop("_e", *(f"_c{k}" for k in range(len(names))))
    else:
        out = out.withColumnsRenamed({f"_r{k}": n for k, n in enumerate(names)})
    return out.drop("_b", *(f"_r{k}" for k in range(len(names))))


def around(df: DataFrame, wanted: dict[str, tuple], position: str) -> DataFrame:
    """df with aggregates of the rows around each row, in order of position (different in every row). wanted: out ->
    (function of a column, column, first row, last row), relative to the row's own; the first and last rows of a bucket are
    also put beside their neighbours."""
    back, on = max(0, -min(w[2] for w in wanted.values())), max(0, max(w[3] for w in wanted.values()))
    reach = max(back, on, 1)
    cuts = bounds(df, F.col(position))
    # Buckets hold far more rows than are looked back or on; else they are joined.
    n = df.count() if cuts else 0
    step = max(1, -(-16 * reach * (len(cuts) + 1) // max(n, 1)))
    cuts = cuts[step - 1 :: step] if n > 64 * reach else []
    slim = df.select(F.col(position).alias("_p"), *(w[1].alias(f"_v{k}") for k, w in enumerate(wanted.values())))
    slim = slim.withColumn("_b", bucket(F.col("_p"), cuts))
    if cuts:
        first, last = W.partitionBy("_b").orderBy("_p"), W.partitionBy("_b").orderBy(F.desc("_p"))
        marked = slim.withColumns({"_f": F.row_number().over(first), "_l": F.row_number().over(last)})
        copies = F.array_compact(F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")), F.when(F.col("_l") <= back, F.struct((F.col("_b") + 1).alias("b"), F.lit(False).alias("own"))), F.when(F.col("_f") <= on, F.struct((F.col("_b") - 1).alias("b"), F.lit(False).alias("own")))))
        slim = marked.withColumn("_x", F.explode(copies)).withColumn("_b", F.col("_x.b")).withColumn("_own", F.col("_x.own")).drop("_x", "_f", "_l")
    else:
        slim = slim.withColumn("_own", F.lit(True))
    order = W.partitionBy("_b").orderBy("_p")
    found = slim.withColumns({f"_o{k}": w[0](F.col(f"_v{k}")).over(order.rowsBetween(w[2], w[3])) for k, w in enumerate(wanted.values())}).filter("_own")
    found = found.select("_p", *(F.col(f"_o{k}").alias(name) for k, name in enumerate(wanted)))
    return df.join(found, F.col(position) == F.col("_p"), "left").drop("_p")


def totals(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """df with aggregates of all its rows: one row, joined to each."""
    return df.join(F.broadcast(df.agg(*(c.alias(n) for n, c in wanted.items()))))


def nth(df: DataFrame, c: Column, n: int, descending: bool) -> DataFrame:
    """One row: `nth`, the n-th value (from 1) of a column in order. A large n first finds the bucket that holds it, from one
    count a bucket, so that no task sorts more than a bucket."""
    values = df.select(c.alias("v")).filter("v IS NOT NULL")
    if n <= 0:
        return df.sparkSession.createDataFrame([(None,)], "nth double")
    if n > 10_000:
        cuts = bounds(values, F.col("v"))
        held = {r[0]: r[1] for r in values.groupBy(bucket(F.col("v"), cuts).alias("b")).count().collect()}
        for b in sorted(held, reverse=descending):
            if held[b] >= n:
                values = values.filter(bucket(F.col("v"), cuts) == b)
                break
            n -= held[b]
        # Within the bucket, values that repeat are counted once each.
        order = F.col("v").desc() if descending else F.col("v").asc()
        counted = values.groupBy("v").count()
        upto = counted.withColumn("upto", F.sum("count").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
        return upto.filter(F.col("upto") >= n).agg((F.max("v") if descending else F.min("v")).alias("nth"))
    best = values.orderBy(F.col("v").desc() if descending else F.col("v").asc()).limit(n)
    return best.agg((F.min("v") if descending else F.max("v")).alias("nth"))


def moving_average(df: DataFrame, c: str, out: str, position: str, periods: int, partition: list[str] | None = None) -> DataFrame:
    """A moving-average trend line: the mean of this row and the periods - 1 before it, blank where there are fewer."""
    if partition:
        w = W.partitionBy(*partition).orderBy(position).rowsBetween(1 - periods, 0)
        return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) == periods, F.avg(c).over(w)))
    got = around(df, {"_mean": (F.avg, F.col(c), 1 - periods, 0), "_n": (F.count, F.lit(1), 1 - periods, 0)}, position)
    return got.withColumn(out, F.when(F.col("_n") == periods, F.col("_mean"))).drop("_mean", "_n")


def trend_line(df: DataFrame, x: str, y: str, kind: str = "linear") -> DataFrame:
    """One row: slope and intercept of a trend line: linear, exp (of ln y), log (over ln x) or power (of ln y over ln x)."""
    a = F.log(x) if kind in ("log", "power") else F.col(x).cast("double")
    b = F.log(y) if kind in ("exp", "power") else F.col(y).cast("double")
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))
