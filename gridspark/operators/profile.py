"""Column profiles, sheet classes and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import num

#: Distinct values are counted up to this.
CAP = 10_000
_KINDS = {"string": "string", "boolean": "bool", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "double": "float", "float": "float"}


def profile(df: DataFrame, order: str | None = None) -> DataFrame:
    """A row for each column: type, null_count, unique_count (capped), unique_capped, cardinality, and samples: the first three
    different values in order of a column, if one is given.

    One aggregate over the columns as they lie counts blanks and kinds, and estimates different values. Only columns with an
    estimate near the cap or below have their values counted one by one, after a partial aggregate; those beyond never leave
    their tasks, and their first values come from three more aggregates of one row."""
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if c != order]
    text = lambda c: F.col(f"`{c}`").cast("string")
    number = lambda c: num(F.trim(text(c)))
    whole = lambda c: F.trim(text(c)).rlike(r"^[+-]?[0-9]{1,18}$")
    asked = [F.count("*").alias("rows")]
    for k, c in enumerate(columns):
        asked += [F.count(f"`{c}`").alias(f"n{k}"), F.approx_count_distinct(f"`{c}`", 0.02).alias(f"d{k}")]
        if kinds[c] == "string":
            asked += [F.max(number(c).isNull() & text(c).isNotNull()).alias(f"t{k}"), F.max(number(c).isNotNull()).alias(f"m{k}"), F.max(number(c).isNotNull() & ~whole(c)).alias(f"f{k}")]
    facts = df.agg(*asked).first()
    few = [c for k, c in enumerate(columns) if facts[f"d{k}"] <= 2 * CAP]
    distinct, firsts = dict.fromkeys(columns, 2 * CAP), {}
    if few:
        cells = F.array(*(F.struct(F.lit(c).alias("name"), text(c).alias("v")) for c in few))
        long = df.select((F.col(order) if order else F.lit(0)).alias("at"), F.explode(cells).alias("c")).select("at", "c.*").filter("v IS NOT NULL")
        counted = long.groupBy("name", "v").agg(F.min("at").alias("at"))
        distinct |= dict.fromkeys(few, 0) | {r["name"]: r["n"] for r in counted.groupBy("name").agg(F.count("*").alias("n")).collect()}
        if order:
            firsts = {r["name"]: r["samples"] for r in samples(counted.select("name", F.struct("at", "v").alias("s"))).collect()}
    many = [c for c in columns if c not in few]
    for _ in range(3 if order and many else 0):
        new = lambda c: text(c).isNotNull() & (~text(c).isin(firsts[c]) if firsts.get(c) else F.lit(True))
        row = df.agg(*(F.min_by(F.when(new(c), text(c)), F.when(new(c), F.struct(F.col(order), text(c)))).alias(f"v{k}") for k, c in enumerate(many))).first()
        for k, c in enumerate(many):
            firsts[c] = [*firsts.get(c, []), *([row[k]] if row[k] is not None else [])]
    out = []
    for k, c in enumerate(columns):
        filled, d = facts[f"n{k}"], distinct[c]
        declared = _KINDS.get(kinds[c], "int" if "int" in kinds[c] else "string")
        if not filled:
            kind = "empty"
        elif kinds[c] != "string":
            kind = declared
        else:
            kind = "mixed" if facts[f"t{k}"] and facts[f"m{k}"] else "string" if facts[f"t{k}"] else "float" if facts[f"f{k}"] else "int"
        spread = "empty" if not filled else "high" if d > CAP else "unique" if d == filled else "categorical" if d <= 20 and 2 * d <= filled else "high"
        out.append((c, kind, facts["rows"] - filled, min(d, CAP), d > CAP, spread, firsts.get(c, [])))
    made = df.sparkSession.createDataFrame(out, "name string, type string, null_count bigint, unique_count bigint, unique_capped boolean, cardinality string, samples array<string>")
    return made if order else made.drop("samples")


#: Parts in which a column's first values are looked for.
_PARTS = 64


def samples(found: DataFrame, k: int = 3) -> DataFrame:
    """name, samples: the k values with the least places of each name; parts of a name are ranked before they meet."""
    part = W.partitionBy("name", F.pmod(F.xxhash64("s.v"), F.lit(_PARTS))).orderBy("s.at", "s.v")
    few = found.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k)
    ranked = few.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("s.at", "s.v"))).filter(F.col("r") <= k)
    return ranked.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "s.v"))), lambda x: x.v).alias("samples"))


def class_of(rows: int, cols: int, filled: int) -> str:
    """empty, readme, summary or data, from a sheet's size and filled cells."""
    if not filled:
        return "empty"
    if cols == 1:
        return "readme"
    return "summary" if rows <= 20 and cols <= 10 and filled / (rows * cols) < 0.4 else "data"


def classify(df: DataFrame) -> DataFrame:
    """One row: rows, cols, density (filled share of all cells) and class: empty, readme, summary or data."""
    cols = len(df.columns)
    filled = sum((F.col(c).isNotNull().cast("bigint") for c in df.columns), F.lit(0))
    d = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled")).withColumn("cols", F.lit(cols).cast("bigint"))
    return sheet_class(d)


def classify_sheets(cells: DataFrame, keys: tuple[str, ...] = ("file", "sheet")) -> DataFrame:
    """classify() of every sheet in long form."""
    d = cells.groupBy(*keys).agg(F.max("row").cast("bigint").alias("rows"), F.max("col").cast("bigint").alias("cols"), F.count("value").alias("filled"))
    return sheet_class(d, keys)


def sheet_class(d: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    d = d.withColumn("density", F.when((F.col("rows") > 0) & (F.col("cols") > 0), F.col("filled") / (F.col("rows") * F.col("cols"))).otherwise(F.lit(0.0)))
    kind = F.when(F.col("filled") == 0, F.lit("empty")).when(F.col("cols") == 1, F.lit("readme")).when((F.col("rows") <= 20) & (F.col("cols") <= 10) & (F.col("density") < 0.4), F.lit("summary")).otherwise(F.lit("data"))
    return d.select(*keys, "rows", "cols", "density", kind.alias("class"))


def picks(total: int, k: int, head: int = 3, tail: int = 2) -> list[int]:
    """Places (from 1) of k rows at even steps of what head and tail leave."""
    middle = total - head - tail
    if middle <= 0 or k <= 0:
        return []
    k = min(k, middle)
    return sorted({head + 1 + (round(i * (middle - 1) / (k - 1)) if k > 1 else 0) for i in range(k)})


def head_and_tail(df: DataFrame, position: str, head: int = 3, tail: int = 2) -> DataFrame:
    """The first and the last rows by a position column, each once."""
    ends = df.orderBy(position).limit(head).unionByName(df.orderBy(F.desc(position)).limit(tail))
    return ends.dropDuplicates([position])


def stratified(df: DataFrame, position: str, k: int, head: int = 3, tail: int = 2) -> DataFrame:
    """`k` rows at even steps of the middle (what head and tail leave), by a 1-based position column."""
    return df.filter(F.col(position).isin(picks(df.count(), k, head, tail)))
