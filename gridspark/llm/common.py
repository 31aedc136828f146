"""Helpers shared by the operators: shared storage, lineage cuts and distributed ranks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a character class for Java and Python regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; an own folder only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="gridspark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing.
    The files go with release(), or when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._gs_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that no later plan reads."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._gs_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sequence_in_groups(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 1 in the given order, as column `out`, without a group ever meeting in one task.

    Rows are range-partitioned by (group, order), so a large group spans many partitions; each row takes its
    position in its sorted partition from monotonically_increasing_id(), and a small table with one row for each
    partition and group carries the offsets. The numbered rows are written once, so both uses see the same positions."""
    keys = [F.col(group), *map(F.col, order)]
    at = table(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_gs_at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_gs_part", F.shiftright("_gs_at", 33))
    return _offsets_applied(at, group, out)


def sequence_as_stored(df: DataFrame, group: str, out: str) -> DataFrame:
    """As sequence_in_groups, for rows read from files: a group's order is that of file names, then of rows in a file, so it
    depends on the files alone; rows stay in the partition they are read in, with no shuffle."""
    known = df.select("*", F.col("_metadata.file_name").alias("_gs_file"), F.col("_metadata.row_index").alias("_gs_row"))
    at = table(known.sortWithinPartitions(group, "_gs_file", "_gs_row").withColumn("_gs_at", F.monotonically_increasing_id()), "ranked")
    return _offsets_applied(at.withColumn("_gs_part", F.shiftright("_gs_at", 33)), group, out, "_gs_file", "_gs_row")


def _offsets_applied(at: DataFrame, group: str, out: str, file: str = "", row: str = "") -> DataFrame:
    named = [F.col(file).alias("_gs_name")] if file else []
    per = at.groupBy("_gs_part", F.col(group).alias("_gs_group"), *named).agg(
        F.count("*").alias("_gs_n"), F.min("_gs_at").alias("_gs_first"), F.min(row or "_gs_part").alias("_gs_begin")
    )
    # One row a partition, file and group: the window reads those, never the rows themselves.
    per = table(per.selectExpr(
        "_gs_part AS _gs_part_r",
        "_gs_group",
        *(["_gs_name"] if file else []),
        "_gs_first",
        f"coalesce(sum(_gs_n) OVER (PARTITION BY _gs_group ORDER BY {'_gs_name, _gs_begin' if file else '_gs_part'}"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _gs_before",
    ), "offsets")
    same = (F.col("_gs_part") == F.col("_gs_part_r")) & F.col(group).eqNullSafe(F.col("_gs_group"))
    if file:
        same &= F.col(file) == F.col("_gs_name")
    joined = at.join(F.broadcast(per) if per.count() <= BROADCAST_ROWS else per, same)
    return joined.withColumn(out, F.col("_gs_before") + F.col("_gs_at") - F.col("_gs_first") + 1).drop(
        "_gs_at", "_gs_part", "_gs_part_r", "_gs_group", "_gs_first", "_gs_before", "_gs_name", *([file, row] if file else [])
    )


#: Most rows of a table that join_groups() broadcasts: of a few hundred bytes each, tens of megabytes.
BROADCAST_ROWS = 50_000
#: Beyond that, the parts a group's rows are dealt over.
SALTS = 32


def join_groups(rows: DataFrame, groups: DataFrame, n: int, left: str, right: str, how: str = "inner") -> DataFrame:
    """rows joined to groups (n rows, one for each value of `right`) where left = right, how: inner or left. A hot group's
    rows never meet in one task: few groups are broadcast, else rows are dealt over SALTS copies of each group."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), F.col(left) == F.col(right), how)
    copies = groups.withColumn("_gs_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_gs_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, (F.col(left) == F.col(right)) & (F.col("_gs_salt") == F.col("_gs_copy")), how).drop("_gs_salt", "_gs_copy")


def join_hot(rows: DataFrame, side: DataFrame, left: str, right: str, how: str = "inner", least: int = 256) -> DataFrame:
    """rows joined to side (one row for each value of `right`) where left = right, how: inner or left; a null key meets a
    null key. Keys with more rows than a task's share, at least `least`, are counted first: those few are broadcast, so
    their rows stay where they are, and only the others are shuffled by key. rows is read twice: a stored table."""
    sizes = table(rows.groupBy(F.col(left).alias("_gs_hot")).agg(F.count("*").alias("_gs_n")).filter(F.col("_gs_n") >= least), "key-sizes")
    total, keys = sizes.agg(F.coalesce(F.sum("_gs_n"), F.lit(0)), F.count("*")).first()
    same = F.col(left).eqNullSafe(F.col(right))
    if not keys:
        release(sizes)
        return rows.join(side, same, how)
    # At most 4 * HOT_KEYS of these, whatever the data's size.
    hot = sizes.filter(F.col("_gs_n") >= max(least, total // HOT_KEYS)).select("_gs_hot")
    is_hot = F.col(left).eqNullSafe(F.col("_gs_hot"))
    few = side.join(F.broadcast(hot), F.col(right).eqNullSafe(F.col("_gs_hot")), "left_semi")
    warm = rows.join(F.broadcast(hot), is_hot, "left_semi").join(F.broadcast(few), same, how)
    return warm.unionByName(rows.join(F.broadcast(hot), is_hot, "left_anti").join(side, same, how))


#: Keys that join_hot() may broadcast.
HOT_KEYS = 4096
#: Bytes of an Arrow batch: what JVM and Python hold of a task's input at once.
BATCH_BYTES = 4 << 20
#: Spark's units of bytes.
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(function, schema) over batches of at most BATCH_BYTES (or one longer row).

    Spark takes the bound from the session when the plan runs, so a higher or missing setting of
    spark.sql.execution.arrow.maxBytesPerBatch is lowered and stays so: given_back() restores it once results are there."""
    spark = df.sparkSession
    held = spark.conf.get(_BYTES_KEY)
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)b?\s*", held.lower()).groups()
    if not 0 < int(number) * _UNITS[unit] <= BATCH_BYTES:
        _before.setdefault(id(spark), held)
        spark.conf.set(_BYTES_KEY, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_before: dict[int, str] = {}


def given_back(spark: SparkSession) -> None:
    """The session's setting as it was before map_batches()."""
    if held := _before.pop(id(spark), None):
        spark.conf.set(_BYTES_KEY, held)


def slot(key, modulus: int):
    """crc32 of the key as text, modulo `modulus`: the documented train and held-out split."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def with_schema(df: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in fields.items())])
