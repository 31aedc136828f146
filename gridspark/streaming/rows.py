"""Streams of rows: incremental aggregates over growing tables, an addition to what spreadsheets do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, size: str, late: str) -> DataFrame:
    """Counts and sums by event-time windows; rows later than `late` are dropped, as a watermark does."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    grouped = timed.withWatermark("_ts", late).groupBy(F.window("_ts", size), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def drain(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming query to the end of its input and return its result."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
