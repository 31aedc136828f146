import pytest
from pyspark.sql import functions as F

from gridspark.llm import common


@pytest.mark.parametrize("n", [2, common.BROADCAST_ROWS + 1])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_groups_matches_each_row_once(spark, n, how):
    rows = spark.range(200).withColumn("g", F.when(F.col("id") < 150, "hot").when(F.col("id") < 190, "cold").when(F.col("id") < 195, "none"))
    groups = spark.createDataFrame([("hot", 1), ("cold", 2)], "h string, v int")
    got = {r["id"]: r["v"] for r in common.join_groups(rows, groups, n, "g", "h", how).collect()}
    want = {i: 1 if i < 150 else 2 if i < 190 else None for i in range(200)}
    assert got == (want if how == "left" else {k: v for k, v in want.items() if v})


def test_map_batches_lowers_the_sessions_bytes_and_keeps_rows(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(64 << 20))
    out = common.map_batches(spark.range(1000), lambda batches: batches, "id bigint")
    assert int(spark.conf.get(key).rstrip("b")) == common.BATCH_BYTES
    assert sorted(r["id"] for r in out.collect()) == list(range(1000))


@pytest.mark.parametrize("held", ["64m", "1g", "67108864", "8192k"])
def test_map_batches_reads_units_and_gives_the_setting_back(spark, held):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    common.given_back(spark)
    spark.conf.set(key, held)
    out = common.map_batches(spark.range(10), lambda batches: batches, "id bigint")
    assert spark.conf.get(key) == str(common.BATCH_BYTES) and out.count() == 10
    common.given_back(spark)
    assert spark.conf.get(key) == held
    spark.conf.set(key, "1m")
    common.map_batches(spark.range(10), lambda batches: batches, "id bigint")
    assert spark.conf.get(key) == "1m"
    spark.conf.set(key, before)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot_matches_each_row_once(spark, how):
    rows = common.table(spark.range(4000).withColumn("g", F.when(F.col("id") < 2500, "hot").when(F.col("id") < 3000, None).otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string")))), "rows")
    side = spark.createDataFrame([("hot", 1), (None, 2), ("c7", 3), ("other", 4)], "h string, v int")
    got = {r["id"]: r["v"] for r in common.join_hot(rows, side, "g", "h", how).collect()}
    want = {i: 1 if i < 2500 else 2 if i < 3000 else 3 if i % 50 == 7 else None for i in range(4000)}
    assert got == (want if how == "left" else {k: v for k, v in want.items() if v})


def test_released_tables_are_gone(spark):
    t = common.table(spark.range(5), "short")
    common.release(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._gs_path).count()
