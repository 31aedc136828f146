"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of `block_rows`. With weight w, block j (from 1) of a source is released at slot
floor((j-1)/w) and due at slot ceil(j/w); in each slot the released block with the earliest deadline runs. With weights
that sum to 1 every block meets its deadline, so after t slots a source has run t*w blocks, give or take less than one.
Weights are whole shares of a period, so the schedule repeats after that many slots. Sources of one share have the same
releases and deadlines and take turns, so the schedule is made from the distinct shares alone: at most the square root of
twice the period, whatever the number of sources. It is a fold in SQL; nothing here runs Python on executors.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, sequence_as_stored, sequence_in_groups, table

NO_SOURCE = ""
#: Slots that are scheduled between two copies of the schedule so far.
_RUN = 1000
_ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")


def target_shares(docs: DataFrame, source_col: str = "source", shares: int = 1000, temper: float = 0.7, weights: dict[str, float] | None = None) -> DataFrame:
    """source, rows, period, share (whole, at least 1, summing to `period`): from `weights` where given, else from counts to
    the power `temper`. Largest remainders round them; ties go to the source that sorts first. The period is `shares`, or
    the number of sources if those are more. A stored table with a row for each source."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source")).agg(F.count("*").alias("rows"))
    if weights:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_source string, w_given double")
        counts = counts.join(F.broadcast(given), counts.source == given.w_source).withColumn("w", F.col("w_given")).drop("w_source", "w_given")
        counts = counts.filter("w > 0")
    else:
        counts = counts.withColumn("w", F.pow("rows", F.lit(temper)))
    # Decimals add up to the same whatever their order.
    counts = table(counts.withColumn("w", F.col("w").cast("decimal(28,9)")), "sources")
    n, all_ = counts.agg(F.count("*"), F.sum("w")).first()
    period = max(int(shares), n)
    wished = counts.selectExpr("source", "rows", f"{period - n} * cast(w / {all_ or 1} AS double) AS wish").selectExpr("*", "cast(floor(wish) AS bigint) AS whole", "floor(wish) - wish AS part", "0 AS one")
    over = period - n - (wished.agg(F.sum("whole")).first()[0] or 0)
    ranked = sequence_in_groups(wished, "one", ["part", "source"], "place")
    return table(ranked.selectExpr("source", "rows", f"cast({period} AS bigint) AS period", f"cast(1 + whole + CASE WHEN place <= {over} THEN 1 ELSE 0 END AS int) AS share"), "shares")


def period_schedule(shares: DataFrame) -> DataFrame:
    """source, share, period, plan (the slots of its blocks, in order) for one period: earliest deadline first among released
    blocks; ties go to the larger share, then to the source that sorts first.

    The fold holds a counter for each distinct share. Blocks of a class of m sources run in turns: the class's c-th block
    (from 0) is block c div m of its source number c mod m."""
    turns = table(sequence_in_groups(shares, "share", ["source"], "turn"), "turns")
    classes = turns.groupBy("share").agg(F.count("*").alias("m"), F.max("period").alias("period"))
    one = classes.groupBy().agg(F.sort_array(F.collect_list(F.struct("share", "m")), asc=False).alias("s"), F.max("period").alias("period")).filter("period IS NOT NULL")
    nth = "(acc.done[k] div x.m)"
    ready = f"acc.done[k] < x.m * x.share AND ({nth} * period) div x.share <= t"
    # The earliest deadline is found once a slot; the array of one binds it to a name.
    first = f"array(array_min(filter(transform(s, (x, k) -> if({ready}, named_struct('due', (({nth} + 1) * period + x.share - 1) div x.share, 'k', k), null)), y -> y IS NOT NULL)))"
    step = f"element_at(transform({first}, p -> named_struct('done', transform(acc.done, (d, i) -> if(i = p.k, d + 1, d)), 'picks', concat(acc.picks, array(named_struct('k', p.k, 'c', acc.done[p.k]))))), 1)"
    none = "cast(array() AS array<struct<k:int,c:bigint>>)"
    inner = f"aggregate(sequence(r * {_RUN}, least((r + 1) * {_RUN}, period) - 1), named_struct('done', runs.done, 'picks', {none}), (acc, t) -> {step})"
    picked = one.selectExpr(
        f"""aggregate(sequence(0L, (period - 1) div {_RUN}),
              named_struct('done', transform(s, x -> 0L), 'picks', cast(array() AS array<array<struct<k:int,c:bigint>>>)),
              (runs, r) -> element_at(transform(array({inner}), q -> named_struct('done', q.done, 'picks', concat(runs.picks, array(q.picks)))), 1)
            ).picks AS picks""", "s",
    )
    slots = picked.selectExpr("posexplode(flatten(picks)) AS (slot, pick)", "s").selectExpr("cast(slot AS bigint) AS slot", "s[pick.k].share AS p_share", "pick.c % s[pick.k].m + 1 AS p_turn")
    plans = slots.groupBy("p_share", "p_turn").agg(F.sort_array(F.collect_list("slot")).alias("plan"))
    joined = turns.join(plans, (F.col("share") == F.col("p_share")) & (F.col("turn") == F.col("p_turn")))
    return joined.select("source", "share", "period", "plan")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 64, shares: int = 1000, temper: float = 0.7, weights: dict[str, float] | None = None, by_id: bool = True) -> DataFrame:
    """docs with mix_block (from 1, in its source), mix_release, mix_deadline, mix_slot and mix_place (from 0, in its block).

    A source's rows form blocks by ascending id, rows that repeat an id by a hash of all columns; or (by_id=False, docs read
    from files) by file name and place in the file, which needs no shuffle. Sorting by (mix_slot, mix_place) gives the
    training order. Every row comes out once: a source that ends leaves its slots empty, and the others keep their ratio to
    each other. A null source is a source of its own, named ''; null ids come first. With `weights`, sources without a
    weight are left out: that is the feature. Text isn't read, so null, empty and long ones don't matter. An empty table
    gives an empty result. A column of docs named like an added one is replaced by it; names that begin with _gs_ are
    reserved."""
    plain = [c for c in docs.columns if c not in _ADDED]
    keyed = docs.select(*(F.col(f"`{c}`") for c in plain)).withColumn("_gs_source", F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)))
    # A pass over one column counts the sources; a row for each source, with its slots in a period, comes of it.
    schedule = table(period_schedule(target_shares(docs, source_col, shares, temper, weights)), "schedule")
    if by_id:
        hashed = [c for c, kind in keyed.dtypes if "map<" not in kind and kind != "variant"]
        ranked = sequence_in_groups(keyed.withColumn("_gs_tie", F.xxhash64(*(F.col(f"`{c}`") for c in hashed))), "_gs_source", [id_col, "_gs_tie"], "_gs_rank").drop("_gs_tie")
    else:
        ranked = sequence_as_stored(keyed, "_gs_source", "_gs_rank")
    blocks = ranked.withColumn("mix_block", F.expr(f"(_gs_rank - 1) div {int(block_rows)} + 1")).withColumn("mix_place", F.expr(f"(_gs_rank - 1) % {int(block_rows)}"))
    wide = schedule.select(F.col("source").alias("_gs_of"), F.col("share").cast("bigint").alias("_gs_share"), F.col("period").alias("_gs_period"), F.col("plan").alias("_gs_plan"))
    joined = join_groups(blocks, wide, schedule.count(), "_gs_source", "_gs_of")
    return joined.selectExpr(
        *[f"`{c}`" for c in plain],
        "mix_block",
        "((mix_block - 1) * _gs_period) div _gs_share AS mix_release",
        "(mix_block * _gs_period + _gs_share - 1) div _gs_share AS mix_deadline",
        "((mix_block - 1) div _gs_share) * _gs_period + _gs_plan[cast((mix_block - 1) % _gs_share AS int)] AS mix_slot",
        "mix_place",
    )


def mixed_order(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs, same columns, in training order over files and rows: the order of mix_slot, then mix_place. Rows of a source go
    by file and place in it, so the order depends on the files alone, however Spark splits them; docs that aren't read from
    files go by id. Nulls, repeated rows and empty tables are as in mix()."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
        stored = True
    except AnalysisException:
        stored = False
    out = mix(docs, id_col, **{"by_id": not stored} | options)
    keys = ["mix_slot", "mix_place"]
    return out.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*(F.col(f"`{c}`") for c in docs.columns))


def training_position(docs: DataFrame, out: str = "position") -> DataFrame:
    """docs, read from Parquet that mixed_order() was written to, with each row's place (from 0) in the training order.

    Spark reads files in an order of its own; a file's number and a row's place in it tell the order written."""
    at = docs.select("*", F.col("_metadata.file_name").alias("_gs_file"), F.col("_metadata.row_index").alias("_gs_at"))
    # One row a file: the window reads those, never the rows themselves.
    files = docs.groupBy(F.col("_metadata.file_name").alias("_gs_name")).agg(F.count("*").alias("_gs_n"))
    files = files.selectExpr(
        "_gs_name",
        r"coalesce(sum(_gs_n) OVER (ORDER BY cast(regexp_extract(_gs_name, 'part-([0-9]+)', 1) AS bigint), _gs_name"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _gs_before",
    )
    joined = at.join(F.broadcast(files), F.col("_gs_file") == F.col("_gs_name"))
    return joined.withColumn(out, F.col("_gs_before") + F.col("_gs_at")).drop("_gs_file", "_gs_name", "_gs_at", "_gs_before")
