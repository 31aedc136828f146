"""Chat formatting of reply trees.

Messages point to their parents. Iterative self-joins with doubling steps (a message's parent, then its parent's parent,
...) find for each message the sum of scores up to its root; leaves are ranked by it, and the path to each chosen leaf is
one conversation. The number of joins is the logarithm of the depth, and only messages whose root isn't reached yet are
joined again. Everything is joins, aggregates and SQL functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, join_hot, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, newline: bool = False) -> Column:
    """No control string is left in the result; unescape() gives the text back."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if newline else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rooted(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """tree, id, score (summed up to the root), depth (messages on the way, its own included) of every message that
    reaches a root, and the table of jumps of each round: tree, id, up."""
    known = messages.select("tree", "id").withColumnsRenamed({"tree": "k_tree", "id": "k_id"})
    # A parent that isn't there makes its child a root.
    first = messages.join(known, F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("parent") == F.col("k_id")), "left")
    state = table(first.select("tree", "id", F.col("k_id").alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).cast("bigint").alias("depth")), "tree-0")
    done, active, jumps = [state.filter("up IS NULL").drop("up")], state.filter("up IS NOT NULL"), []
    left, limit, k = active.count(), state.count(), 1
    while left and 2 ** (k - 1) <= limit:
        jumps.append(active.select("tree", "id", "up"))
        whole = reduce(DataFrame.unionByName, [d.withColumn("up", F.lit(None).cast("bigint")) for d in done], active)
        r = whole.select(*(F.col(c).alias(f"r_{c}") for c in ("tree", "id", "up", "score", "depth")))
        step = active.join(r, F.col("tree").eqNullSafe(F.col("r_tree")) & (F.col("up") == F.col("r_id")))
        state = table(step.select("tree", "id", F.col("r_up").alias("up"), (F.col("score") + F.col("r_score")).alias("score"), (F.col("depth") + F.col("r_depth")).alias("depth")), f"tree-{k}")
        done.append(state.filter("up IS NULL").drop("up"))
        active = state.filter("up IS NOT NULL")
        left, k = active.count(), k + 1
    return reduce(DataFrame.unionByName, done), jumps


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch (from 1), id, place (from 1 at the root) of the messages on each tree's best `branches` paths.

    messages: tree, id, parent (bigint), score. Paths rank by their mean score, ties by the smaller leaf id."""
    reached, jumps = rooted(messages)
    parents = messages.filter("parent IS NOT NULL").select(F.col("tree").alias("p_tree"), F.col("parent").alias("p_id")).distinct()
    leaves = reached.join(parents, F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("id") == F.col("p_id")), "left_anti")
    leaves = table(leaves.selectExpr("tree", "id AS leaf", "depth", "score / depth AS mean"), "leaves")
    # A tree's leaves are ranked in SALTS parts first, so a tree with very many of them never meets in one task.
    best = f"row_number() OVER (PARTITION BY tree, pmod(xxhash64(leaf), {SALTS}) ORDER BY mean DESC, leaf) AS part_rank"
    ranked = leaves.selectExpr("*", best).filter(F.col("part_rank") <= branches).selectExpr("*", "row_number() OVER (PARTITION BY tree ORDER BY mean DESC, leaf) AS branch")
    counts = leaves.groupBy(F.col("tree").alias("n_tree")).agg(F.count("*").alias("n_leaves"))
    chosen = table(ranked.filter(F.col("branch") <= branches).join(counts, F.col("tree").eqNullSafe(F.col("n_tree"))).select("tree", "leaf", "depth", "branch", "n_leaves"), "chosen")
    # A tree with one leaf and one root is its own path.
    roots = reached.filter("depth = 1").groupBy(F.col("tree").alias("r_tree")).agg(F.count("*").alias("n_roots"))
    chosen = chosen.join(roots, F.col("tree").eqNullSafe(F.col("r_tree"))).drop("r_tree")
    plain = chosen.filter("n_leaves = 1 AND n_roots = 1").select(F.col("tree").alias("c_tree"), "branch")
    whole = join_hot(reached, plain, "tree", "c_tree").select("tree", "branch", "id", F.col("depth").alias("place"))
    forked = chosen.filter("n_leaves > 1 OR n_roots > 1")
    if not forked.take(1):
        return whole
    # From each chosen leaf upwards: the largest jumps first, so each ancestor comes out once.
    path = forked.select("tree", "branch", F.col("leaf").alias("id"), F.col("depth").alias("place"))
    for k in reversed(range(len(jumps))):
        j = jumps[k].select(F.col("tree").alias("j_tree"), F.col("id").alias("j_id"), "up")
        higher = path.join(j, F.col("tree").eqNullSafe(F.col("j_tree")) & (F.col("id") == F.col("j_id"))).select("tree", "branch", F.col("up").alias("id"), (F.col("place") - 2**k).alias("place"))
        path = table(path.unionByName(higher), f"path-{k}")
    return whole.unionByName(path)


def format_chats(messages: DataFrame, branches: int = 1, learn_from: str = "assistant", ids_unique: bool = False) -> DataFrame:
    """tree, branch, formatted, n_turns, mask for each chosen path.

    messages: tree, id, parent (bigint), role, text, score. A turn is `<|im_start|>role\\ntext<|im_end|>\\n` with role and
    text escaped. mask: for each turn to learn from, its number (from 0) and the start (from 0) and length, in code points
    of that turn, of its escaped text. Null role, text and score count as '', '' and 0; a null tree
    is a tree of its own. A message whose parent is missing
    is a root; of messages that repeat an id the one with the least (parent, role, text, score) stays, nulls first; messages that reach no root (cycles) are left out. An empty table
    gives an empty result. Other columns are not read."""
    rows = messages.select(
        F.col("tree").cast("bigint"), F.col("id").cast("bigint"), F.col("parent").cast("bigint"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    if not ids_unique:
        rows = rows.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "id", "m.*")
    paths = best_paths(rows.select("tree", "id", "parent", "score"), branches)
    head = F.concat(F.lit(OPEN), escape(F.col("role"), newline=True), F.lit("\n"))
    turns = rows.select(F.col("tree").alias("t_tree"), F.col("id").alias("t_id"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learn_from).alias("learn"))
    turns = turns.select("t_tree", "t_id", F.struct(F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.when(F.col("learn"), F.struct(F.length("head").alias("start"), F.length("body").alias("length"))).alias("span")).alias("x"))
    joined = paths.join(turns, F.col("tree").eqNullSafe(F.col("t_tree")) & (F.col("id") == F.col("t_id")))
    # A conversation is one value of the result, so its turns meet in one row.
    whole = joined.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct("place", "id", "x"))).alias("turns"))
    return whole.select(
        "tree", "branch", F.concat_ws("", F.expr("transform(turns, t -> t.x.turn)")).alias("formatted"), F.size("turns").cast("bigint").alias("n_turns"),
        F.expr("filter(transform(turns, (t, i) -> named_struct('turn', i, 'start', t.x.span.start, 'length', t.x.span.length)), m -> m.start IS NOT NULL)").alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, still escaped: array of (whole, role, text)."""
    parts = F.split(formatted, r"<\|im_start\|>")
    whole = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.lit(OPEN), p))
    role = lambda w: F.regexp_extract(w, r"^<\|im_start\|>((?s)[^\n\\]*+(?:\\.[^\n\\]*+)*+)\n", 1)
    return F.transform(whole, lambda w: F.struct(
        w.alias("whole"), unescape(role(w)).alias("role"),
        unescape(F.substring(w, F.length(role(w)) + len(OPEN) + 2, F.length(w) - F.length(role(w)) - len(OPEN) - 1 - len(CLOSE))).alias("text"),
    ))
