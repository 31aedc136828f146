"""Quality rules with robust multivariate outliers.

Each text's counts become a vector of transformed statistics. For each language and source the minimum covariance
determinant estimate gives the centre and scatter of the bulk: from medians, concentration steps re-estimate both from the
three quarters of rows that lie nearest, until centres settle (or `steps` are done), then once more from all rows within the 97.5 % ellipsoid. Rows
whose Mahalanobis distance passes a chi-square limit are rejected. Steps are aggregates over all rows; what they pass on is
one row for each language and source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_groups, map_batches, table
from .words import bytes_of, fresh, owners, slices, sums, words

SYMBOLS = "#*$%&|<>"
NEAREST = 0.75
#: Transformed statistics, and for each the least deviation that counts as one: scatter never falls below it.
FEATURES = {
    "word_length": ("word_chars / n_words", 0.35),
    "symbols": ("sqrt(n_symbols / word_chars)", 0.05),
    "capitals": ("sqrt(n_upper / word_chars)", 0.05),
    "repeats": ("sqrt(n_repeat_words / n_words)", 0.1),
    "dup_lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.1),
}
#: Chi-square quantiles for 5 degrees of freedom (fixed values): 0.75, 0.975 and 1 - 1e-6; and the shares of the
#: chi-square law with 7 degrees below the first two.
CHI_NEAREST, CHI_WEIGHT, CHI_LIMIT = 6.6257, 12.8325, 35.8882
SHARE_NEAREST, SHARE_WEIGHT = 0.5309, 0.9239
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def text_counts(texts: pa.Array, window: int = 3) -> dict[str, np.ndarray]:
    """Counts of each text; see quality()."""
    texts = fresh(texts)
    n = len(texts)
    flat, offsets = words(texts)
    out = {"n_words": np.diff(offsets), "word_chars": sums(pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64), offsets)}
    data, ends = bytes_of(texts)
    kind = np.zeros(256, np.int8)
    kind[list(SYMBOLS.encode())] = 1
    out["n_symbols"] = sums(kind[data], ends)
    kind[:] = 0
    kind[65:91] = 1
    out["n_upper"] = sums(kind[data], ends)

    lines = pc.split_pattern(texts, "\n")
    l_ends = lines.offsets.to_numpy().astype(np.int64)
    all_lines = lines.values.slice(l_ends[0], l_ends[-1] - l_ends[0])
    l_owner = owners(l_ends - l_ends[0])
    has = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(all_lines)), 0).to_numpy(zero_copy_only=False)
    code = all_lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = l_owner[has] * (len(code) + 1) + code[has]
    distinct = np.unique(key) // (len(code) + 1) if len(key) else key
    out["n_lines"] = np.bincount(l_owner[has], minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct, minlength=n)

    # A window is a number made by coding pairs again and again; windows of one text that are equal get equal numbers.
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    w_owner = owners(offsets)
    repeated = np.zeros(len(code), bool)
    if len(code) >= window:
        gram = code
        for k in range(1, window):
            _, gram = np.unique(gram[: len(code) - k] * (len(code) + 1) + code[k:], return_inverse=True)
        whole = w_owner[: len(gram)] == w_owner[window - 1 :]
        key = w_owner[: len(gram)] * (len(code) + 1) + gram
        order = np.argsort(key[whole], kind="stable")
        sorted_ = key[whole][order]
        same = sorted_[1:] == sorted_[:-1]
        twice = np.zeros(len(sorted_), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = np.flatnonzero(whole)[order[twice]]
        for k in range(window):
            repeated[at + k] = True
    out["n_repeat_words"] = sums(repeated.astype(np.int64), offsets)
    return out


def statistics(docs: DataFrame, id_col: str, text_col: str, group_cols: tuple[str, ...]) -> DataFrame:
    """id, the group columns as strings (null: '') and the counts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, b - a)
                counts = text_counts(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS)], names)

    names = ["id", *(f"g{i}" for i in range(len(group_cols))), *_COUNTS]
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"g{i}") for i, c in enumerate(group_cols)), F.col(text_col).cast("string").alias("text")
    )
    return map_batches(rows, run, ", ".join(["id bigint", *(f"g{i} string" for i in range(len(group_cols))), *(f"{c} bigint" for c in _COUNTS)]))


def _distance() -> str:
    """The squared Mahalanobis distance as SQL over x (array), centre and inverse (by rows)."""
    p = len(FEATURES)
    term = lambda i, j: f"{1 if i == j else 2} * (x[{i}] - centre[{i}]) * (x[{j}] - centre[{j}]) * inverse[{i * p + j}]"
    return " + ".join(term(i, j) for i in range(p) for j in range(i, p))


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """grp, centre, inverse, from the rows of each group: one row a group leaves the aggregate."""
    p = len(FEATURES)
    floors = [f for _, f in FEATURES.values()]
    agg = rows.groupBy("grp").agg(
        F.count("*").alias("n"), F.array(*(F.sum(F.col("x")[i]) for i in range(p))).alias("s"), F.array(*(F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(p) for j in range(p))).alias("ss")
    )

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, n, s, ss in zip(f["grp"], f["n"], f["s"], f["ss"], strict=True):
                mean = np.asarray(s, float) / n
                cov = (np.asarray(ss, float).reshape(p, p) / n - np.outer(mean, mean)) * factor
                inverse = np.linalg.inv(cov + np.diag(np.square(floors)))
                out.append((g, mean.tolist(), inverse.ravel().tolist()))
            yield pd.DataFrame(out, columns=["grp", "centre", "inverse"])

    return table(agg.mapInPandas(solve, "grp string, centre array<double>, inverse array<double>"), "moments")


def scatter(vectors: DataFrame, steps: int, groups: int = BROADCAST_ROWS + 1) -> DataFrame:
    """grp, centre, inverse of the reweighted minimum covariance determinant estimate of vectors (grp, x) of at most so many
    groups."""
    p = len(FEATURES)
    middle = vectors.groupBy("grp").agg(F.array(*(F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(p))).alias("centre"))
    flat = [0.0 if i != j else float(f"{1 / f**2:.6g}") for i in range(p) for j, (_, f) in enumerate(FEATURES.values())]
    estimate = middle.withColumn("inverse", F.array(*map(F.lit, flat)))
    for _ in range(steps):
        far = _with(vectors, estimate, groups)
        limit = far.groupBy("grp").agg(F.percentile_approx("d2", NEAREST, 1000).alias("limit")).withColumnRenamed("grp", "l_grp")
        near = join_groups(far, limit, groups, "grp", "l_grp").filter("d2 <= limit")
        before, estimate = estimate, _moments(near, NEAREST / SHARE_NEAREST)
        if settled(before, estimate):
            break
    return _moments(_with(vectors, estimate, groups).filter(F.col("d2") <= CHI_WEIGHT), 0.975 / SHARE_WEIGHT)


def settled(before: DataFrame, after: DataFrame) -> bool:
    """Whether no group's centre has moved by more than a hundredth of a floor. One number comes to the driver."""
    old = before.select(F.col("grp").alias("b_grp"), F.col("centre").alias("b_centre"))
    moved = F.greatest(*(F.abs(F.col("centre")[i] - F.col("b_centre")[i]) / f for i, (_, f) in enumerate(FEATURES.values())))
    return (after.join(old, F.col("grp") == F.col("b_grp")).agg(F.max(moved)).first()[0] or 0.0) < 0.01


def _with(vectors: DataFrame, estimate: DataFrame, groups: int) -> DataFrame:
    joined = join_groups(vectors, estimate.withColumnRenamed("grp", "e_grp"), groups, "grp", "e_grp")
    return joined.withColumn("d2", F.expr(_distance())).drop("e_grp", "centre", "inverse")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), least_rows: int = 50, steps: int = 10, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance for every row of docs.

    Words are parted by ASCII white space; a null text has none. base_failed: under least_words words, or over
    repeat_percent % of words in 3-word windows that occur again in the text. Vectors of rows that pass are judged within
    their group (null labels are a group of their own); groups with fewer than least_rows such rows share one estimate.
    kept: not base_failed and not an outlier. distance is the squared Mahalanobis distance, null if base_failed. Ids may be
    null or repeat; an empty table gives an empty result; other columns are not read."""
    counts = table(statistics(docs, id_col, text_col, group_cols), "statistics")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed).withColumn("grp", F.to_json(F.array(*(F.col(f"g{i}") for i in range(len(group_cols))))))
    x = F.array(*(F.expr(f"CASE WHEN n_words > 0 THEN {e} ELSE 0D END") for e, _ in FEATURES.values()))
    sizes = table(counts.filter("NOT base_failed").groupBy(F.col("grp").alias("s_grp")).agg(F.count("*").alias("s_n")), "sizes")
    groups = sizes.count()
    small = sizes.filter(F.col("s_n") < least_rows)
    marked = join_groups(counts.withColumn("x", x), small, groups, "grp", "s_grp", "left").withColumn("grp", F.when(F.col("s_n").isNull(), F.col("grp")).otherwise(F.lit("*")))
    vectors = table(marked.drop("s_grp", "s_n"), "vectors")
    estimate = scatter(vectors.filter("NOT base_failed").select("grp", "x"), steps, groups).withColumnRenamed("grp", "e_grp")
    judged = join_groups(vectors, estimate, groups, "grp", "e_grp", "left").withColumn("distance", F.expr(f"CASE WHEN NOT base_failed THEN {_distance()} END"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CHI_LIMIT, F.lit(True))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
