"""Exact deduplication by content sort.

Splitters are sampled texts, each cut after the first byte that tells it from the sample before it. They range-partition the
normalised texts by their bytes, an external sort places equal texts side by side, and full comparisons of neighbours find
the runs of equal texts. Equal texts that meet in one input batch are folded before the shuffle; where a text was sampled
more than once, ids are part of its splitters, so a very large group is dealt over several ranges. A run that crosses a
range's edge is finished by comparing the edge texts, at most two for each range.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table
from .words import give_back

#: Sampled texts for each range, and bytes of sampled texts and of splitters that the driver holds at most: beyond those
#: ranges are fewer and larger, with the same result.
SAMPLES, SAMPLE_BYTES = 8, 64 << 20
_OUT_ROWS = 50_000

_FOLDED = "pid int, txt string, ids array<bigint>, digest string"
_RUNS = "doc_id bigint, text_sha256 string, run_keep bigint, run_size bigint, first boolean, pid int, edge int, edge_text string"
LAST = (1 << 63) - 1


def _ranks(ids: pa.Array, sign: int) -> np.ndarray:
    """_order() of an array, but for ties."""
    plain = pc.fill_null(ids, LAST if sign > 0 else -LAST - 1).to_numpy(zero_copy_only=False)
    return plain if sign > 0 else ~plain


def splitters(rows: DataFrame, parts: int, sign: int) -> list[tuple[bytes, int]]:
    """Bounds (bytes of text, sign * id) between at most `parts` ranges of rows (txt, id): a row lies in the range numbered by
    the bounds that are not greater than it. A bound has a text's first bytes up to where it differs from the sampled text
    before it; only between samples of one text it has the whole text, and an id."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("txt")), F.lit(0))).first()
    step = max(1, n // (SAMPLES * parts), -(-size // SAMPLE_BYTES))
    sample = rows.filter((F.pmod(F.xxhash64("txt", "id"), F.lit(step)) == 0) & (F.octet_length("txt") <= SAMPLE_BYTES // 64))
    return cut(sorted((r["txt"].encode(), _order(r["id"], sign)) for r in sample.collect()), parts)


def _order(ident: int | None, sign: int) -> int:
    """Ids in the order in which they are kept; null last."""
    return LAST if ident is None else sign * ident


def cut(found: list[tuple[bytes, int]], parts: int) -> list[tuple[bytes, int]]:
    """Bounds of at most `parts` ranges that divide the sorted samples evenly."""
    out: list[tuple[bytes, int]] = []
    held = 0
    for k in sorted({len(found) * i // parts for i in range(1, parts)} - {0}):
        (before, _), (text, at) = found[k - 1], found[k]
        if found[k] == found[k - 1]:  # no bound between rows alike: a bound with an id has a row of its text before it
            continue
        if text == before:
            bound = (text, at)
        else:
            same = next((i for i, (x, y) in enumerate(zip(before, text, strict=False)) if x != y), len(before))
            bound = (text[: same + 1], -LAST - 1)
        held += len(bound[0])
        if held > SAMPLE_BYTES:
            break
        if not out or bound > out[-1]:
            out.append(bound)
    return out


def _ranges(bounds: list[tuple[bytes, int]], texts: pa.Array, ids: pa.Array, sign: int) -> pa.Array:
    """The range of each row."""
    pairs = zip(texts, ids.to_pylist(), strict=True)
    return pa.array([bisect_right(bounds, ((t.as_buffer() or b"") and t.as_buffer().to_pybytes(), _order(i, sign))) for t, i in pairs], pa.int32())


def _fold(bounds: list[tuple[bytes, int]], sign: int):
    """One row for each distinct text of a batch (txt, id), with all its ids, the best first, and the text's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((_ranks(batch.column(1), sign), codes))
            counts = np.bincount(codes, minlength=len(coded.dictionary))
            ids = batch.column(1).take(pa.array(order))
            ends = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
            pid = _ranges(bounds, coded.dictionary, ids.take(pa.array(ends[:-1])), sign)
            columns = [pid, coded.dictionary.cast(pa.string()), lists]
            digest = [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in coded.dictionary]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digest, pa.string())], ["pid", "txt", "ids", "digest"])
        give_back()

    return run


class _Out:
    """Rows of finished runs, given out as batches of bounded size."""

    names = ("doc_id", "text_sha256", "run_keep", "run_size", "first", "pid", "edge", "edge_text")
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string())

    def __init__(self, largest: bool):
        self.best = pc.max if largest else pc.min
        self.columns: list[list] = [[] for _ in self.names]

    def add(self, pid: int, digest: str, parts: list[pa.Array], edge: int, text: str | None) -> Iterator[pa.RecordBatch]:
        """The rows of one run; the run's text goes with its first row if the run touches an edge (1: the range's first, 2: its
        last, 3: both)."""
        ids = pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
        keep, size, marked = self.best(ids).as_py(), len(ids), False
        for at in range(0, size, _OUT_ROWS):
            for i in ids.slice(at, _OUT_ROWS).to_pylist():
                first = not marked and i == keep
                marked |= first
                for column, value in zip(self.columns, (i, digest, keep, size, first, pid, edge, text), strict=True):
                    column.append(value)
                text = None
            if len(self.columns[0]) >= _OUT_ROWS:
                yield self.batch()

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, self.types, strict=True)], list(self.names))
        self.columns = [[] for _ in self.names]
        return made


def _runs(largest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(largest)
        pid, text, digest, parts, edge = -1, None, "", [], 1  # of the run that is still open
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            pids = batch.column(0).to_numpy()
            texts, lists, digests = batch.column(1), batch.column(2), batch.column(3)
            differs = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (pids[1:] != pids[:-1])
            starts = [0, *(np.flatnonzero(differs) + 1).tolist(), n]
            offsets, flat = lists.offsets.to_numpy(), lists.values
            for a, b in zip(starts, starts[1:], strict=False):
                ids = flat.slice(offsets[a], offsets[b] - offsets[a])
                new = int(pids[a])
                if parts and a == 0 and new == pid and text == texts[0].as_py():
                    parts.append(ids)
                    continue
                if parts:
                    last = new != pid
                    yield from out.add(pid, digest, parts, edge + 2 * last, text if edge or last else None)
                    edge = 0
                if new != pid:
                    pid, edge = new, 1
                digest, parts = digests[a].as_py(), [ids]
                # An edge's text is kept: of a range's first run, of its last and of one that may go on in the next batch.
                at_edge = edge or b == n or pids[b] != new
                text = texts[a].as_py() if at_edge else None
        if parts:
            yield from out.add(pid, digest, parts, edge + 2, text)
        if out.columns[0]:
            yield out.batch()

    return walk


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after `normalise` (default: no change); a null text counts as empty. The row with the
    smallest id stays (keep="max": the largest). Of rows that repeat both id and text one is marked kept. Null ids lose
    against any other; in a group of null ids one row stays and keep_id is null. An empty table gives an empty result.
    Other columns of docs are not read."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select((normalise(text) if normalise else text).alias("txt"), F.col(id_col).cast("bigint").alias("id"))
    sign, parts = (1 if keep == "min" else -1), _parts(docs)
    bounds = splitters(rows, parts, sign)
    dealt = map_batches(rows, _fold(bounds, sign), _FOLDED).repartitionById(len(bounds) + 1, "pid").sortWithinPartitions("pid", "txt")
    runs = table(map_batches(dealt, _runs(keep == "max"), _RUNS), "runs")

    best = "max" if keep == "max" else "min"
    edges = _edges(runs, best)
    # Two rows for each partition at most: the bound of the broadcast.
    joined = runs.join(F.broadcast(edges), (F.col("pid") == F.col("e_pid")) & (F.col("edge") == F.col("e_edge")), "left")
    edge = F.col("edge") > 0
    return joined.select(
        "doc_id",
        F.when(edge, F.col("e_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.when(edge, F.col("e_size")).otherwise(F.col("run_size")).alias("group_size"),
        (F.col("first") & (~edge | (F.col("pid") == F.col("e_at")))).alias("kept"),
        "text_sha256",
    )


def _parts(docs: DataFrame) -> int:
    """Ranges: as many as a shuffle has partitions."""
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _edges(runs: DataFrame, best: str) -> DataFrame:
    """For each run at an edge: id kept, size and the partition that holds the kept row, over all its parts."""
    parts = runs.filter("edge_text IS NOT NULL").selectExpr(
        "pid AS e_pid", "edge AS e_edge", "edge_text", "run_keep",
        f"{best}(run_keep) OVER (PARTITION BY edge_text) AS e_keep",
        "sum(run_size) OVER (PARTITION BY edge_text) AS e_size",
    )
    return parts.selectExpr(
        "e_pid", "e_edge", "e_keep", "e_size",
        "min(CASE WHEN run_keep <=> e_keep THEN e_pid END) OVER (PARTITION BY edge_text) AS e_at",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs without its copies, columns unchanged: of equal texts the row with the smallest id stays (keep="max": the
    largest), of rows that repeat the id one. A null text counts as empty; null ids lose against any other. An empty table
    gives an empty result. Names that begin with _gs_ are reserved. docs is read twice, and has to be the same each time.

    Rows go through the same ranges, sort and comparisons as in exact_dedup, whole and once: in an input batch only the best
    row of a text is kept, and of the sorted rows those that differ from the row before them. A range that begins within the
    rows of one text begins with copies: the sampled row before its bound has that text and lies in a range before it."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    sign, parts = (1 if keep == "min" else -1), _parts(docs)
    plain = dict(docs.dtypes)[text_col] == "string"
    text, ident = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("bigint")
    bounds = splitters(docs.select(text.alias("txt"), ident.alias("id")), parts, sign)
    # The text goes once: whether it was null is told by a flag.
    own = [c for c in docs.columns if c != text_col or not plain]
    keyed = docs.select(*(F.col(f"`{c}`") for c in own), F.col(text_col).isNull().alias("_gs_null"), text.alias("_gs_txt"), ident.alias("_gs_id"), F.lit(0).alias("_gs_pid"))
    n = len(keyed.columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(n - 3).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((_ranks(batch.column(n - 2), sign), codes))
            best = batch.take(pa.array(np.sort(order[np.concatenate([[True], np.diff(codes[order]) != 0])])))
            pid = _ranges(bounds, best.column(n - 3), best.column(n - 2), sign)
            yield pa.RecordBatch.from_arrays([*best.columns[:-1], pid], schema=best.schema)
            give_back()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, pid = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, pids = batch.column(n - 3), batch.column(n - 1).to_numpy()
            same = (pids[1:] == pids[:-1]) & pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
            new = ~np.concatenate([[pids[0] == pid and texts[0].as_py() == text], same])
            for k in np.unique(pids[new]).tolist():
                if k and bounds[k - 1][1] != -LAST - 1:
                    new &= (pids != k) | pc.not_equal(texts, bounds[k - 1][0].decode()).to_numpy(zero_copy_only=False)
            text, pid = texts[len(texts) - 1].as_py(), int(pids[-1])
            yield batch.filter(pa.array(new))
            give_back()

    dealt = map_batches(keyed, fold, keyed.schema).repartitionById(len(bounds) + 1, "_gs_pid")
    order = F.col("_gs_id").asc_nulls_last() if sign > 0 else F.col("_gs_id").desc_nulls_last()
    out = map_batches(dealt.sortWithinPartitions("_gs_pid", "_gs_txt", order), walk, keyed.schema)
    return out.select(*(F.when(~F.col("_gs_null"), F.col("_gs_txt")).alias(c) if c == text_col and plain else F.col(f"`{c}`") for c in docs.columns))
