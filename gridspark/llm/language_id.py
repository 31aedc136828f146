"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to `order` bytes with escape method C and exclusion; its statistics are
frozen after training. A tree holds what training met and no more: counts of grams, and for each context what an escape
costs and what is left to code once its own bytes are excluded. A text's code length in each language is the exact sum over
its bytes; the language with the shortest code is predicted. Trees are fitted on a bounded number of whole labelled
documents, some dozens of which are counted together in a task; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slot, table
from .words import bytes_of, slices

UNKNOWN = "und"
#: The byte that stands for the start of a text (never part of UTF-8).
START = 0xFF
#: Bytes scored at once.
AT_ONCE = 1 << 18
#: Bytes of trees that are broadcast at once: more languages are scored in several passes over the texts.
TREE_BYTES = 128 << 20
#: Training texts of a language that one task counts together, and bytes from which a text is counted by itself.
TOGETHER, LONG = 64, 1 << 20
#: Rows of counts that leave a task at once.
ROWS = 1 << 18


@dataclass
class Level:
    """Contexts of one length. Grams and contexts are bytes as one number, sorted; costs are in bits."""

    grams: np.ndarray
    cost: np.ndarray  # of a gram's last byte, in its context
    count: np.ndarray  # -log2 of a gram's count
    contexts: np.ndarray
    escape: np.ndarray  # cost of an escape
    left: np.ndarray  # log2 of what the next shorter context has left, bytes met here excluded
    again: np.ndarray  # cost of an escape from there


@dataclass
class Trees:
    languages: list[str]
    order: int
    levels: list[list[Level]]  # of each language, by length of context
    rest: list[float]  # cost of a byte that no context has

    def nbytes(self, k: int) -> int:
        return sum(x.nbytes for level in self.levels[k] for x in vars(level).values())

    def groups(self) -> Iterator[Trees]:
        """The trees of runs of languages, each of at most TREE_BYTES (or one language)."""
        at, size = 0, 0
        for k in range(len(self.languages) + 1):
            more = self.nbytes(k) if k < len(self.languages) else TREE_BYTES
            if k > at and size + more > TREE_BYTES or k == len(self.languages):
                yield Trees(self.languages[at:k], self.order, self.levels[at:k], self.rest[at:k])
                at, size = k, 0
            size += more


def _levels(grams: np.ndarray, n: np.ndarray, order: int) -> tuple[list[Level], float]:
    """The tree of one language, from its grams of order + 1 bytes and how often they occur."""
    out: list[Level] = []
    below: tuple[np.ndarray, ...] | None = None
    for k in range(order + 1):
        g, of = np.unique(grams % 256 ** (k + 1), return_inverse=True)
        c = np.bincount(of, weights=n)
        contexts, owner = np.unique(g // 256, return_inverse=True)
        total, kinds = np.bincount(owner, weights=c), np.bincount(owner).astype(float)
        left, again = np.zeros(len(contexts)), np.zeros(len(contexts))
        if below is not None:
            # After an escape the shorter context counts only bytes that the longer one never met.
            g0, c0, contexts0, total0, kinds0 = below
            up = np.searchsorted(contexts0, contexts % 256 ** (k - 1))
            types = kinds0[up] - kinds
            all_ = total0[up] - np.bincount(owner, weights=c0[np.searchsorted(g0, g % 256**k)]) + types
            some = types > 0
            left[some], again[some] = np.log2(all_[some]), np.log2(all_[some] / types[some])
        bits = [np.log2((total + kinds)[owner] / c), -np.log2(c), np.log2((total + kinds) / kinds), left, again]
        cost, count, escape, left, again = (x.astype(np.float32) for x in bits)
        out.append(Level(g, cost, count, contexts, escape, left, again))
        below = g, c, contexts, total, kinds
    return out, float(np.log2(max(256 - len(out[0].grams), 1)))


def _codes(data: np.ndarray, offsets: np.ndarray, low: int, at: int, stop: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of order + 1 bytes that ends at each place from at to stop, and the text each lies in. data begins at low."""
    first, last = np.searchsorted(offsets, (at, stop - 1), side="right") - 1
    inside = np.minimum(offsets[first + 1 : last + 2], stop) - np.maximum(offsets[first : last + 1], at)
    owner = np.repeat(np.arange(first, last + 1), inside)
    place = np.arange(at, stop) - offsets[owner]
    code = data[at - low : stop - low].astype(np.int64)
    for k in range(1, order + 1):
        back = np.arange(at - low - k, stop - low - k)
        code += np.where(place >= k, data[np.maximum(back, 0)], START).astype(np.int64) << 8 * k
    return code, owner


def count_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of order + 1 bytes of all texts, START before each text, and how often they occur."""
    data, offsets = bytes_of(texts)
    found = [np.unique(_codes(data, offsets, 0, at, min(at + AT_ONCE, len(data)), order)[0], return_counts=True) for at in range(0, len(data), AT_ONCE)]
    return _summed([f[0] for f in found], [f[1] for f in found])


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, of = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(of, weights=np.concatenate(counts)).astype(np.int64)


def fit(texts: dict[str, list[bytes]], order: int = 3) -> Trees | None:
    """Trees of the given training texts, or None without any byte."""
    return fit_grams({k: count_grams(pa.array([p.decode() for p in v], pa.large_string()), order) for k, v in texts.items()}, order)


def fit_grams(grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Trees | None:
    """Trees of each language's grams and their counts."""
    grams = {k: v for k, v in sorted(grams.items()) if len(v[0])}
    made = [_levels(g, n, order) for g, n in grams.values()]
    return Trees(list(grams), order, [m[0] for m in made], [m[1] for m in made]) if grams else None


def _costs(levels: list[Level], rest: float, codes: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each gram in one language. A context never met costs nothing: coding begins at its longest
    suffix that was."""
    out = np.zeros(len(codes))
    todo, escaped = np.arange(len(codes)), np.zeros(len(codes), bool)
    left, again = np.zeros(len(codes)), np.zeros(len(codes))
    for k in range(len(levels) - 1, -1, -1):
        x = levels[k]
        g = codes[todo] % 256 ** (k + 1)
        i = np.minimum(np.searchsorted(x.grams, g), len(x.grams) - 1)
        hit = x.grams[i] == g
        at = todo[hit]
        out[at] += np.where(escaped[at], left[at] + x.count[i[hit]], x.cost[i[hit]])
        todo, g = todo[~hit], g[~hit]
        j = np.minimum(np.searchsorted(x.contexts, g // 256), len(x.contexts) - 1)
        met = x.contexts[j] == g // 256
        out[todo] += np.where(escaped[todo], again[todo], np.where(met, x.escape[j], 0))
        at, j = todo[met], j[met]
        escaped[at], left[at], again[at] = True, x.left[j], x.again[j]
    out[todo] += rest
    return out


def code_lengths(trees: Trees, texts: pa.Array) -> np.ndarray:
    """Bits of each text in each language."""
    data, offsets = bytes_of(texts)
    out = np.zeros((len(offsets) - 1, len(trees.languages)))
    for at in range(0, len(data), AT_ONCE):
        stop = min(at + AT_ONCE, len(data))
        low = max(0, at - trees.order)
        codes, owner = _codes(data[low:stop], offsets, low, at, stop, trees.order)
        # Grams repeat: each is worked out once.
        distinct, of = np.unique(codes, return_inverse=True)
        bits = np.stack([_costs(levels, rest, distinct) for levels, rest in zip(trees.levels, trees.rest, strict=True)], axis=-1)
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[cuts]] += np.add.reduceat(bits[of], cuts, axis=0)
    return out


def training_grams(docs: DataFrame, train, id_col: str, text_col: str, lang_col: str, max_docs: int, order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of at most max_docs whole texts of each language, chosen by a hash of text. Some dozens of texts of a
    language are counted together, so the rows that a count makes don't follow the number of partitions; a row for each
    different gram of a language comes to the driver."""
    able = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    able = able.withColumn("k", F.xxhash64("text"))
    slim = table(able.select(F.col("lang").alias("l"), F.col("k").alias("h")).distinct(), "hashes")
    # The least hashes of a language lie in a share of their range that holds many times as many as are wanted; only those
    # meet where ranks are taken. A language with fewer keeps them all. One row a language is less than the trees hold.
    share = slim.groupBy(F.col("l").alias("s_l")).agg(F.expr(f"least(1D, {8 * max_docs + 64}D / count(*))").alias("share"))
    low = slim.join(F.broadcast(share), F.col("l") == F.col("s_l")).filter("h <= (share * 2 - 1) * 9223372036854775807D")
    picked = low.selectExpr("l", "h", "row_number() OVER (PARTITION BY l ORDER BY h) AS r").filter(F.col("r") <= max_docs).select("l", "h")
    rows = able.join(F.broadcast(picked), (F.col("lang") == F.col("l")) & (F.col("k") == F.col("h"))).groupBy("lang", "k").agg(F.first("text").alias("text"))

    # Few texts to a task would send a gram once from nearly every text that has it.
    deal = F.when(F.octet_length("text") >= LONG, F.col("k")).otherwise(F.pmod("k", F.lit(max(-(-max_docs // TOGETHER), 1))))
    rows = rows.repartition("lang", deal)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
                for a, b in slices(texts):
                    new = count_grams(texts.slice(a, b - a), order)
                    found[lang] = _summed(*zip(found[lang], new, strict=True)) if lang in found else new
        for lang, (grams, n) in found.items():
            for at in range(0, len(grams), ROWS):
                g = pa.array(grams[at : at + ROWS])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(g)), g, pa.array(n[at : at + ROWS])], ["lang", "gram", "n"])

    counted = map_batches(rows.select("lang", "text"), count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    for lang in pc.unique(counted["lang"]).to_pylist():
        own = counted.filter(pc.equal(counted["lang"], lang)).sort_by("gram")
        out[lang] = own["gram"].to_numpy(), own["n"].to_numpy()
    return out


_STATE = ("low", "total", "pred")


def _scored(rows: DataFrame, trees: Trees | None) -> DataFrame:
    """rows (any columns, `text` the last) with low (bits of the shortest code, null for `und`), total (sum over languages of
    2 to the power of low - bits) and pred. Trees of a bounded size are broadcast; more of them take another pass."""
    spark, out = rows.sparkSession, rows
    groups = list(trees.groups()) if trees else [None]
    for k, group in enumerate(groups):
        shared = spark.sparkContext.broadcast(group)
        width = len(rows.columns)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(width - 1)):
                    part = batch.slice(a, b - a)
                    state = [x.to_numpy(zero_copy_only=False) for x in part.columns[width : width + 2]] + [part.column(width + 2)] if k else None
                    found = step(shared.value, part.column(width - 1), state)
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *found], [*batch.schema.names[:width], *_STATE])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        out = map_batches(out, run, f"{fields}, low double, total double, pred string")
        if k + 1 < len(groups):
            out = table(out, "scored")
    return out


def step(trees: Trees | None, texts: pa.Array, state: list | None) -> list[pa.Array]:
    """low, total and pred of each text after these languages, given those before."""
    n = len(texts)
    known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if trees is None:
        known = np.zeros(n, bool)
    low, total, pred = np.full(n, np.inf), np.zeros(n), np.full(n, UNKNOWN, object)
    if state:
        low, total, pred = np.where(known, state[0], np.inf).astype(float), np.where(known, state[1], 0).astype(float), np.array(state[2].to_pylist(), object)
    if known.any():
        bits = code_lengths(trees, texts.filter(pa.array(known)))
        mine = bits.min(1)
        best = np.minimum(mine, low[known])
        better = mine < low[known]
        names = np.array(trees.languages, object)[bits.argmin(1)]
        before = np.where(total[known] > 0, total[known] * np.exp2(-np.minimum(np.where(np.isfinite(low[known]), low[known] - best, 1000), 1000)), 0)
        total[known] = before + np.exp2(-np.minimum(bits - best[:, None], 1000)).sum(1)
        pred[known] = np.where(better, names, pred[known])
        low[known] = best
    return [pa.array(low, mask=~known), pa.array(total), pa.array(pred, pa.string())]


def identify(docs: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 3, max_docs: int = 400) -> DataFrame:
    """id, lang_pred, score, bits_per_byte for every row of docs.

    Trees learn from at most max_docs whole texts for each language, however long, among rows where `train` holds (default:
    the documented three quarters) and neither label nor text is null; equal texts count once. score: the posterior of the
    predicted language at equal priors, 0 to 1. A null text, or one without a letter, is `und` with score 0; so is every
    text if nothing was learned. Ties go to the language that sorts first. bits_per_byte is null for `und`. Ids may be null
    or repeat; an empty table gives an empty result; other columns are never read."""
    train = slot(F.col(id_col), 4) != 2 if train is None else train
    trees = fit_grams(training_grams(docs, train, id_col, text_col, lang_col, max_docs, order), order)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = F.col("low").isNotNull()
    return _scored(rows, trees).select(
        F.col("id").alias(id_col), F.col("pred").alias("lang_pred"), F.when(known, 1 / F.col("total")).otherwise(F.lit(0.0)).alias("score"),
        F.when(known, F.col("low") / F.greatest(F.octet_length("text"), F.lit(1))).alias("bits_per_byte"),
    )


def keep_identified(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", order: int = 3, max_docs: int = 400) -> DataFrame:
    """The rows of docs, columns unchanged, whose text isn't `und`; see identify(). Names that begin with _gs_ are reserved."""
    trees = fit_grams(training_grams(docs, slot(F.col(id_col), 4) != 2, id_col, text_col, lang_col, max_docs, order), order)
    shared = docs.sparkSession.sparkContext.broadcast(next(trees.groups()) if trees else None)
    at = docs.columns.index(text_col)

    # Whether any language codes a text is the same for all of them, so the trees of one run of languages tell.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [step(shared.value, batch.column(at).slice(a, b - a), None)[2] for a, b in slices(batch.column(at))]
            yield batch.filter(pc.not_equal(pa.concat_arrays(keep), UNKNOWN)) if keep else batch

    return map_batches(docs, run, docs.schema)
