"""SimHash near-deduplication with bit-sliced comparison.

Equal fingerprints are folded first. Different ones are compared only if they agree in all but `radius` of `blocks` blocks
of bits, as any two within the radius must: every choice of agreeing blocks makes a key, and fingerprints meet under equal
keys. In a bucket, fingerprints lie as vertical bit planes: one comparison XORs a plane with the plane of the partners,
and carry-save counters held as bit planes add up 64 distances for each machine word; a block of partners is left as soon
as all of its distances exceed the radius. A bucket gives out a forest of its links, not all of its pairs, and large
buckets are dealt over tasks as pairs of tiles.

Near copies of a corpus (drop_near_copies) are sets of shingles of a Jaccard similarity of at least `similarity`. Sets that
similar share one of their rarest shingles, whatever the input's size, if each gives out size - ceil(similarity * size) + 1
of them in one order of all shingles; fingerprints meet under those, and links are checked on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, map_batches, release, table
from .components import components, forest
from .ragged import gather
from .words import bytes_of, slices, sums, words

BITS = 64
#: Fingerprints of a bucket that one task compares; larger buckets become pairs of tiles of this size.
TILE = 4096
#: Shingles hashed at once, and lanes of small buckets compared at once.
AT_ONCE = 1 << 17
#: Buckets of more fingerprints compare a few of them at a time with the planes of all.
SMALL, QUERIES = 64, 16


def fingerprints(texts: pa.Array, shingle: int, seed: int, words_: int = 1, kept: list | None = None) -> np.ndarray:
    """SimHash of each text over its word shingles, repeats included: a row of 64-bit words. The first word's hash is
    XXH64; those of further words mix it again. kept takes (owner, first hash) of the shingles."""
    flat, offsets = words(texts, lower=True)
    counts = np.diff(offsets)
    out = np.zeros((len(counts), words_), np.uint64)
    # The words of all texts, one space after each, and where each begins.
    begin = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    data = bytes_of(pc.binary_join_element_wise(flat, *(pa.scalar(x, flat.type) for x in ("", " "))))[0].tobytes()
    # Shingles begin at all words of a text but its last ones; a short text is one shingle.
    per = np.where(counts > shingle, counts - shingle + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), per)
    cuts = np.concatenate([[0], np.cumsum(per)])
    first = np.arange(cuts[-1]) - cuts[owner] + offsets[owner]
    last = np.minimum(first + shingle, offsets[owner + 1])
    starts, stops = begin[first], begin[last] - 1
    digest = xxhash.xxh64_intdigest
    # Bits are counted over whole texts, about AT_ONCE shingles at a time.
    at = 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + AT_ONCE, side="right")) - 1)
        low, high = cuts[at], cuts[stop]
        ones = np.zeros((words_, stop - at, BITS), np.int64)
        for x in range(low, high, AT_ONCE):
            y = min(x + AT_ONCE, high)
            h = np.array([digest(data[i:j], seed) for i, j in zip(starts[x:y].tolist(), stops[x:y].tolist(), strict=True)], np.uint64)
            own = owner[x:y] - at
            if kept is not None:
                kept.append((owner[x:y], h))
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for k in range(words_):
                if k:
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(32)
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[k][own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        for k in range(words_):
            major = ones[k] * 2 > per[at:stop, None]
            out[at:stop, k] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
        at = stop
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of bits for each value, low bits first."""
    values = np.ascontiguousarray(values)
    return np.unpackbits(values.view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def _planes(values: np.ndarray) -> np.ndarray:
    """Packed lanes for each bit: bit i of plane b is bit b of value i."""
    lanes = -(-len(values) // 64) * 64
    bits = np.zeros((lanes, values.shape[1] * BITS), np.uint8)
    bits[: len(values)] = _bits(values)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _within(diff: np.ndarray, radius: int) -> np.ndarray:
    """Packed lanes whose distance is at most the radius. diff: the XOR planes, first axis.

    Two planes at a time go through a carry-save adder into counters held as planes; a lane that passes their range stays
    out. The block is left when every lane is beyond the radius."""
    size = (radius + 1).bit_length()
    counter = [np.zeros(diff.shape[1:], np.uint64) for _ in range(size)]
    out = np.zeros(diff.shape[1:], np.uint64)
    for k in range(0, len(diff), 2):
        a, b = diff[k], diff[k + 1]
        half = a ^ b
        carry = (a & b) | (half & counter[0])
        counter[0] = half ^ counter[0]
        for i in range(1, size):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        out |= carry
        if k % 16 == 14:
            beyond = _beyond(counter, out, radius)
            if (beyond == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                break
    return ~beyond


def _beyond(counter: list[np.ndarray], out: np.ndarray, radius: int) -> np.ndarray:
    """Lanes that are out, or whose counter is over the radius: compared from the highest plane down."""
    over, even = np.zeros_like(out), ~np.zeros_like(out)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            even &= counter[i]
        else:
            over |= even & counter[i]
            even &= ~counter[i]
    return over | out


def _lanes(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(packed).view(np.uint8), axis=-1, bitorder="little")


def close_pairs(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) in the same group, within the radius, each once. group: sorted, so that groups lie together.
    values: a row of 64-bit words each."""
    values = values.reshape(len(values), -1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        found += _large(values[start : start + size], start, radius)
    # Small groups, the largest first: step s compares each lane with the lane s places on, in groups longer than s.
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    small = small[np.argsort(-sizes[small], kind="stable")]
    n, width = sizes[small], 1
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lane, left = np.repeat(starts[small], n) + place, np.repeat(n, n) - place
    for width in range(1, int(n[0]) if len(n) else 0):
        at = np.flatnonzero(left[: int(n[n > width].sum())] > width)
        for k in range(0, len(at), AT_ONCE):
            i = lane[at[k : k + AT_ONCE]]
            hits = _lanes(_within(_planes(values[i] ^ values[i + width]), radius))[: len(i)].astype(bool)
            found.append((i[hits], i[hits] + width))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _large(values: np.ndarray, start: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one large group: its planes are made once; each query flips the planes of the bits it has."""
    planes = _planes(values)
    bits = _bits(values).astype(bool)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(values), QUERIES):
        own = bits[at : at + QUERIES]
        low = (at + 1) // 64  # lanes before the first query have met it already
        flips = np.where(own.T[:, :, None], full, np.uint64(0))
        hits = _lanes(_within(planes[:, None, low:] ^ flips, radius))
        q, lane = np.nonzero(hits)
        lane = lane + low * 64
        good = (lane > at + q) & (lane < len(values))
        yield start + at + q[good], start + lane[good]


def block_keys(radius: int, blocks: int) -> list[tuple[int, int]]:
    """(word, mask) for each choice of blocks - radius agreeing blocks of the first word."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [(0, sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose keys tell about n fingerprints apart; more blocks mean longer keys and more of them."""
    for blocks in range(radius + 2, radius + 8):
        if 2 ** (BITS * (blocks - radius) // blocks) >= n:
            return blocks
    return radius + 8


def _compare(radius: int, words_: int, similarity: float = 0.0):
    """A forest of the links of a task's buckets; with similarity, of those that the sizes of sets allow, checked on the sets
    if the rows have them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        names = ("t", "bucket", "a", "b")
        rows = rows.sort_by([(c, "ascending") for c in names])
        change = np.zeros(rows.num_rows, bool)
        for c in names:
            x = rows[c].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        values = np.stack([rows[f"fp{k}"].to_numpy().view(np.uint64) for k in range(words_)], axis=1)
        node = rows["node"].to_numpy()
        i, j = close_pairs(values, np.cumsum(change), radius)
        if similarity:
            size = rows["size"].to_numpy()
            good = np.minimum(size[i], size[j]) >= _needed(np.maximum(size[i], size[j]), similarity)
            i, j = i[good], j[good]
        if "shingles" in rows.column_names:
            i, j = _similar(rows["shingles"].combine_chunks(), node, i, j, similarity)
        x, y = forest(node[i], node[j])
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def links(distinct: DataFrame, radius: int, keys: list[tuple[int, int]], words_: int, parts: int) -> DataFrame:
    """a, b: links between nodes of distinct (node, fp0, ...; fingerprints all different) that join the same components as
    all pairs which are within the radius and agree in the masked bits of a key. Tasks, at least `parts`, have about
    TASK_ROWS rows each, however many there are."""
    fps = [f"fp{k}" for k in range(words_)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    made = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"fp{w}").bitwiseAND(F.lit(signed(m))).alias("bucket")) for t, (w, m) in enumerate(keys))))
    # Sizes of buckets are counted apart, and only fingerprints in a bucket with others go on.
    bucket = distinct.select("node", *fps, made.alias("k")).select("node", *fps, "k.t", "k.bucket")
    sizes = bucket.groupBy(F.col("t").alias("s_t"), F.col("bucket").alias("s_bucket")).agg(F.count("*").alias("n")).filter("n > 1")
    met = table(bucket.join(sizes, (F.col("t") == F.col("s_t")) & (F.col("bucket") == F.col("s_bucket"))).select("node", *fps, "t", "bucket", "n"), "met")
    return _dealt(met, ["node", *fps, "t", "bucket"], _tasks(met, parts)).groupBy("task").applyInArrow(_compare(radius, words_), "a bigint, b bigint")


def _tasks(met: DataFrame, parts: int) -> int:
    """Tasks for rows of met: each row is compared once for each tile of its bucket."""
    return max(parts, (met.agg(F.sum(F.expr(f"cast(ceil(n / {TILE}) AS bigint)"))).first()[0] or 0) // TASK_ROWS)


def _dealt(met: DataFrame, names: list[str], parts: int, tile: int = TILE) -> DataFrame:
    """names, tiles a and b, and task: rows of met (node, t, bucket, n: the bucket's rows) once for each pair of tiles."""
    tiled = met.withColumn("tiles", F.expr(f"cast(ceil(n / {tile}) AS int)"))
    tiled = tiled.withColumn("own", F.expr("cast(pmod(xxhash64(node, 7), tiles) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).select(
        *names, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")
    )
    return tiled.withColumn("task", F.pmod(F.xxhash64("t", "bucket", "a", "b"), F.lit(parts)))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, words_: int = 1) -> DataFrame:
    """id, fp0, fp1, ... (the fingerprint's bits as signed 64-bit numbers) for every row of docs."""
    names = ["id", *(f"fp{k}" for k in range(words_))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints(batch.column(1).slice(a, b - a), shingle, seed, words_) for a, b in slices(batch.column(1))]
            fp = np.concatenate(parts or [np.zeros((0, words_), np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(words_))], names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, ", ".join(f"{n} bigint" for n in names))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4, seed: int = 42) -> DataFrame:
    """id, fingerprint (16 lowercase hex digits), component_id for every row of docs.

    A-Z are lower-cased; words are parted by ASCII white space; shingles count as often as they occur; a text with fewer
    words is one shingle; null or empty texts have fingerprint zero, linked like any other. Fingerprints link at up to
    `radius` differing bits; no such link is lost. component_id is the smallest id reachable over links; rows that repeat an
    id are kept, and a null id leads a component only if it has no other. Other columns are not read."""
    spark = docs.sparkSession
    prints = table(simhash(docs, id_col, text_col, shingle, seed).withColumn("node", F.col("fp0")), "fingerprints")
    distinct = table(prints.groupBy("node", "fp0").agg(F.min("id").alias("first")), "distinct")
    n = max(distinct.count(), 1)
    found = links(distinct, radius, block_keys(radius, blocks_for(n, radius)), 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = _led(prints, distinct, components(found))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), F.col("lead").alias("component_id"))


def _led(prints: DataFrame, distinct: DataFrame, joined: DataFrame) -> DataFrame:
    """prints (a stored row each, by node) with lead, the least `first` of its component, from distinct (node, first) and
    the components of nodes. A node with very many rows, and a component with very many nodes, stay where they lie."""
    # Nodes without a link are their own component; the others, usually few, learn their component's lead.
    of = table(distinct.join(joined.withColumnRenamed("node", "j_node"), F.col("node") == F.col("j_node")).select("node", "first", "component"), "linked")
    leads = of.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("lead"))
    named = join_hot(of, leads, "component", "c").select(F.col("node").alias("n_node"), "lead")
    every = distinct.join(named, F.col("node") == F.col("n_node"), "left").select(F.col("node").alias("n_node"), F.coalesce("lead", "first").alias("lead"))
    return join_hot(prints, every, "node", "n_node")


#: Near copies in a corpus: five-word shingles, 256 bits. Two texts with a Jaccard similarity s of shingles differ in about
#: 256 * acos(2s / (1 + s)) / pi bits: 39 for 0.8, give or take 6. The radius is three deviations more.
CORPUS = {"shingle": 5, "seed": 42, "words_": 4, "radius": 56, "similarity": 0.8}
#: Texts sampled for shingles that many texts have, how many of the sample make one common, and the most that are listed.
#: The list only says which shingles are given out last: no link depends on it.
SAMPLE, COMMON, LISTED = 20_000, 4, 100_000
#: Shingles that are checked at once; bucket rows of a task; texts of a component that one task checks, as TILE has them.
CELL, TASK_ROWS, CHECKED = 1 << 20, 500_000, 512


def _sets(kept: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and hash of each text's different shingles, sorted, and their number for each text."""
    owner, h = (np.concatenate([k[i] for k in kept]) if kept else np.zeros(0, t) for i, t in ((0, np.int64), (1, np.uint64)))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new], np.bincount(owner[new], minlength=n).astype(np.int64)


def _needed(size, similarity: float):
    """The least shared shingles of a set of this size with any that is similar."""
    return np.ceil(size * similarity - 1e-9).astype(np.int64)


def rarest(owner: np.ndarray, h: np.ndarray, sizes: np.ndarray, similarity: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's set, the shingles that any similar set shares one of, and their number for each text. common: sorted
    by how many texts have them; shingles that aren't listed come before, by hash."""
    order = np.argsort(common)
    at = np.minimum(np.searchsorted(common[order], h), max(len(common) - 1, 0))
    rank = np.where(common[order][at] == h, order[at] + 1, 0) if len(common) else np.zeros(len(h), np.int64)
    turn = np.lexsort((h, rank, owner))
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    most = np.where(sizes > 0, sizes - _needed(sizes, similarity) + 1, 0)
    return h[turn][place < np.repeat(most, sizes)], most


def shingled(rows: DataFrame, shingle: int, seed: int, words_: int, similarity: float = 0.0, common: np.ndarray | None = None) -> DataFrame:
    """id, th, fp0, ..., size (different shingles), node, shingles (array of hashes) for every row of rows (id, th, text): the
    whole set, sorted, or, with common, the rarest. node is a hash of fingerprint and set: texts of one node differ only by
    rare chance."""
    names = ["id", "th", *(f"fp{k}" for k in range(words_)), "size", "same", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                kept: list = []
                fp = fingerprints(batch.column(2).slice(a, b - a), shingle, seed, words_, kept).view(np.int64)
                owner, h, sizes = _sets(kept, b - a)
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                same = total[ends[1:]] - total[ends[:-1]]
                out, counts = (h, sizes) if common is None else rarest(owner, h, sizes, similarity, common)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(out.view(np.int64)))
                columns = [*(np.ascontiguousarray(fp[:, k]) for k in range(words_)), sizes, same.view(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in (0, 1)] + [*map(pa.array, columns), lists], names)

    made = map_batches(rows.select("id", "th", "text"), run, ", ".join(f"{n} bigint" for n in names[:-1]) + ", shingles array<bigint>")
    return made.withColumn("node", F.xxhash64(*names[2:-1])).drop("same")


def common_shingles(rows: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """Hashes of shingles that many sampled texts have, the commonest last."""
    step = max(4, rows.count() // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("id", "th"), F.lit(step)) == 0)
    each = shingled(sample, shingle, seed, 1).select(F.explode("shingles").alias("h")).groupBy("h").count()
    found = each.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(LISTED).collect()
    return np.array([r["h"] for r in reversed(found)], np.int64).view(np.uint64)


def _similar(lists: pa.ListArray, node: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of rows, similar ones that join the same components as all similar ones: pairs that are joined
    by others already are left out."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    different, code = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
    # Sets are sorted by hash, so these are sorted over all sets.
    keys = np.repeat(np.arange(len(sizes)), sizes) * len(different) + code
    label = np.unique(node, return_inverse=True)[1]
    found, width = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 256
    while True:
        left = label[i] != label[j]
        i, j = i[left], j[left]
        if not len(i):
            return found
        stop = min(width, max(1, int(np.searchsorted(np.cumsum(sizes[i]), CELL, side="right"))))
        a, b, i, j, width = i[:stop], j[:stop], i[stop:], j[stop:], width * 2
        n = sizes[a]
        wanted = np.repeat(b, n) * len(different) + code[gather(ends[a], n)]
        hits = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
        shared = sums(hits, np.concatenate([[0], np.cumsum(n)]))
        good = shared >= similarity * (n + sizes[b] - shared) - 1e-9
        if good.any():
            found = np.concatenate([found[0], a[good]]), np.concatenate([found[1], b[good]])
            x, y = forest(label[a[good]], label[b[good]])
            to = np.arange(len(label))
            to[x] = y
            label = to[label]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th, text: id and a hash of the text name a row, since ids may repeat or be null."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, seed: int, words_: int, similarity: float) -> DataFrame:
    """id, th, lead (no_id, id, th of the least row of its component; no_id sorts null ids last) for every row of docs."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fps = [f"fp{k}" for k in range(words_)]
    rows = _rows(docs, id_col, text_col)
    common = common_shingles(rows, shingle, seed)
    prints = table(shingled(rows, shingle, seed, words_, similarity, common), "fingerprints")
    name = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    nodes = table(prints.groupBy("node").agg(F.min(name).alias("first"), *(F.first(c).alias(c) for c in ("size", *fps))), "distinct")
    lead = nodes.select(F.col("node").alias("l_node"), F.col("first.id").alias("l_id"), F.col("first.th").alias("l_th"))
    first = (F.col("node") == F.col("l_node")) & F.col("id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th"))
    bucket = prints.join(lead, first).select("node", F.explode("shingles").alias("bucket"))
    # Rows that repeat id and text would give their shingles out again.
    if prints.groupBy("id", "th").count().filter("count > 1").limit(1).count():
        bucket = bucket.distinct()
    counts = bucket.groupBy(F.col("bucket").alias("s_bucket")).agg(F.count("*").alias("n")).filter("n > 1")
    met = table(bucket.join(counts, F.col("bucket") == F.col("s_bucket")).select(F.col("node").alias("m_node"), F.lit(0).alias("t"), "bucket", "n"), "met")
    names = ["node", *fps, "size", "t", "bucket"]
    dealt = _dealt(met.join(nodes, F.col("m_node") == F.col("node")), names, _tasks(met, parts))
    # What similar texts can be linked to, at most: all of their pairs lie within these components.
    coarse = table(components(dealt.groupBy("task").applyInArrow(_compare(radius, words_, similarity), "a bigint, b bigint")), "coarse")
    release(met)
    wanted = table(nodes.join(coarse.select(F.col("node").alias("w_node"), "component"), F.col("node") == F.col("w_node")).select("w_node", "component", F.col("first.id").alias("w_id"), F.col("first.th").alias("w_th")), "wanted")
    texts = rows.join(wanted.select("w_id", "w_th"), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")), "left_semi")
    again = shingled(texts, shingle, seed, words_).join(wanted.drop("w_id", "w_th"), F.col("node") == F.col("w_node"))
    sets = table(again.select("node", *fps, "size", "shingles", F.lit(0).alias("t"), F.col("component").alias("bucket")).dropDuplicates(["node"]), "sets")
    groups = wanted.groupBy(F.col("component").alias("g_bucket")).agg(F.count("*").alias("n"))
    known = join_hot(sets, groups, "bucket", "g_bucket")
    total = sets.agg(F.sum("size")).first()[0] or 0
    checked = _dealt(known, [*names, "shingles"], max(parts, total // CELL), CHECKED)
    joined = components(checked.groupBy("task").applyInArrow(_compare(radius, words_, similarity), "a bigint, b bigint"))
    release(coarse, wanted, sets)
    return _led(prints.select("id", "th", "node"), nodes, joined).select("id", "th", "lead")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 56, seed: int = 42, words_: int = 4, similarity: float = 0.8) -> DataFrame:
    """id, component_id for every row of docs, as near_duplicates() has them. Texts link if their sets of shingles have a
    Jaccard similarity of at least `similarity` and their fingerprints of 64 * words_ bits are within the radius."""
    found = _classes(docs, id_col, text_col, shingle, radius, seed, words_, similarity)
    return found.select(F.col("id").alias(id_col), F.col("lead.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row for each component of near copies (see near_copies), columns unchanged: the row with the smallest
    id, of rows with that id the one whose text has the smallest hash, of equal rows one. Rows are told apart by id and
    text, so of unrelated texts that repeat an id, or have none, each stays. Null ids lose against any other. A null text,
    an empty one and one without a word are alike: one of them stays. An empty table gives an empty result. Names that
    begin with _gs_ are reserved."""
    marks = table(_classes(docs, id_col, text_col, **CORPUS | options), "members")
    # Rows that go, not those that stay: usually far fewer.
    is_lead = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("th") == F.col("lead.th"))
    gone = marks.filter(~is_lead).select(F.col("id").alias("_gs_id"), F.col("th").alias("_gs_th")).distinct()
    own = F.xxhash64(F.col(text_col).cast("string"))
    out = docs.join(gone, F.col(id_col).cast("bigint").eqNullSafe(F.col("_gs_id")) & (own == F.col("_gs_th")), "left_anti")
    repeated = marks.filter(is_lead).groupBy("id", "th").count().filter("count > 1").limit(1)
    return out.dropDuplicates([id_col, text_col]) if repeated.take(1) else out
