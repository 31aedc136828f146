"""Language-model scores: a Katz backoff bigram model over all training documents.

Documents form blocks of whole texts. A block asks for counts of its own words, then of its own bigrams, once each: words
and bigrams are dealt to partitions by a hash, a partition adds up the training counts that all blocks sent it, and
answers each block in the order it asked. So the count tables stay partitioned, nothing grows in one place, and a block
then scores its documents token by token: a bigram that training has is discounted (Good-Turing), any other backs off to
the word with a weight that makes each context's probabilities sum to exactly one. Bigrams lie together by their first
word; frequent first words are dealt over several partitions, and the sums of those few contexts are added up apart.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slot, table
from .words import words

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text for which the count tables get one part.
PART_BYTES = 12 << 20
_MESSAGES = "block bigint, part int, payload binary, n array<bigint>"


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers (not negative) or floats, by byte planes, compressed."""
    out, squeeze = [struct.pack("<B", len(arrays))], zstandard.ZstdCompressor(level=1)
    for a in arrays:
        real = a.dtype.kind == "f"
        raw = np.ascontiguousarray(a, np.float64 if real else np.uint64).view(np.uint8).reshape(-1, 8)
        width = 8 if real else max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        data = squeeze.compress(np.ascontiguousarray(raw[:, :width].T).tobytes())
        out += [struct.pack("<BBQQ", real, width, len(a), len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at, open_ = [], 1, zstandard.ZstdDecompressor()
    for _ in range(data[0]):
        real, width, n, size = struct.unpack_from("<BBQQ", data, at)
        at += struct.calcsize("<BBQQ")
        raw = np.zeros((n, 8), np.uint8)
        if n:
            raw[:, :width] = np.frombuffer(open_.decompress(data[at : at + size], max_output_size=n * width), np.uint8).reshape(width, n).T
        at += size
        out.append(raw.view(np.float64 if real else np.int64).ravel())
    return out


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _by_part(part: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of asking (by part, then the given keys), and each part with its bounds."""
    at = np.lexsort((*reversed(order), part))
    sorted_ = part[at]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(at) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(at))
    return at, [(int(sorted_[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different pair (a, b) first stands, sorted, and which of them each pair is. Numbers may be of any size."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "part", "payload", "n"])


def _blocks(parts: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k = TaskContext.get().partitionId() << 24, 0
        waiting, size = [], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                base = sizes[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES - size, side="right"))) if size < BLOCK_BYTES else at
                if stop > at:
                    waiting.append(batch.slice(at, stop - at))
                    size += int(sizes[stop - 1] - base)
                    at = stop
                if at < batch.num_rows or size >= BLOCK_BYTES:
                    yield from _block(first + k, waiting, parts).to_batches()
                    waiting, size, k = [], 0, k + 1
        if waiting:
            yield from _block(first + k, waiting, parts).to_batches()

    return cut


def _block(block: int, batches: list[pa.RecordBatch], parts: int) -> pa.Table:
    rows = pa.Table.from_batches(batches).combine_chunks()
    ids, texts, held = (rows.column(k).combine_chunks() for k in range(3))
    ids, texts, held = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, texts, held))
    flat, offsets = words(texts, lower=True)
    held = held.to_numpy(zero_copy_only=False).astype(bool)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    keys = np.array([*(_hash(w.encode()) for w in coded.dictionary.to_pylist()), _hash(b"\n")], np.uint64)  # the last is the end
    # Words are renumbered in the order in which they are asked for.
    order, bounds = _by_part((keys % np.uint64(parts)).astype(np.int64), keys)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sequence = np.insert(rank[codes], offsets[1:], rank[-1])
    lengths = np.diff(offsets) + 1
    train = np.repeat(~held, lengths)
    counts = np.bincount(sequence[train], minlength=len(keys))
    null = ids.is_null().to_numpy(zero_copy_only=False)
    plain = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    # Ids go as their differences from the smallest, to stay not negative.
    low = int(plain.min())
    docs = pack((plain.astype(object) - low).astype(np.uint64), null.astype(np.int64), held.astype(np.int64), lengths, sequence, rank[-1:])
    out = [(block, -1, docs, [low, int((~held).sum())])]
    out += [(block, part, pack(keys[order[a:b]], counts[a:b]), None) for part, a, b in bounds]
    return _rows(out)


def _count_words(key: tuple, rows: pa.Table) -> pa.Table:
    """Answers for one part: each word's training count and its number, frequent words first. n: tokens, distinct words."""
    blocks = rows["block"].to_pylist()
    asked = [unpack(p) for p in rows["payload"].to_pylist()]
    keys, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([a[1] for a in asked])).astype(np.int64)
    number = np.empty(len(keys), np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(len(keys))
    cuts = np.cumsum([len(a[0]) for a in asked])[:-1]
    part = key[0].as_py()
    out = [(b, part, pack(total[i], number[i]), None) for b, i in zip(blocks, np.split(inverse, cuts), strict=True)]
    return _rows([*out, (-1, part, None, [int(total.sum()), int((total > 0).sum())])])


class _Pairs:
    """A block's documents, its answered words and its distinct bigrams in the order of asking."""

    def __init__(self, docs: dict, answers: list[tuple[int, bytes]], parts: int, n_docs: int, n_tokens: int):
        ids, null, self.held, self.lengths, self.sequence, (end,) = unpack(docs["payload"])
        self.ids = [None if z else i + docs["n"][0] for i, z in zip(ids.tolist(), null.tolist(), strict=True)]
        got = [(part, *unpack(p)) for part, p in sorted(answers)]
        self.count = np.concatenate([g[1] for g in got])
        number = np.concatenate([g[2] * parts + g[0] + 1 for g in got])  # 0 is the begin
        n = len(number)
        history = np.concatenate([[n], self.sequence[:-1]])
        history[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = n
        distinct, self.inverse = np.unique(history * (n + 1) + self.sequence, return_inverse=True)
        self.h, self.w = distinct // (n + 1), distinct % (n + 1)
        self.h_number, self.w_number = np.append(number, 0)[self.h], number[self.w]
        self.h_count = np.append(self.count, n_docs)[self.h]
        # A context that holds more than its share of tokens is dealt over several partitions.
        share = max(n_tokens // (8 * parts), 1000)
        self.salts = self.h_count // share + 1
        salt = (self.w_number * 0x9E3779B1 >> 7) % self.salts
        part = (self.h_number * 0x85EBCA6B % 0xFFFFFFFB + salt) % parts
        self.order, self.bounds = _by_part(part, self.h_number, self.w_number)

    def runs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each context begins among those asked of one part, and how many bigrams it has."""
        h = self.h_number[self.order[a:b]]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return starts, np.diff(np.append(starts, len(h)))


def _ask_pairs(parts: int, n_docs: int, n_tokens: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        (d,) = docs.to_pylist()
        p = _Pairs(d, list(zip(answers["part"].to_pylist(), answers["payload"].to_pylist(), strict=True)), parts, n_docs, n_tokens)
        train = np.repeat(p.held == 0, p.lengths)
        counts = np.bincount(p.inverse[train], minlength=len(p.h))
        out = []
        for part, a, b in p.bounds:
            at = p.order[a:b]
            starts, sizes = p.runs(a, b)
            first = at[starts]
            # Numbers of contexts ascend: their differences are small.
            steps = np.diff(p.h_number[first], prepend=0)
            out.append((d["block"], part, pack(steps, sizes, (p.salts[first] > 1).astype(np.int64), p.w_number[at], counts[at], p.count[p.w[at]]), None))
        return _rows(out)

    return run


def _count_pairs(n_tokens: int, n_words: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        blocks, asked = rows["block"].to_pylist(), [unpack(p) for p in rows["payload"].to_pylist()]
        h = np.concatenate([np.repeat(np.cumsum(a[0]), a[1]) for a in asked])
        hot = np.unique(np.concatenate([np.cumsum(a[0])[a[2] > 0] for a in asked]))
        w, c, cw = (np.concatenate([a[k] for a in asked]) for k in (3, 4, 5))
        at, inverse = _distinct(h, w)
        total = np.bincount(inverse, weights=c).astype(np.int64)
        heads, of = np.unique(h[at], return_inverse=True)
        seen = total > 0
        mass = np.bincount(of[seen], weights=(cw[at][seen] + 1) / (n_tokens + n_words + 1), minlength=len(heads))
        low = [np.bincount(of[total == r], minlength=len(heads)) for r in range(1, DISCOUNTED + 1)]
        out, cuts = [], np.cumsum([int(a[1].sum()) for a in asked])[:-1]
        for block, a, own in zip(blocks, asked, np.split(inverse, cuts), strict=True):
            k = np.searchsorted(heads, np.cumsum(a[0]))
            out.append((block, part, pack(total[own], mass[k], *(x[k] for x in low)), None))
        k = np.searchsorted(heads, hot)
        out.append((-2, part, pack(hot, mass[k], *(x[k] for x in low)), None))
        out.append((-1, part, None, [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)]))
        return _rows(out)

    return run


def discounts(counts: list[int]) -> np.ndarray:
    """Good-Turing discount of counts 1 to DISCOUNTED, from how many bigrams occur 1 to DISCOUNTED + 1 times. Where the
    counts give none between 0 and 1, (r - 1/2) / r."""
    r = np.arange(1, DISCOUNTED + 1)
    n = np.asarray(counts, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        last = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - last) / (1 - last)
    return np.where(np.isfinite(d) & (d > 0) & (d < 1), d, (r - 0.5) / r)


def _score(parts: int, n_docs: int, n_tokens: int, n_words: int, discount: np.ndarray, hot: list[np.ndarray]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        (d,) = docs.to_pylist()
        got: dict[str, list] = {"w": [], "p": []}
        for kind, part, payload in zip(answers["kind"].to_pylist(), answers["part"].to_pylist(), answers["payload"].to_pylist(), strict=True):
            got[kind].append((part, payload))
        p = _Pairs(d, got["w"], parts, n_docs, n_tokens)
        n = len(p.h)
        r, mass, low = np.zeros(n, np.int64), np.zeros(n), np.zeros((DISCOUNTED, n), np.int64)
        pairs = dict(got["p"])
        for part, a, b in p.bounds:
            total, m, *l = unpack(pairs[part])  # noqa: E741
            _, sizes = p.runs(a, b)
            at = p.order[a:b]
            r[at], mass[at] = total, np.repeat(m, sizes)
            low[:, at] = [np.repeat(x, sizes) for x in l]
        spread = np.flatnonzero(p.salts > 1)
        if len(spread):
            k = np.searchsorted(hot[0], p.h_number[spread])
            mass[spread], low[:, spread] = hot[1][k], np.stack(hot[2:])[:, k]
        c = np.maximum(p.h_count, 1)
        base = (p.count + 1) / (n_tokens + n_words + 1)
        ranks = np.arange(1, DISCOUNTED + 1)
        kept = p.h_count - ((ranks * (1 - discount))[:, None] * low).sum(0)  # of the count, after the discounts
        # Where no count is small enough for a discount, one more is added to the context's.
        none = low.sum(0) == 0
        c = np.where(none, c + 1, c)
        factor = np.append(discount, 1.0)[np.clip(r, 1, DISCOUNTED + 1) - 1]
        backoff = np.where(p.h_count > 0, (1 - kept / c) / (1 - mass), 1.0)
        prob = np.where(r > 0, factor * r / c, backoff * base[p.w])
        starts = np.concatenate([[0], np.cumsum(p.lengths)[:-1]])
        per = lambda x: np.add.reduceat(x, starts)
        known = p.count[p.sequence] > 0
        return pa.table({
            "doc_id": pa.array(p.ids, pa.int64()), "held_out": pa.array(p.held.astype(bool)), "n_tokens": pa.array(p.lengths), "n_known": pa.array(per(known.astype(np.int64))),
            "train_tokens": pa.array(np.full(len(p.ids), n_tokens)), "base_score": pa.array(per(np.log10(base)[p.sequence])), "score": pa.array(per(np.log10(prob)[p.inverse])),
        })

    return run


def score_documents(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Tokens: words parted by ASCII white space with A-Z lower-cased, then one end. The model learns from every row whose
    held_out is false (default: crc32 of the id modulo 7 isn't 2). Scores are log10 probabilities of the whole text;
    base_score is that of single words, (c + 1) / (N + V + 1), to which bigrams back off. A null text is empty: one token.
    Rows may repeat, and each counts; a null id belongs to the training rows; an empty table gives an empty result; without
    training rows every word has the same probability. Other columns are not read."""
    spark = docs.sparkSession
    held = F.coalesce(slot(F.col(id_col), 7) == 2 if held_out is None else held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held"))
    # Count tables have a part for so many bytes of text, so that a part's share is the same at every size.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    blocks = table(map_batches(rows, _blocks(parts), _MESSAGES), "blocks")
    texts, asked = blocks.filter("part < 0"), blocks.filter("part >= 0")
    n_docs = texts.agg(F.sum(F.col("n")[1])).first()[0] or 0
    counted = table(asked.groupBy("part").applyInArrow(_count_words, _MESSAGES), "words")
    found = counted.filter("block = -1").agg(F.sum(F.col("n")[0]), F.sum(F.col("n")[1])).first()
    n_tokens, n_words = (x or 0 for x in found)
    word_answers = counted.filter("block >= 0")

    asks = texts.groupBy("block").cogroup(word_answers.groupBy("block")).applyInArrow(_ask_pairs(parts, n_docs, n_tokens), _MESSAGES)
    pairs = table(asks.groupBy("part").applyInArrow(_count_pairs(n_tokens, n_words), _MESSAGES), "pairs")
    of = pairs.filter("block = -1").agg(*(F.sum(F.col("n")[k]) for k in range(DISCOUNTED + 1))).first()
    # Contexts dealt over several partitions: at most 8 for each partition, with as many parts in all again.
    sums = [unpack(x.payload) for x in pairs.filter("block = -2").select("payload").collect()]
    hot: list[np.ndarray] = [np.zeros(0)] * (DISCOUNTED + 2)
    if sums:
        numbers, at = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
        hot = [numbers, *(np.bincount(at, weights=np.concatenate([s[k] for s in sums]), minlength=len(numbers)) for k in range(1, DISCOUNTED + 2))]
    answers = word_answers.select("block", "part", "payload", F.lit("w").alias("kind")).unionByName(pairs.filter("block >= 0").select("block", "part", "payload", F.lit("p").alias("kind")))
    score = _score(parts, n_docs, n_tokens, n_words, discounts([x or 0 for x in of]), hot)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema).withColumnRenamed("doc_id", id_col)
