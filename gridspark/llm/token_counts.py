"""Token counts of a byte-level BPE by rank-synchronous merging.

Pieces of a batch are coded once each; the pre-tokens of those not met before are laid out as one ragged numpy array of symbols, and in
each step every sequence applies its own lowest-ranked pair at all its places, left to right. Steps go on until no
sequence has a pair with a rank; the symbols that survive are its tokens. Counts of pieces met before are kept in a
table of bounded size. Texts are cut at added tokens first, as the library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .ragged import PairTable
from .words import fresh, slices, sums

#: The pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A white-space character, as the pattern's \\s or any library's near it has it.
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Pieces whose counts a worker keeps, and the longest such piece.
KEPT, LONGEST_KEPT = 500_000, 64
#: Symbols laid out at once.
AT_ONCE = 4_000_000


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies, by the public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level BPE. Symbols of bytes are 0 to 255, merged ones 256 and up, by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        spec = model["model"]
        pre = model["pre_tokenizer"]
        if spec["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or model["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        symbols = _byte_symbols()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        ids: dict[str, int] = dict(symbols)
        n, left, right, rank, made = 256, [], [], [], []
        for r, (a, b) in enumerate(pairs):
            if a + b not in ids:
                ids[a + b] = n
                n += 1
            left.append(ids[a])
            right.append(ids[b])
            rank.append(r)
            made.append(ids[a + b])
        self.pairs = PairTable(left, right, rank, made)
        self.added = [t["content"] for t in model["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(PATTERN)
        self.kept: dict[str, int] = {}

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each sequence."""
        out = np.zeros(len(sequences), np.int64)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        at = 0
        while at < len(sequences):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), AT_ONCE)) + at)
            symbols = np.frombuffer(b"".join(sequences[at:stop]), np.uint8).astype(np.int64)
            out[at:stop] = self.pairs.merge(symbols, lengths[at:stop])[1]
            at = stop
        return out

    def tokens(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Where no two white-space characters follow each other, no pre-token crosses the place
        before a space, so such texts are coded by the pieces between spaces; the others by whole texts."""
        texts = fresh(texts)
        plain = pc.invert(pc.match_substring_regex(texts, f"{WHITE}{{2}}"))
        for token in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, token)))
        plain = plain.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        slow = np.flatnonzero(~plain)
        out[slow] = [self._whole(t) for t in texts.take(pa.array(slow)).to_pylist()]
        lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        firsts = offsets[:-1] - offsets[0]
        codes = coded.indices.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        spaced = self._units([" " + p for p in coded.dictionary.to_pylist()])[codes] if len(codes) else np.zeros(0, np.int64)
        if len(firsts):
            spaced[firsts] = self._units(coded.dictionary.take(pa.array(codes[firsts])).to_pylist())
        out[plain] = sums(spaced, offsets - offsets[0])
        return out

    def _whole(self, text: str) -> int:
        parts = self.cut.split(text) if self.cut else [text]
        return int(self._units(parts).sum()) + len(parts) - 1

    def _units(self, units: list[str]) -> np.ndarray:
        """Tokens of each piece of text; those of the shorter ones are remembered."""
        kept = self.kept
        new = list({u for u in units if u not in kept})
        if new:
            if len(kept) + len(new) > KEPT:
                kept.clear()
                new = list(set(units))
            found = list(map(self.words.findall, new))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = [p for f in found for p in f]
            distinct = list(set(flat))
            by = dict(zip(distinct, self.count([p.encode() for p in distinct]).tolist(), strict=True))
            counts = np.fromiter(map(by.__getitem__, flat), np.int64, len(flat))
            fresh = dict(zip(new, sums(counts, np.concatenate([[0], np.cumsum(sizes)])).tolist(), strict=True))
            got = np.array([fresh[u] if u in fresh else kept[u] for u in units], np.int64)
            kept.update((u, n) for u, n in fresh.items() if len(u) <= LONGEST_KEPT)
            return got
        return np.fromiter(map(kept.__getitem__, units), np.int64, len(units))


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def count_tokens(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit for every row of docs.

    model: path of a byte-level BPE in the tokenizers library's JSON form, on every executor. Counts are those of the
    library without added begin or end tokens; added tokens inside texts count as one. A null text counts as empty, with
    no tokens. Ids may be null or repeat; an empty table gives an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges(model)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            counts = np.concatenate([np.zeros(0, np.int64), *(bpe.tokens(texts.slice(a, b - a)) for a, b in slices(texts, 8 << 20))])
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts, pa.int64()), pa.array(counts > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"`{id_col}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
