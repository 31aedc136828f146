"""SentencePiece encoding and decoding, with giant texts cut into chunks that are solved in parallel.

A segmentation is what the BPE model's merges give exactly if every two neighbouring pieces, merged alone, stay those two
pieces; so the right one is the only path without a forbidden step. Weights are 0 for a step that stays and minus infinity
for one that doesn't, and paths are solved in the max-plus semiring. A chunk of a giant text gives a matrix from the
pieces that may cross its left boundary to those that may cross its right one; matrices are combined by an associative
product, a scan over them (and one from the right) picks the piece at each boundary, and every chunk is then traced
back by itself, all of it through the lattice: its ends from state to state, and what lies between places that no piece
crosses by the lattice of all units at once (lattice.py), where a unit's matrix is one number. Texts under the chunk size
are one chunk: no boundary, nothing to scan; they take the merges, by units, with the same result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import map_batches, table
from .lattice import Lattice
from .ragged import PairTable, gather
from .words import fresh, slices

SPACE = "▁"
#: Units whose pieces a worker keeps, and the longest one kept.
KEPT, LONGEST_KEPT = 250_000, 48
#: A text of more characters is cut into chunks of this size.
CHUNK = 32_768
#: Bytes of text encoded at once.
AT_ONCE = 6 << 20
NO = -np.inf


class Codec:
    """A BPE model with byte fallback, an identity normaliser and a space put in front."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"{path}: only BPE models with byte fallback and an identity normaliser are read")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.longest = max(map(len, self.ids))
        inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] for x in inner):
            raise ValueError(f"{path}: a piece goes on after a space")
        alone = "\n" if not any("\n" in x for x in inner) else ""
        self.units = re.compile(f"{alone}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.text = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.table = self._pairs()
        parts = [self.text.get(i, b"") for i in range(len(model.pieces))]
        self.piece_bytes, self.piece_sizes = np.frombuffer(b"".join(parts), np.uint8), np.array(list(map(len, parts)))
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.kept: dict[str, bytes] = {}
        self.kept_paths: dict[str, bytes] = {}
        self.lattice: Lattice | None = None
        self.pairs: dict[tuple[str, str], bool] = {}

    @staticmethod
    def normalise(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merge(self, unit: str) -> list[str]:
        """Pieces of a unit by the model's merges: the best score first, then the leftmost."""
        parts, score = list(unit), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def id_of(self, piece: str) -> tuple[int, ...]:
        i = self.ids.get(piece)
        return (i,) if i is not None else tuple(self.bytes[b] for b in piece.encode())

    def _pairs(self) -> PairTable:
        """All pairs that make a piece. Symbols: ids of pieces; a character outside them is 2**21 and its code point."""
        left, right, rank, made = [], [], [], []
        ranks = {x: r for r, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = (self.ids.get(x, (1 << 21) + ord(x) if len(x) == 1 else None) for x in (piece[:cut], piece[cut:]))
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(ranks[self.score[piece]]), made.append(i)
        return PairTable(left, right, rank, made)

    def solve(self, units: list[str], paths: bool = False) -> list[bytes]:
        """Ids of each unit as int32 bytes: by merges, or (paths) by the best paths through the lattice."""
        # Different pieces with one score go by place, not by rank: that can only be in runs of spaces.
        plain = [len(u) <= LONGEST_KEPT and SPACE + SPACE not in u for u in units]
        some = [u for u, p in zip(units, plain, strict=True) if p]
        points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        if paths and len(points):
            self.lattice = self.lattice or Lattice(self.ids, self.table)
            symbols, sizes = self.lattice.solve(points, lengths)
        else:
            distinct, at = np.unique(points, return_inverse=True)
            symbols = np.array([self.ids.get(chr(c), (1 << 21) + c) for c in distinct.tolist()], np.int64)[at] if len(points) else points
            symbols, sizes = self.table.merge(symbols, lengths)
        foreign = np.flatnonzero(symbols >= 1 << 21)
        if len(foreign):  # characters without a piece become their bytes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            coded = [[self.bytes[b] for b in chr(int(c)).encode()] for c in symbols[foreign] - (1 << 21)]
            times = np.ones(len(symbols), np.int64)
            times[foreign] = list(map(len, coded))
            symbols, owner = np.repeat(symbols, times), np.repeat(owner, times)
            symbols[symbols >= 1 << 21] = np.concatenate(coded)
            sizes = np.bincount(owner, minlength=len(sizes))
        data, ends = symbols.astype(np.int32).tobytes(), (np.cumsum(sizes) * 4).tolist()
        made = iter([data[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        whole = lambda u: self.path(u) if paths or len(u) > LONGEST_KEPT else self.merge(u)
        return [next(made) if p else np.array([i for x in whole(u) for i in self.id_of(x)], np.int32).tobytes() for u, p in zip(units, plain, strict=True)]

    def encode_units(self, units: list[str], paths: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, laid end to end, and how many each has."""
        kept = self.kept_paths if paths else self.kept
        new = list({u for u in units if u not in kept})
        extra: dict[str, bytes] = {}
        if new:
            if len(kept) + len(new) > KEPT:
                kept.clear()
                new = list(set(units))
            for at in range(0, len(new), 100_000):
                extra.update(zip(new[at : at + 100_000], self.solve(new[at : at + 100_000], paths), strict=True))
            kept.update((u, b) for u, b in extra.items() if len(u) <= LONGEST_KEPT)
        found = [kept[u] if u in kept else extra[u] for u in units]
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, laid end to end, and where each text's begin. No piece goes on after a space, so a text
        without spaces side by side is coded by its parts between spaces, each with a space before it."""
        texts = fresh(texts)
        odd = pc.or_(pc.match_substring_regex(texts, f"[ {SPACE}][ {SPACE}]|^[ {SPACE}]|[ {SPACE}]$"), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        by_part = ~np.repeat(odd, np.diff(offsets))
        coded = flat.filter(pa.array(by_part)).dictionary_encode()
        ids, sizes = self.encode_units([SPACE + p for p in coded.dictionary.to_pylist()])
        codes = np.zeros(len(flat), np.int64)
        codes[by_part] = coded.indices.to_numpy(zero_copy_only=False)
        per = np.where(by_part, sizes[codes] if len(sizes) else 0, 0)
        first = (np.cumsum(sizes) - sizes)[codes] if len(sizes) else codes
        rest = {}
        for k in np.flatnonzero(odd).tolist():
            rest[k] = self.encode_units(self.units.findall(self.normalise(texts[k].as_py())))[0]
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(per, 0), offsets[:-1]) if len(texts) else [])]).astype(np.int64)
        plain = ids[gather(first, per)] if len(ids) else ids
        if not rest:
            return plain, ends
        pieces = [rest[k] if k in rest else plain[ends[k] : ends[k + 1]] for k in range(len(texts))]
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(list(map(len, pieces)))])

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of ids laid end to end."""
        sizes = self.piece_sizes[ids]
        data = self.piece_bytes[gather(self.piece_starts[ids], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
        return [data[a + (data[a : a + 1] == b" " and a < b) : b] for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # The lattice: pieces are (start, end) in a text; a step from piece to piece costs 0 or minus infinity.

    def stays(self, left: str, right: str) -> bool:
        """Merging the two pieces alone gives just them. left "" is the start of the text."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            found = self.merge(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def starting(self, text: str, at: int, stop: int) -> Iterator[int]:
        """Ends of the pieces that begin at a place; a single character is always one."""
        yield at + 1
        for end in range(at + 2, min(at + self.longest, stop) + 1):
            if text[at:end] in self.ids:
                yield end

    def reach(self, text: str, first: tuple[int, int], upto: int, stop: int) -> dict[tuple[int, int], tuple[int, int] | None]:
        """All pieces met on paths of weight 0 from `first` (a piece, or an empty one for the start), begun before upto, and
        the piece before each. At most one path reaches each piece, and one piece ends each path at a place."""
        back: dict[tuple[int, int], tuple[int, int] | None] = {first: None}
        open_: dict[int, list[tuple[int, int]]] = {first[1]: [first]}
        for at in range(first[1], upto):
            for piece in open_.pop(at, ()):
                left = text[piece[0] : piece[1]]
                for end in self.starting(text, at, stop):
                    step = (at, end)
                    if step not in back and self.stays(left, text[at:end]):
                        back[step] = piece
                        open_.setdefault(end, []).append(step)
        return back

    def path(self, unit: str) -> list[str]:
        """Pieces of one long unit, by the path that ends with it."""
        back = self.reach(unit, (0, 0), len(unit), len(unit))
        (last,) = [p for p in back if p[1] == len(unit) and p[0] < p[1]]
        return [unit[a:b] for a, b in self._trace(back, last)]

    @staticmethod
    def _trace(back: dict, last: tuple[int, int]) -> list[tuple[int, int]]:
        out = []
        while last is not None and last[0] < last[1]:
            out.append(last)
            last = back[last]
        return out[::-1]

    # A chunk: text with up to `longest` characters of what comes before and after it. States of a boundary are the pieces
    # (start, end), relative to it, that begin before it and end at it or after it.

    def states(self, before: str, after: str) -> list[tuple[int, int]]:
        whole, cut = before + after, len(before)
        if not before:
            return [(0, 0)]
        return [(a - cut, e - cut) for a in range(max(0, cut - self.longest), cut) for e in self.starting(whole, a, len(whole)) if e >= cut]

    def _edges(self, before: str, chunk: str, after: str) -> tuple[str, int, int, list, list]:
        text, low, high = before + chunk + after, len(before), len(before) + len(chunk)
        left = [(a + low, e + low) for a, e in self.states(before, (chunk + after)[: self.longest])]
        right = [(a + high, e + high) for a, e in self.states((before + chunk)[-self.longest :], after)] if after else [(a, high) for a in range(max(0, high - self.longest), high)]
        return text, low, high, left, right

    def _safe(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and last place in a chunk that no piece crosses."""
        units = [low + m.start() for m in self.units.finditer(text[low:high]) if m.start() and (text[low + m.start()] == SPACE or "\n" in text[low + m.start() - 1 : low + m.start() + 1])]
        units = [u for u in units if u > low + self.longest and u < high - self.longest]
        return (units[0], units[-1]) if units else None

    def spread(self, text: str, left: list[tuple[int, int]], upto: int, stop: int) -> dict[tuple[int, int], int]:
        """All pieces met on paths of weight 0 from the states, begun before upto, each with the set of states that reach it
        as a number's bits: one pass for all states, whose paths soon run together."""
        reached: dict[tuple[int, int], int] = {}
        open_: dict[int, list[tuple[int, int]]] = {}
        for k, state in enumerate(left):
            reached[state] = reached.get(state, 0) | 1 << k
            if state not in open_.setdefault(state[1], []):
                open_[state[1]].append(state)
        for at in range(min(open_, default=upto), upto):
            for piece in open_.pop(at, ()):
                text_left = text[piece[0] : piece[1]]
                for end in self.starting(text, at, stop):
                    if self.stays(text_left, text[at:end]):
                        if (at, end) not in reached:
                            open_.setdefault(end, []).append((at, end))
                        reached[at, end] = reached.get((at, end), 0) | reached[piece]
        return reached

    def transfer(self, before: str, chunk: str, after: str) -> np.ndarray:
        """Weights from the left boundary's states to the right one's, through this chunk."""
        text, low, high, left, right = self._edges(before, chunk, after)
        safe = self._safe(text, low, high)
        if safe is None:
            found = self.spread(text, left, high, len(text))
            return np.array([[0.0 if found.get(r, 0) >> i & 1 else NO for r in right] for i in range(len(left))]).reshape(len(left), len(right))
        # All paths pass the safe places: a column, the one weight of what lies between, and a row.
        ends: dict[int, int] = {}
        for (_, end), states in self.spread(text, left, safe[0], safe[0]).items():
            ends[end] = ends.get(end, 0) | states
        enter = np.array([[0.0 if ends.get(safe[0], 0) >> i & 1 else NO] for i in range(len(left))])
        self.encode_units(self.units.findall(text[safe[0] : safe[1]]), paths=True)  # raises without a path of weight 0
        back = self.reach(text, (safe[1], safe[1]), high, len(text))
        leave = np.array([[0.0 if r in back else NO for r in right]])
        return product(product(enter, np.zeros((1, 1))), leave)

    def trace(self, before: str, chunk: str, after: str, enter: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in this chunk, given the states at its two boundaries."""
        ids = lambda pieces: [i for a, b in pieces if a >= low for i in self.id_of(text[a:b])]
        text, low, high, left, right = self._edges(before, chunk, after)
        safe = self._safe(text, low, high)
        first, last = left[enter], right[leave]
        if safe is None:
            pieces = self._trace(self.reach(text, first, high, len(text)), last)
            return ids(pieces)
        back = self.reach(text, first, safe[0], safe[0])
        (turn,) = [p for p in back if p[1] == safe[0]]
        middle = self.encode_units(self.units.findall(text[safe[0] : safe[1]]), paths=True)[0].tolist()
        return ids(self._trace(back, turn)) + middle + ids(self._trace(self.reach(text, (safe[1], safe[1]), high, len(text)), last))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by halves: pairs are combined, scanned, and filled in between."""
    if len(matrices) == 1:
        return matrices
    pairs = [product(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
    inner = scan(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(inner[i // 2] if i % 2 else product(inner[i // 2 - 1], matrices[i]))
    return out


def boundaries(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states at each chunk's two boundaries on the best path through all chunks."""
    forward = [m.max(0) for m in scan(matrices)]
    backward = [m.T.max(1) for m in reversed(scan([m.T for m in reversed(matrices)]))]
    states = [int(np.argmax(matrices[0].max(1) if len(matrices) == 1 else backward[0]))]
    states += [int(np.argmax(forward[k] + (backward[k + 1] if k + 1 < len(matrices) else 0))) for k in range(len(matrices))]
    return list(zip(states, states[1:], strict=False))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_tokens, ids (array), decoded_sha256 and round_trip for every row of docs.

    ids are those of the sentencepiece library for this model, without begin or end. round_trip: decoding gives the text
    back (a text with the space sign U+2581 itself doesn't come back). A null text is empty: no ids. Ids may be null or
    repeat; an empty table gives an empty result; of other
    columns only `carry` are read, and come out as they are. Texts of more than `chunk` characters are
    cut and spread over tasks: see the module."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.col(id_col).cast("bigint").alias("id"), *carry).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for a, b in slices(batch.column(1), AT_ONCE):
                texts = batch.column(1).slice(a, b - a)
                ids, ends = c.encode_all(texts)
                decoded = c.decode_all(ids, ends)
                same = [d == (t.as_buffer() or b"") for d, t in zip(decoded, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends), pa.int64()), lists, pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array(same)], names)

    names = [id_col, "n_tokens", "ids", "decoded_sha256", "round_trip"]
    held = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {held}, n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean"
    small = map_batches(rows.filter(F.length("text") <= chunk).select("id", "text"), short, schema)
    whole = small.unionByName(_giants(rows.filter(F.length("text") > chunk), model, id_col, chunk, schema, held))
    return whole.select(F.col(f"`{id_col}`.id").alias(id_col), *names[1:], *(F.col(f"`{id_col}`.`{c}`").alias(c) for c in carry))


def _giants(rows: DataFrame, model: str, id_col: str, chunk: int, schema: str, held: str) -> DataFrame:
    margin = codec(model).longest
    # One row a chunk, cut where the text is read: chunks are dealt over tasks, each with a margin on both sides.
    marked = rows.withColumn("t", F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))).withColumn("k", F.explode(F.expr(f"sequence(0, cast((length(t) - 1) div {chunk} AS int))")))
    cut = marked.selectExpr(
        "row", "id", "k", f"substring(t, greatest(k * {chunk} - {margin}, 0) + 1, least(k * {chunk}, {margin})) AS before", f"substring(t, k * {chunk} + 1, {chunk}) AS chunk",
        f"substring(t, (k + 1) * {chunk} + 1, {margin}) AS after",
    )
    chunks = table(cut.repartition(F.col("row"), F.col("k")), "chunks")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            found = [c.transfer(*(x.as_py() for x in texts)) for texts in zip(*(batch.column(n) for n in ("before", "chunk", "after")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("k"), pa.array([m.shape[0] for m in found], pa.int32()), pa.array([(m == 0).ravel().tolist() for m in found], pa.list_(pa.bool_()))], ["row", "k", "height", "open"]
            )

    def solve(matrices: pa.Table) -> pa.Table:
        m = matrices.sort_by("k")
        found = boundaries([np.where(np.array(x, bool).reshape(h, -1), 0.0, NO) for x, h in zip(m["open"].to_pylist(), m["height"].to_pylist(), strict=True)])
        return pa.table({"b_row": m["row"], "b_k": m["k"], "enter": pa.array([f[0] for f in found], pa.int32()), "leave": pa.array([f[1] for f in found], pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            d = {n: batch.column(n).to_pylist() for n in ("before", "chunk", "after", "enter", "leave")}
            ids = [c.trace(*x) for x in zip(*d.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["row", "id", "k", "ids"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            decoded = [c.decode(x) for x in batch.column("ids").to_pylist()]
            same = [_digest(d) == s for d, s in zip(decoded, batch.column("sha").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pc.list_value_length(batch.column("ids")).cast(pa.int64()), batch.column("ids"), pa.array(map(_digest, decoded), pa.string()), pa.array(same, pa.bool_())],
                [id_col, "n_tokens", "ids", "decoded_sha256", "round_trip"],
            )

    # A matrix has a few bits for each chunk; a text's matrices meet in one row, as its ids do in the result.
    weights = map_batches(chunks.select("row", "k", "before", "chunk", "after"), weigh, "row bigint, k int, height int, open array<boolean>")
    solved = weights.groupBy("row").applyInArrow(solve, "b_row bigint, b_k int, enter int, leave int")
    traced = chunks.join(solved, (F.col("row") == F.col("b_row")) & (F.col("k") == F.col("b_k"))).select("row", "id", "k", "before", "chunk", "after", "enter", "leave")
    pieces = map_batches(traced, trace, f"row bigint, id {held}, k int, ids array<int>")
    whole = pieces.groupBy("row").agg(F.first("id").alias("id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x.ids)).alias("ids"))
    # Chunks laid end to end are the text: its digest tells whether decoding gave it back.
    text = chunks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "chunk"))).alias("c")).select(
        F.col("row").alias("s_row"), F.sha2(F.expr(f"translate(substring(concat_ws('', c.chunk), 2), '{SPACE}', ' ')"), 256).alias("sha")
    )
    return map_batches(whole.join(text, F.col("row") == F.col("s_row")).select("id", "ids", "sha"), check, schema)
