"""The lattice of pieces of many short texts at once, solved in the max-plus semiring.

An edge is a piece that lies at a place of a unit; a step from edge to edge weighs 0 if merging the two pieces alone leaves
just them, else minus infinity. Weights are worked out once for each pair of pieces. Best weights go from left to right, a
place of all units at a time, and each unit is traced back from its end.
"""

from __future__ import annotations

import numpy as np

from .ragged import PairTable, gather

NO = np.float32(-np.inf)
#: A character without a piece of its own: this and its code point.
FOREIGN = 1 << 21
#: Weights of pairs of pieces that are remembered.
REMEMBERED = 4_000_000


class Lattice:
    def __init__(self, pieces: dict[str, int], table: PairTable):
        self.table, self.pieces = table, pieces
        self.chars = {ord(p): i for p, i in pieces.items() if len(p) == 1}
        self.known = np.array(sorted(self.chars), np.int64)
        self.known_ids = np.array([self.chars[c] for c in sorted(self.chars)], np.int64)
        # A tree of prefixes: (node, character) -> node, and the piece that ends there.
        nodes: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        for p, i in pieces.items():
            at = 0
            for ch in map(ord, p):
                if (at, ch) not in nodes:
                    nodes[at, ch] = len(piece_of)
                    piece_of.append(-1)
                at = nodes[at, ch]
            piece_of[at] = i
        keys = np.array([a << 21 | c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.next, self.piece_of = keys[order], np.array(list(nodes.values()), np.int64)[order], np.array(piece_of)
        # The characters of each piece as symbols, for merging pairs of pieces.
        texts = {i: p for p, i in pieces.items()}
        top = max(texts) + 1
        sizes = np.array([len(texts.get(i, "")) for i in range(top)])
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        self.flat = self.symbols(np.array([ord(c) for i in range(top) for c in texts.get(i, "")], np.int64))
        self.pair_keys, self.pair_stays = np.zeros(0, np.int64), np.zeros(0, bool)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, points), len(self.known) - 1)
        return np.where(self.known[at] == points, self.known_ids[at], FOREIGN + points)

    def edges(self, points: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every edge, by start. last: where the unit of each place ends."""
        n = len(points)
        start, node = np.arange(n), np.zeros(n, np.int64)
        found = [(start, start + 1, self.symbols(points))]
        size = 1
        while len(start):
            key = node << 21 | points[start + size - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            start, node = start[good], self.next[at[good]]
            piece = self.piece_of[node]
            whole = (piece >= 0) & (size > 1)
            found.append((start[whole], start[whole] + size, piece[whole]))
            size += 1
            inside = start + size <= last[start]
            start, node = start[inside], node[inside]
        a, b, piece = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(a, kind="stable")
        return a[order], b[order], piece[order]

    def stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging two pieces alone leaves just them. left -1: nothing, at the start."""
        # A foreign character merges with nothing.
        plain = (left < FOREIGN) & (right < FOREIGN)
        out = np.ones(len(left), bool)
        keys, of = np.unique((left[plain] + 1) << 21 | right[plain], return_inverse=True)
        at = np.searchsorted(self.pair_keys, keys)
        held = at < len(self.pair_keys)
        held[held] = self.pair_keys[at[held]] == keys[held]
        new = keys[~held]
        if len(new):
            a, b = (new >> 21) - 1, new & (FOREIGN - 1)
            sizes_a, sizes_b = np.where(a >= 0, self.sizes[np.maximum(a, 0)], 0), self.sizes[b]
            starts = np.stack([np.where(a >= 0, self.starts[np.maximum(a, 0)], 0), self.starts[b]], 1).ravel()
            symbols, lengths = self.table.merge(self.flat[gather(starts, np.stack([sizes_a, sizes_b], 1).ravel())], sizes_a + sizes_b)
            ends = np.cumsum(lengths)
            first, last = symbols[ends - lengths], symbols[ends - 1]
            good = np.where(a >= 0, (lengths == 2) & (first == a) & (last == b), (lengths == 1) & (last == b))
            if len(self.pair_keys) + len(new) > REMEMBERED:
                self.pair_keys, self.pair_stays = keys[held], self.pair_stays[at[held]]
            both = np.concatenate([self.pair_keys, new])
            order = np.argsort(both, kind="stable")
            self.pair_keys, self.pair_stays = both[order], np.concatenate([self.pair_stays, good])[order]
            at = np.searchsorted(self.pair_keys, keys)
        out[plain] = self.pair_stays[at][of] if len(keys) else True
        return out

    def solve(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the best path of every unit, laid end to end, and how many each has. points: all units' characters."""
        ends = np.cumsum(lengths)
        first = np.repeat(ends - lengths, lengths)
        a, b, piece = self.edges(points, np.repeat(ends, lengths))
        # Steps from the edges that end at a place to those that begin there.
        out_at = np.searchsorted(a, np.arange(len(points) + 1))
        inner = b < np.repeat(ends, lengths)[a]
        left = np.flatnonzero(inner)
        fan = out_at[b[left] + 1] - out_at[b[left]]
        right = gather(out_at[b[left]], fan)
        left = np.repeat(left, fan)
        opening = np.flatnonzero(a == first[a])
        weight = np.full(len(a), NO)
        weight[opening[self.stays(np.full(len(opening), -1), piece[opening])]] = 0
        good = self.stays(piece[left], piece[right])
        left, right = left[good], right[good]
        # By place in the unit: when a place's turn comes, the weights of the edges that end there are final.
        turn = a[right] - first[a[right]]
        order = np.argsort(turn, kind="stable")
        left, right = left[order], right[order]
        cuts = np.searchsorted(turn[order], np.arange(1, (int(turn.max()) if len(turn) else 0) + 2))
        before = np.full(len(a), -1)
        for x, y in zip(cuts, cuts[1:], strict=False):
            l, r = left[x:y], right[x:y]  # noqa: E741
            open_ = weight[l] > NO
            np.maximum.at(weight, r[open_], weight[l[open_]])
            before[r[open_]] = l[open_]
        done = np.flatnonzero(~inner & (weight > NO))
        if len(done) != len(lengths):
            raise ValueError("a unit has no path of weight 0, or several")
        trace, steps = done, []
        while len(trace):
            steps.append(trace)
            trace = before[trace]
            trace = trace[trace >= 0]
        path = np.sort(np.concatenate(steps)) if steps else done
        return piece[path], np.bincount(np.searchsorted(ends, a[path], side="right"), minlength=len(lengths))
