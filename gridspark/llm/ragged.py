"""Rank-synchronous merging of ragged arrays of symbols."""

from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np

_NONE = np.int64(1) << 40
#: Longer sequences keep their places by rank, so that a step costs what it merges and not the sequence's length.
LONG = 2048


class PairTable:
    """Ranks of pairs of symbols and what they merge into, by sorted keys."""

    def __init__(self, left: list[int], right: list[int], rank: list[int], made: list[int]):
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], np.array(rank, np.int64)[order], np.array(made, np.int64)[order]
        self.index: dict[int, tuple[int, int]] = {}

    def _at(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pair that begins at each place."""
        rank, made = np.full(len(at), _NONE), np.zeros(len(at), np.int64)
        nxt = np.minimum(at + 1, len(symbols) - 1)
        good = (at + 1 < len(symbols)) & (owner[nxt] == owner[at])
        keys = symbols[at] << 32 | symbols[nxt]
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        good &= self.keys[i] == keys
        rank[good], made[good] = self.ranks[i[good]], self.made[i[good]]
        return rank, made

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of each sequence, and its length, when in each step every sequence merges its own lowest-ranked
        pair at all its places, left to right, until no pair has a rank."""
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            ends = np.cumsum(lengths)
            parts = np.split(symbols, ends[:-1])
            rest = lengths <= LONG
            got, sizes = self.merge(np.concatenate([np.zeros(0, np.int64), *(parts[k] for k in np.flatnonzero(rest))]), lengths[rest])
            short = iter(np.split(got, np.cumsum(sizes)[:-1]) if len(sizes) else [])
            done = [next(short) if r else self.merge_one(p) for p, r in zip(parts, rest.tolist(), strict=True)]
            return np.concatenate(done), np.array(list(map(len, done)), np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        rank, made = self._at(symbols, owner, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(owner)))
            over = lowest >= _NONE
            if over.any():
                keep = np.repeat(~over, sizes)
                done.append((owner[~keep], symbols[~keep]))
                symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
                lowest, sizes = lowest[~over], sizes[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # Of hits side by side (as in "aaa") every second one counts, from the left.
            run = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # Pairs that begin at a merged symbol, or at the last one kept before it, are looked up anew.
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = True
            before = at[at > 0] - 1
            before = np.where(keep[before], before, before - 1)
            fresh[before[before >= 0]] = True
            symbols, owner, rank, made, fresh = symbols[keep], owner[keep], rank[keep], made[keep], fresh[keep]
            todo = np.flatnonzero(fresh)
            rank[todo], made[todo] = self._at(symbols, owner, todo)
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        owner, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))


    def merge_one(self, symbols: np.ndarray) -> np.ndarray:
        """What is left of one long sequence: as merge(), with the places of each rank in a table by rank."""
        n = len(symbols)
        rank, made = self._at(symbols, np.zeros(n, np.int64), np.arange(n))
        if not self.index:
            self.index = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        held, ranks, makes = symbols.tolist(), rank.tolist(), made.tolist()
        after, before, none = [*range(1, n), -1], list(range(-1, n - 1)), int(_NONE)
        places: dict[int, list[int]] = defaultdict(list)
        for p in np.flatnonzero(rank < _NONE).tolist():
            places[ranks[p]].append(p)
        heap = list(places)
        heapify(heap)
        while heap:
            r = heappop(heap)
            for p in sorted(places.pop(r)):
                q = after[p]
                if ranks[p] != r or q < 0:
                    continue
                held[p], after[p], ranks[q] = makes[p], after[q], -1
                if after[q] >= 0:
                    before[after[q]] = p
                for x in (p, before[p]):
                    if x < 0:
                        continue
                    y = after[x]
                    ranks[x], makes[x] = self.index.get(held[x] << 32 | held[y], (none, 0)) if y >= 0 else (none, 0)
                    if ranks[x] < none:
                        if ranks[x] not in places:
                            heappush(heap, ranks[x])
                        places[ranks[x]].append(x)
        out, p = [], 0
        while p >= 0:
            out.append(held[p])
            p = after[p]
        return np.array(out, np.int64)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the given runs, laid end to end."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
