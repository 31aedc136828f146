"""Words of Arrow text columns as flat arrays: ASCII white space parts them; nothing else does."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def fresh(texts: pa.Array) -> pa.Array:
    """The texts, null as empty, in buffers of their own. Casting a slice leaves its first offset behind, and kernels such
    as ascii_lower then read other rows' bytes, so slices are copied first."""
    texts = texts.take(pa.array(np.arange(len(texts)))) if texts.offset or _first(texts) else texts
    return pc.fill_null(texts.cast(pa.large_string()), "")


def _first(texts: pa.Array) -> int:
    """Where an array's first value begins in its data."""
    buffer = texts.buffers()[1] if len(texts) else None
    if buffer is None:
        return 0
    return int(np.frombuffer(buffer, np.int64 if pa.types.is_large_string(texts.type) else np.int32, 1)[0])


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `most` bytes in all (or one longer text): what is worked on at once has a bound."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop
    give_back()


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and where each text's words begin (one more entry than texts). A null text has none."""
    texts = fresh(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at either end of a text leaves empty strings
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's values; 0 for none."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text that each value belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and its offsets into them."""
    array = fresh(array)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]
