"""Encoding distinct chunks once: chunk boundaries in Arrow bytes, and a bounded memory of their encodings."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from staffmatch.llm.words import binary_array

#: Encodings that a task keeps from batch to batch; later ones are looked up within their batch only.
KEPT_CHUNKS = 250_000
#: Chunks given to a tokenizer at a time: its results are much larger than the ids in them.
STEP = 8192


def chunks(data: np.ndarray, rows: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The bytes cut at `cuts` (a flag per byte: a chunk starts here) and at every row; first chunk of each row."""
    starts = cuts.copy()
    starts[rows[:-1][rows[:-1] < len(data)]] = True
    at = np.flatnonzero(starts)
    return binary_array(data, np.append(at, len(data))), np.searchsorted(at, rows)


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and the number per list."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum())), sizes


class ChunkEncoder:
    """Encodes distinct chunks with `encode` and keeps the first ones.

    `encode` takes the bytes of many chunks and gives their id lists, or all ids in one array and the number per chunk.
    Kept ids lie in one growing array, so that nothing but a dictionary entry is made per chunk.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]] | tuple[np.ndarray, np.ndarray]], kept: int = KEPT_CHUNKS) -> None:
        self.encode, self.kept = encode, kept
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and the place and number of each distinct chunk's ids in it."""
        keys = distinct.to_pylist()
        at = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.ids, self.starts[at], self.sizes[at]
        names = [keys[i] for i in missing.tolist()]
        flats, sizes = [], []
        for low in range(0, len(names), STEP):
            found = self.encode(names[low:low + STEP])
            flat, size = found if isinstance(found, tuple) else flat_lists(found)
            flats.append(flat)
            sizes.append(size)
        fresh, size = np.concatenate(flats), np.concatenate(sizes)
        start = np.cumsum(size) - size
        starts, counts = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        old = np.flatnonzero(at >= 0)
        starts[old], counts[old] = self.starts[at[old]], self.sizes[at[old]]
        starts[missing], counts[missing] = len(self.ids) + start, size
        ids = np.concatenate([self.ids, fresh])
        room = min(max(0, self.kept - len(self.known)), len(names))
        if room:
            first = len(self.known)
            self.known.update(zip(names[:room], range(first, first + room)))
            self.ids = ids[:len(self.ids) + int(size[:room].sum())]
            self.starts = np.concatenate([self.starts, starts[missing[:room]]])
            self.sizes = np.concatenate([self.sizes, size[:room]])
        return ids, starts, counts


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all chunks in order and the first id of every row, from the chunks' codes and rows' first chunks."""
    sizes = counts[codes]
    ends = np.append(0, np.cumsum(sizes))
    take = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], sizes)
    return flat[take], ends[first]
