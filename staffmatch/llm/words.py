"""Splitting Arrow text columns into words without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as a run of such
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step works on; a single longer document is still taken whole.
PIECE_BYTES = 2 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def pieces(batches, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds about `limit` bytes at most, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(batch):
            base = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, base + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: none) and the offset of every row, one more at the end."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow array over bytes and offsets, without copying either."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)])


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows in order, and the index of each row's first word (one more at the end)."""
    data, rows = text_bytes(column)
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = rows[:-1][rows[:-1] < len(data)]
    starts[heads] = inside[heads]
    at = np.flatnonzero(starts)
    before = np.cumsum(inside, dtype=np.int64)
    total = int(before[-1]) if len(data) else 0
    words = binary_array(data[inside], np.append(before[at] - 1, total))
    return words, np.searchsorted(at, rows)


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A dense code per word and the distinct words by code."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def row_of(starts: np.ndarray) -> np.ndarray:
    """The row of every word, from the rows' first words."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
