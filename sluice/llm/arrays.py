"""Words, word hashes and window hashes of whole Arrow batches, as numpy arrays.

Spark hands a task its documents in Arrow batches.  The functions here cut a batch into chunks of about
``CHUNK`` bytes (whole documents, so one longer document is a chunk of its own) and work on all documents
of a chunk at once, which keeps the Python cost per document small and memory bounded.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  These bytes never occur inside a multi-byte UTF-8
character, so this equals the pattern ``[^\\x20\\x09-\\x0D]+`` on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POSITION = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the two window hashes.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _POSITION)


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, start of each row and the end) of runs of rows with about ``limit`` bytes."""
    column = binary(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, data[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


@dataclass
class Words:
    """The words of a chunk: ``start``/``end`` byte positions, ``hash``, and ``at``: each document's first word, and the end."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    def whole(self, k: int) -> np.ndarray:
        """Of the windows of k words that begin at each word: which lie in one document."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        return doc[:n] == doc[k - 1:]


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, starts: np.ndarray, hashed: bool = True) -> Words:
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    begin = np.flatnonzero(~space & (before | edge[:n]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    at = np.searchsorted(begin, starts)
    if not hashed or not len(begin):
        return Words(begin, end, np.zeros(len(begin), dtype=np.uint64), at)
    # The sum over a word's bytes of a mixed value of byte and place; blanks add nothing.
    place = np.arange(n, dtype=np.uint64)
    place[begin[0]:] -= np.repeat(begin, np.diff(np.append(begin, n))).astype(np.uint64)
    value = _BYTE[data] + place * _POSITION
    value = (value ^ (value >> np.uint64(32))) * _M1
    value ^= value >> np.uint64(29)
    value[space] = 0
    return Words(begin, end, mix(np.add.reduceat(value, begin)), at)


def grams(hashes: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each window of k words, put together from windows of 1, 2, 4, ... words (64-bit wrap-around)."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    out, done, level, size = None, 0, hashes, 1
    while True:
        if k & size:
            if out is None:
                out, done = level, size
            else:
                n = len(hashes) - (done + size) + 1
                out = out[:n] * np.uint64(pow(base, size, 1 << 64)) + level[done:done + n]
                done += size
        if 2 * size > k:
            return out
        level = level[:len(level) - size] * np.uint64(pow(base, size, 1 << 64)) + level[size:]
        size *= 2


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours."""
    if len(x) < k:
        return x[:0]
    size, out = 1, x
    while 2 * size <= k:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    n = len(x) - k + 1
    return np.minimum(out[:n], out[k - size:k - size + n])


def signed(x: np.ndarray) -> np.ndarray:
    """64 bits as Spark's long."""
    return x.view(np.int64)


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the values of all rows and each row's first place, and the end."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, type=kind))
