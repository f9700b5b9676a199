"""Words of whole Arrow columns as 64-bit hashes, or as two of them, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Seeds and odd multipliers of two independent hashes; any others do.
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], dtype=np.uint64)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
#: Longer words, in bytes, are hashed one by one.
LONG = 512
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row starts and the last ends; null rows are empty."""
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the last."""
    x = np.zeros(len(data) + 8, dtype=np.uint64)
    x[: len(data)] = data
    for n in (1, 2, 4):
        x[:-n] |= x[n:] << np.uint64(8 * n)  # the right side is made before
    return x


def hashed(data: np.ndarray, chunks: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """64 bits for each of the words from ``begin`` to ``end``: eight bytes at a time are mixed in."""
    size = end - begin
    h = mix64(size.astype(np.uint64) * ODD[which] ^ SEEDS[which])
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    at = np.flatnonzero(size <= LONG)
    done = 0
    while len(at):
        left = size[at] - done
        h[at] = mix64(h[at] ^ (chunks[begin[at] + done] & masks[np.minimum(left, 8)])) * ODD[which]
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes(), seed=int(SEEDS[which]))
    return mix64(h)


class Hashed:
    """hashes: of all words in order; starts: index of each row's first word, and their number at the end;
    more: independent hashes of the same words, with ``wide``."""

    def __init__(self, column: pa.Array, lower: bool = True, wide: bool = False):
        data, rows = column_bytes(column)
        if lower:
            data = LOWER[data]
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = ~SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)  # a row's first byte starts a word, whatever is before it
        edge[rows] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:]
        begin = np.flatnonzero(first)
        last = np.append(~inside[1:] | edge[1:], True) & inside
        end = np.flatnonzero(last) + 1
        chunks = eights(data)
        self.hashes = hashed(data, chunks, begin, end, 0)
        self.more = hashed(data, chunks, begin, end, 1) if wide else None
        self.starts = np.searchsorted(begin, rows, side="left")

    def rolled(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of ``size`` words from each word on, across rows; the last ones are missing."""
        return roll(self.more if which else self.hashes, size, which)


def roll(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of each ``size`` words in turn: a polynomial, by doubling."""
    n, odd = len(hashes), int(ODD[which])
    out, length = None, 0
    part, reach = hashes, 1  # of reach words
    while reach <= size:
        if size & reach:
            if out is None:
                out, length = part, reach
            else:  # words of out come first
                m = n - length - reach + 1
                out = out[: max(0, m)] * np.uint64(pow(odd, reach, 1 << 64)) + part[length : length + max(0, m)]
                length += reach
        m = max(0, n - 2 * reach + 1)
        part, reach = part[:m] * np.uint64(pow(odd, reach, 1 << 64)) + part[reach : reach + m], 2 * reach
    return mix64(out[: max(0, n - size + 1)] ^ np.uint64(size * int(SEEDS[which]) % (1 << 64)))


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Parts of a batch with at most ``most`` bytes in the text column, or one row."""
    _, rows = column_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
