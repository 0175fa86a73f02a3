"""Numpy kernels over Arrow string columns. They see whole texts as UTF-8 bytes, chunk by chunk, and make no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd number has an inverse modulo 2**64, so a prefix sum of byte * BASE**i gives every substring's hash.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans: the bytes of the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs of anything but space and the controls 9 to 13; every byte of a longer UTF-8 sequence is over 127.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def powers(base: int, n: int) -> np.ndarray:
    held = _powers[base]
    if len(held) < n:
        grown = np.full(max(n, 1 << 20), base, np.uint64)
        grown[0] = 1
        held = _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Chunk:
    """Consecutive rows of a batch: data holds their bytes, starts and ends the byte range of each row."""

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray):
        self.row, self.n, self.data = row, len(offsets) - 1, data
        self.starts, self.ends = offsets[:-1], offsets[1:]
        self._sums: np.ndarray | None = None

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def lowered(self) -> Chunk:
        """With A to Z in lower case; other letters stay."""
        return Chunk(self.row, LOWER[self.data], np.append(self.starts, self.ends[-1:]))

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and row, of each maximal run of bytes of the class; none spans two rows."""
        return self.runs(is_word[self.data])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the bytes that are flagged."""
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        full = self.starts < self.ends
        s, e = self.starts[full], self.ends[full] - 1
        begin[s], finish[e] = inside[s], inside[e]
        first = np.flatnonzero(begin)
        return first, np.flatnonzero(finish) + 1, self.row_of(first)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and row, of each line; newline characters separate, so an empty text is one empty line."""
        at = np.flatnonzero(self.data == 10)
        row = np.concatenate([np.arange(self.n), self.row_of(at)])
        first, last = np.concatenate([self.starts, at + 1]), np.concatenate([self.ends, at])
        by_first, by_last = np.lexsort((first, row)), np.lexsort((last, row))
        return first[by_first], last[by_last], row[by_first]

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from first to last; equal bytes have equal hashes wherever they stand."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self._sums[1:])
        at = np.minimum(first, max(len(self.data) - 1, 0))
        inverse = powers(_INVERSE, max(len(self.data), 1))
        return mix((self._sums[last] - self._sums[first]) * inverse[at] + (last - first).astype(np.uint64))

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """True bytes of each row."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.ends] - sums[self.starts]


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[Chunk]:
    """The rows of a string column in chunks of about limit bytes; a longer text is a chunk of its own, null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def ngram_hashes(words: np.ndarray, row: np.ndarray, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of n consecutive words of one row, and the index of its first word; at: only of windows that start there."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if at is None:
        at = np.flatnonzero(row[:m] == row[n - 1 :])
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h *= np.uint64(BASE)
            h += words[j : j + m]
        return mix(h[at]), at
    at = at[at < m]
    at = at[row[at] == row[at + n - 1]]
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h *= np.uint64(BASE)
        h += words[at + j]
    return mix(h), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    many = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return many
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many


def repeats(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that equal an earlier one."""
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    return again


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Flags of the n positions that lie in a window of the width that starts at one of at."""
    d = np.zeros(n + 1, np.int32)
    d[at] += 1  # no value of at occurs twice
    d[at + width] -= 1
    return np.cumsum(d[:-1]) > 0
