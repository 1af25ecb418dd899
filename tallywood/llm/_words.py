"""Words of UTF-8 texts as numpy arrays: boundaries and 64-bit hashes, whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of letters and digits: every byte but ASCII punctuation, space and controls.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False
#: The first bytes of eight, by how many.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; one table serves all shorter texts."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(1 << (n - 1).bit_length(), U(factor))
        table[0] = U(1)
        made.append(np.cumprod(table, out=table))
    if n <= 1 << 20:  # what only a very long text asks for isn't kept
        _powers = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offset of every row; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), off


def spans(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


@dataclass
class Words:
    """``data`` of a few texts; word ``i`` is ``data[starts[i]:ends[i]]``, row ``r`` has words ``first[r]`` to ``first[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words with A-Z lower-cased: eight bytes at a time, each step a bijection of what was before."""
        padded = np.concatenate([_LOWER[self.data], np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        size = self.ends - self.starts
        out = mix(size.astype(U) + U(_BASE))
        left, at = np.arange(len(size)), self.starts
        while len(left):
            block = eight[at] & _MASKS[np.minimum(self.ends[left] - at, 8)]
            out[left] = mix(out[left] * U(_BASE) + mix(block))
            at = at + 8
            on = at < self.ends[left]
            left, at = left[on], at[on]
        return out

    def text(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` lower-cased, one space between them."""
        d = self.data
        return b" ".join(d[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True)).lower()


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """The maximal runs of bytes of ``kind`` in each row; no word crosses rows."""
    x, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    is_word = kind[x]
    begin, end = is_word.copy(), is_word.copy()
    if len(x):
        begin[1:] &= ~is_word[:-1]
        end[:-1] &= ~is_word[1:]
        edge = at[:-1][at[:-1] < len(x)]
        begin[edge] = is_word[edge]
        edge = at[1:][at[1:] > 0] - 1
        end[edge] = is_word[edge]
    starts = np.flatnonzero(begin)
    return Words(x, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at))


def shingles_at(hashes: np.ndarray, begin: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles of the rows of ``n`` words from ``begin``, and the bounds of rows.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(begin - bounds[:-1], count) + np.arange(bounds[-1])
    size = np.repeat(np.minimum(n, width), count)
    out = size.astype(U)
    for k in range(width):
        has = size > k
        if has.all():
            out = mix(out * U(0xD6E8FEB86659FD93) + hashes[at + k])
        else:
            out[has] = mix(out[has] * U(0xD6E8FEB86659FD93) + hashes[at[has] + k])
    return out, bounds


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of rows that follow one another; see :func:`shingles_at`."""
    return shingles_at(hashes, first[:-1], np.diff(first), width)
