"""Vectorised words: from an Arrow string column to word offsets and 64-bit word hashes.

A *word* is a maximal run of Unicode letters and digits of the lower-cased text.  Nothing here
builds a Python string per word: the column's own UTF-8 buffer is classified byte by byte and a
prefix sum gives every word's polynomial hash at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte classes of ASCII: letters and digits stay, the rest separates.
_KEEP = np.zeros(256, np.bool_)
for _c in range(128):
    _KEEP[_c] = chr(_c).isalnum()
_KEEP[128:] = True
#: Lead bytes under which every character is a letter (but for two signs, looked for apart), and continuation bytes.
_PLAIN = np.ones(256, np.bool_)
_PLAIN[0xC0:] = False
_PLAIN[[0xC3, 0xC4, 0xC5]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_BYTE_POWERS = Powers(_P)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's row offsets (n + 1, from 0) and bytes; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As buffers(), lower-cased, with 0 for each byte that belongs to no word."""
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    offsets, raw = buffers(column)
    odd = ~_PLAIN[raw]
    odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    if odd.any():  # signs and scripts whose bytes don't tell: let the regex engine blank what is no letter or digit
        column = pc.replace_substring_regex(column, r"[^\p{L}\p{N}]", " ")
        offsets, raw = buffers(column)
    return offsets, np.where(_KEEP[raw], raw, np.uint8(0))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each span of bytes."""
    up, down = _BYTE_POWERS(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


@dataclass
class Words:
    """first: index of each row's first word (rows + 1); start, end: byte span in data; hash: 64 bits."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(column: pa.Array) -> Words:
    offsets, raw = normalised(column)
    n = len(raw)
    inside = raw != 0
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(np.searchsorted(start, offsets), start, end, span_hashes(raw, start, end), raw)


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about size bytes with the number of the first row; a longer row is a run of its own."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string())
    offsets, _ = buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def window_hashes(w: Words, width: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of width words inside one row, and the index of its first word."""
    n = len(w.hash)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * up[:n], out=total[1:])
    counts = np.diff(w.first) - width + 1
    counts[counts < 0] = 0
    before = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(w.first[:-1] - before, counts)
    return mix((total[at + width] - total[at]) * down[at]), at


def flat(column: pa.Array, pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of each text as `pad` spaces, then its words with one space after each."""
    offsets, raw = normalised(column)
    inside = raw != 0
    rows = len(offsets) - 1
    take = inside.copy()
    take[1:] |= inside[:-1]  # the first separator after a word
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    take[heads] = inside[heads]
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(take, out=count[1:])
    kept = count[offsets[1:]] - count[offsets[:-1]]
    closed = np.zeros(rows, np.int64)  # a last word that nothing ends gets its space
    full = np.flatnonzero(offsets[:-1] < offsets[1:])
    closed[full] = inside[offsets[1:][full] - 1]
    at = np.zeros(rows + 1, np.int64)
    np.cumsum(kept + closed + pad, out=at[1:])
    out = np.full(at[-1], 32, np.uint8)
    picked = raw[take]
    picked[picked == 0] = 32
    out[np.arange(len(picked)) + np.repeat(at[:-1] + pad - count[offsets[:-1]], kept)] = picked
    return at, out
