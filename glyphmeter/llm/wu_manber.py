"""Wu-Manber multi-pattern search over bytes, many cursors in lockstep.

Only the first m bytes of a pattern, m being the length of the shortest, decide the skipping.  SHIFT holds,
for each hashed block of bytes, how far a window can move before that block could end a pattern's first m
bytes; a window of shift 0 has its block's bucket of patterns compared byte by byte.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a block, at most: long enough that few blocks of ordinary text are in any pattern.  Patterns of under
#: twice as many bytes have blocks of half their length, of two bytes at least.
BLOCK = 8
#: Bytes of a pattern that decide the skipping, at most.
HEAD = 1 << 12
SEGMENT = 1 << 10


def _words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian numbers of eight, with zeros behind."""
    padded = np.zeros(-(-len(data) // 8) * 8 + 16, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


class Searcher:
    def __init__(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """The patterns are raw[start : start + length]: distinct, none shorter than two bytes."""
        self.start, self.length, self.raw = start, length, raw.tobytes()
        self.m = min(HEAD, int(length.min())) if len(start) else 0
        self.block = max(2, min(BLOCK, self.m // 2))
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        blocks = self.m - self.block + 1
        if not len(start):
            return
        # where a block of raw is in several patterns, it is deepest in the one that starts first
        starts, words = np.sort(start), _words(raw)
        self.bits = max(10, min(24, len(raw).bit_length() + 2))
        self.shift = np.full(1 << self.bits, blocks, np.uint16)
        for low in range(0, len(raw), 1 << 20):
            q = np.arange(low, min(len(raw), low + (1 << 20)))
            k = np.minimum(np.searchsorted(starts, q - (blocks - 1)), len(starts) - 1)
            inside = (starts[k] <= q) & (starts[k] >= q - (blocks - 1))
            q, shift = q[inside], (blocks - 1 - (q - starts[k]))[inside]
            slot = self._hash(self._blocks(words, q))
            order = np.argsort(-shift, kind="stable")  # of equal slots the least is written last
            slot, shift = slot[order], shift[order].astype(np.uint16)
            before = self.shift[slot]
            self.shift[slot] = shift
            self.shift[slot] = np.minimum(self.shift[slot], before)
        end = self._blocks(words, start + self.m - self.block)
        self.order = np.argsort(end, kind="stable")
        self.last = end[self.order]  # the blocks that end a pattern's first m bytes

    def _blocks(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return ((words[low] >> bits) | ((words[low + 1] << np.uint64(1)) << (np.uint64(63) - bits))) & self.mask

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def search(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence in the bytes."""
        n = len(text)
        if not self.m or n < self.m:
            return []
        words = _words(text)
        # a cursor is where the window's last block starts; each has SEGMENT of them
        first = self.m - self.block
        at = np.arange(first, n - self.block + 1, SEGMENT)
        stop = np.minimum(at + SEGMENT, n - self.block + 1)
        found: list[np.ndarray] = []
        while len(at):
            block = self._blocks(words, at)
            shift = self.shift[self._hash(block)]
            zero = shift == 0
            if zero.any():
                hit = block[zero]
                k = np.minimum(np.searchsorted(self.last, hit), len(self.last) - 1)
                found.append(at[zero][self.last[k] == hit])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return []
        ends = np.sort(np.concatenate(found))
        block = self._blocks(words, ends)
        out, data = [], text.tobytes()
        for end, a, b in zip(ends.tolist(), np.searchsorted(self.last, block).tolist(), np.searchsorted(self.last, block, "right").tolist()):
            begin = end - first
            for k in self.order[a:b].tolist():
                size, here = int(self.length[k]), int(self.start[k])
                if data[begin : begin + size] == self.raw[here : here + size]:
                    out.append((begin, k))
        return out
