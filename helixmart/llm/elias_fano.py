"""Monotone sequences in Elias-Fano form, and n-gram tries made of them.

All parts are views of one buffer, as a memory-mapped file gives them: opening copies nothing, and a query touches only
the blocks it needs.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a block of the unary part; each block has one 32-bit directory entry.
BLOCK = 8
#: SELECT[byte, r] is the place of the r-th set bit (lowest first).
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
SELECT = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)


def _aligned(parts: list[np.ndarray]) -> bytes:
    """Parts one after the other at multiples of 8 bytes, behind the table of their sizes."""
    head = np.array([len(parts), *[p.nbytes for p in parts]], "<u8")
    return head.tobytes() + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)


def _views(buffer, at: int = 0) -> tuple[list[np.ndarray], int]:
    n = int(np.frombuffer(buffer, "<u8", 1, at)[0])
    sizes = np.frombuffer(buffer, "<u8", n, at + 8).tolist()
    at, out = at + 8 * (n + 1), []
    for size in sizes:
        out.append(np.frombuffer(buffer, np.uint8, size, at))
        at += size + -size % 8
    return out, at


class EliasFano:
    """A non-decreasing sequence below 2**64: the low bits of each value side by side, the high bits in unary."""

    def __init__(self, buffer, at: int = 0):
        (head, self.low, self.high, ones), self.end = _views(buffer, at)
        self.n, self.width = (int(v) for v in head.view("<u8"))
        self.ones = ones.view("<u4")

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        width = min(width, 56)
        packed = []
        for start in range(0, n, 1 << 16):
            part = values[start : start + (1 << 16)]
            packed.append(np.packbits((part[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little"))
        # Eight spare bytes let every value be read with one 64-bit word.
        low = np.concatenate([*packed, np.zeros(8, np.uint8)])
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = (top >> width) + n + 1
        # One spare block lets every place be read with one word.
        bits = np.zeros((-(-size // 64) + 1) * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        counts = np.bitwise_count(high.view("<u8")[:-1])
        ones = np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)])
        return _aligned([np.array([n, width], "<u8"), low, high, ones])

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """Place of the bit of that rank (from 0) among the set or the clear bits of the unary part."""
        words = self.high.view("<u8")[:-1]
        if one:
            block = np.searchsorted(self.ones, rank, side="right") - 1
            rest, part = rank - self.ones[block], words[block]
        else:
            clear = np.arange(len(self.ones)) * 64 - self.ones
            block = np.searchsorted(clear, rank, side="right") - 1
            rest, part = rank - clear[block], ~words[block]
        out = block * 64
        # Halve the word until one bit is left.
        for width in (32, 16, 8):
            half = part & np.uint64((1 << width) - 1)
            count = np.bitwise_count(half)
            above = rest >= count
            rest = np.where(above, rest - count, rest)
            part = np.where(above, part >> np.uint64(width), half)
            out += above * width
        return out + SELECT[part.astype(np.uint8), rest]

    def _after(self, place: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
        """The next set (or clear) bit at or after each place, and whether it lies within the 57 bits that were read."""
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.high, 8)[place >> 3]).view("<u8")[:, 0]
        words = (words if one else ~words) >> (place & 7).astype(np.uint64)
        words &= np.uint64((1 << 57) - 1)
        return place + np.bitwise_count((words & -words) - np.uint64(1)), words != 0

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.width
        words = np.lib.stride_tricks.sliding_window_view(self.low, 8)[bit >> 3]
        words = np.ascontiguousarray(words).view("<u8")[:, 0]
        return (words >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, True) - at).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._low(at)

    def span(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries ``at`` and ``at + 1``."""
        place = self._select(at, True)
        following, near = self._after(place + 1, True)
        following[~near] = self._select(at[~near] + 1, True)
        shift = np.uint64(self.width)
        return (((place - at).astype(np.uint64) << shift) | self._low(at)).astype(np.int64), (
            ((following - at - 1).astype(np.uint64) << shift) | self._low(at + 1)).astype(np.int64)

    def successor(self, values: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each value the index of the first entry at or above it within [first, end), and whether it is the value.

        Entries of equal high bits lie between two clear bits of the unary part; inside them the low bits are bisected.
        """
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        top = len(self.high) * 8 - 64 - self.n  # clear bits there are
        inside = high < top
        h = np.where(inside, high, 0)
        before = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1, 0)
        after, near = self._after(before, False)
        after[~near] = self._select(h[~near], False)
        low, stop = before - h, after - h
        low, stop = np.where(inside, low, self.n), np.where(inside, stop, self.n)
        if first is not None:
            low, stop = np.clip(low, first, end), np.clip(stop, first, end)
        last = stop.copy()
        wanted = values & np.uint64((1 << self.width) - 1)
        left = np.flatnonzero(low < stop)
        while len(left):
            middle = (low[left] + stop[left]) >> 1
            less = self._low(middle) < wanted[left]
            low[left[less]] = middle[less] + 1
            stop[left[~less]] = middle[~less]
            left = left[low[left] < stop[left]]
        found = low < last
        found[found] = self._low(low[found]) == wanted[found]
        return low, found


class Trie:
    """Sorted keys cut into fields, one level per field, with a number at every leaf.

    A level holds its nodes' codes, made monotone by the rank of the context they stand under, and the pointers to each
    node's successors; a key is followed from level to level by a successor search inside the context's range.
    """

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<u8", 1)[0]
        self.fields = [int(f) for f in np.frombuffer(buffer, "<u8", int(head), 8)]
        at = 8 * (len(self.fields) + 1)
        self.codes, self.pointers = [], []
        for i in range(len(self.fields)):
            self.codes.append(EliasFano(buffer, at))
            at = self.codes[-1].end
            if i + 1 < len(self.fields):
                self.pointers.append(EliasFano(buffer, at))
                at = self.pointers[-1].end
        (values,), _ = _views(buffer, at)
        self.wide = self.codes[-1].n and len(values) == 8 * self.codes[-1].n
        self.values = values.view("<u8" if self.wide else "<u2")

    @staticmethod
    def build(keys: np.ndarray, values: np.ndarray, fields: tuple[int, ...]) -> bytes:
        """``keys`` are distinct and sorted; ``values`` are 16 bits wide (quantised) or 64 (exact)."""
        parts, left, above = [], sum(fields), np.zeros(len(keys), np.int64)
        for i, width in enumerate(fields):
            left -= width
            prefix = keys >> np.uint64(left) if left else keys
            new = np.ones(len(keys), bool)
            new[1:] = prefix[1:] != prefix[:-1]
            nodes = np.flatnonzero(new)
            code = prefix[nodes] & np.uint64((1 << width) - 1) if width < 64 else prefix[nodes]
            if i:
                code = code | (above[nodes].astype(np.uint64) << np.uint64(width))
                parts.append(EliasFano.build(np.concatenate([np.searchsorted(above[nodes], np.arange(above[-1] + 1)), [len(nodes)]]).astype(np.uint64)
                                             if len(keys) else np.zeros(1, np.uint64)))
            parts.append(EliasFano.build(code))
            above = np.cumsum(new) - 1
        head = np.array([len(fields), *fields], "<u8").tobytes()
        return head + b"".join(parts) + _aligned([np.ascontiguousarray(values)])

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its value or 0). Neighbouring keys of one context ask for it once."""
        left = sum(self.fields)
        node, found = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        for i, width in enumerate(self.fields):
            left -= width
            prefix = keys >> np.uint64(left) if left else keys
            new = np.ones(len(keys), bool)
            new[1:] = prefix[1:] != prefix[:-1]
            code = prefix[new] & np.uint64((1 << width) - 1) if width < 64 else prefix[new]
            parent, hit = node[new], found[new]
            at = np.flatnonzero(hit)
            if i == 0:
                place, here = self.codes[0].successor(code[at])
            else:
                first, end = self.pointers[i - 1].span(parent[at])
                place, here = self.codes[i].successor(code[at] | (parent[at].astype(np.uint64) << np.uint64(width)), first, end)
            parent[at], hit[at] = place, here
            run = np.cumsum(new) - 1
            node, found = parent[run], hit[run]
        out = np.zeros(len(keys), self.values.dtype)
        out[found] = self.values[node[found]]
        return found, out
