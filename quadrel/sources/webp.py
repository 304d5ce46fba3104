"""Lossless WebP files (VP8L) in numpy: entropy-coded pixels without back references."""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Longest code of the format.
MAX_BITS = 15
#: Order in which the format stores the lengths of the codes that code lengths are written in (fixed by the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most MAX_BITS; 0 for symbols that do not occur."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out[used] = 1
        return out
    floor = 0
    while True:
        heap = [(max(int(counts[s]), floor), n, (int(s),)) for n, s in enumerate(used)]
        heapq.heapify(heap)
        out[:] = 0
        n = len(heap)
        while len(heap) > 1:
            (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            out[list(a + b)] += 1
            heapq.heappush(heap, (x + y, n, a + b))
            n += 1
        if out.max(initial=0) <= MAX_BITS:
            return out
        floor = max(1, 2 * floor, int(counts.sum()) >> MAX_BITS)  # rare symbols count as more


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest, as they stand in the file."""
    out = np.zeros(len(lengths), np.int64)
    code = 0
    for bits in range(1, MAX_BITS + 1):
        code <<= 1
        for s in np.flatnonzero(lengths == bits):
            out[s] = int(f"{code:0{bits}b}"[::-1], 2)
            code += 1
    return out


class _Bits:
    """Bits in the order of the file: the lowest of each value first."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(np.array([value >> i & 1 for i in range(n)], np.uint8))

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        starts = ends - sizes
        for i in range(int(sizes.max(initial=0))):
            at = sizes > i
            out[starts[at] + i] = values[at] >> i & 1
        self.parts.append(out)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def _put_lengths(bits: _Bits, lengths: np.ndarray) -> None:
    """A prefix code by its lengths, each of them in four bits."""
    bits.put(0, 1)
    bits.put(len(LENGTH_ORDER) - 4, 4)
    for s in LENGTH_ORDER:
        bits.put(4 if s <= MAX_BITS else 0, 3)
    bits.put(0, 1)  # lengths of all symbols follow
    four = np.array([int(f"{v:04b}"[::-1], 2) for v in range(16)])
    bits.put_all(four[lengths], np.full(len(lengths), 4))


def encode(rgba: np.ndarray) -> bytes:
    """A lossless WebP of an array (height, width, 4)."""
    h, w = rgba.shape[:2]
    px = np.ascontiguousarray(rgba, np.uint8).reshape(-1, 4)
    red, green, blue, alpha = (px[:, i].astype(np.int64) for i in range(4))
    bits = _Bits()
    bits.put(0x2F, 8)
    bits.put(w - 1, 14)
    bits.put(h - 1, 14)
    bits.put(int((alpha < 255).any()), 1)
    bits.put(0, 3)
    # One transform, number 2: green is taken from red and blue, so that grey has one channel.
    bits.put(1, 1)
    bits.put(2, 2)
    bits.put(0, 1)
    bits.put(0, 1)  # no colour cache
    bits.put(0, 1)  # one set of codes
    channels = [green, (red - green) & 255, (blue - green) & 255, alpha]
    values, sizes = [], []
    for x, symbols in zip(channels, (256 + 24, 256, 256, 256), strict=True):
        lengths = code_lengths(np.bincount(x, minlength=symbols))
        _put_lengths(bits, lengths)
        # A code of one symbol takes no bits.
        size = lengths if (lengths > 0).sum() > 1 else np.zeros_like(lengths)
        values.append(codes(lengths)[x])
        sizes.append(size[x])
    for v in (1, 0, 0, 0):  # distances: a code of the one symbol 0
        bits.put(v, 1)
    bits.put_all(np.stack(values, 1).ravel(), np.stack(sizes, 1).ravel())
    data = bits.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
