"""WebP files against a plain reader of the format."""

import struct

import numpy as np
import pytest

from quadrel.sources import webp


class Bits:
    def __init__(self, data):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        self.at = 0

    def take(self, n):
        v = sum(int(b) << i for i, b in enumerate(self.bits[self.at : self.at + n]))
        self.at += n
        return v


def tree(lengths):
    """A dictionary from (length, code) to symbol."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return used[0]
    assert sum(2.0**-n for n in lengths if n) == 1.0
    out, code = {}, 0
    for n in range(1, 16):
        code <<= 1
        for s in (s for s, x in enumerate(lengths) if x == n):
            out[n, code] = s
            code += 1
    return out


def symbol(bits, t):
    if isinstance(t, int):
        return t
    n = code = 0
    while (n, code) not in t:
        code, n = code << 1 | bits.take(1), n + 1
    return t[n, code]


def prefix(bits, size):
    if bits.take(1):  # simple
        n, wide = bits.take(1) + 1, bits.take(1)
        found = [bits.take(8 if wide else 1)] + [bits.take(8) for _ in range(n - 1)]
        assert n == 1
        return found[0]
    order = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    own = [0] * 19
    for i in range(bits.take(4) + 4):
        own[order[i]] = bits.take(3)
    assert not bits.take(1)
    t = tree(own)
    return tree([symbol(bits, t) for _ in range(size)])


def pixels(data):
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and struct.unpack("<I", data[4:8])[0] == len(data) - 8
    bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    assert bits.take(8) == 0x2F
    w, h = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    assert bits.take(3) == 0
    green = False
    while bits.take(1):
        assert bits.take(2) == 2
        green = True
    assert not bits.take(1) and not bits.take(1)
    codes = [prefix(bits, n) for n in (280, 256, 256, 256, 40)]
    out = np.zeros((h * w, 4), np.uint8)
    for i in range(h * w):
        g, r, b, a = (symbol(bits, t) for t in codes[:4])
        assert g < 256
        out[i] = ((r + g) & 255, g, (b + g) & 255, a) if green else (r, g, b, a)
    return out.reshape(h, w, 4)


@pytest.mark.parametrize("kind", ["noise", "grey", "clear", "skewed"])
def test_round_trip(kind):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (23, 31, 4)).astype(np.uint8)
    if kind == "grey":
        x[:, :, :3] = x[:, :, :1]
        x[:, :, 3] = 255
    elif kind == "clear":
        x[:] = 0
    elif kind == "skewed":
        x = np.minimum(rng.geometric(0.6, (60, 60, 4)), 255).astype(np.uint8)
    assert (pixels(webp.encode(x)) == x).all()


def test_code_lengths_are_bounded():
    counts = np.array([1, 1, *np.cumsum(np.ones(30)).astype(int) ** 9, 0])
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    for c in (counts, np.array(fib)):
        n = webp.code_lengths(c)
        assert n.max() <= 15 and sum(2.0 ** -n[n > 0]) == 1.0 and ((n > 0) == (c > 0)).all()
