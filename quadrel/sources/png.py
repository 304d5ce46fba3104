"""PNG files by the standard library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA PNG of an array (height, width, 4)."""
    h, w = rgba.shape[:2]
    lines = np.zeros((h, 1 + 4 * w), np.uint8)
    lines[:, 1:] = np.ascontiguousarray(rgba, np.uint8).reshape(h, 4 * w)
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return _MAGIC + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _part(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a PNG as `encode` writes it."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, body, shape = 8, b"", (0, 0)
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack(">IIBB", part[:10])
            if (depth, colour) != (8, 6):
                raise ValueError("only 8-bit RGBA is read")
            shape = (h, w)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], 1 + 4 * shape[1])
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read")
    return lines[:, 1:].reshape(*shape, 4)

