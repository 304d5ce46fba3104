"""GeoTIFF files: tags, pixels, georeference; and a writer of small ones.

Classic and big TIFF, both byte orders, strips and tiles, chunky and planar samples,
8 to 64 bits, unsigned, signed and float; uncompressed, deflate, LZW and PackBits,
with the horizontal predictor. Other compressions raise Unsupported. Reduced images
come from later directories, SubIFDs and .ovr files.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from quadrel.functions import systems

# TIFF and GeoTIFF tags, field types and geo keys.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, SUB_IFDS, SAMPLE_FORMAT = 322, 323, 324, 325, 330, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, GEO_DOUBLES, NODATA = 33550, 33922, 34735, 34736, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KEYS = {1024: "model_type", 2048: "geographic", 3072: "projected", 3075: "coord_trans", 3080: "lon0", 3081: "lat0", 3082: "fe", 3083: "fn", 3092: "k"}
# Fixed value: the code of what parameters define.
USER_DEFINED = 32767


class Unsupported(ValueError):
    """A file that is valid but not read here."""


@dataclass
class Level:
    """One image of a file."""

    width: int
    height: int
    bands: int
    dtype: str
    chunk_w: int
    chunk_h: int
    tiled: bool
    planar: bool
    compression: int
    predictor: int
    offsets: list[int]
    counts: list[int]
    external: bool = False


@dataclass
class Info:
    """A file's images, the base first, and its georeference."""

    levels: list[Level]
    transform: list[float]
    geokeys: dict[str, float] = field(default_factory=dict)
    nodata: str | None = None

    @property
    def epsg(self) -> int | None:
        """Code of the declared CRS; None for one defined by parameters."""
        k = self.geokeys
        if k.get("projected") and k["projected"] != USER_DEFINED:
            return int(k["projected"])
        if k.get("model_type") == 2:
            return int(k.get("geographic", 4326))
        if k.get("coord_trans") == 1:
            return None
        return int(k["geographic"]) if k.get("geographic") else None

    @property
    def tm(self) -> list[float] | None:
        """Transverse Mercator by parameters, if that is what is declared: lon0, lat0, k, fe, fn."""
        k = self.geokeys
        if self.epsg is not None or k.get("coord_trans") != 1 or "lon0" not in k or "lat0" not in k:
            return None
        return [float(k["lon0"]), float(k["lat0"]), float(k.get("k", 1.0)), float(k.get("fe", 0.0)), float(k.get("fn", 0.0))]

    @property
    def crs_class(self) -> str:
        return {1: "Projected", 2: "Geographic"}.get(int(self.geokeys.get("model_type", 0)), "Unknown")


class _Reader:
    """Directories of a file; data: bytes, or anything whose slices are bytes."""

    def __init__(self, data: bytes):
        self.data = data
        order = data[:2]
        if order not in (b"II", b"MM"):
            raise ValueError("not a TIFF")
        self.e = "<" if order == b"II" else ">"
        magic = self.get("H", 2)[0]
        if magic not in (42, 43):
            raise ValueError("not a TIFF")
        self.big = magic == 43
        self.first = self.get("Q", 8)[0] if self.big else self.get("I", 4)[0]

    def get(self, fmt: str, at: int) -> tuple:
        return struct.unpack(self.e + fmt, self.data[at : at + struct.calcsize(self.e + fmt)])

    def directory(self, at: int) -> tuple[dict[int, list], int]:
        """Tags of a directory and the place of the next."""
        n = self.get("Q" if self.big else "H", at)[0]
        at += 8 if self.big else 2
        size, inline = (20, 8) if self.big else (12, 4)
        tags = {}
        for i in range(n):
            p = at + i * size
            tag, kind = self.get("HH", p)
            count = self.get("Q" if self.big else "I", p + 4)[0]
            fmt = FIELDS.get(kind)
            if fmt is None:
                continue
            width = struct.calcsize("<" + fmt.replace("s", "B")) * count
            place = p + size - inline
            if width > inline:
                place = self.get("Q" if self.big else "I", place)[0]
            if fmt == "s" or kind == 2:
                tags[tag] = [self.data[place : place + count]]
            elif len(fmt) == 2:
                v = self.get(fmt[0] * 2 * count, place)
                tags[tag] = [a / b if b else math.nan for a, b in zip(v[::2], v[1::2], strict=True)]
            else:
                tags[tag] = list(self.get(f"{count}{fmt}", place))
        end = at + n * size
        return tags, self.get("Q" if self.big else "I", end)[0]

    def level(self, t: dict[int, list], external: bool = False) -> Level | None:
        w, h = t.get(WIDTH, [0])[0], t.get(HEIGHT, [0])[0]
        if not w or not h:
            return None
        bits, form = t.get(BITS, [1])[0], t.get(SAMPLE_FORMAT, [1])[0]
        kind = {1: "u", 2: "i", 3: "f"}.get(form)
        if kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits == 8):
            raise Unsupported(f"samples of {bits} bits in format {form}")
        tiled = TILE_W in t
        cw, ch = (t[TILE_W][0], t[TILE_H][0]) if tiled else (w, min(t.get(ROWS, [h])[0], h))
        return Level(w, h, t.get(SAMPLES, [1])[0], f"{self.e}{kind}{bits // 8}", cw, ch, tiled, t.get(PLANAR, [1])[0] == 2, t.get(COMPRESSION, [1])[0], t.get(PREDICTOR, [1])[0], t.get(TILE_OFFSETS if tiled else OFFSETS, []), t.get(TILE_COUNTS if tiled else COUNTS, []), external)


def read_info(data: bytes, world: str | None = None, ovr: bytes | None = None) -> Info:
    """Images and georeference; world: text of a world file, which wins over the tags."""
    r = _Reader(data)
    tags, at = r.directory(r.first)
    base = r.level(tags)
    if base is None:
        raise ValueError("a TIFF without an image")
    levels, seen = [base], {r.first}
    for sub in tags.get(SUB_IFDS, []):
        levels.append(r.level(r.directory(sub)[0]))
    while at and at not in seen:
        seen.add(at)
        more, at = r.directory(at)
        levels.append(r.level(more))
    if ovr:
        levels += _external(ovr)
    smaller = [x for x in levels[1:] if x and x.width <= base.width and x.bands == base.bands]
    nodata = tags.get(NODATA)
    return Info([base, *smaller], _transform(tags, world), _geokeys(tags), nodata[0].decode("latin-1") if nodata else None)


def _external(data: bytes) -> list[Level | None]:
    r = _Reader(data)
    out, at, seen = [], r.first, set()
    while at and at not in seen:
        seen.add(at)
        tags, at = r.directory(at)
        out.append(r.level(tags, True))
    return out


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _transform(t: dict[int, list], world: str | None) -> list[float]:
    """x0, pixel width, 0, y0, 0, pixel height of a north-up image.

    A world file of exactly six numbers wins; its last two are taken for the corner.
    """
    if world:
        a = [v for line in world.splitlines() if (v := _number(line)) is not None]
        if len(a) == 6:
            return [a[4], a[0], a[1], a[5], a[2], a[3]]
    scale, tie = t.get(PIXEL_SCALE), t.get(TIEPOINT)
    if scale and tie and len(tie) >= 6:
        sx, sy = scale[0], scale[1]
        return [tie[3] - tie[0] * sx, sx, 0.0, tie[4] + tie[1] * sy, 0.0, -sy]
    return [0.0, 1.0, 0.0, 0.0, 0.0, -1.0]


def _geokeys(t: dict[int, list]) -> dict[str, float]:
    raw, doubles = t.get(GEO_KEYS, []), t.get(GEO_DOUBLES, [])
    out: dict[str, float] = {}
    for i in range(4, len(raw) - 3, 4):
        key, where, count, value = raw[i : i + 4]
        if key in KEYS:
            if where == 0:
                out[KEYS[key]] = value
            elif where == GEO_DOUBLES and count and value < len(doubles):
                out[KEYS[key]] = doubles[value]
    return out


def _lzw(data: bytes) -> bytes:
    out, table = bytearray(), []
    bits, code_bits, value, prev = 0, 9, 0, b""
    for byte in data:
        value = (value << 8) | byte
        bits += 8
        while bits >= code_bits:
            code = (value >> (bits - code_bits)) & ((1 << code_bits) - 1)
            bits -= code_bits
            value &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table = [bytes([i]) for i in range(256)] + [b"", b""]
                code_bits, prev = 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif prev:
                entry = prev + prev[:1]
            else:
                raise ValueError("broken LZW data")
            out += entry
            if prev:
                table.append(prev + entry[:1])
                code_bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
            prev = entry
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def overlapping(level: Level, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> list[int]:
    """Numbers of the strips or tiles, of all bands, that touch a window of rows and columns (first, end)."""
    across = -(-level.width // level.chunk_w)
    down = -(-level.height // level.chunk_h)
    r0, r1 = rows or (0, level.height)
    c0, c1 = cols or (0, level.width)
    r0, r1, c0, c1 = max(r0, 0), min(r1, level.height), max(c0, 0), min(c1, level.width)
    if r0 >= r1 or c0 >= c1:
        return []
    places = [r * across + c for r in range(r0 // level.chunk_h, -(-r1 // level.chunk_h)) for c in range(c0 // level.chunk_w, -(-c1 // level.chunk_w))]
    every = [plane * across * down + p for plane in range(level.bands if level.planar else 1) for p in places]
    return [i for i in every if i < len(level.offsets)]


def read_chunk(data: bytes, level: Level, index: int) -> tuple[int, int, int | None, np.ndarray]:
    """One strip or tile as float64: first row, first column, band (None if all), array (rows, columns, bands)."""
    across = -(-level.width // level.chunk_w)
    down = -(-level.height // level.chunk_h)
    band, place = divmod(index, across * down) if level.planar else (None, index)
    row, col = place // across * level.chunk_h, place % across * level.chunk_w
    raw = data[level.offsets[index] : level.offsets[index] + level.counts[index]]
    if level.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif level.compression == 5:
        raw = _lzw(raw)
    elif level.compression == 32773:
        raw = _packbits(raw)
    elif level.compression != 1:
        raise Unsupported(f"compression {level.compression}")
    depth = 1 if level.planar else level.bands
    rows = level.chunk_h if level.tiled else min(level.chunk_h, level.height - row)
    a = np.frombuffer(raw, level.dtype, rows * level.chunk_w * depth).reshape(rows, level.chunk_w, depth)
    if level.predictor == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
    elif level.predictor != 1:
        raise Unsupported(f"predictor {level.predictor}")
    a = a[: level.height - row, : level.width - col].astype(np.float64)
    return row, col, band, a


def read_image(data: bytes, level: Level) -> np.ndarray:
    """A whole image (rows, columns, bands) as float64."""
    out = np.zeros((level.height, level.width, level.bands))
    for i in range(len(level.offsets)):
        r, c, band, a = read_chunk(data, level, i)
        if band is None:
            out[r : r + a.shape[0], c : c + a.shape[1]] = a
        else:
            out[r : r + a.shape[0], c : c + a.shape[1], band] = a[:, :, 0]
    return out


def write(images: list[np.ndarray], transform: list[float] | None = None, epsg: int | None = None, nodata: str | None = None, tile: int | None = None, planar: bool = False, compress: bool = False, predictor: bool = False, order: str = "<", tm: list[float] | None = None) -> bytes:
    """A TIFF of images (rows, columns, bands), the base first; overviews follow as directories."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for n, image in enumerate(images):
        h, w, bands = image.shape
        a = np.ascontiguousarray(image, image.dtype.newbyteorder(order))
        kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
        cw, ch = (tile, tile) if tile else (w, min(h, 64))
        offsets, counts = [], []
        for b in range(bands) if planar else [slice(None)]:
            for r in range(0, h, ch):
                for c in range(0, w, cw):
                    part = a[r : r + ch, c : c + cw, b]
                    part = part[:, :, None] if planar else part
                    if tile:
                        full = np.zeros((ch, cw, part.shape[2]), part.dtype)
                        full[: part.shape[0], : part.shape[1]] = part
                        part = full
                    if predictor:
                        part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1])).astype(part.dtype)
                    raw = np.ascontiguousarray(part).tobytes()
                    raw = zlib.compress(raw) if compress else raw
                    offsets.append(len(out))
                    counts.append(len(raw))
                    out += raw + b"\0" * (len(raw) % 2)
        tags: list[tuple[int, int, list | bytes]] = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [image.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8 if compress else 1]), (262, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [2 if planar else 1]), (SAMPLE_FORMAT, 3, [kind] * bands)]
        tags += [(TILE_W, 4, [tile]), (TILE_H, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(OFFSETS, 4, offsets), (ROWS, 4, [ch]), (COUNTS, 4, counts)]
        if predictor:
            tags.append((PREDICTOR, 3, [2]))
        if n == 0 and transform:
            tags += [(PIXEL_SCALE, 12, [transform[1], -transform[5], 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, transform[0], transform[3], 0.0])]
        if n == 0 and epsg:
            keys = [1024, 0, 1, 2, 2048, 0, 1, epsg] if epsg in systems.GEOGRAPHIC else [1024, 0, 1, 1, 3072, 0, 1, epsg]
            tags.append((GEO_KEYS, 3, [1, 1, 0, 2, *keys]))
        elif n == 0 and tm:
            keys = [1024, 0, 1, 1, 3072, 0, 1, USER_DEFINED, 3075, 0, 1, 1]
            for at, key in enumerate((3080, 3081, 3092, 3082, 3083)):
                keys += [key, GEO_DOUBLES, 1, at]
            tags += [(GEO_KEYS, 3, [1, 1, 0, 8, *keys]), (GEO_DOUBLES, 12, list(tm))]
        if n == 0 and nodata is not None:
            tags.append((NODATA, 2, nodata.encode("latin-1") + b"\0"))
        link = _directory(out, sorted(tags, key=lambda t: t[0]), link, order)
    return bytes(out)


def _directory(out: bytearray, tags: list, link: int, order: str) -> int:
    """Append a directory, hang it on `link`, and return the place of its own link."""
    entries = b""
    for tag, kind, values in tags:
        fmt = {3: "H", 4: "I", 12: "d"}.get(kind)
        raw = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{fmt}", *values)
        if len(raw) > 4:
            at = len(out)
            out += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    struct.pack_into(order + "I", out, link, len(out))
    out += struct.pack(order + "H", len(tags)) + entries
    out += struct.pack(order + "I", 0)
    return len(out) - 4


def write_overviews(base: np.ndarray, smallest: int = 256, most: int = 8) -> bytes:
    """An .ovr file: each image half the size of the one above, by bilinear samples. At most four bands."""
    if base.shape[2] > 4:
        raise Unsupported("overviews of more than four bands")
    levels, cur = [], base.astype(np.float64)
    while len(levels) < most and max(cur.shape[:2]) > smallest:
        cur = halve(cur)
        a = cur
        if base.dtype.kind in "ui":
            lim = np.iinfo(base.dtype)
            a = np.clip(np.round(a), lim.min, lim.max)
        levels.append(a.astype(base.dtype))
    return write(levels) if levels else b""


def halve(a: np.ndarray) -> np.ndarray:
    """Half the size by bilinear samples at the new pixels' centres."""
    out = a
    for axis in (0, 1):
        n = out.shape[axis]
        m = max(1, n // 2)
        at = np.maximum((np.arange(m) + 0.5) * (n / m) - 0.5, 0.0)
        lo = np.floor(at).astype(int)
        f = (at - lo).reshape([-1 if i == axis else 1 for i in range(3)])
        out = np.take(out, lo, axis) * (1 - f) + np.take(out, np.minimum(lo + 1, n - 1), axis) * f
    return out
