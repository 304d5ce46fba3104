"""Shapefiles and DBF tables, read and written (points, lines, polygons, multipoints)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Shape types of the format; Z and M types keep x and y only.
KINDS = {1: "Point", 3: "MultiLineString", 5: "Polygon", 8: "MultiPoint"}


def _shape(body: bytes):
    """(kind, data) of a record, None for a null or unknown shape."""
    code = struct.unpack_from("<i", body)[0] % 10
    kind = KINDS.get(code)
    if kind == "Point":
        return kind, struct.unpack_from("<2d", body, 4)
    if kind == "MultiPoint":
        (n,) = struct.unpack_from("<i", body, 36)
        return kind, [struct.unpack_from("<2d", body, 40 + 16 * i) for i in range(n)]
    if kind is None:
        return None
    parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    points = [struct.unpack_from("<2d", body, 44 + 4 * parts + 16 * i) for i in range(n)]
    lines = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    if kind == "MultiLineString":
        return ("LineString", lines[0]) if len(lines) == 1 else (kind, lines)
    return _polygons(lines)


def _area(ring) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def _polygons(rings):
    """Clockwise rings are shells; a hole belongs to the last shell before it."""
    polys: list[list] = []
    for ring in rings:
        if _area(ring) <= 0 or not polys:
            polys.append([ring])
        else:
            polys[-1].append(ring)
    return ("Polygon", polys[0]) if len(polys) == 1 else ("MultiPolygon", polys)


def shapes(data: bytes) -> Iterator[tuple[int, tuple | None]]:
    """(record number from 0, shape)."""
    if struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("not a shapefile")
    at, n = 100, 0
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        try:
            yield n, _shape(data[at + 8 : at + 8 + 2 * words])
        except struct.error:
            yield n, None
        at += 8 + 2 * words
        n += 1


def table(data: bytes) -> list[dict | None]:
    """Records of a DBF; a deleted or broken one is null. Dates stay text, blanks are null."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at + 32 <= head and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    out: list[dict | None] = []
    for i in range(n):
        row = data[head + i * size : head + (i + 1) * size]
        if len(row) < size or row[:1] == b"*":
            out.append(None)
            continue
        at, rec = 1, {}
        for name, kind, width, places in fields:
            rec[name] = _value(row[at : at + width].decode("utf-8", "replace").strip(), kind, places)
            at += width
        out.append(rec)
    return out


def _value(text: str, kind: str, places: int):
    if not text.strip("*"):
        return None
    if kind in "NF":
        try:
            return float(text) if places or kind == "F" or "." in text else int(text)
        except ValueError:
            return None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return text if kind in "CD" else None


def read(shp: bytes, dbf: bytes | None, crs: str | None) -> Iterator[tuple]:
    """(id, shape, properties, crs) of each record, matched by its number."""
    try:
        rows = table(dbf) if dbf else []
    except (struct.error, IndexError):
        rows = []
    for n, shape in shapes(shp):
        yield n, shape, rows[n] if n < len(rows) else None, crs


def write(records: list[tuple[str, list]]) -> bytes:
    """A shapefile of (kind, data) records of one kind: Point, LineString, Polygon; None is a null shape."""
    code = {"Point": 1, "LineString": 3, "Polygon": 5}[next(r for r in records if r)[0]]
    body = b""
    for i, rec in enumerate(records, 1):
        if rec is None:
            content = struct.pack("<i", 0)
        elif code == 1:
            content = struct.pack("<i2d", 1, *rec[1])
        else:
            parts = [rec[1]] if code == 3 else rec[1]
            points = [p for part in parts for p in part]
            starts = [sum(len(x) for x in parts[:k]) for k in range(len(parts))]
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            content = struct.pack("<i4d2i", code, min(xs), min(ys), max(xs), max(ys), len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i, len(content) // 2) + content
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, code, *[0.0] * 8)
    return head + body


def write_table(fields: list[tuple[str, str, int, int]], rows: list[tuple]) -> bytes:
    """A DBF of fields (name, kind, width, places) and rows of texts."""
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), size)
    for name, kind, width, places in fields:
        head += name.encode("latin-1")[:10].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, places]) + b"\0" * 14
    out = head + b"\r"
    for row in rows:
        out += b" " + b"".join(str(v).encode("utf-8")[: f[2]].ljust(f[2]) for f, v in zip(fields, row, strict=True))
    return out + b"\x1a"
