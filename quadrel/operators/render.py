"""Tile images from array chunks, a tile at a time in numpy.

The relational path of `raster` explodes a tile into 65,536 rows; this one joins tiles
with the chunks that they can touch (an equi-join on chunk coordinates) and renders each
tile in one Arrow group. A group holds the tile's window and nothing else.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions import grid, projection, systems
from quadrel.operators import raster
from quadrel.sources import png, webp


#: Side of the blocks in which a map is drawn.
MAP_BLOCK = 512


@dataclass
class Image:
    """Where an image lies, its size, and lo and hi of each band's stretch.

    corners: west, south, east, north in the CRS `code`. affine: map a tile of a projected
    image by three of its corners instead of each pixel.
    """

    corners: tuple[float, float, float, float]
    width: int
    height: int
    limits: list[tuple[float, float]]
    sentinel: float | None = None
    bands: list[int] = field(default_factory=lambda: [1, 2, 3])
    code: int | systems.System = 4326
    affine: bool = False

    def place(self, lng: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fractional rows and columns of points."""
        x, y = projection.forward(lng, lat, self.code)
        west, south, east, north = self.corners
        return (1.0 - (y - south) / (north - south)) * (self.height - 1.0), (x - west) / (east - west) * (self.width - 1.0)


def chunks(px: DataFrame, by: list[str], size: int) -> DataFrame:
    """Dense chunks of a pixel table: by, band, chunk_row, chunk_col, pixels (place in the chunk, value)."""
    band = "band" if "band" in px.columns else None
    keys = [*by, *([F.col("band")] if band else [F.lit(1).alias("band")])]
    place = (F.col("row") % size * size + F.col("col") % size).cast("int")
    return px.groupBy(*keys, F.expr(f"cast(row div {size} as int)").alias("chunk_row"), F.expr(f"cast(col div {size} as int)").alias("chunk_col")).agg(F.collect_list(F.struct(place.alias("p"), F.col("v").alias("v"))).alias("pixels"))


_BATCH = "i int, z int, x long, y long, data binary, rendered int, error string"


def batch(jobs: DataFrame, chunk_table: DataFrame, image: Image, chunk_size: int, mode: str = "nearest", size: int = 256, raw: bool = False, form: str = "png") -> DataFrame:
    """Render jobs (i, z, x, y): the PNG or WebP (or raw RGBA) bytes, the pixels drawn, and an error or null.

    A job that fails does not stop the others.
    """
    w = raster.window(jobs.select("i", "z", "x", "y"), image.corners, image.width, image.height, image.code)
    span = lambda off, n: F.sequence(F.expr(f"cast({off} div {chunk_size} as int)"), F.expr(f"cast(({off} + {n} - 1) div {chunk_size} as int)"))
    asked = w.withColumn("chunk_row", F.explode(span("row_off", "src_h"))).withColumn("chunk_col", F.explode(span("col_off", "src_w")))
    rows = asked.join(chunk_table, ["chunk_row", "chunk_col"], "left")
    if mode == "nearest":  # what the step skips does not reach the shuffle
        rows = rows.withColumn("pixels", _decimated(chunk_size, F.col("row_off"), F.col("col_off"), F.col("step")))
    rows = rows.select("i", "z", "x", "y", "row_off", "col_off", "src_h", "src_w", "step", "band", "chunk_row", "chunk_col", "pixels")
    return rows.groupBy("i").applyInArrow(_render(image, chunk_size, mode, size, raw, form), _BATCH)


def _decimated(chunk_size: int, row_off: Column, col_off: Column, step: Column) -> Column:
    """The pixels of a chunk on every step-th row and column from a window's corner."""
    row = lambda p: F.col("chunk_row") * chunk_size + F.floor(p / chunk_size) - row_off
    col = lambda p: F.col("chunk_col") * chunk_size + p % chunk_size - col_off
    return F.when(step > 1, F.filter("pixels", lambda s: (F.pmod(row(s["p"]), step) == 0) & (F.pmod(col(s["p"]), step) == 0))).otherwise(F.col("pixels"))


def _render(image: Image, chunk_size: int, mode: str, size: int, raw: bool, form: str = "png"):
    def run(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in ("i", "z", "x", "y")}
        data = error = None
        n = 0
        try:
            rgba = _draw(table, image, chunk_size, mode, size)
            n = int((rgba[:, :, 3] > 0).sum())
            data = rgba.tobytes() if raw else {"png": png, "webp": webp}[form].encode(rgba)
        except Exception as e:  # noqa: BLE001  reported for this tile
            error = f"{type(e).__name__}: {e}"
        row = [first["i"], first["z"], first["x"], first["y"], data, n, error]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string()]
        return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _BATCH.split(", ")])

    return run


def _draw(table: pa.Table, image: Image, chunk_size: int, mode: str, size: int) -> np.ndarray:
    first = {c: table.column(c)[0].as_py() for c in ("z", "x", "y", "row_off", "col_off", "src_h", "src_w", "step")}
    win = (first["row_off"], first["col_off"], first["src_h"], first["src_w"], first["step"] if mode == "nearest" else 1)
    return paint(table, image, chunk_size, mode, win, *_positions(image, first["z"], first["x"], first["y"], size))


def paint(table: pa.Table, image: Image, chunk_size: int, mode: str, window: tuple[int, int, int, int, int], row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """RGBA at the image's fractional rows and columns, from the chunks of a window (row, column, height, width, step)."""
    row0, col0, src_h, src_w, step = window
    bands = sorted({b for b in table.column("band").to_pylist() if b is not None})
    win = {b: np.full((-(-src_h // step), -(-src_w // step)), np.nan) for b in bands}
    for i in range(table.num_rows):
        pixels = table.column("pixels")[i].values
        if pixels is None:
            continue
        p = pixels.field("p").to_numpy()
        r = table.column("chunk_row")[i].as_py() * chunk_size + p // chunk_size - row0
        c = table.column("chunk_col")[i].as_py() * chunk_size + p % chunk_size - col0
        ok = (r >= 0) & (c >= 0) & (r < src_h) & (c < src_w) & (r % step == 0) & (c % step == 0)
        win[table.column("band")[i].as_py()][r[ok] // step, c[ok] // step] = pixels.field("v").to_numpy(zero_copy_only=False)[ok]
    inside = (row >= 0) & (row < image.height) & (col >= 0) & (col < image.width)
    out = np.zeros((*row.shape, 4), np.uint8)
    if not bands:
        return out
    asked = [1] if max(bands) < 3 else image.bands[:3]
    if not asked or min(asked) < 1:
        raise ValueError("bands count from 1, and one is needed")
    seen = inside.copy()
    for k, b in enumerate(asked):
        if b not in win:
            return np.zeros_like(out)
        v = sample(win[b], (row - row0) / step, (col - col0) / step, mode)
        data = np.isfinite(v)  # no sample outside the window
        if image.sentinel is not None and math.isfinite(image.sentinel):
            data &= v != image.sentinel
        lo, hi = image.limits[b - 1]
        seen &= data
        byte = np.floor(np.clip((np.where(data, v, lo) - lo) / (hi - lo) * 255.0, 0, 255)) if abs(hi - lo) > np.finfo(float).eps else np.zeros_like(v)
        for to in range(3) if len(asked) == 1 and max(bands) < 3 else [k]:
            out[:, :, to] = byte
    out[:, :, 3] = 255
    out[~seen] = 0
    return out


def map_image(chunk_table: DataFrame, image: Image, chunk_size: int, bbox: tuple[float, float, float, float], width: int, height: int, transparent: bool = True, raw: bool = False) -> DataFrame:
    """A map of a box in Mercator metres: data and rendered, in one row. Nearest pixel by rounding."""
    x0, y0, x1, y1 = bbox
    wx = x0 + (np.arange(width) + 0.5) / width * (x1 - x0)
    wy = y1 - (np.arange(height) + 0.5) / height * (y1 - y0)
    lng, lat = projection.inverse(*np.broadcast_arrays(wx[None, :], wy[:, None]), 3857)
    row, col = (np.sign(v) * np.floor(np.abs(v) + 0.5) for v in image.place(lng, lat))
    ok = (row >= 0) & (row < image.height) & (col >= 0) & (col < image.width)
    r, c = (v[ok].astype(int) if ok.any() else np.zeros(1, int) for v in (row, col))
    h, w = int(r.max() - r.min()) + 1, int(c.max() - c.min()) + 1
    step = max(1, math.ceil(math.sqrt(h * w / raster.MAX_READ)))
    window = (int(r.min()), int(c.min()), h, w, step)
    # The map is drawn in blocks, each from the chunks that it can touch, and put together from the drawn blocks.
    blocks = []
    for top in range(0, height, MAP_BLOCK):
        for left in range(0, width, MAP_BLOCK):
            part = slice(top, top + MAP_BLOCK), slice(left, left + MAP_BLOCK)
            if ok[part].any():
                r, c = row[part][ok[part]].astype(int), col[part][ok[part]].astype(int)
                blocks.append((top, left, *(int(v) // chunk_size for v in (r.min(), r.max(), c.min(), c.max()))))
    spark = chunk_table.sparkSession
    spans = spark.createDataFrame(blocks, "top int, left int, r0 int, r1 int, c0 int, c1 int")
    near = spans.select("top", "left", F.explode(F.sequence("r0", "r1")).alias("chunk_row"), "c0", "c1").select("top", "left", "chunk_row", F.explode(F.sequence("c0", "c1")).alias("chunk_col"))
    near = near.join(chunk_table.select("band", "chunk_row", "chunk_col", "pixels"), ["chunk_row", "chunk_col"])
    near = near.withColumn("pixels", _decimated(chunk_size, F.lit(window[0]), F.lit(window[1]), F.lit(step)))

    def draw(table: pa.Table) -> pa.Table:
        top, left = (table.column(c)[0].as_py() for c in ("top", "left"))
        part = slice(top, top + MAP_BLOCK), slice(left, left + MAP_BLOCK)
        # Only the part of the window that this block reads, on the same steps.
        r, c = row[part][ok[part]].astype(int), col[part][ok[part]].astype(int)
        r0, c0 = (window[i] + (int(v.min()) - window[i]) // step * step for i, v in ((0, r), (1, c)))
        rgba = paint(table, image, chunk_size, "nearest", (r0, c0, int(r.max()) - r0 + 1, int(c.max()) - c0 + 1, step), row[part], col[part])
        return pa.table({"top": pa.array([top], pa.int32()), "left": pa.array([left], pa.int32()), "part": pa.array([rgba.tobytes()], pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        rgba = np.zeros((height, width, 4), np.uint8)
        for top, left, part in zip(*(table.column(c).to_pylist() for c in ("top", "left", "part")), strict=True):
            if part is not None:
                h, w = min(MAP_BLOCK, height - top), min(MAP_BLOCK, width - left)
                rgba[top : top + h, left : left + w] = np.frombuffer(part, np.uint8).reshape(h, w, 4)
        n = int((rgba[:, :, 3] > 0).sum())
        if not transparent:
            rgba[rgba[:, :, 3] == 0] = 255
        return pa.table({"data": pa.array([rgba.tobytes() if raw else png.encode(rgba)], pa.binary()), "rendered": pa.array([n], pa.int32())})

    drawn = near.groupBy("top", "left").applyInArrow(draw, "top int, left int, part binary")
    # A map without any pixel is still a map: a row without a part stands for it.
    none = spark.range(1).select(F.lit(None).cast("int").alias("top"), F.lit(None).cast("int").alias("left"), F.lit(None).cast("binary").alias("part"))
    return drawn.unionByName(none).groupBy(F.lit(0).alias("one")).applyInArrow(join, "data binary, rendered int")


def _positions(image: Image, z: int, x: int, y: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fractional row and column of each pixel of a tile."""
    side = 2 * grid.HALF / 2**z
    x0, y1 = -grid.HALF + x * side, grid.HALF - y * side

    def place(mx: np.ndarray, my: np.ndarray):
        lat = np.degrees(2 * (np.arctan(np.exp(my / grid.RADIUS)) - math.pi / 4))
        return image.place(mx * 180 / grid.HALF, lat)

    if image.affine and image.code != 4326:
        # North-west, north-east and south-west corners are the outermost pixels.
        r, c = place(np.array([x0, x0 + side, x0]), np.array([y1, y1, y1 - side]))
        step = np.arange(size) / (size - 1)
        return tuple(v[0] + (v[1] - v[0]) * step[None, :] + (v[2] - v[0]) * step[:, None] for v in (r, c))
    at = (np.arange(size) + 0.5) / size
    return place(*np.broadcast_arrays((x0 + at * side)[None, :], (y1 - at * side)[:, None]))


def sample(win: np.ndarray, row: np.ndarray, col: np.ndarray, mode: str) -> np.ndarray:
    """Values at fractional rows and columns (arrays of one shape); nan outside the window."""
    h, w = win.shape
    ok = (row >= 0) & (row < h) & (col >= 0) & (col < w)
    r, c = np.clip(np.floor(row), 0, h - 1).astype(int), np.clip(np.floor(col), 0, w - 1).astype(int)
    if mode == "nearest":
        return np.where(ok, win[r, c], np.nan)
    total, weights = np.zeros(row.shape), np.zeros(row.shape)
    for dy, wy in _weights(row - r, mode):
        for dx, wx in _weights(col - c, mode):
            rr, cc, wt = r + dy, c + dx, wy * wx
            if mode == "lanczos3":
                wt = wt * ((rr >= 0) & (rr < h) & (cc >= 0) & (cc < w))
            total += wt * win[np.clip(rr, 0, h - 1), np.clip(cc, 0, w - 1)]
            weights += wt
    if mode == "lanczos3":
        with np.errstate(divide="ignore", invalid="ignore"):
            total = total / weights
    return np.where(ok, total, np.nan)


def _weights(t: np.ndarray, mode: str) -> list[tuple[int, np.ndarray]]:
    if mode == "bilinear":
        return [(0, 1 - t), (1, t)]
    if mode == "bicubic":
        return [(-1, 0.5 * (-t + 2 * t**2 - t**3)), (0, 0.5 * (2 - 5 * t**2 + 3 * t**3)), (1, 0.5 * (t + 4 * t**2 - 3 * t**3)), (2, 0.5 * (t**3 - t**2))]
    if mode != "lanczos3":
        raise ValueError(f"unknown sampling: {mode}")
    return [(d, np.where(np.abs(d - t) < 3, np.sinc(d - t) * np.sinc((d - t) / 3), 0.0)) for d in range(-2, 4)]


def png_tiles(px: DataFrame, by: list[str], size: int = 256) -> DataFrame:
    """PNG bytes of composed pixels (by, ty, tx, red, green, blue): by, data, rendered."""
    rows = px.groupBy(*by).agg(F.collect_list(F.struct("ty", "tx", "red", "green", "blue")).alias("px"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(_encode(by, size), ", ".join([*(f"{c} {kinds[c]}" for c in by), "data binary", "rendered int"]))


def _encode(by: list[str], size: int):
    def run(batches):
        for rb in batches:
            data, n = [], []
            for i in range(rb.num_rows):
                px = rb.column("px")[i].values
                get = lambda c: px.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                rgba = np.zeros((size, size, 4), np.uint8)
                rgba[get("ty"), get("tx")] = np.stack([get("red"), get("green"), get("blue"), np.full(len(px), 255)], axis=1)
                data.append(png.encode(rgba))
                n.append(len(px))
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in by), pa.array(data, pa.binary()), pa.array(n, pa.int32())], names=[*by, "data", "rendered"])

    return run
