"""Rasters as relations of pixels.

A pixel table has key columns (raster, level or whatever names an image), band, row,
col and v. Every operator is a composition of aggregates and equi-joins on these
columns, so that a mosaic of any size is dealt by its own keys. Joins to per-band
bounds have one row for each band; adaptive execution broadcasts them if they are small.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.functions import crs, grid, paths, systems

#: Pixels of a region read beyond which the nearest mode skips rows and columns.
MAX_READ = 1024 * 1024
#: Pixels around a tile's window.
PADDING = 10


def valid(px: DataFrame, sentinel: Column | None = None) -> DataFrame:
    """Pixels that are data."""
    return px.where(~paths.is_nodata(F.col("v"), F.lit(None).cast("double") if sentinel is None else sentinel))


def band_stats(px: DataFrame, by: list[str], sentinel: Column | None = None) -> DataFrame:
    """For each band: n, min_v, max_v, mean_v, std_v (population); zeros where no pixel is data."""
    bad = paths.is_nodata(F.col("v"), F.lit(None).cast("double") if sentinel is None else sentinel)
    v = F.when(~bad, F.col("v"))
    zero = F.lit(0.0)
    return px.groupBy(*by).agg(F.count(v).alias("n"), F.coalesce(F.min(v), zero).alias("min_v"), F.coalesce(F.max(v), zero).alias("max_v"), F.coalesce(F.avg(v), zero).alias("mean_v"), F.coalesce(F.stddev_pop(v), zero).alias("std_v"))


def first_n(px: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group: whole runs of order[0] by their counts, and only the run that holds the n-th row is ranked."""
    keys, head = ", ".join(by), order[0]
    runs = px.groupBy(*by, head).agg(F.count(F.lit(1)).alias("_in"))
    runs = runs.withColumn("_before", F.expr(f"sum(_in) over (partition by {keys} order by {head}) - _in")).where(F.col("_before") < n)
    near = px.join(runs, [*by, head])
    whole = F.col("_before") + F.col("_in") <= n
    last = near.where(~whole).withColumn("_i", F.expr(f"row_number() over (partition by {keys}, {head} order by {', '.join(order[1:] or order)})")).where(F.col("_before") + F.col("_i") <= n).drop("_i")
    return near.where(whole).unionByName(last).drop("_in", "_before")


#: Equal parts of a band's value range; only the parts that hold a percentile are ranked.
PARTS = 1024
#: Distinct values of a band, or up to twice as many, from which the parts' range is taken.
CUT_VALUES = 10_000


def percentiles(px: DataFrame, by: list[str], low: float = 0.02, high: float = 0.98, sample_cap: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Exact lower and upper percentile of each band: the element floor(p * (n - 1)) of its sorted values.

    Values are counted first, so grey levels are few rows. The counts are summed up for equal
    parts of the band's range; values are ranked only in the two parts that hold a
    percentile, so no task sorts a band. sample_cap: only the first so many values of a
    band, in `order`. Values that are not finite are left out.
    """
    keys = ", ".join(by)
    px = valid(px)
    if sample_cap is not None:
        px = first_n(px, by, order or ["row", "col"], sample_cap)
    counts = px.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("_n"))

    def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """Inner join in which nulls are equal: a band without a name is a band."""
        right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
        return left.join(right, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))).drop(*(f"_on_{c}" for c in on))

    # The parts divide what lies between two quantiles of the distinct values, so that a few far values do not
    # widen them; the first and the last part take the rest. Any ascending parts give the exact rank, but the plan
    # reads the parts twice and Spark may compute them twice: they must depend on the values only, not on the order in
    # which rows arrive, as percentile_approx does. So the quantiles are exact ones of the values with small hashes.
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_all"))
    some = meet(counts, sizes, by).where(F.pmod(F.xxhash64("v"), F.greatest(F.expr(f"_m div {CUT_VALUES}"), F.lit(1))) == 0)
    cuts = some.groupBy(*by).agg(F.percentile("v", F.array(F.lit(0.001), F.lit(0.999))).alias("_cut"), F.first("_all").alias("_all"))
    bands = cuts.select(*by, F.get("_cut", F.lit(0)).alias("_lo"), F.get("_cut", F.lit(1)).alias("_hi"), "_all")
    span = F.col("_hi") - F.col("_lo")
    scaled = F.greatest(F.least((F.col("v") - F.col("_lo")) / span * F.lit(float(PARTS - 2)), F.lit(float(PARTS - 2))), F.lit(-1.0))
    part = F.when(span > 0, F.floor(scaled) + 1).otherwise(F.when(F.col("v") < F.col("_lo"), 0).when(F.col("v") == F.col("_lo"), 1).otherwise(2))
    parted = meet(counts, bands, by).withColumn("_part", part.cast("int"))
    sums = parted.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"), F.first("_all").alias("_all"))
    sums = sums.withColumn("_start", F.expr(f"sum(_in) over (partition by {keys} order by _part) - _in"))
    rank = lambda p: F.floor(F.lit(p) * (F.col("_all") - 1))
    holds = lambda p: (F.col("_start") <= rank(p)) & (rank(p) < F.col("_start") + F.col("_in"))
    near = meet(parted.select(*by, "_part", "v", "_n"), sums.where(holds(low) | holds(high)), [*by, "_part"])
    near = near.withColumn("_upto", F.col("_start") + F.expr(f"sum(_n) over (partition by {keys}, _part order by v)"))
    pick = lambda p: F.min(F.when(holds(p) & (F.col("_upto") > rank(p)), F.col("v")))
    return near.groupBy(*by).agg(pick(low).alias("lo"), pick(high).alias("hi"))


def bounds(stats: DataFrame, by: list[str], method: str = "minmax", factor: float = 2.0, percentile: DataFrame | None = None) -> DataFrame:
    """lo and hi of each band's stretch."""
    if method == "percentile":
        assert percentile is not None, "percentile bounds are needed"
        return percentile.select(*by, "lo", "hi")
    if method == "stddev":
        f = F.lit(abs(float(factor)))
        return stats.select(*by, (F.col("mean_v") - f * F.col("std_v")).alias("lo"), (F.col("mean_v") + f * F.col("std_v")).alias("hi"))
    return stats.select(*by, F.col("min_v").alias("lo"), F.col("max_v").alias("hi"))


def to_byte(v: Column, lo: Column, hi: Column) -> Column:
    """Linear stretch to 0..255, cut off; 0 for an empty range."""
    scaled = (v - lo) / (hi - lo) * F.lit(255.0)
    cut = F.greatest(F.least(scaled, F.lit(255.0)), F.lit(0.0))
    return F.when(F.abs(hi - lo) > F.lit(2.220446049250313e-16), F.floor(cut)).otherwise(F.lit(0)).cast("int")


def stretch(px: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """Adds byte."""
    return px.join(limits, by).withColumn("byte", to_byte(F.col("v"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def overview(px: DataFrame, by: list[str]) -> DataFrame:
    """Half the size, by the mean of 2x2 pixels (the bilinear sample between them). Both sides must be even."""
    return px.groupBy(*by, F.expr("row div 2").alias("row"), F.expr("col div 2").alias("col")).agg(F.avg("v").alias("v"))


def downsample(px: DataFrame, by: list[str], width: int, height: int) -> tuple[DataFrame, int, int]:
    """Half the size of an image of any size by bilinear samples; returns the image and its size."""
    w, h = max(1, width // 2), max(1, height // 2)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    at = lambda c, size, to: F.greatest((F.col(c) + F.lit(0.5)) * F.lit(size / to) - F.lit(0.5), F.lit(0.0))
    images = px.select(*by).distinct() if by else px.sparkSession.range(1).select()
    targets = images.select("*", each(h).alias("o_row")).select("*", each(w).alias("o_col"))
    targets = targets.withColumns({"row": at("o_row", height, h), "col": at("o_col", width, w)})
    out = resample(px, targets, by, [*by, "o_row", "o_col"], "bilinear", width, height)
    return out.withColumnsRenamed({"o_row": "row", "o_col": "col"}), w, h


def pyramid(px: DataFrame, by: list[str], width: int, height: int, smallest: int = 256, most: int = 8) -> list[tuple[DataFrame, int, int]]:
    """Levels below the base, each made from the one above, until both sides are `smallest` at most."""
    out: list[tuple[DataFrame, int, int]] = []
    cur = (px, width, height)
    while len(out) < most and max(cur[1:]) > smallest:
        if cur[1] % 2 == 0 and cur[2] % 2 == 0:
            cur = overview(cur[0], by), cur[1] // 2, cur[2] // 2
        else:
            cur = downsample(cur[0], by, cur[1], cur[2])
        out.append(cur)
    return out


def choose_level(levels: DataFrame, tiles: DataFrame, by: list[str]) -> DataFrame:
    """For each raster and zoom, the level whose resolution is nearest to the tiles'.

    levels: by, idx, width, base_width, metres (of a base pixel). tiles: by, z. First level wins ties.
    """
    # One row for each raster on either side, so that the join grows with the rasters only. The sizes that Spark
    # expects behind an explode are far too low, hence the hint: it would broadcast what no driver holds.
    shapes = levels.groupBy(*by).agg(F.collect_set(F.struct("idx", "width", "base_width", "metres")).alias("_levels"))
    zooms = tiles.groupBy(*by).agg(F.collect_set(F.struct("z")).alias("_zooms"))
    each = zooms.join(shapes.hint("merge"), by).select(*by, "_levels", F.explode("_zooms.z").alias("z"))

    def ranked(level: Column) -> Column:
        res = level["metres"] * level["base_width"] / level["width"]
        diff = F.when(level["metres"] > 0, F.abs(res - grid.resolution(F.col("z")))).otherwise(F.lit(0.0))
        return F.struct(diff.alias("diff"), level["idx"].alias("idx"))

    return each.select(*by, "z", F.array_min(F.transform("_levels", ranked))["idx"].alias("idx"))


# ---------------------------------------------------------------- sampling


def cubic(t: Column) -> list[Column]:
    """Weights of the four taps at -1, 0, 1, 2 (Catmull-Rom)."""
    t2, t3, h = t * t, t * t * t, F.lit(0.5)
    return [h * (-t + 2 * t2 - t3), h * (2 - 5 * t2 + 3 * t3), h * (t + 4 * t2 - 3 * t3), h * (t3 - t2)]


def lanczos(x: Column, a: float = 3.0) -> Column:
    p = F.lit(math.pi) * x
    return F.when(x == 0, F.lit(1.0)).when(F.abs(x) >= a, F.lit(0.0)).otherwise(F.sin(p) / p * (F.sin(p / a) / (p / a)))


def _taps(at: Column, mode: str) -> Column:
    """Array of (offset, weight) for one axis."""
    if mode == "bilinear":
        pairs = [(0, 1 - at), (1, at)]
    elif mode == "bicubic":
        pairs = list(zip((-1, 0, 1, 2), cubic(at), strict=True))
    else:
        pairs = [(d, lanczos(F.lit(float(d)) - at)) for d in range(-2, 4)]
    return F.array(*(F.struct(F.lit(d).alias("d"), w.cast("double").alias("w")) for d, w in pairs))


#: Rows and columns of a cell, the unit in which pixels meet targets.
CELL = 16
#: Taps before and behind a target's own pixel.
REACH = {"bilinear": (0, 1), "bicubic": (1, 2), "lanczos3": (2, 3)}


def _dense(side: int):
    """Lists of (place, value) as arrays of side * side: the sums of the values (0 where there are none) and, unless each
    place has one value, the pixels and the values of each place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = side * side
        for rb in batches:
            lists = rb.column("_pixels")
            ends = lists.offsets.to_numpy()
            flat = lists.flatten()
            place, v = (flat.field(f) for f in ("p", "v"))
            at = np.repeat(np.arange(rb.num_rows, dtype=np.int64) * n, np.diff(ends)) + place.to_numpy(zero_copy_only=False)
            there = v.is_valid().to_numpy(zero_copy_only=False)
            cells = rb.num_rows * n
            # Not bincount's weights: they would do as well, but sums of one value must be that value, NaN and -0.0 included.
            sums = np.zeros(cells)
            np.add.at(sums, at[there], v.drop_null().to_numpy(zero_copy_only=False))
            pixels, values = np.bincount(at, minlength=cells), np.bincount(at[there], minlength=cells)
            whole = (pixels == 1).reshape(-1, n).all(axis=1) & (values == 1).reshape(-1, n).all(axis=1)
            starts = pa.array(np.arange(rb.num_rows + 1, dtype=np.int32) * n)
            counts = [pa.ListArray.from_arrays(starts, pa.array(c.astype(np.int32)), mask=pa.array(whole)) for c in (pixels, values)]
            rest = [(c, rb.column(c)) for c in rb.schema.names if c != "_pixels"]
            done = [*rest, ("_v", pa.ListArray.from_arrays(starts, pa.array(sums))), *zip(("_n", "_m"), counts, strict=True)]
            yield pa.RecordBatch.from_arrays([c for _, c in done], names=[name for name, _ in done])

    return run


def cells(px: DataFrame, on: list[str], before: int, behind: int) -> DataFrame:
    """Cells of an image with what their targets' taps reach: on, _cr, _cc, and dense arrays _v, _n, _m of `_dense`.

    A pixel near an edge is in both cells beside it, so each target needs one cell.
    """
    side = CELL + before + behind
    over = lambda c: F.explode(F.sequence(F.floor((F.col(c) - behind) / F.lit(float(CELL))), F.floor((F.col(c) + before) / F.lit(float(CELL)))))
    each = px.select(*on, "row", "col", F.col("v").cast("double").alias("v")).withColumn("_cr", over("row")).withColumn("_cc", over("col"))
    place = (F.col("row") - F.col("_cr") * CELL + before) * side + F.col("col") - F.col("_cc") * CELL + before
    packed = each.groupBy(*on, "_cr", "_cc").agg(F.collect_list(F.struct(place.cast("int").alias("p"), "v")).alias("_pixels"))
    kinds = [*packed.drop("_pixels").schema.fields, *T.StructType.fromDDL("_v array<double>, _n array<int>, _m array<int>").fields]
    return packed.mapInArrow(_dense(side), T.StructType(kinds))


def resample(px: DataFrame, targets: DataFrame, on: list[str], keep: list[str], mode: str, width: int, height: int) -> DataFrame:
    """Sample an image of width x height at the targets' fractional row and col.

    on: key columns that px and targets share; keep: the targets' own columns. nearest cuts
    off the fraction. Taps beyond the edge are the edge's pixels, but lanczos3 leaves them
    out and divides by the weights that are left. Taps without a pixel are left out; a target
    without any has no row. Targets outside the image have no row.

    Pixels are packed into cells that hold all taps of their targets, so a target is one row of one
    equi-join, whatever its taps are, and no aggregate follows; adaptive execution may split the targets of a cell.
    """
    inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < height) & (F.col("col") < width)
    at = targets.where(inside)
    ons = [c for c in on if c not in keep]
    # Targets are mostly exploded, and Spark expects far too few of them: it would broadcast them.
    if mode == "nearest":
        at = at.select(*keep, *ons, F.floor("row").cast("long").alias("row"), F.floor("col").cast("long").alias("col"))
        return at.join(px.hint("merge"), [*on, "row", "col"]).select(*keep, "v")
    before, behind = REACH[mode]
    side, taps = CELL + before + behind, F.array(*map(F.lit, range(before + behind + 1)))
    at = at.withColumn("_r", F.floor("row")).withColumn("_c", F.floor("col"))
    at = at.withColumns({"_wy": _taps(F.col("row") - F.col("_r"), mode), "_wx": _taps(F.col("col") - F.col("_c"), mode), "_cr": F.floor(F.col("_r") / F.lit(float(CELL))), "_cc": F.floor(F.col("_c") / F.lit(float(CELL)))})

    def places(pixel: str, cell: str, size: int) -> Column:
        """The taps' rows or columns, counted from the cell's first."""
        tap = lambda i: F.col(pixel) + i - before
        cut = tap if mode == "lanczos3" else lambda i: F.greatest(F.least(tap(i), F.lit(size - 1)), F.lit(0))
        return F.transform(taps, lambda i: (cut(i) - F.col(cell) * CELL + before).cast("int"))

    at = at.select(*keep, *ons, "_cr", "_cc", F.col("_wy.w").alias("_wy"), F.col("_wx.w").alias("_wx"), F.transform(places("_r", "_cr", height), lambda y: y * side).alias("_y"), places("_c", "_cc", width).alias("_x"))
    hit = at.join(cells(px, on, before, behind).hint("merge"), [*on, "_cr", "_cc"])
    all_taps = F.sequence(F.lit(0), F.lit(before + behind))

    def fold(value: str) -> Column:
        """Sum over the taps of weight * value; value is SQL of the place p."""
        inner = f"aggregate(_t, 0D, (b, j) -> b + _wx[j] * {value.format(p='_y[i] + _x[j]')})"
        return F.expr(f"aggregate(_t, 0D, (a, i) -> a + _wy[i] * {inner})")

    some = lambda c: F.expr(f"{c} is null or exists(_y, y -> exists(_x, x -> {c}[y + x] > 0))")
    hit = hit.withColumn("_t", all_taps).where(some("_n"))
    total = F.when(some("_m"), fold("_v[{p}]"))
    return hit.select(*keep, (total / fold("if(_n is null, 1, _n[{p}])") if mode == "lanczos3" else total).alias("v"))


def decimation(pixels: Column) -> Column:
    """Step of a region read: 1, or the least that brings it to MAX_READ pixels."""
    return F.when(pixels > MAX_READ, F.ceil(F.sqrt(pixels / F.lit(float(MAX_READ))))).otherwise(F.lit(1)).cast("int")


def read_region(px: DataFrame, col_off: int, row_off: int, width: int, height: int, step: int = 1) -> DataFrame:
    """A window of an image, every step-th row and column, counted from the window's corner.

    The range of row and col reaches the scan of a stored pixel table.
    """
    win = px.where(F.col("row").between(row_off, row_off + height - 1) & F.col("col").between(col_off, col_off + width - 1))
    win = win.withColumns({"row": F.col("row") - row_off, "col": F.col("col") - col_off})
    if step > 1:
        win = win.where((F.col("row") % step == 0) & (F.col("col") % step == 0))
        win = win.withColumns({"row": F.expr(f"row div {step}"), "col": F.expr(f"col div {step}")})
    return win


def blocks(images: DataFrame, size: int = 512, overlap: int = 0) -> DataFrame:
    """Blocks of images (width, height): block_row, block_col, the trimmed window and the one with its halo."""
    n = lambda c: F.expr(f"explode(sequence(0, greatest(cast(ceil({c} / {size}) as int) - 1, 0)))")
    out = images.where("width > 0 and height > 0").withColumn("block_row", n("height")).withColumn("block_col", n("width"))
    col, row = F.col("block_col") * size, F.col("block_row") * size
    w, h = F.least(F.lit(size), F.col("width") - col), F.least(F.lit(size), F.col("height") - row)
    out = out.withColumns({"col_off": col, "row_off": row, "w": w, "h": h})
    col0, row0 = F.greatest(F.lit(0), col - overlap), F.greatest(F.lit(0), row - overlap)
    halo = {"halo_col": col0, "halo_row": row0, "halo_w": F.least(F.col("width"), col + w + overlap) - col0, "halo_h": F.least(F.col("height"), row + h + overlap) - row0}
    return out.withColumns(halo)


# ---------------------------------------------------------------- tiles


def tile_pixels(tiles: DataFrame, size: int = 256) -> DataFrame:
    """A row for each pixel of tiles (z, x, y): ty, tx, and its centre lng, lat."""
    out = tiles.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    x0, y0, x1, y1 = grid.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return _centres(out, x0, y0, x1, y1, size, size)


def map_pixels(maps: DataFrame, width: int, height: int) -> DataFrame:
    """A row for each pixel of maps (x0, y0, x1, y1 in Mercator metres): ty, tx, lng, lat."""
    out = maps.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return _centres(out, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), width, height)


def _centres(out: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> DataFrame:
    half = F.lit(0.5)
    wx = x0 + (F.col("tx") + half) / F.lit(float(width)) * (x1 - x0)
    wy = y1 - (F.col("ty") + half) / F.lit(float(height)) * (y1 - y0)
    return out.withColumn("lng", grid.merc_lng(wx)).withColumn("lat", grid.merc_lat(wy))


def locate(points: DataFrame, corners: tuple[float, float, float, float], width: int, height: int, x: str = "lng", y: str = "lat") -> DataFrame:
    """Adds fractional row and col of points in an image that spans west, south, east, north."""
    w, s, e, n = corners
    u = (F.col(x) - F.lit(float(w))) / F.lit(float(e - w))
    v = (F.col(y) - F.lit(float(s))) / F.lit(float(n - s))
    return points.withColumn("col", u * F.lit(width - 1.0)).withColumn("row", (F.lit(1.0) - v) * F.lit(height - 1.0))


def window(tiles: DataFrame, corners: tuple[float, float, float, float], width: int, height: int, code: int | systems.System = 4326) -> DataFrame:
    """Adds the window of image pixels that tiles (z, x, y) can touch, and the step to read it with.

    corners: west, south, east, north in the CRS `code`; the tile's corners are moved there.
    """
    x0, y0, x1, y1 = grid.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    w, s, e, n = corners
    out = tiles.withColumns({"_x0": grid.merc_lng(x0), "_y0": grid.merc_lat(y0), "_x1": grid.merc_lng(x1), "_y1": grid.merc_lat(y1)})
    points = {f"_p{i}": F.struct(*(c.alias(f"col{j}") for j, c in enumerate(crs.from_wgs84(F.col(x), F.col(y), code), 1))) for i, (x, y) in enumerate((("_x0", "_y1"), ("_x1", "_y1"), ("_x0", "_y0"), ("_x1", "_y0")))}
    out = out.withColumns(points)
    cols = [F.round((F.col(f"_p{i}.col1") - w) / (e - w) * (width - 1.0)).cast("long") for i in range(4)]
    rows = [F.round((1.0 - (F.col(f"_p{i}.col2") - s) / (n - s)) * (height - 1.0)).cast("long") for i in range(4)]
    zero = F.lit(0).cast("long")
    out = out.withColumns({"_c0": F.greatest(F.least(*cols), zero), "_c1": F.greatest(*cols), "_r0": F.greatest(F.least(*rows), zero), "_r1": F.greatest(*rows)})
    out = out.withColumn("col_off", F.least(F.greatest(F.col("_c0") - PADDING, zero), F.lit(width - 1))).withColumn("row_off", F.least(F.greatest(F.col("_r0") - PADDING, zero), F.lit(height - 1)))
    out = out.withColumn("src_w", F.least(F.greatest(F.col("_c1") - F.col("_c0") + 2 * PADDING, F.lit(1)), F.lit(width) - F.col("col_off")))
    out = out.withColumn("src_h", F.least(F.greatest(F.col("_r1") - F.col("_r0") + 2 * PADDING, F.lit(1)), F.lit(height) - F.col("row_off")))
    out = out.drop("_x0", "_y0", "_x1", "_y1", *points, "_c0", "_c1", "_r0", "_r1")
    return out.withColumn("step", decimation(F.col("src_w") * F.col("src_h")))


def grey_tile(px: DataFrame, tiles: DataFrame, limits: tuple[Column, Column], corners: tuple[float, float, float, float], width: int, height: int, mode: str = "nearest", size: int = 256, sentinel: Column | None = None) -> DataFrame:
    """Tiles of a one-band image: z, x, y, ty, tx, grey; transparent pixels have no row."""
    at = locate(tile_pixels(tiles, size), corners, width, height)
    got = valid(resample(px, at, [], ["z", "x", "y", "ty", "tx"], mode, width, height), sentinel)
    return got.select("z", "x", "y", "ty", "tx", to_byte(F.col("v"), *limits).alias("grey"))


def compose_rgb(bytes_: DataFrame, by: list[str], bands: list[int]) -> DataFrame:
    """Red, green, blue of the first three bands asked for; a pixel with a band that is no data is left out.

    bytes_: by, band, byte (null where it is no data).
    """
    if not bands or min(bands) < 1:
        raise ValueError("bands count from 1, and one is needed")
    use = bands[:3]
    pivot = [F.max(F.when(F.col("band") == b, F.col("byte"))) for b in use]
    named = [p.alias(n) for p, n in zip(pivot, ("red", "green", "blue"), strict=False)]
    out = bytes_.where(F.col("band").isin(use)).groupBy(*by).agg(*named).dropna(subset=["red", "green", "blue"][: len(use)])
    for n in ("red", "green", "blue")[len(use) :]:
        out = out.withColumn(n, F.lit(0))
    return out


def map_image(px: DataFrame, maps: DataFrame, limits: tuple[Column, Column], corners: tuple[float, float, float, float], size: tuple[int, int], image: tuple[int, int], by: list[str], transparent: bool = False, sentinel: Column | None = None) -> DataFrame:
    """Maps of any bounding box: by, ty, tx, grey, alpha. Nearest pixel by rounding; white where there is none, unless transparent."""
    w, h = image
    at = locate(map_pixels(maps, *size), corners, w, h)
    away = lambda c: F.signum(c) * F.floor(F.abs(c) + F.lit(0.5))
    at = at.select(*by, "ty", "tx", away(F.col("row")).cast("long").alias("row"), away(F.col("col")).cast("long").alias("col"))
    got = at.join(px, ["row", "col"], "left")
    bad = F.col("v").isNull() | paths.is_nodata(F.col("v"), F.lit(None).cast("double") if sentinel is None else sentinel)
    none = F.lit(0) if transparent else F.lit(255)
    return got.select(*by, "ty", "tx", F.when(bad, none).otherwise(to_byte(F.col("v"), *limits)).alias("grey"), F.when(bad, none).otherwise(F.lit(255)).alias("alpha"))
