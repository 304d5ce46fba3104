"""Features and tiles: spatial filters and joins.

A feature table has a bounding box xmin, ymin, xmax, ymax in degrees beside its geometry.
The join with tiles is an equi-join on the cell of a coarse grid, with the exact
bounds as a residue: features and tiles list the cells they touch. A box has a zoom of its own, the finest at which it touches 2x2 cells at most,
and is listed there and at coarser zooms, so a feature the size of the world costs as
few rows as a point, and a tile of any zoom looks into a few cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions import geometry, grid

#: Zooms of cells, finest first; a box takes the first at which it touches at most 2x2 cells.
ZOOMS = (12, 8, 4, 0)


def _index(lng: Column, lat: Column, z: int) -> tuple[Column, Column]:
    """Cell of a point, with what lies beyond the grid in its outermost cells."""
    top = F.lit((1 << z) - 1).cast("long")
    x, y = grid.tile_index(lng, grid.clamp(lat), z)
    zero = F.lit(0).cast("long")
    return F.greatest(F.least(x, top), zero), F.greatest(F.least(y, top), zero)


def cells(boxes: DataFrame) -> DataFrame:
    """A row for each cell (cz, cx, cy) that a box touches at its own zoom and all coarser ones.

    own: whether cz is the box's own zoom; fx, fy: its first cell there. A box without bounds has none.
    """
    spans, own = [], None
    for z in ZOOMS:
        x0, y0 = _index(F.col("xmin"), F.col("ymax"), z)
        x1, y1 = _index(F.col("xmax"), F.col("ymin"), z)
        spans.append(F.struct(F.lit(z).alias("z"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
        fits = (x1 - x0 <= 1) & (y1 - y0 <= 1)
        own = F.when(fits, z) if own is None else own.when(fits, z)
    out = boxes.where("xmin is not null and ymin is not null and xmax is not null and ymax is not null")
    out = out.withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("_s", F.explode(F.array(*spans))).where("_s.z <= _own")
    out = out.withColumn("cx", F.explode(F.sequence("_s.x0", "_s.x1"))).withColumn("cy", F.explode(F.sequence("_s.y0", "_s.y1")))
    return out.withColumns({"cz": F.col("_s.z"), "own": F.col("_s.z") == F.col("_own"), "fx": F.col("_s.x0"), "fy": F.col("_s.y0")}).drop("_s", "_own")


def looks(tiles: DataFrame) -> DataFrame:
    """A row for each cell (cz, cx, cy) in which a tile (z, x, y, west, south, east, north) looks.

    At the finest zoom of cells no finer than the tile it meets all boxes (top); at coarser
    ones only boxes of that zoom. A tile has a few cells at each.
    """
    spans = []
    for cz in ZOOMS:
        x0, y0 = _index(F.col("west"), F.col("north"), cz)
        x1, y1 = _index(F.col("east"), F.col("south"), cz)
        zero = F.lit(0).cast("long")
        spans.append(F.struct(F.lit(cz).alias("z"), F.greatest(x0 - 1, zero).alias("x0"), F.greatest(y0 - 1, zero).alias("y0"), x1.alias("x1"), y1.alias("y1")))
    out = tiles.withColumn("_s", F.explode(F.array(*spans))).where("_s.z <= z")
    finest = F.lit(0)
    for cz in reversed(ZOOMS):
        finest = F.when(F.col("z") >= cz, cz).otherwise(finest)
    out = out.withColumn("top", F.col("_s.z") == finest)
    out = out.withColumn("cx", F.explode(F.sequence("_s.x0", "_s.x1"))).withColumn("cy", F.explode(F.sequence("_s.y0", "_s.y1")))
    return out.withColumns({"cz": F.col("_s.z"), "lx": F.col("_s.x0"), "ly": F.col("_s.y0")}).drop("_s")


def rects(tiles: DataFrame) -> DataFrame:
    """Adds west, south, east, north to tiles (z, x, y)."""
    w, s, e, n = grid.tile_rect(F.col("z"), F.col("x"), F.col("y"))
    return tiles.withColumns({"west": w, "south": s, "east": e, "north": n})


def tile_join(features: DataFrame, tiles: DataFrame) -> DataFrame:
    """Features whose box meets a tile's rectangle (edges count): the features' columns and z, x, y, west, south, east, north."""
    hit = cells(features).join(looks(rects(tiles)), ["cz", "cx", "cy"]).where("top or own")
    hit = hit.where("xmin <= east and xmax >= west and ymin <= north and ymax >= south")
    # Of the cells that both list, the first counts.
    hit = hit.where("cx = greatest(fx, lx) and cy = greatest(fy, ly)")
    return hit.drop("cz", "cx", "cy", "fx", "fy", "lx", "ly", "own", "top")


def meets(column: str = "geometry"):
    """An Arrow function for mapInArrow: rows whose GeoJSON geometry meets their tile's rectangle, exactly."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rect = zip(*(rb.column(c).to_pylist() for c in ("west", "south", "east", "north")), strict=True)
            ok = []
            for g, r in zip(rb.column(column).to_pylist(), rect, strict=True):
                shape = geometry.from_geojson(json.loads(g)) if g else None
                ok.append(shape is not None and geometry.meets(*shape, r))
            yield rb.filter(pa.array(ok, pa.bool_()))

    return run


def exact_join(features: DataFrame, tiles: DataFrame, column: str = "geometry") -> DataFrame:
    """`tile_join`, and the exact test of the geometries that passed it."""
    near = tile_join(features, tiles)
    return near.mapInArrow(meets(column), near.schema)


def feature_json(geometry_json: Column, id_: Column | None = None, props: Column | None = None) -> Column:
    """Text of one feature; geometry and properties are JSON texts."""
    parts = [F.lit('{"type":"Feature",')]
    if id_ is not None:
        parts += [F.when(id_.isNotNull(), F.concat(F.lit('"id":'), id_.cast("string"), F.lit(","))).otherwise(F.lit(""))]
    props = F.lit("null") if props is None else F.coalesce(props, F.lit("null"))
    return F.concat(*parts, F.lit('"geometry":'), geometry_json, F.lit(',"properties":'), props, F.lit("}"))


def collections(features: DataFrame, by: list[str], order: str, feature: str = "feature") -> DataFrame:
    """One FeatureCollection text for each tile, features in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(feature).alias("f"))))
    texts = F.transform(pairs, lambda p: p["f"])
    return features.groupBy(*by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(texts, ","), F.lit("]}")).alias("geojson"), F.count(F.lit(1)).alias("n_features"))


def attach(geometries: DataFrame, attributes: DataFrame, on: str = "rec_no") -> DataFrame:
    """Geometries with their attributes by record number; null where a record has none."""
    return geometries.join(attributes, on, "left")


def extent(features: DataFrame, by: list[str]) -> DataFrame:
    """Bounds of all features; zeros where there are none."""
    zero = F.lit(0.0)
    return features.groupBy(*by).agg(*(F.coalesce(f(c), zero).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))))
