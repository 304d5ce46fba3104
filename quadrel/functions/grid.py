"""Web Mercator tile grid as column expressions (zoom 0 to 30, 256 pixels a tile by default)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere's radius, half its girth, and the two latitude bounds in use.
RADIUS = 6378137.0
HALF = 20037508.342789244
LAT_TILE = 85.051129
LAT_EXTENT = 85.0511
MAX_ZOOM = 30


def _d(x: float) -> Column:
    return F.lit(float(x))


def pow2(z: Column | int) -> Column:
    """2 ** z as double, null outside 0..30."""
    z = F.lit(z) if isinstance(z, int) else z
    return F.when(z.between(0, MAX_ZOOM), F.pow(_d(2), z.cast("double")))


def tile_index(lng: Column, lat: Column, z: Column | int) -> tuple[Column, Column]:
    """Tile column and row that hold a point."""
    n = pow2(z)
    x = F.floor((lng + _d(180)) / _d(360) * n)
    y = F.floor((_d(1) - F.asinh(F.tan(F.radians(lat))) / F.pi()) / _d(2) * n)
    return x.cast("long"), y.cast("long")


def tile_bounds(z: Column | int, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """min x, min y, max x, max y of a tile in Mercator metres."""
    side = _d(2 * HALF) / pow2(z)
    x0, y1 = _d(-HALF) + x.cast("double") * side, _d(HALF) - y.cast("double") * side
    return x0, y1 - side, x0 + side, y1


def merc_lng(x: Column) -> Column:
    return x * _d(180) / _d(HALF)


def merc_lat(y: Column) -> Column:
    return F.degrees(_d(2) * (F.atan(F.exp(y / _d(RADIUS))) - F.pi() / _d(4)))


def lng_merc(lng: Column) -> Column:
    return lng * _d(HALF) / _d(180)


def lat_merc(lat: Column) -> Column:
    """Mercator y of a latitude within the extent's bounds."""
    return _d(RADIUS) * F.ln(F.tan(F.pi() / _d(4) + F.radians(clamp(lat, LAT_EXTENT)) / _d(2)))


def clamp(lat: Column, bound: float = LAT_TILE) -> Column:
    return F.greatest(F.least(lat, _d(bound)), _d(-bound))


def tile_rect(z: Column | int, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a tile in degrees."""
    x0, y0, x1, y1 = tile_bounds(z, x, y)
    return merc_lng(x0), clamp(merc_lat(y0)), merc_lng(x1), clamp(merc_lat(y1))


def flip_y(z: Column | int, y: Column) -> Column:
    """Row of the other counting direction, null if it is not on the grid."""
    last = (pow2(z) - _d(1)).cast("long")
    return F.when(y.between(F.lit(0), last), last - y)


def resolution(z: Column | int, size: int = 256) -> Column:
    """Metres of a pixel."""
    return _d(2 * HALF) / (_d(size) * pow2(z))


def scale_denominator(z: Column | int, size: int = 256) -> Column:
    """Scale at the standard pixel of 0.28 mm."""
    return resolution(z, size) / _d(0.00028)


def max_zoom(pixel: Column, degrees: Column) -> Column:
    """Least zoom whose pixels are no larger than those of a raster, 0 to 22."""
    metres = F.when(degrees, F.abs(pixel) * _d(111320)).otherwise(F.abs(pixel))
    z = F.ceil(F.log2(_d(2 * HALF) / (_d(256) * metres)))
    return F.when(metres > 0, F.greatest(F.least(z, F.lit(22)), F.lit(0))).otherwise(F.lit(22)).cast("int")


def bbox_zoom(x0: Column, x1: Column, width: Column) -> Column:
    """Zoom whose pixels are nearest to those of a map of this width, 0 to 22."""
    z = F.round(F.log2(width * _d(2 * HALF) / ((x1 - x0) * _d(256))))
    return F.when(x1 > x0, F.greatest(F.least(z, F.lit(22)), F.lit(0))).otherwise(F.lit(0)).cast("int")
