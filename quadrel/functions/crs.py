"""Coordinate reference systems as column expressions.

Known: 3857, the codes of `systems` and transverse Mercator with parameters. Anything else is
null, never a guess.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions import grid, systems
from quadrel.functions.ellipsoid import ALPHA, BETA, DELTA, E2, RECTIFYING

# UTM.
UTM_SCALE = 0.9996
FALSE_EAST = 500000.0
FALSE_NORTH = 10000000.0


def _d(x: float) -> Column:
    return F.lit(float(x))


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def parse(name: Column) -> Column:
    """EPSG code of a CRS name, null if unknown."""
    c = F.translate(F.upper(name), " _-", "")
    zone = F.regexp_extract(c, "UTM[^0-9]{0,16}([0-9]{1,2})[^0-9NS][^NS]{0,15}[NS]|UTM[^0-9]{0,16}([0-9]{1,2})[NS]", 0)
    number = F.regexp_extract(zone, "([0-9]{1,2})[^0-9]*$", 1).try_cast("int")
    north = zone.endswith("N")
    titled = F.try_element_at(_literal({_compact(name): code for code, name, _ in systems.names()}, "map<string, int>"), c)
    code = F.regexp_extract(c, "(?:^|[^A-Z0-9])EPSG:*(?:[0-9]+[.][0-9.]*:)?([0-9]{1,5})$", 1).try_cast("int")
    return (
        F.when(c.rlike("EPSG:*3857|WEBMERCATOR|PSEUDOMERCATOR|AUXILIARYSPHERE|EPSG:*900913"), 3857)
        .when(titled.isNotNull(), titled)
        .when(number.between(1, 60), F.when(north, 32600).otherwise(32700) + number)
        .when(c.rlike("EPSG:*4326|CRS84|WGS84|WGS1984"), 4326)
        .when(known(code), code)
        .cast("int")
    )


def known(code: Column) -> Column:
    """Whether coordinates of a code can be moved."""
    return code.isin([c for c, _, _ in systems.names()])


def _literal(value: dict, kind: str) -> Column:
    """A constant map, as one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _compact(name: str) -> str:
    return name.upper().translate(str.maketrans("", "", " _-"))


def prj(text: Column) -> Column:
    """EPSG code of a .prj text: its last AUTHORITY, which names the whole, else its name."""
    code = F.regexp_extract(text, '(?s).*AUTHORITY\\["EPSG",\\s*"?([0-9]{4,6})"?\\]', 1).try_cast("int")
    code = F.when(code == 900913, 3857).otherwise(code)
    named = parse(F.regexp_extract(text, '^\\s*[A-Z]+\\["([^"]*)"', 1))
    return F.coalesce(F.when(known(code), code), named).cast("int")


def tm_forward(lng: Column, lat: Column, lon0: Column, lat0: float = 0.0, k: float = UTM_SCALE, fe: float = FALSE_EAST, fn: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing by transverse Mercator."""
    x, y = _tm(lng - lon0, lat)
    origin = _tm_north(lat0) if lat0 else 0.0
    fn = _d(0) if fn is None else fn
    return _d(fe) + _d(k * RECTIFYING) * x, fn + _d(k * RECTIFYING) * (y - _d(origin))


def _tm(dlng: Column, lat: Column) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(dlng)
    t = F.sinh(F.atanh(F.sin(phi)) - _d(E2) * F.atanh(_d(E2) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(_d(1) + t * t))
    east = eta + _sum([_d(a) * F.cos(_d(2 * j) * xi) * F.sinh(_d(2 * j) * eta) for j, a in enumerate(ALPHA, 1)])
    north = xi + _sum([_d(a) * F.sin(_d(2 * j) * xi) * F.cosh(_d(2 * j) * eta) for j, a in enumerate(ALPHA, 1)])
    return east, north


def _tm_north(lat: float) -> float:
    s = math.sin(math.radians(lat))
    xi = math.atan(math.sinh(math.atanh(s) - E2 * math.atanh(E2 * s)))
    return xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(ALPHA, 1))


def tm_inverse(x: Column, y: Column, lon0: Column, lat0: float = 0.0, k: float = UTM_SCALE, fe: float = FALSE_EAST, fn: Column | None = None) -> tuple[Column, Column]:
    """Longitude and latitude of a transverse Mercator point."""
    fn = _d(0) if fn is None else fn
    xi = (y - fn) / _d(k * RECTIFYING) + _d(_tm_north(lat0) if lat0 else 0.0)
    eta = (x - _d(fe)) / _d(k * RECTIFYING)
    xi1 = xi - _sum([_d(b) * F.sin(_d(2 * j) * xi) * F.cosh(_d(2 * j) * eta) for j, b in enumerate(BETA, 1)])
    eta1 = eta - _sum([_d(b) * F.cos(_d(2 * j) * xi) * F.sinh(_d(2 * j) * eta) for j, b in enumerate(BETA, 1)])
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + _sum([_d(d) * F.sin(_d(2 * j) * chi) for j, d in enumerate(DELTA, 1)])
    return lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def _utm(code: Column) -> tuple[Column, Column, Column]:
    """Whether a code is UTM, its central meridian and false northing."""
    north, south = code.between(32601, 32660), code.between(32701, 32760)
    zone = code % 100
    return north | south, (zone * 6 - 183).cast("double"), F.when(south, _d(FALSE_NORTH)).otherwise(_d(0))


def from_wgs84(lng: Column, lat: Column, code: Column | int | systems.System, others: Iterable[int] = ()) -> tuple[Column, Column]:
    """Coordinates in a known CRS, null in others.

    A number, or a system itself, gives the expression of that system alone. A column may hold systems in degrees,
    3857, UTM on WGS84, and those of `others`: each of them adds its formula to the plan.
    """
    if isinstance(code, int | systems.System):
        return _one(lng, lat, code, grid.lng_merc, grid.lat_merc, systems.forward)
    utm, lon0, fn = _utm(code)
    e, n = tm_forward(lng, lat, lon0, fn=fn)
    flat = code.isin(list(systems.GEOGRAPHIC))
    x = F.when(flat, lng).when(code == 3857, grid.lng_merc(lng)).when(utm, e)
    y = F.when(flat, lat).when(code == 3857, grid.lat_merc(lat)).when(utm, n)
    return _with_others(x, y, lng, lat, code, others, from_wgs84)


def to_wgs84(x: Column, y: Column, code: Column | int | systems.System, others: Iterable[int] = ()) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates in a known CRS, null in others; `code` and `others` as in `from_wgs84`."""
    if isinstance(code, int | systems.System):
        return _one(x, y, code, grid.merc_lng, grid.merc_lat, systems.inverse)
    utm, lon0, fn = _utm(code)
    lng, lat = tm_inverse(x, y, lon0, fn=fn)
    flat = code.isin(list(systems.GEOGRAPHIC))
    lng, lat = F.when(flat, x).when(code == 3857, grid.merc_lng(x)).when(utm, lng), F.when(flat, y).when(code == 3857, grid.merc_lat(y)).when(utm, lat)
    return _with_others(lng, lat, x, y, code, others, to_wgs84)


def _one(x: Column, y: Column, code: int | systems.System, merc_x, merc_y, move) -> tuple[Column, Column]:
    if code in systems.GEOGRAPHIC:
        return x, y
    if code == 3857:
        return merc_x(x), merc_y(y)
    system = code if isinstance(code, systems.System) else systems.known().get(code)
    return move(systems.COLUMNS, x, y, system) if system else (F.lit(None).cast("double"), F.lit(None).cast("double"))


def _with_others(x: Column, y: Column, a: Column, b: Column, code: Column, others: Iterable[int], move) -> tuple[Column, Column]:
    for other in others:
        u, v = move(a, b, int(other))
        x, y = x.when(code == other, u), y.when(code == other, v)
    return x, y


def corners(gt: Column, width: Column, height: Column) -> list[tuple[Column, Column]]:
    """The four corners of a raster from its transform (north up; rotation is not used)."""
    x0, y0 = F.get(gt, F.lit(0)), F.get(gt, F.lit(3))
    x1, y1 = x0 + width * F.get(gt, F.lit(1)), y0 + height * F.get(gt, F.lit(5))
    return [(x0, y0), (x1, y0), (x0, y1), (x1, y1)]


def let(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def extent(points: Column) -> Column:
    """[min x, min y, max x, max y] of an array of (x, y), null if a coordinate is missing."""

    def bounds(p: Column) -> Column:
        xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        gone = F.exists(p, lambda q: q["x"].isNull() | q["y"].isNull())
        return F.when(~gone, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))

    return let(points, bounds)


def guess(points: list[tuple[Column, Column]]) -> Column:
    """4326 or 3857 by the range of the corners, else null."""
    degrees = metres = F.lit(True)
    for x, y in points:
        degrees = degrees & (F.abs(x) <= 180.0) & (F.abs(y) <= 90.0)
        metres = metres & (F.abs(x) <= 20037508.34) & (F.abs(y) <= 20037508.34) & (F.abs(x) > 180.0)
    return F.when(degrees, 4326).when(metres, 3857)


def raster_extent(gt: Column, width: Column, height: Column, code: Column, others: Iterable[int] = ()) -> Column:
    """Extent in degrees by the declared code, else by the guess; `others` as in `from_wgs84`.

    Null for systems that are known and not among these: `projection.extent` takes them all.
    """
    points = corners(gt, width, height)
    use = F.coalesce(F.when(known(code), code), guess(points))

    def moved(p: Column) -> Column:
        x, y = to_wgs84(p["x"], p["y"], p["code"], others)
        return F.struct(x.alias("x"), y.alias("y"))

    def every(code: Column) -> Column:
        rows = F.array(*(F.struct(x.alias("x"), y.alias("y"), code.alias("code")) for x, y in points))
        return extent(F.transform(rows, moved))

    return let(use, every)


def name_table(names: DataFrame) -> DataFrame:
    """(code, name) with one name for each code, the first by `ord`; codes beyond 16 bits are left out."""
    ok = names.where(F.col("code").between(0, 65535))
    return ok.groupBy("code").agg(F.min_by("name", "ord").alias("name"))


def names(spark) -> DataFrame:
    """(code, name, ord) of the known systems, for `name_table`."""
    return spark.createDataFrame(systems.names(), "code int, name string, ord int")


def named(rows: DataFrame, names: DataFrame, code: str = "epsg") -> DataFrame:
    """Adds crs_name: the code's name, else EPSG:n, else unknown."""
    joined = rows.join(names.select(F.col("code").alias(code), F.col("name").alias("_name")), code, "left")
    text = F.coalesce(F.col("_name"), F.concat(F.lit("EPSG:"), F.col(code).cast("string")), F.lit("unknown"))
    return joined.withColumn("crs_name", text).drop("_name")
