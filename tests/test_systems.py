"""Projected systems: published points and constants, their defining properties, and both forms alike."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.functions import crs, projection, systems
from quadrel.functions.ellipsoid import A_AXIS
from quadrel.functions.ellipsoid import E2 as ECC

#: A place within each kind of system.
PLACES = {2154: (2.35, 48.85), 3035: (5.0, 50.0), 3031: (120.0, -75.0), 3413: (-45.5, 71.25), 3577: (149.1, -35.3), 5070: (-77.0, 38.9), 3338: (-149.9, 61.2)}
PLACES |= {3395: (-0.1, 51.5), 6933: (100.25, -41.5), 6931: (170.0, 66.0), 6932: (-60.0, -64.75), 3571: (-175.0, 70.0), 4547: (114.3, 30.6), 4507: (105.5, 29.5), 6677: (139.7, 35.7), 2193: (174.8, -36.85), 25832: (9.0, 53.5), 2157: (-6.25, 53.35), 5186: (127.0, 37.5), 3948: (1.4, 48.1), 3112: (133.9, -23.7), 5041: (44.0, 73.0)}


@pytest.mark.parametrize(
    ("code", "place", "expected"),
    [
        # Worked examples of the public guidance note on coordinate conversions.
        (3035, (5.0, 50.0), (3962799.45, 2999718.85)),
        (3032, (120.0, -75.0), (7255380.79, 7053389.56)),
        (5041, (44.0, 73.0), (3320416.75, 632668.43)),
    ],
)
def test_published_points(code, place, expected):
    assert projection.forward(*map(np.float64, place), code) == pytest.approx(expected, abs=0.01)
    assert projection.inverse(*map(np.float64, expected), code) == pytest.approx(place, abs=1e-6)


def test_published_constants_of_lambert_93():
    s = systems.known()[2154]
    assert s.n == pytest.approx(0.7256077650, abs=1e-10)
    assert s.c * A_AXIS == pytest.approx(11754255.426, abs=1e-2)
    assert s.fn + s.r0 * A_AXIS == pytest.approx(12655612.050, abs=1e-2)


@pytest.mark.parametrize("code", sorted(systems.known()))
def test_there_and_back(code):
    s = systems.known()[code]
    lng, lat = projection.inverse(np.float64(s.fe + 120000.0), np.float64(s.fn - 230000.0 + (400000.0 if code == 3794 else 0.0)), code)
    assert projection.forward(lng, lat, code) == pytest.approx((s.fe + 120000.0, s.fn - 230000.0 + (400000.0 if code == 3794 else 0.0)), abs=1e-3)


@pytest.mark.parametrize("code", sorted(PLACES))
def test_shape_or_area_is_kept(code):
    lng, lat = PLACES[code]
    step = 1e-5
    f = lambda a, b: np.array(projection.forward(np.float64(a), np.float64(b), code))
    s = math.sin(math.radians(lat))
    along = A_AXIS * math.cos(math.radians(lat)) / math.sqrt(1 - ECC**2 * s * s)
    up = A_AXIS * (1 - ECC**2) / (1 - ECC**2 * s * s) ** 1.5
    east = (f(lng + step, lat) - f(lng - step, lat)) / (2 * math.radians(step) * along)
    north = (f(lng, lat + step) - f(lng, lat - step)) / (2 * math.radians(step) * up)
    turned = east[0] * north[1] - east[1] * north[0]
    assert turned > 0  # not mirrored
    if systems.known()[code].method in ("tm", "merc", "conformal"):
        assert np.dot(east, north) == pytest.approx(0, abs=1e-6) and np.hypot(*east) == pytest.approx(np.hypot(*north), rel=1e-6)
    else:
        assert turned == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize(("code", "lat"), [(2154, 49), (2154, 44), (5070, 29.5), (5070, 45.5), (3577, -36), (3413, 70), (3031, -71), (6933, 30), (3994, -41)])
def test_scale_is_true_on_the_standard_parallels(code, lat):
    lon0 = systems.known()[code].lon0
    a, b = (np.array(projection.forward(np.float64(lon0 + d), np.float64(lat), code)) for d in (-1e-4, 1e-4))
    s = math.sin(math.radians(lat))
    assert np.hypot(*(b - a)) == pytest.approx(math.radians(2e-4) * A_AXIS * math.sqrt((1 - s * s) / (1 - ECC**2 * s * s)), rel=1e-8)


def test_poles_and_the_date_line():
    assert projection.forward(np.float64(10.0), np.float64(-90.0), 3031) == pytest.approx((0, 0), abs=1e-6)
    assert projection.inverse(np.float64(0.0), np.float64(0.0), 6931)[1] == pytest.approx(90, abs=1e-6)
    east, west = (projection.forward(np.float64(v), np.float64(52.0), 3338)[0] for v in (179.999, -179.999))
    assert abs(east - west) < 500
    lng, _ = projection.inverse(np.float64(-2e6), np.float64(1e6), 3413)
    assert -180 <= lng < 180


def test_columns_agree_with_arrays(spark):
    some = [2154, 3035, 3031, 5070, 3395, 6933, 4547]  # of each method
    rows = spark.createDataFrame([(c, *PLACES[c]) for c in some], "code int, lng double, lat double")
    x, y = crs.from_wgs84(F.col("lng"), F.col("lat"), F.col("code"), some)
    there = spark.createDataFrame(rows.select("*", x.alias("x"), y.alias("y")).collect())
    lng, lat = crs.to_wgs84(F.col("x"), F.col("y"), F.col("code"), some)
    for r in there.select("*", lng.alias("a"), lat.alias("b")).collect():
        assert (r.x, r.y) == pytest.approx(projection.forward(np.float64(r.lng), np.float64(r.lat), r.code), abs=1e-6)
        assert (r.a, r.b) == pytest.approx((r.lng, r.lat), abs=1e-8)


@pytest.mark.parametrize("code", sorted(PLACES))
def test_extent_of_rasters_in_any_system(code):
    x, y = projection.forward(*map(np.float64, PLACES[code]), code)
    assert projection.extent([float(x), 1e-3, 0.0, float(y), 0.0, -1e-3], 1, 1, code) == pytest.approx([*PLACES[code]] * 2, abs=1e-6)


def test_extent_of_unknown_systems_is_guessed():
    assert projection.extent([10.0, 0.1, 0.0, 50.0, 0.0, -0.1], 10, 10, 27700) == pytest.approx([10, 49, 11, 50])
    assert projection.extent([5e7, 1.0, 0.0, 5e7, 0.0, -1.0], 10, 10, None) is None and projection.extent(None, 1, 1, 4326) is None


def test_names(spark):
    table = systems.names()
    assert len({c for c, _, _ in table}) == len(table)
    found = dict((c, n) for c, n, _ in table)
    assert (found[32633], found[4547], found[28355], found[31983]) == ("WGS 84 / UTM zone 33N", "CGCS2000 / 3-degree Gauss-Kruger CM 114E", "GDA94 / MGA zone 55", "SIRGAS 2000 / UTM zone 23S")
    rows = spark.createDataFrame([(2154,), (27700,), (None,)], "epsg int")
    named = {r.epsg: r.crs_name for r in crs.named(rows, crs.name_table(crs.names(spark))).collect()}
    assert named == {2154: "RGF93 v1 / Lambert-93", 27700: "EPSG:27700", None: "unknown"}


def test_names_and_codes_are_parsed(spark):
    asked = ["EPSG:2154", "urn:ogc:def:crs:EPSG::3035", "urn:ogc:def:crs:EPSG:9.9:5070", "WGS 84 / World Mercator", "NAD83 / UTM zone 10N", "EPSG:27700", "EPSG:999999", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(asked)], "i int, name string")
    assert [r.epsg for r in rows.select("i", crs.parse(F.col("name")).alias("epsg")).orderBy("i").collect()] == [2154, 3035, 5070, 3395, 26910, None, None, None]


def test_unknown_systems_are_null_or_an_error(spark):
    x, y = crs.from_wgs84(F.lit(1.0), F.lit(1.0), 27700)
    assert tuple(spark.range(1).select(x, y).first()) == (None, None)
    with pytest.raises(ValueError, match="unknown CRS 27700"):
        projection.forward(np.float64(1), np.float64(1), 27700)
