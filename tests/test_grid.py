import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrel.functions import crs, grid
from quadrel.sources.readers import inverse


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_origin_and_bounds(spark):
    z, x, y = F.lit(1), F.lit(1), F.lit(0)
    assert list(one(spark, *grid.tile_bounds(z, x, y))) == [0.0, 0.0, grid.HALF, grid.HALF]
    w, s, e, n = one(spark, *grid.tile_rect(z, x, y))
    assert (w, s, e) == (0.0, 0.0, 180.0) and n == pytest.approx(85.0511, abs=1e-3)


def test_zoom_outside_is_null(spark):
    assert one(spark, grid.pow2(F.lit(31)), grid.pow2(F.lit(-1)), grid.flip_y(F.lit(2), F.lit(4))) == (None, None, None)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lng=st.floats(-179.9, 179.9), lat=st.floats(-84, 84), z=st.integers(0, 18))
def test_tile_holds_its_point(spark, lng, lat, z):
    x, y = grid.tile_index(F.lit(lng), F.lit(lat), z)
    west, south, east, north = grid.tile_rect(z, x, y)
    r = one(spark, west, south, east, north, grid.flip_y(F.lit(z), grid.flip_y(F.lit(z), y)) == y)
    assert r[0] - 1e-9 <= lng <= r[2] + 1e-9 and r[1] - 1e-9 <= lat <= r[3] + 1e-9 and r[4]


def test_utm_known_points(spark):
    e, n = crs.from_wgs84(F.lit(3.0), F.lit(45.0), F.lit(32631))
    assert one(spark, F.round(e, 3), F.round(n, 3)) == (500000.0, 4982950.4)
    e, n = crs.from_wgs84(F.lit(0.0), F.lit(0.0), F.lit(32631))
    assert one(spark, F.round(e, 3), F.round(n, 3)) == (166021.443, 0.0)


@pytest.mark.parametrize("code", [4326, 3857, 32633, 32719])
def test_there_and_back(spark, code):
    x, y = crs.from_wgs84(F.lit(16.5), F.lit(-33.25 if code == 32719 else 48.25), F.lit(code))
    row = one(spark, x, y)
    lng, lat = inverse(code)(*row)
    back = one(spark, *crs.to_wgs84(F.lit(row[0]), F.lit(row[1]), F.lit(code)))
    assert back == pytest.approx((lng, lat), abs=1e-9)
    if code != 32719:  # far outside its zone
        assert back == pytest.approx((16.5, 48.25), abs=1e-6)


def test_tm_with_parameters(spark):
    lon0 = F.lit(-2.0)
    x, y = crs.tm_forward(F.lit(-1.5), F.lit(52.0), lon0, 49.0, 0.9996012717, 400000.0, F.lit(-100000.0))
    lng, lat = crs.tm_inverse(x, y, lon0, 49.0, 0.9996012717, 400000.0, F.lit(-100000.0))
    assert one(spark, lng, lat) == pytest.approx((-1.5, 52.0), abs=1e-7)


def test_unknown_code_is_null(spark):
    assert one(spark, *crs.from_wgs84(F.lit(1.0), F.lit(1.0), F.lit(27700))) == (None, None)


def test_prj_uses_the_last_authority(spark):
    text = 'PROJCS["WGS 84 / UTM zone 33N",GEOGCS["WGS 84",SPHEROID["WGS 84",6378137,298.25,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32633"]]'
    other = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]'
    assert one(spark, crs.prj(F.lit(text)), crs.prj(F.lit(other)), crs.prj(F.lit("nothing"))) == (32633, 4326, None)


def test_extent_guess(spark):
    gt = F.array(*map(F.lit, (10.0, 0.1, 0.0, 50.0, 0.0, -0.1)))
    far = F.array(*map(F.lit, (5e7, 1.0, 0.0, 5e7, 0.0, -1.0)))
    row = one(spark, crs.raster_extent(gt, F.lit(10), F.lit(10), F.lit(None).cast("int")), crs.raster_extent(far, F.lit(10), F.lit(10), F.lit(None).cast("int")))
    assert row[0] == pytest.approx([10.0, 49.0, 11.0, 50.0]) and row[1] is None


def test_scale(spark):
    assert one(spark, grid.scale_denominator(0))[0] == pytest.approx(559082264.0287178)
    assert one(spark, grid.max_zoom(F.lit(0.0), F.lit(False)), grid.max_zoom(F.lit(2 * math.pi * grid.RADIUS / 256), F.lit(False))) == (22, 0)
