import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrel.functions import geometry
from quadrel.operators import vector

SQUARE = ("Polygon", [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (8, 2), (8, 8), (2, 8)]])


@pytest.mark.parametrize(
    ("shape", "rect", "meets"),
    [
        (("Point", (1, 1)), (1, 1, 2, 2), True),
        (("Point", (0.9, 1)), (1, 1, 2, 2), False),
        (("LineString", [(0, 0), (4, 4)]), (1, 0, 3, 2), True),
        (("LineString", [(0, 3), (3, 0)]), (0, 0, 1, 1), False),
        (("LineString", [(0, 2), (2, 0)]), (0, 0, 1, 1), True),
        (SQUARE, (3, 3, 4, 4), False),
        (SQUARE, (0.5, 0.5, 1, 1), True),
        (SQUARE, (-5, -5, 20, 20), True),
        (SQUARE, (10, 10, 11, 11), True),
        (SQUARE, (2, 2, 8, 8), True),
        (("MultiPolygon", [SQUARE[1], [[(20, 0), (21, 0), (21, 1)]]]), (20.5, 0, 20.6, 0.1), True),
        (("GeometryCollection", [("Point", (50, 50)), SQUARE]), (1, 1, 1.5, 1.5), True),
    ],
)
def test_meets(shape, rect, meets):
    assert geometry.meets(*shape, rect) is meets


@settings(max_examples=200)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=3, max_size=3), st.integers(-5, 5), st.integers(-5, 5))
def test_triangle_meets_square_like_its_points(tri, x, y):
    # On a grid, a point of the triangle in the square means that they meet.
    inside = any(x <= a <= x + 1 and y <= b <= y + 1 for a, b in tri)
    if inside:
        assert geometry.meets("Polygon", [tri], (x, y, x + 1, y + 1))


@pytest.mark.parametrize("text", ["POINT (1 2)", "POINT Z (1 2 3)", "LINESTRING(0 0,1 1)", "POLYGON((0 0,1 0,1 1,0 0),(0.1 0.1,0.2 0.1,0.2 0.2,0.1 0.1))", "MULTIPOINT((1 1),(2 2))", "MULTIPOINT(1 1,2 2)", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,1 1))", "SRID=4326;POINT(1 2)"])
def test_wkt_and_geojson_agree(text):
    shape = geometry.from_wkt(text)
    again = geometry.from_geojson(json.loads(json.dumps(geometry.to_geojson(*shape))))
    assert geometry.bbox(*again) == geometry.bbox(*shape)


@pytest.mark.parametrize("text", ["", "POINT", "POINT (1)", "POINT (1 2", "CIRCLE (1 2)", "POINT (1 2) x"])
def test_bad_wkt(text):
    assert geometry.from_wkt(text) is None


def test_join_is_complete_and_single(spark):
    boxes = [(0, -180.0, -85.0, 180.0, 85.0), (1, 0.0, 0.0, 0.0, 0.0), (2, -0.5, -0.5, 0.5, 0.5), (3, 90.0, 40.0, 91.0, 41.0), (4, 179.9, -89.0, 180.0, 89.0), (5, None, 0.0, 1.0, 1.0), (6, -45.0, 0.0, -45.0, 0.0)]
    tiles = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1), (3, 4, 3), (3, 3, 4), (8, 128, 127), (13, 4096, 4095), (3, 3, 3), (3, 2, 3)]
    f = spark.createDataFrame(boxes, "id int, xmin double, ymin double, xmax double, ymax double")
    t = spark.createDataFrame(tiles, "z int, x long, y long")
    got = sorted((r.id, r.z, r.x, r.y) for r in vector.tile_join(f, t).collect())
    want = vector.rects(t).crossJoin(f).where("xmin <= east and xmax >= west and ymin <= north and ymax >= south")
    assert got == sorted((r.id, r.z, r.x, r.y) for r in want.collect()) and len(got) == len(set(got))


def test_extent_of_nothing(spark):
    f = spark.createDataFrame([("a", None, None, None, None)], "layer string, xmin double, ymin double, xmax double, ymax double")
    assert vector.extent(f, ["layer"]).first()[1:] == (0.0, 0.0, 0.0, 0.0)


def test_collection_is_json(spark):
    rows = spark.createDataFrame([(1, 2, '{"a":1}'), (1, 1, None)], "z int, id int, props string")
    rows = rows.withColumn("feature", vector.feature_json(F.lit('{"type":"Point","coordinates":[1,2]}'), F.col("id"), F.col("props")))
    doc = json.loads(vector.collections(rows, ["z"], "id").first().geojson)
    assert [f["id"] for f in doc["features"]] == [1, 2] and doc["features"][0]["properties"] is None
