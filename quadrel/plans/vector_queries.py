"""Queries on features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrel.operators import vector
from quadrel.plans.grid_queries import rect_sql
from quadrel.plans.registry import query
from quadrel.sources import fixtures

#: Tiles asked for: all of zoom 3, a block of zoom 6, one of zoom 13.
ASKED = [(3, x, y) for x in range(8) for y in range(8)] + [(6, x, y) for x in range(28, 36) for y in range(28, 36)] + [(13, 4096, 4095)]
_TILES = "select cast(z as int) as z, cast(x as bigint) as x, cast(y as bigint) as y from (values " + ", ".join(map(str, ASKED)) + ") t(z, x, y)"
_RECTS = rect_sql(_TILES)


def _tiles(spark):
    return spark.createDataFrame(ASKED, "z int, x long, y long")


def _point_boxes(spark, sf_dir):
    return fixtures.pts(spark, sf_dir).select("event_id", "event_type", "props", "value", F.col("lng").alias("xmin"), F.col("lat").alias("ymin"), F.col("lng").alias("xmax"), F.col("lat").alias("ymax"))


@query("vector_tile_points", f"select z, x, y, event_id from ({fixtures.SQL_PTS}) join ({_RECTS}) on lng <= east and lng >= west and lat <= north and lat >= south")
def vector_tile_points(spark, sf_dir):
    return vector.tile_join(_point_boxes(spark, sf_dir), _tiles(spark)).select("z", "x", "y", "event_id")


@query("vector_tile_boxes", f"select z, x, y, count(*) as n, cast(sum(event_id) as bigint) as ids from ({fixtures.SQL_BOXES}) join ({_RECTS}) on xmin <= east and xmax >= west and ymin <= north and ymax >= south group by z, x, y")
def vector_tile_boxes(spark, sf_dir):
    return vector.tile_join(fixtures.boxes(spark, sf_dir), _tiles(spark)).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def diamonds(spark, sf_dir):
    """The boxes' inscribed diamonds as GeoJSON polygons."""
    mx, my = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    ring = [(mx, F.col("ymin")), (F.col("xmax"), my), (mx, F.col("ymax")), (F.col("xmin"), my), (mx, F.col("ymin"))]
    text = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *(F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]")) for x, y in ring)), F.lit("]]}"))
    return fixtures.boxes(spark, sf_dir).withColumn("geometry", text)


#: A diamond and a rectangle meet if the rectangle's nearest point to the centre lies in the diamond.
@query(
    "vector_tile_polygons",
    f"""select z, x, y, event_id from (select *, (xmin+xmax)/2 as mx, (ymin+ymax)/2 as my, (xmax-xmin)/2 as half from ({fixtures.SQL_BOXES})) join ({_RECTS}) on xmin <= east and xmax >= west and ymin <= north and ymax >= south
    where abs(greatest(least(mx,east),west)-mx)+abs(greatest(least(my,north),south)-my) <= half""",
)
def vector_tile_polygons(spark, sf_dir):
    return vector.exact_join(diamonds(spark, sf_dir), _tiles(spark)).select("z", "x", "y", "event_id")


_POINT = """'{"type":"Feature","id":' || event_id || ',"geometry":{"type":"Point","coordinates":[' || printf('%.4f', lng) || ',' || printf('%.4f', lat) || ']},"properties":' || props || '}'"""


@query("vector_tile_geojson", f"""select z, x, y, '{{"type":"FeatureCollection","features":[' || string_agg({_POINT}, ',' order by event_id) || ']}}' as geojson, count(*) as n_features from ({fixtures.SQL_PTS}) join ({_RECTS}) on lng <= east and lng >= west and lat <= north and lat >= south group by z, x, y""")
def vector_tile_geojson(spark, sf_dir):
    hits = vector.tile_join(_point_boxes(spark, sf_dir), _tiles(spark))
    point = F.concat(F.lit('{"type":"Point","coordinates":['), F.format_string("%.4f", "xmin"), F.lit(","), F.format_string("%.4f", "ymin"), F.lit("]}"))
    hits = hits.withColumn("feature", vector.feature_json(point, F.col("event_id"), F.col("props")))
    return vector.collections(hits, ["z", "x", "y"], "event_id")


@query("layer_extent", f"select event_type as layer, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from ({fixtures.SQL_BOXES}) join events using (event_id) group by event_type")
def layer_extent(spark, sf_dir):
    kinds = fixtures.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("layer"))
    return vector.extent(fixtures.boxes(spark, sf_dir).join(kinds, "event_id"), ["layer"])


@query("attr_join", "select o_orderkey as rec_no, o_totalprice, l_quantity from orders left join (select l_orderkey, l_quantity from lineitem where l_linenumber = 2) on o_orderkey = l_orderkey")
def attr_join(spark, sf_dir):
    geometries = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_no"), "o_totalprice")
    attributes = fixtures.table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("rec_no"), "l_quantity")
    return vector.attach(geometries, attributes)


@query("props_json", "select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def props_json(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
