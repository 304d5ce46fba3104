"""Spatial views over the test tables, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Coordinates of the views, valid in both engines.
LNG = "cast((event_id*7919+user_id*104729)%3600000 as double)/cast(10000 as double)-cast(180 as double)"
LAT = "cast((event_id*15485863+user_id*32452843)%1600000 as double)/cast(10000 as double)-cast(80 as double)"
SQL_PTS = f"select event_id, {LNG} as lng, {LAT} as lat, event_type, value, ts, props, user_id from events"
SQL_TX = "cast(floor((lng+180)/360*power(cast(2 as double),{z})) as bigint)"
SQL_TY = "cast(floor((1-asinh(tan(radians(lat)))/pi())/2*power(cast(2 as double),{z})) as bigint)"
#: Chunks in a row of the mosaic.
ACROSS = 25
SQL_PX = "select label, vec_id, (pos-1)//8 as r, (pos-1)%8 as c, cast(embedding[pos] as double) as v from (select label, vec_id, embedding, unnest(range(1,65)) as pos from embeddings)"
SQL_MOSAIC = f"select cast(8*(vec_id//{ACROSS})+r as bigint) as row, cast(8*(vec_id%{ACROSS})+c as bigint) as col, v from ({SQL_PX})"
SQL_BANDS3 = f"select vec_id//3 as chunk, cast(vec_id%3+1 as int) as band, r, c, v from (select vec_id, r, c, v from ({SQL_PX}) union all select vec_id+(select count(*) from embeddings), r, c, v from ({SQL_PX}) where vec_id < (select (3-count(*)%3)%3 from embeddings))"
SQL_BOXES = f"select event_id, lng as xmin, lat as ymin, lng+cast((event_id*31)%100 as double)/cast(100 as double) as xmax, lat+cast((event_id*31)%100 as double)/cast(100 as double) as ymax from ({SQL_PTS})"
SQL_REQS = f"select event_id, ts, event_type as layer, cast(event_id%12 as int) as z, {SQL_TX.format(z='event_id%12')} as x, {SQL_TY.format(z='event_id%12')} as y from ({SQL_PTS})"
EXTS = ["tif", "tiff", "geojson", "json", "shp", "wkt", "kml", "kmz", "txt"]
SQL_SRCS = "select name, ext, case when ext in ('tif','tiff') then 'raster' when ext in ('geojson','json','wkt','kml','kmz','shp') then 'vector' end as kind, p_partkey from (select p_partkey, ['tif','tiff','geojson','json','shp','wkt','kml','kmz','txt'][p_partkey%9+1] as ext, 'src_' || p_partkey || '.' || ext as name from part)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: event_id, lng, lat, event_type, value, ts, props, user_id."""
    return table(spark, sf_dir, "events").select("event_id", F.expr(LNG).alias("lng"), F.expr(LAT).alias("lat"), "event_type", "value", "ts", "props", "user_id")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 8x8 chunks: label, vec_id, r, c, v."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("pos", "e"))
    return rows.select("label", "vec_id", F.expr("pos div 8").alias("r"), (F.col("pos") % 8).cast("long").alias("c"), F.col("e").cast("double").alias("v"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks side by side, ACROSS to a row: row, col, v."""
    return px(spark, sf_dir).select(F.expr(f"8 * (vec_id div {ACROSS}) + r").alias("row"), F.expr(f"8 * (vec_id % {ACROSS}) + c").alias("col"), "v")


def mosaic_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Width and height of the mosaic."""
    n = table(spark, sf_dir, "embeddings").count()
    return 8 * ACROSS, 8 * (-(-n // ACROSS))


def bands3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks as the bands of one: chunk, band, r, c, v. The first chunks fill up the last."""
    n = table(spark, sf_dir, "embeddings").count()
    rows = px(spark, sf_dir).select("vec_id", "r", "c", "v")
    if n % 3:
        rows = rows.union(rows.where(F.col("vec_id") < 3 - n % 3).withColumn("vec_id", F.col("vec_id") + n))
    return rows.select(F.expr("vec_id div 3").alias("chunk"), F.expr("cast(vec_id % 3 + 1 as int)").alias("band"), "r", "c", "v")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, xmin, ymin, xmax, ymax."""
    side = F.expr("cast((event_id*31)%100 as double)/cast(100 as double)")
    return pts(spark, sf_dir).select("event_id", F.col("lng").alias("xmin"), F.col("lat").alias("ymin"), (F.col("lng") + side).alias("xmax"), (F.col("lat") + side).alias("ymax"))


def reqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile requests: event_id, ts, layer, z, x, y."""
    from quadrel.functions import grid

    z = (F.col("event_id") % 12).cast("int")
    x, y = grid.tile_index(F.col("lng"), F.col("lat"), z)
    return pts(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("layer"), z.alias("z"), x.alias("x"), y.alias("y"))


def srcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources: name, ext, kind, p_partkey."""
    from quadrel.functions import paths

    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    named = table(spark, sf_dir, "part").select(F.concat(F.lit("src_"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("name"), "p_partkey")
    return named.select("name", paths.extension(F.col("name")).alias("ext"), paths.kind(paths.extension(F.col("name"))).alias("kind"), "p_partkey")


#: Raster layers with an extent: the raster sources of `srcs`.
_LAYER = "cast({n}%{m} as double)/cast(10 as double)"
W_EXPR = _LAYER.format(n="(p_partkey*37)", m=3400) + "-cast(180 as double)"
S_EXPR = _LAYER.format(n="(p_partkey*53)", m=1500) + "-cast(80 as double)"
W_SIDE = _LAYER.format(n="(p_partkey*7)", m=97) + "+cast(0.5 as double)"
SQL_LAYERS = f"select name, kind, ext, w, s, w+side as e, s+side/cast(2 as double) as n, cast(p_partkey%23 as int) as max_zoom from (select name, kind, ext, p_partkey, {W_EXPR} as w, {S_EXPR} as s, {W_SIDE} as side from ({SQL_SRCS})) where kind is not null"


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows: name, kind, ext, w, s, e, n (degrees), max_zoom."""
    side = F.expr(W_SIDE)
    rows = srcs(spark, sf_dir).where("kind is not null").select("name", "kind", "ext", "p_partkey", F.expr(W_EXPR).alias("w"), F.expr(S_EXPR).alias("s"), side.alias("side"))
    return rows.select("name", "kind", "ext", "w", "s", (F.col("w") + F.col("side")).alias("e"), (F.col("s") + F.col("side") / F.lit(2.0)).alias("n"), (F.col("p_partkey") % 23).cast("int").alias("max_zoom"))
