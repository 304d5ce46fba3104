"""Queries on the catalogue, service documents, requests and stored tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrel.functions import paths
from quadrel.operators import catalog, ogc, tilestore
from quadrel.plans.grid_queries import C, MY
from quadrel.plans.registry import query
from quadrel.sources import fixtures

SRCS, LAYERS, REQS = fixtures.SQL_SRCS, fixtures.SQL_LAYERS, fixtures.SQL_REQS
RASTERS = f"select * from ({LAYERS}) where kind = 'raster'"


@query("source_kind", f"select ext, kind, count(*) as n from ({SRCS}) group by ext, kind")
def source_kind(spark, sf_dir):
    return fixtures.srcs(spark, sf_dir).groupBy("ext", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_listing",
    f"""select name, origin, kind from (select *, row_number() over (partition by name order by prio) as i from
    (select name, 'config' as origin, kind, 0 as prio from ({SRCS}) where p_partkey % 4 = 0 union all select name, 'scan', kind, 1 from ({SRCS}))) where i = 1 and kind is not null order by name""",
)
def source_listing(spark, sf_dir):
    rows = fixtures.srcs(spark, sf_dir)
    config = rows.where("p_partkey % 4 = 0").select("name", F.lit("config").alias("origin"), "kind")
    return catalog.listing(catalog.first_by_priority(config, rows.select("name", F.lit("scan").alias("origin"), "kind")))


_ASKED = "select event_id, 'src_' || (event_id % 3000) || '.' || ['tif','tiff','geojson','json','shp','wkt','kml','kmz','txt'][event_id%3000%9+1] as layer from events"


def _asked(spark, sf_dir):
    n = F.col("event_id") % 3000
    ext = F.element_at(F.array(*map(F.lit, fixtures.EXTS)), (n % 9 + 1).cast("int"))
    return fixtures.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("src_"), n.cast("string"), F.lit("."), ext).alias("layer"))


@query("resolve_layer", f"select event_id, layer, kind from ({_ASKED}) join ({LAYERS}) on layer = name")
def resolve_layer(spark, sf_dir):
    return catalog.resolve(_asked(spark, sf_dir), fixtures.layers(spark, sf_dir).select("name", "kind"))


@query("missing_layer", f"select event_id, layer from ({_ASKED}) where layer not in (select name from ({LAYERS}))")
def missing_layer(spark, sf_dir):
    return catalog.missing(_asked(spark, sf_dir), fixtures.layers(spark, sf_dir))


@query("kind_mismatch", f"select kind, count(*) as n_415 from ({_ASKED}) join ({LAYERS}) on layer = name where (event_id%2=0 and kind='vector') or (event_id%2=1 and kind='raster') group by kind")
def kind_mismatch(spark, sf_dir):
    asked = F.when(F.col("event_id") % 2 == 0, "raster").otherwise("vector")
    rows = catalog.resolve(_asked(spark, sf_dir), fixtures.layers(spark, sf_dir).select("name", "kind"))
    return rows.where(F.col("kind") != asked).groupBy("kind").agg(F.count(F.lit(1)).alias("n_415"))


PATHS = ["a.tif", "sub/a.tif", "../a.tif", "a/../b.tif", "/etc/passwd", "a..b.tif", ".env", "a/.git/config", "", "..", "dir/.hidden", "x/..y"]
_PATHS = f"select unnest({PATHS!r}) as path"


@query("path_validate", f"select path, case when list_contains(string_split(path,'/'),'..') then 'traversal' when path like '/%' then 'absolute' else 'ok' end as verdict from ({_PATHS})")
def path_validate(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", paths.check(F.col("path")).alias("verdict"))


@query("dotfile_filter", f"select path, path like '.%' or path like '%/.%' as hidden from ({_PATHS})")
def dotfile_filter(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", paths.hidden(F.col("path")).alias("hidden"))


_LISTS = ["1,2,3", " 1 , 2", "x,2", "", "4294967296,7", "0,1", "3"]


@query("band_list_parse", f"select raw, array_to_string(list_filter(list_transform(string_split(raw,','), lambda s: try_cast(trim(s) as bigint)), lambda n: n is not null and n between 1 and 4294967295), '|') as bands from (select unnest({_LISTS!r}) as raw)")
def band_list_parse(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in _LISTS], "raw string")
    return rows.select("raw", F.array_join(paths.band_list(F.col("raw")), "|").alias("bands"))


_MODES = ["nearest", "Nearest-Neighbor", "Bilinear", "BICUBIC", "lanczos", "lanczos3", "linear", "stddev", "standard-deviation", "Percentile", "minmax", "", "other"]


@query(
    "mode_parse",
    f"""select raw, case when m = 'bilinear' then 'bilinear' when m = 'bicubic' then 'bicubic' when m in ('lanczos','lanczos3') then 'lanczos3' else 'nearest' end as resampling,
    case when m = 'percentile' then 'percentile' when m in ('stddev','standard-deviation') then 'stddev' else 'minmax' end as stretch from (select raw, lower(raw) as m from (select unnest({_MODES!r}) as raw))""",
)
def mode_parse(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in _MODES], "raw string")
    return rows.select("raw", paths.resampling(F.col("raw")).alias("resampling"), paths.stretch(F.col("raw")).alias("stretch"))


_DEG = "printf('%.6f', {0})"


@query(
    "tilejson",
    f"""select name, '{{"tilejson":"3.0.0","name":"' || name || '","description":"' || kind || ' tile layer for ' || name || '","version":"1.0.0","attribution":"","scheme":"xyz","tiles":["http://localhost:8080/api/tiles/' || name || '/' || fmt || '/{{z}}/{{x}}/{{y}}"],"minzoom":0,"maxzoom":' || max_zoom
    || ',"bounds":[' || {_DEG.format("w")} || ',' || {_DEG.format("s")} || ',' || {_DEG.format("e")} || ',' || {_DEG.format("n")} || '],"center":[' || {_DEG.format("(w+e)/2")} || ',' || {_DEG.format("(s+n)/2")} || ',' || (max_zoom // 2) || '],"format":"' || fmt || '","type":"' || kind || '"}}' as json
    from (select *, case when kind = 'raster' then 'png' else 'geojson' end as fmt from ({LAYERS}))""",
)
def tilejson(spark, sf_dir):
    return ogc.tilejson(fixtures.layers(spark, sf_dir))


def _merc(lng: str, lat: str) -> tuple[str, str]:
    return f"{lng}*cast({C} as double)/180", MY.replace("lat", lat)


@query("wms_layers", f"select name, round({_merc('w', 's')[0]},3) as x0, round({_merc('w', 's')[1].replace('fs', 'fs')},3) as y0, round({_merc('e', 'n')[0]},3) as x1, round({_merc('e', 'n')[1]},3) as y1 from ({RASTERS})")
def wms_layers(spark, sf_dir):
    rows = ogc.metres(ogc.rasters(fixtures.layers(spark, sf_dir)))
    return rows.select("name", *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("tms_layers", f"select name, cast(z as int) as z, printf('%.10f', 2*cast({C} as double)/(256*power(cast(2 as double),z))) as units_per_pixel, 'http://localhost:8080/ogc/tms/1.0.0/' || name || '/' || z as href from (select name, unnest(range(0, least(max_zoom,22)+1)) as z from ({RASTERS}))")
def tms_layers(spark, sf_dir):
    return ogc.tms_sets(fixtures.layers(spark, sf_dir))


@query("union_extent", f"select min(w) as w, min(s) as s, max(e) as e, max(n) as n from ({RASTERS})")
def union_extent(spark, sf_dir):
    return ogc.union_extent(fixtures.layers(spark, sf_dir))


@query(
    "api_paths",
    f"""select replace(template,'{{filename}}',name) as path, name, op || '_' || regexp_replace(name,'[^A-Za-z0-9_]','_','g') as operation_id from ({LAYERS}),
    (values ('/api/tiles/{{filename}}/info','get_tile_info',''), ('/api/tiles/{{filename}}/png/{{z}}/{{x}}/{{y}}','get_raster_tile','raster'), ('/api/tiles/{{filename}}/webp/{{z}}/{{x}}/{{y}}','get_raster_tile_webp','raster'), ('/api/tiles/{{filename}}/geojson/{{z}}/{{x}}/{{y}}','get_vector_tile','vector')) t(template, op, need) where need = '' or need = kind order by path""",
)
def api_paths(spark, sf_dir):
    return ogc.api_paths(fixtures.layers(spark, sf_dir)).orderBy("path")


_KEY = ["layer", "z", "x", "y"]


@query("cache_outcome", f"select layer, count(*) filter (i=1) as misses, count(*) filter (i>1) as hits from (select *, row_number() over (partition by layer,z,x,y order by ts,event_id) as i from ({REQS})) group by layer")
def cache_outcome(spark, sf_dir):
    rows = tilestore.outcomes(fixtures.reqs(spark, sf_dir), _KEY, ["ts", "event_id"])
    return rows.groupBy("layer").agg(F.count_if(F.col("outcome") == "miss").alias("misses"), F.count_if(F.col("outcome") == "hit").alias("hits"))


@query("request_dedupe", f"select layer, z, x, y, count(*) as n_requests from ({REQS}) group by layer, z, x, y")
def request_dedupe(spark, sf_dir):
    return tilestore.dedupe(fixtures.reqs(spark, sf_dir), _KEY)


@query("render_queue", f"select layer, z, x, y, count(*) as n_requests, (cast(z as bigint) << 40) | (cast(x as bigint) << 20) | cast(y as bigint) as priority from ({REQS}) group by layer, z, x, y order by priority, layer")
def render_queue(spark, sf_dir):
    return tilestore.queue(fixtures.reqs(spark, sf_dir), _KEY)


_FILES = "select event_id || '.png' as path, ts as mtime, event_id % 997 + 100 as size from events"


@query(
    "cache_evict",
    f"""select path, cast(freed as bigint) as freed_before from (select path, mtime, size, coalesce(sum(size) over (order by cast(mtime as date), mtime, path rows between unbounded preceding and 1 preceding),0) as freed, sum(size) over () as total from ({_FILES}))
    where total > 1000000 and freed < total - 800000""",
)
def cache_evict(spark, sf_dir):
    files = fixtures.table(spark, sf_dir, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(".png")).alias("path"), F.col("ts").alias("mtime"), (F.col("event_id") % 997 + 100).alias("size"))
    return tilestore.evict(files, 1_000_000).select("path", F.col("freed_before").cast("long").alias("freed_before"))


@query("requests_by_hour", f"select date_trunc('hour', ts) as hour, layer, count(*) as n from ({REQS}) group by 1, 2")
def requests_by_hour(spark, sf_dir):
    from quadrel.streaming import requests

    return requests.hourly(fixtures.reqs(spark, sf_dir)).select(F.col("window.start").alias("hour"), "layer", "n")


_MIMES = ["a.png", "b.JPG", "c", "d.geojson", "e.tar.gz", "f.html", "g.svg"]


@query(
    "mime_type",
    """select path, case when path not like '%.%' then 'application/octet-stream' when path ilike '%.png' then 'image/png' when path ilike '%.jpg' or path ilike '%.jpeg' then 'image/jpeg' when path ilike '%.geojson' then 'application/geo+json'
    when path ilike '%.html' then 'text/html' when path ilike '%.svg' then 'image/svg+xml' else 'application/octet-stream' end as mime from (values ('a.png'), ('b.JPG'), ('c'), ('d.geojson'), ('e.tar.gz'), ('f.html'), ('g.svg')) t(path)""",
)
def mime_type(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _MIMES], "path string").select("path", paths.mime(F.col("path")).alias("mime"))


_REQUESTS = [("WMS", "GetMap", "a,b", "EPSG:3857", "0,0,1,1", "256"), ("wms", "getmap", "a", "EPSG:900913", " 0 , 0,1,1", "1"), ("WFS", "GetMap", "a", "EPSG:3857", "0,0,1,1", "256"), ("WMS", "GetFeature", "a", "EPSG:3857", "0,0,1,1", "256"), ("WMS", "GetMap", "", "EPSG:3857", "0,0,1,1", "256"), ("WMS", "GetMap", "a", "EPSG:4326", "0,0,1,1", "256"), ("WMS", "GetMap", "a", "EPSG:3857", "0,0,1", "256"), ("WMS", "GetMap", "a", "EPSG:3857", "0,0,1,x", "256"), ("WMS", "GetMap", "a", "EPSG:3857", "0,0,1,1", "4097"), ("WMS", "GetMap", "a", "EPSG:3857", "0,0,1,1", "wide")]


@query(
    "map_request_check",
    f"""select i, case when upper(service) <> 'WMS' then 'InvalidService' when lower(request) <> 'getmap' then 'OperationNotSupported' when trim(string_split(layers, ',')[1]) = '' then 'LayerNotDefined'
    when upper(crs) not in ('EPSG:3857','EPSG:900913') then 'InvalidCRS' when len(string_split(bbox, ',')) <> 4 or list_contains(list_transform(string_split(bbox, ','), lambda s: try_cast(trim(s) as double) is null), true) then 'InvalidBBox'
    when coalesce(try_cast(width as int) not between 1 and 4096, true) then 'InvalidDimensionValue' else 'ok' end as verdict from (values {", ".join(str((i, *r)) for i, r in enumerate(_REQUESTS))}) t(i, service, request, layers, crs, bbox, width)""",
)
def map_request_check(spark, sf_dir):
    keys = ["service", "REQUEST", "layers", "CRS", "bbox", "WIDTH"]
    rows = spark.createDataFrame([(i, dict(zip(keys, r, strict=True)) | {"HEIGHT": r[-1]}) for i, r in enumerate(_REQUESTS)], "i int, p map<string,string>")
    return rows.select("i", ogc.check_map_request(F.col("p")).alias("verdict"))


@query("tile_store_size", f"select count(*) as n_files, cast(sum(size) as bigint) as bytes from ({_FILES})")
def tile_store_size(spark, sf_dir):
    files = fixtures.table(spark, sf_dir, "events").select((F.col("event_id") % 997 + 100).alias("size"))
    return tilestore.size(files)


@query("base_url", "select host, 'http://' || coalesce(nullif(trim(host), ''), 'localhost:8080') as url from (values ('tiles.example.org'), (' h:80 '), (''), (null)) t(host)")
def base_url(spark, sf_dir):
    rows = spark.createDataFrame([("tiles.example.org",), (" h:80 ",), ("",), (None,)], "host string")
    return rows.select("host", ogc.base_url(F.col("host")).alias("url"))
