"""Queries on tiles and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrel.functions import crs, grid
from quadrel.plans.registry import query
from quadrel.sources import fixtures

C = repr(grid.HALF)
R = repr(grid.RADIUS)
PTS, REQS = fixtures.SQL_PTS, fixtures.SQL_REQS


def tiles_sql() -> str:
    return f"select distinct z, x, y from ({REQS})"


def tiles(spark, sf_dir):
    return fixtures.reqs(spark, sf_dir).select("z", "x", "y").distinct()


@query("tile_index_agg", f"select x, y, count(*) as n, round(sum(value), 4) as total from (select value, {fixtures.SQL_TX.format(z=10)} as x, {fixtures.SQL_TY.format(z=10)} as y from ({PTS})) group by x, y")
def tile_index_agg(spark, sf_dir):
    x, y = grid.tile_index(F.col("lng"), F.col("lat"), 10)
    return fixtures.pts(spark, sf_dir).groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


SIDE = f"(2*cast({C} as double)/power(cast(2 as double), z))"
BOUNDS = f"-cast({C} as double)+x*{SIDE} as x0, cast({C} as double)-y*{SIDE}-{SIDE} as y0, -cast({C} as double)+x*{SIDE}+{SIDE} as x1, cast({C} as double)-y*{SIDE} as y1"
LAT = "degrees(2*(atan(exp({y}/cast(6378137 as double)))-pi()/4))"
CLAMPED = "greatest(least({lat}, cast(85.051129 as double)), cast(-85.051129 as double))"


def rect_sql(of: str) -> str:
    """Tiles with their bounds in metres and degrees."""
    c = f"cast({C} as double)"
    return f"select *, x0*180/{c} as west, {CLAMPED.format(lat=LAT.format(y='y0'))} as south, x1*180/{c} as east, {CLAMPED.format(lat=LAT.format(y='y1'))} as north from (select *, {BOUNDS} from ({of}))"


@query("tile_bounds", "select z, x, y, round(x0,3)+0 as x0, round(y0,3)+0 as y0, round(x1,3)+0 as x1, round(y1,3)+0 as y1, round(west,6)+0 as west, round(south,6)+0 as south, round(east,6)+0 as east, round(north,6)+0 as north from (" + rect_sql(tiles_sql()) + ")")
def tile_bounds(spark, sf_dir):
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    metres = {n: F.round(c, 3) + F.lit(0.0) for n, c in zip(("x0", "y0", "x1", "y1"), grid.tile_bounds(z, x, y), strict=True)}
    degrees = {n: F.round(c, 6) + F.lit(0.0) for n, c in zip(("west", "south", "east", "north"), grid.tile_rect(z, x, y), strict=True)}
    return tiles(spark, sf_dir).withColumns(metres | degrees)


MY = "cast(6378137 as double)*ln(tan(pi()/4+radians(greatest(least(lat, cast(85.0511 as double)), cast(-85.0511 as double)))/2))"


@query("mercator_roundtrip", f"select event_id, round(mx,3) as mx, round(my,3) as my, round(mx*180/cast({C} as double),6) as lng, round({LAT.format(y='my')},6) as lat from (select event_id, lng*cast({C} as double)/180 as mx, {MY} as my from ({PTS}))")
def mercator_roundtrip(spark, sf_dir):
    out = fixtures.pts(spark, sf_dir).select("event_id", grid.lng_merc(F.col("lng")).alias("mx"), grid.lat_merc(F.col("lat")).alias("my"))
    return out.select("event_id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.round(grid.merc_lng(F.col("mx")), 6).alias("lng"), F.round(grid.merc_lat(F.col("my")), 6).alias("lat"))


@query("tms_flip", f"select z, x, y, case when y between 0 and cast(power(2,z) as bigint)-1 then cast(power(2,z) as bigint)-1-y end as tms_y from ({tiles_sql()})")
def tms_flip(spark, sf_dir):
    return tiles(spark, sf_dir).withColumn("tms_y", grid.flip_y(F.col("z"), F.col("y")))


@query("wmts_matrix", f"select cast(z as int) as z, cast(power(2,z) as bigint) as matrix_width, round(2*cast({C} as double)/(256*power(cast(2 as double),z)),6) as resolution, round(2*cast({C} as double)/(256*power(cast(2 as double),z))/cast(0.00028 as double),4) as scale from (select unnest(range(0,23)) as z)")
def wmts_matrix(spark, sf_dir):
    z = F.col("z")
    return spark.range(23).select(F.col("id").cast("int").alias("z")).select("z", grid.pow2(z).cast("long").alias("matrix_width"), F.round(grid.resolution(z), 6).alias("resolution"), F.round(grid.scale_denominator(z), 4).alias("scale"))


NAMES = ["EPSG:4326", "epsg:3857", "urn:ogc:def:crs:EPSG::3857", "urn:ogc:def:crs:OGC:1.3:CRS84", "WGS 84", "WGS_1984_UTM_Zone_33N", "WGS 84 / UTM zone 19S", "UTM 7 N", "UTM zone 61N", "WGS_1984_Web_Mercator_Auxiliary_Sphere", "Popular Visualisation Pseudo-Mercator", "EPSG:32633", "EPSG:32761", "EPSG:2154", "urn:ogc:def:crs:EPSG::3035", "WGS 84 / World Mercator", "EPSG:27700", "EPSG32701", "", "local"]
COMPACT = "replace(replace(replace(upper(name),' ',''),'_',''),'-','')"
_ZONE = "regexp_extract(c,'UTM[^0-9]{0,16}([0-9]{1,2})[^0-9NS][^NS]{0,15}[NS]|UTM[^0-9]{0,16}([0-9]{1,2})[NS]',0)"
_KNOWN = "(code in (4326,3857,2154,3035) or code between 32601 and 32661 or code between 32701 and 32761)"


@query(
    "crs_parse",
    f"""select name, cast(case when regexp_matches(c,'EPSG:*3857|WEBMERCATOR|PSEUDOMERCATOR|AUXILIARYSPHERE|EPSG:*900913') then 3857
    when c = 'WGS84/WORLDMERCATOR' then 3395 when number between 1 and 60 then case when zone like '%N' then 32600 else 32700 end + number
    when regexp_matches(c,'EPSG:*4326|CRS84|WGS84|WGS1984') then 4326 when {_KNOWN} then code end as int) as epsg
    from (select *, try_cast(regexp_extract(zone,'([0-9]{{1,2}})[^0-9]*$',1) as int) as number, try_cast(regexp_extract(c,'(?:^|[^A-Z0-9])EPSG:*([0-9]{{1,5}})$',1) as int) as code
    from (select name, {COMPACT} as c, {_ZONE.replace("c,", COMPACT + ",", 1)} as zone from (select unnest({NAMES!r}) as name)))""",
)
def crs_parse(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", crs.parse(F.col("name")).alias("epsg"))


def _series(coefs: list[float], f: str, g: str, x: str, e: str) -> str:
    return "+".join(f"cast({c!r} as double)*{f}({2 * j}*{x})*{g}({2 * j}*{e})" for j, c in enumerate(coefs, 1))


_KA = repr(crs.UTM_SCALE * crs.RECTIFYING)
ZONED = f"select event_id, lng, lat, cast(least(floor((lng+180)/6),59)+1 as int) as zone from ({PTS}) where abs(lat) < 80"
UTM_SQL = f"""select event_id, zone, 500000+cast({_KA} as double)*(eta+{_series(crs.ALPHA, "cos", "sinh", "xi", "eta")}) as e,
    case when lat < 0 then 10000000 else 0 end + cast({_KA} as double)*(xi+{_series(crs.ALPHA, "sin", "cosh", "xi", "eta")}) as n
    from (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam)/sqrt(1+t*t)) as eta from
    (select event_id, zone, lat, radians(lng-(zone*6-183)) as lam, sinh(atanh(sin(radians(lat)))-cast({crs.E2!r} as double)*atanh(cast({crs.E2!r} as double)*sin(radians(lat)))) as t from ({ZONED})))"""


def _zoned(spark, sf_dir):
    zone = (F.least(F.floor((F.col("lng") + 180) / 6), F.lit(59)) + 1).cast("int")
    return fixtures.pts(spark, sf_dir).where("abs(lat) < 80").select("event_id", "lng", "lat", zone.alias("zone"))


@query("utm_forward", f"select event_id, zone, round(e,3) as e, round(n,3) as n from ({UTM_SQL})")
def utm_forward(spark, sf_dir):
    code = F.col("zone") + F.when(F.col("lat") < 0, 32700).otherwise(32600)
    e, n = crs.from_wgs84(F.col("lng"), F.col("lat"), code)
    return _zoned(spark, sf_dir).select("event_id", "zone", F.round(e, 3).alias("e"), F.round(n, 3).alias("n"))


@query("utm_roundtrip", f"select event_id, round(lng,6) as lng, round(lat,6) as lat from ({ZONED})")
def utm_roundtrip(spark, sf_dir):
    code = F.col("zone") + F.when(F.col("lat") < 0, 32700).otherwise(32600)
    e, n = crs.from_wgs84(F.col("lng"), F.col("lat"), code)
    there = _zoned(spark, sf_dir).select("event_id", code.alias("code"), e.alias("e"), n.alias("n"))
    lng, lat = crs.to_wgs84(F.col("e"), F.col("n"), F.col("code"))
    return there.select("event_id", F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


@query("reproject_points", f"select event_id, cast(event_id%2 as int) as kind, round(case when event_id%2=0 then lng else lng*cast({C} as double)/180 end,4) as x, round(case when event_id%2=0 then lat else {MY} end,4) as y from ({PTS})")
def reproject_points(spark, sf_dir):
    code = F.when(F.col("event_id") % 2 == 0, 4326).otherwise(3857)
    x, y = crs.from_wgs84(F.col("lng"), F.col("lat"), code)
    return fixtures.pts(spark, sf_dir).select("event_id", (F.col("event_id") % 2).cast("int").alias("kind"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


# Textbook formulas in SQL, with the published parameters of four systems.
_PHI = {"t": "(tan(pi()/4-({p})/2)/pow((1-e*sin({p}))/(1+e*sin({p})),e/2))", "m": "(cos({p})/sqrt(1-e*e*sin({p})*sin({p})))", "q": "((1-e*e)*(sin({p})/(1-e*e*sin({p})*sin({p}))-ln((1-e*sin({p}))/(1+e*sin({p})))/(2*e)))"}


def _at(kind: str, lat: str) -> str:
    return _PHI[kind].format(p=f"radians({lat})")


_NATIONAL = [2154, 5070, 3031, 6933]
_CONES = f"""select event_id, code, lat, e, radians(d-360*floor((d+180)/360)) as lam,
    (ln({_at("m", "49e0")})-ln({_at("m", "44e0")}))/(ln({_at("t", "49e0")})-ln({_at("t", "44e0")})) as n,
    (pow({_at("m", "29.5e0")},2)-pow({_at("m", "45.5e0")},2))/({_at("q", "45.5e0")}-{_at("q", "29.5e0")}) as g,
    {_at("m", "71e0")}/{_at("t", "71e0")} as s, {_at("m", "30e0")} as k, {_at("t", "lat")} as t, {_at("t", "-lat")} as t_south, {_at("q", "lat")} as q
    from (select event_id, lat, sqrt(2/298.257223563e0-1/pow(298.257223563e0,2)) as e, [2154,5070,3031,6933][event_id%4+1] as code, lng-[3e0,-96e0,0e0,0e0][event_id%4+1] as d from ({PTS}) where abs(lat) < 80)"""
_RADII = f"""select *, {_at("m", "49e0")}/(n*pow({_at("t", "49e0")},n)) as f, pow({_at("m", "29.5e0")},2)+g*{_at("q", "29.5e0")} as c from ({_CONES})"""
NATIONAL_SQL = f"""select event_id, cast(code as int) as code,
    round(case code when 2154 then 700000+a*f*pow(t,n)*sin(n*lam) when 5070 then a*sqrt(c-g*q)/g*sin(g*lam) when 3031 then a*s*t_south*sin(lam) else a*k*lam end,2) as x,
    round(case code when 2154 then 6600000+a*f*(pow({_at("t", "46.5e0")},n)-pow(t,n)*cos(n*lam)) when 5070 then a*(sqrt(c-g*{_at("q", "23e0")})-sqrt(c-g*q)*cos(g*lam))/g when 3031 then a*s*t_south*cos(lam) else a*q/(2*k) end,2) as y
    from (select *, 6378137e0 as a from ({_RADII}))"""


@query("national_grids", NATIONAL_SQL)
def national_grids(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, _NATIONAL)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = fixtures.pts(spark, sf_dir).where("abs(lat) < 80").select("event_id", "lng", "lat", code.alias("code"))
    x, y = crs.from_wgs84(F.col("lng"), F.col("lat"), F.col("code"), _NATIONAL)
    return rows.select("event_id", "code", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


#: Rasters of 100x50 pixels at the points: in degrees, in metres, or in neither.
_GT = {"x0": f"case event_id%3 when 0 then lng when 1 then lng*cast({C} as double)/180 else lng*cast(1000000 as double) end", "px": "case event_id%3 when 0 then cast(0.001 as double) else cast(30 as double) end"}
_YT = f"case event_id%3 when 0 then lat when 1 then {MY} else lat*cast(1000000 as double) end"


@query(
    "extent_guess",
    f"""select event_id, cast(case when d then 4326 when m then 3857 end as int) as epsg,
    round(case when d then x0 when m then x0*180/cast({C} as double) end,6) as west, round(case when d then y0 when m then {LAT.format(y="y0")} end,6) as south,
    round(case when d then x1 when m then x1*180/cast({C} as double) end,6) as east, round(case when d then y1 when m then {LAT.format(y="y1")} end,6) as north
    from (select *, greatest(abs(x0),abs(x1))<=180 and greatest(abs(y0),abs(y1))<=90 as d, greatest(abs(x0),abs(x1),abs(y0),abs(y1))<=20037508.34 and least(abs(x0),abs(x1))>180 as m
    from (select event_id, x0, x0+100*px as x1, yt-50*px as y0, yt as y1 from (select event_id, {_GT["x0"]} as x0, {_GT["px"]} as px, {_YT} as yt from ({PTS}))))""",
)
def extent_guess(spark, sf_dir):
    kind = F.col("event_id") % 3
    x0 = F.when(kind == 0, F.col("lng")).when(kind == 1, grid.lng_merc(F.col("lng"))).otherwise(F.col("lng") * F.lit(1e6))
    y0 = F.when(kind == 0, F.col("lat")).when(kind == 1, grid.lat_merc(F.col("lat"))).otherwise(F.col("lat") * F.lit(1e6))
    px = F.when(kind == 0, F.lit(0.001)).otherwise(F.lit(30.0))
    gt = F.array(x0, px, F.lit(0.0), y0, F.lit(0.0), -px)
    rows = fixtures.pts(spark, sf_dir).select("event_id", gt.alias("gt"))
    w, h = F.lit(100), F.lit(50)
    e = crs.raster_extent(F.col("gt"), w, h, F.lit(None).cast("int"))
    rows = rows.select("event_id", crs.guess(crs.corners(F.col("gt"), w, h)).alias("epsg"), e.alias("e"))
    return rows.select("event_id", "epsg", *(F.round(F.get("e", F.lit(i)), 6).alias(n) for i, n in enumerate(("west", "south", "east", "north"))))


_ZOOM = "greatest(least(ceil(log2(2*cast({c} as double)/(256*{m}))),22),0)"


@query("max_zoom", f"select p_partkey, cast(case when m > 0 then {_ZOOM.format(c=C, m='m')} else 22 end as int) as z from (select p_partkey, case when p_partkey%2=0 then abs(p_retailprice/10) else abs(p_retailprice/1000000)*111320 end as m from part)")
def max_zoom(spark, sf_dir):
    even = F.col("p_partkey") % 2 == 0
    pixel = F.when(even, F.col("p_retailprice") / 10).otherwise(F.col("p_retailprice") / 1000000)
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", grid.max_zoom(pixel, ~even).alias("z"))


@query("bbox_zoom", f"select name, cast(greatest(least(round(log2(800*2*cast({C} as double)/((x1-x0)*256))),22),0) as int) as z from (select name, w*cast({C} as double)/180 as x0, e*cast({C} as double)/180 as x1 from ({fixtures.SQL_LAYERS}))")
def bbox_zoom(spark, sf_dir):
    rows = fixtures.layers(spark, sf_dir).select("name", grid.lng_merc(F.col("w")).alias("x0"), grid.lng_merc(F.col("e")).alias("x1"))
    return rows.select("name", grid.bbox_zoom(F.col("x0"), F.col("x1"), F.lit(800.0)).alias("z"))


# Names beside the library's own; the first of a code counts.
_MORE = [(3857, "another name", 1), (27700, "OSGB36 / British National Grid", 0), (900913, "too large", 0)]
_EPSG = "case p_partkey % 9 when 0 then 4326 when 1 then 3857 when 2 then 32633 when 3 then 32719 when 4 then 2154 when 5 then 25831 when 6 then 27700 when 7 then 2000 end"


@query(
    "crs_names",
    f"""select p_partkey, epsg, case when epsg is null then 'unknown' when epsg = 4326 then 'WGS 84' when epsg = 3857 then 'WGS 84 / Pseudo-Mercator'
    when epsg between 32601 and 32660 then 'WGS 84 / UTM zone ' || (epsg - 32600) || 'N' when epsg between 32701 and 32760 then 'WGS 84 / UTM zone ' || (epsg - 32700) || 'S'
    when epsg between 25828 and 25838 then 'ETRS89 / UTM zone ' || (epsg - 25800) || 'N' when epsg = 2154 then 'RGF93 v1 / Lambert-93'
    when epsg = 27700 then 'OSGB36 / British National Grid' else 'EPSG:' || epsg end as crs_name from (select p_partkey, {_EPSG} as epsg from part)""",
)
def crs_names(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "part").select("p_partkey", F.expr(_EPSG).alias("epsg"))
    more = spark.createDataFrame(_MORE, "code int, name string, ord int")
    return crs.named(rows, crs.name_table(crs.names(spark).unionByName(more)))
