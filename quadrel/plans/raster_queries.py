"""Queries on pixels: statistics, stretch, overviews, sampling and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrel.functions import paths
from quadrel.operators import raster, render
from quadrel.plans.registry import query
from quadrel.plans.grid_queries import C, LAT, rect_sql
from quadrel.sources import fixtures

PX, MOSAIC, BANDS3 = fixtures.SQL_PX, fixtures.SQL_MOSAIC, fixtures.SQL_BANDS3
#: A sentinel that occurs once values are rounded to one digit.
ND = 0.1


def labelled(spark, sf_dir):
    """All chunks of a label as one band, with rows in the order of the chunks."""
    return fixtures.px(spark, sf_dir).select(F.col("label").alias("raster"), F.lit(1).alias("band"), (F.col("vec_id") * 8 + F.col("r")).alias("row"), F.col("c").alias("col"), "v")


@query("nodata_filter", f"select label, count(*) as n from ({PX}) where round(v,1) <> cast({ND} as double) group by label")
def nodata_filter(spark, sf_dir):
    px = fixtures.px(spark, sf_dir).withColumn("v", F.round("v", 1))
    return raster.valid(px, F.lit(ND)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


TAGS = ["-9999", " 0 ", "nan", "NaN extra", "1e3", "-1.5E-2", "+inf", "-Infinity", "abc", "", "12abc", ".5", "7 8"]


@query(
    "nodata_parse",
    f"""select tag, case when w = 'nan' then 'nan' when w in ('inf','+inf','infinity','+infinity') then 'inf' when w in ('-inf','-infinity') then '-inf' when v is null then 'none' else 'number' end as kind,
    case when w in ('nan','inf','+inf','infinity','+infinity','-inf','-infinity') then null else v end as v
    from (select tag, w, case when regexp_matches(w,'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$') then try_cast(w as double) end as v from (select tag, lower(regexp_extract(tag,'([^ ]+)',1)) as w from (select unnest({TAGS!r}) as tag)))""",
)
def nodata_parse(spark, sf_dir):
    v = paths.nodata(F.col("tag"))
    inf = F.lit(float("inf"))
    rows = spark.createDataFrame([(t,) for t in TAGS], "tag string").select("tag", v.alias("v"))
    kind = F.when(F.col("v").isNull(), "none").when(F.isnan("v"), "nan").when(F.col("v") == inf, "inf").when(F.col("v") == -inf, "-inf").otherwise("number")
    return rows.select("tag", kind.alias("kind"), F.when(kind == "number", F.col("v")).alias("v"))


@query("band_stats", f"select label as raster, count(*) as n, round(min(v),9) as min_v, round(max(v),9) as max_v, round(avg(v),9) as mean_v, round(stddev_pop(v),9) as std_v from ({PX}) group by label")
def band_stats(spark, sf_dir):
    s = raster.band_stats(labelled(spark, sf_dir), ["raster", "band"])
    return s.select("raster", "n", *(F.round(c, 9).alias(c) for c in ("min_v", "max_v", "mean_v", "std_v")))


_PCT = "list_sort(list(v))[cast(floor(cast({p} as double)*(count(*)-1)) as bigint)+1]"
PCT_SQL = f"select label, {_PCT.format(p=0.02)} as lo, {_PCT.format(p=0.98)} as hi from ({PX}) group by label"


@query("percentile_bounds", f"select label as raster, lo, hi from ({PCT_SQL})")
def percentile_bounds(spark, sf_dir):
    return raster.percentiles(labelled(spark, sf_dir), ["raster", "band"]).select("raster", "lo", "hi")


@query("percentile_sampled", f"select label as raster, {_PCT.format(p=0.02)} as lo, {_PCT.format(p=0.98)} as hi from (select *, row_number() over (partition by label order by vec_id, r, c) as i from ({PX})) where i <= 1000 group by label")
def percentile_sampled(spark, sf_dir):
    return raster.percentiles(labelled(spark, sf_dir), ["raster", "band"], sample_cap=1000, order=["row", "col"]).select("raster", "lo", "hi")


BYTE = "cast(case when abs(hi-lo) > 2.220446049250313e-16 then floor(greatest(least((v-lo)/(hi-lo)*255,cast(255 as double)),cast(0 as double))) else 0 end as int)"


def _stretched(spark, sf_dir, method):
    px = labelled(spark, sf_dir)
    by = ["raster", "band"]
    limits = raster.bounds(raster.band_stats(px, by), by, method, 2.0, raster.percentiles(px, by) if method == "percentile" else None)
    return raster.stretch(px, limits, by).select("raster", "row", "col", "byte")


_ROWS = "label as raster, vec_id*8+r as row, c as col"


@query("stretch_minmax", f"select {_ROWS}, {BYTE} as byte from ({PX}) join (select label, min(v) as lo, max(v) as hi from ({PX}) group by label) using (label)")
def stretch_minmax(spark, sf_dir):
    return _stretched(spark, sf_dir, "minmax")


@query("stretch_percentile", f"select {_ROWS}, {BYTE} as byte from ({PX}) join ({PCT_SQL}) using (label)")
def stretch_percentile(spark, sf_dir):
    return _stretched(spark, sf_dir, "percentile")


@query("stretch_stddev", f"select {_ROWS}, {BYTE} as byte from ({PX}) join (select label, avg(v)-2*stddev_pop(v) as lo, avg(v)+2*stddev_pop(v) as hi from ({PX}) group by label) using (label)")
def stretch_stddev(spark, sf_dir):
    return _stretched(spark, sf_dir, "stddev")


@query("overview_l1", f"select row//2 as row, col//2 as col, round(avg(v),9) as v from ({MOSAIC}) group by row//2, col//2")
def overview_l1(spark, sf_dir):
    return raster.overview(fixtures.mosaic(spark, sf_dir), []).select("row", "col", F.round("v", 9).alias("v"))


@query("overview_l2", f"select row//2 as row, col//2 as col, round(avg(v),9) as v from (select row//2 as row, col//2 as col, avg(v) as v from ({MOSAIC}) group by row//2, col//2) group by row//2, col//2")
def overview_l2(spark, sf_dir):
    return raster.overview(raster.overview(fixtures.mosaic(spark, sf_dir), []), []).select("row", "col", F.round("v", 9).alias("v"))


SIZE = "(select 8*25 as w, 8*cast(ceil(count(*)/cast(25 as double)) as int) as h from embeddings)"
_OUT = "select t.row as orow, t.col as ocol, t.row/cast({s} as double)+cast({dy} as double) as y, t.col/cast({s} as double)+cast({dx} as double) as x, w, h from (select row, col from (select unnest(range(0, {s}*(select h from {size}))) as row), (select unnest(range(0, {s}*200)) as col)) t, {size}"


def _targets(spark, w, h, scale, dy, dx):
    """A target for each pixel of the output grid."""
    rows = spark.range(scale * h).select(F.col("id").alias("orow"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(scale * w - 1).cast("long"))).alias("ocol"))
    at = lambda c, d: F.col(c) / F.lit(float(scale)) + F.lit(float(d))
    return rows.select("orow", "ocol", at("orow", dy).alias("row"), at("ocol", dx).alias("col"))


def _sampled(spark, sf_dir, mode, scale, dy, dx):
    w, h = fixtures.mosaic_size(spark, sf_dir)
    out = raster.resample(fixtures.mosaic(spark, sf_dir), _targets(spark, w, h, scale, dy, dx), [], ["orow", "ocol"], mode, w, h)
    return out.select("orow", "ocol", F.round("v", 6).alias("v"))


def _kernel_sql(scale, dy, dx, taps, weight, clamp=True, normal=False):
    place = lambda p, n: f"greatest(least(cast(floor({p}) as bigint)+d{p},{n}-1),0)" if clamp else f"cast(floor({p}) as bigint)+d{p}"
    out = _OUT.format(s=scale, dy=dy, dx=dx, size=SIZE)
    w = f"{weight.format(t='(y-floor(y))', d='dy')}*{weight.format(t='(x-floor(x))', d='dx')}"
    total = "sum(wt*v)/sum(wt)" if normal else "sum(wt*v)"
    return f"select orow, ocol, round({total},6) as v from (select orow, ocol, {place('y', 'h')} as row, {place('x', 'w')} as col, {w} as wt from ({out}), (select unnest({taps}) as dy), (select unnest({taps}) as dx) where y < h and x < w) join ({MOSAIC}) using (row, col) group by orow, ocol"


@query("resample_nearest", f"select orow, ocol, round(v,6) as v from (select orow, ocol, cast(floor(y) as bigint) as row, cast(floor(x) as bigint) as col from ({_OUT.format(s=2, dy=0.25, dx=0.25, size=SIZE)}) where y < h and x < w) join ({MOSAIC}) using (row, col)")
def resample_nearest(spark, sf_dir):
    return _sampled(spark, sf_dir, "nearest", 2, 0.25, 0.25)


@query("resample_bilinear", _kernel_sql(2, 0, 0, "[0,1]", "case {d} when 0 then 1-{t} else {t} end"))
def resample_bilinear(spark, sf_dir):
    return _sampled(spark, sf_dir, "bilinear", 2, 0, 0)


@query("resample_bicubic", _kernel_sql(1, 0.25, 0.75, "[-1,0,1,2]", "0.5*case {d} when -1 then -{t}+2*{t}*{t}-{t}*{t}*{t} when 0 then 2-5*{t}*{t}+3*{t}*{t}*{t} when 1 then {t}+4*{t}*{t}-3*{t}*{t}*{t} else {t}*{t}*{t}-{t}*{t} end"))
def resample_bicubic(spark, sf_dir):
    return _sampled(spark, sf_dir, "bicubic", 1, 0.25, 0.75)


@query("resample_lanczos3", _kernel_sql(1, 0.25, 0.75, "[-2,-1,0,1,2,3]", "case when {d}-{t}=0 then 1 when abs({d}-{t})>=3 then 0 else sin(pi()*({d}-{t}))/(pi()*({d}-{t}))*sin(pi()*({d}-{t})/3)/(pi()*({d}-{t})/3) end", clamp=False, normal=True))
def resample_lanczos3(spark, sf_dir):
    return _sampled(spark, sf_dir, "lanczos3", 1, 0.25, 0.75)


@query("decimated_read", f"select (row-10)//3 as row, (col-5)//3 as col, v from ({MOSAIC}) where row between 10 and 109 and col between 5 and 154 and (row-10)%3=0 and (col-5)%3=0")
def decimated_read(spark, sf_dir):
    return raster.read_region(fixtures.mosaic(spark, sf_dir), 5, 10, 150, 100, 3)


@query(
    "block_grid",
    """select k, r as block_row, c as block_col, cast(c*64 as int) as col_off, cast(r*64 as int) as row_off, cast(least(64, width-c*64) as int) as w, cast(least(64, height-r*64) as int) as h, cast(greatest(0,c*64-2) as int) as halo_col, cast(greatest(0,r*64-2) as int) as halo_row
    from (select p_partkey as k, p_size*7 as width, p_size*5 as height from part) i, (select cast(unnest(range(0,40)) as int) as r), (select cast(unnest(range(0,40)) as int) as c) where c*64 < width and r*64 < height""",
)
def block_grid(spark, sf_dir):
    images = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 7).alias("width"), (F.col("p_size") * 5).alias("height"))
    return raster.blocks(images, 64, 2).select("k", "block_row", "block_col", "col_off", "row_off", "w", "h", "halo_col", "halo_row")


def _bytes3(spark, sf_dir):
    px = fixtures.bands3(spark, sf_dir).withColumn("v", F.round("v", 1)).select("chunk", "band", F.col("r").alias("row"), F.col("c").alias("col"), "v")
    limits = raster.bounds(raster.band_stats(px, ["chunk", "band"], F.lit(ND)), ["chunk", "band"])
    data = px.withColumn("v", F.when(~paths.is_nodata(F.col("v"), F.lit(ND)), F.col("v")))
    return raster.stretch(data, limits, ["chunk", "band"]).withColumn("byte", F.when(F.col("v").isNotNull(), F.col("byte")))


_B3 = f"select chunk, band, r as row, c as col, round(v,1) as v from ({BANDS3})"
_BYTES3 = f"select p.*, case when v = cast({ND} as double) then null else {BYTE} end as byte from ({_B3}) p join (select chunk, band, min(v) as lo, max(v) as hi from ({_B3}) where v <> cast({ND} as double) group by chunk, band) using (chunk, band)"


@query("rgb_compose", f"select * from (select chunk, row, col, max(case when band=3 then byte end) as red, max(case when band=2 then byte end) as green, max(case when band=1 then byte end) as blue from ({_BYTES3}) group by chunk, row, col) where red is not null and green is not null and blue is not null")
def rgb_compose(spark, sf_dir):
    return raster.compose_rgb(_bytes3(spark, sf_dir), ["chunk", "row", "col"], [3, 2, 1])


@query("gray_compose", f"select chunk, row, col, byte as red, byte as green, byte as blue from ({_BYTES3}) where band=1 and byte is not null")
def gray_compose(spark, sf_dir):
    one = _bytes3(spark, sf_dir).where("band = 1 and byte is not null")
    return one.select("chunk", "row", "col", *(F.col("byte").alias(n) for n in ("red", "green", "blue")))


#: Where the mosaic lies: west, south, east, north.
PLACE = (-10.0, -8.0, 10.0, 8.0)
TILE = (5, 16, 15)


def _limits(spark, sf_dir):
    s = fixtures.mosaic(spark, sf_dir).agg(F.min("v"), F.max("v")).first()
    return F.lit(s[0]), F.lit(s[1])


def tiles_of(spark, rows):
    return spark.createDataFrame(rows, "z int, x long, y long")


_LIM = f"(select min(v) as lo, max(v) as hi from ({MOSAIC}))"


def _at_sql(rows: list[tuple[int, int, int]]) -> str:
    """Fractional row and col of each pixel of tiles in the mosaic."""
    tiles = " union all ".join(f"select cast({z} as int) as z, cast({x} as bigint) as x, cast({y} as bigint) as y" for z, x, y in rows)
    lng = f"(x0+(tx+cast(0.5 as double))/256*(x1-x0))*180/cast({C} as double)"
    lat = LAT.format(y="(y1-(ty+cast(0.5 as double))/256*(y1-y0))")
    at = f"select z, x, y, ty, tx, ({lng}+10)/20*(w-1) as col, (1-({lat}+8)/16)*(h-1) as row, w, h from ({rect_sql(tiles)}), (select unnest(range(0,256)) as ty), (select unnest(range(0,256)) as tx), {SIZE}"
    return f"select * from ({at}) where row >= 0 and col >= 0 and row < h and col < w"


def _tile_sql(rows: list[tuple[int, int, int]]) -> str:
    return f"select z, x, y, cast(ty as int) as ty, cast(tx as int) as tx, {BYTE} as grey from (select z, x, y, ty, tx, cast(floor(row) as bigint) as row, cast(floor(col) as bigint) as col from ({_at_sql(rows)})) join ({MOSAIC}) using (row, col), {_LIM}"


def _bilinear_sql(rows: list[tuple[int, int, int]]) -> str:
    taps = "(select unnest([0,1]) as dy), (select unnest([0,1]) as dx)"
    weight = "(case dy when 0 then 1-(row-floor(row)) else row-floor(row) end)*(case dx when 0 then 1-(col-floor(col)) else col-floor(col) end)"
    hits = f"select z, x, y, ty, tx, {weight} as wt, least(cast(floor(row) as bigint)+dy,h-1) as row, least(cast(floor(col) as bigint)+dx,w-1) as col from ({_at_sql(rows)}), {taps}"
    sums = f"select z, x, y, ty, tx, sum(wt*v) as v from ({hits}) join ({MOSAIC}) using (row, col) group by z, x, y, ty, tx"
    return f"select z, x, y, cast(ty as int) as ty, cast(tx as int) as tx, {BYTE} as grey from ({sums}), {_LIM}"


@query("raster_tile_pixels", _tile_sql([TILE]))
def raster_tile_pixels(spark, sf_dir):
    w, h = fixtures.mosaic_size(spark, sf_dir)
    return raster.grey_tile(fixtures.mosaic(spark, sf_dir), tiles_of(spark, [TILE]), _limits(spark, sf_dir), PLACE, w, h)


AROUND = [(5, x, y) for x in range(14, 18) for y in range(14, 18)]


@query("rendered_count", f"select z, x, y, count(*) as n from ({_tile_sql(AROUND)}) group by z, x, y")
def rendered_count(spark, sf_dir):
    w, h = fixtures.mosaic_size(spark, sf_dir)
    px = raster.grey_tile(fixtures.mosaic(spark, sf_dir), tiles_of(spark, AROUND), _limits(spark, sf_dir), PLACE, w, h)
    return px.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


#: A map a little wider than the mosaic, in metres.
BOX = (-1300000.5, -1000000.25, 1300000.25, 1000000.75)


@query(
    "map_bbox_pixels",
    f"""select cast(ty as int) as ty, cast(tx as int) as tx, coalesce({BYTE},255) as grey, 255 as alpha from (select ty, tx, cast(sign(row)*floor(abs(row)+0.5) as bigint) as row, cast(sign(col)*floor(abs(col)+0.5) as bigint) as col
    from (select ty, tx, ((cast({BOX[0]} as double)+(tx+cast(0.5 as double))/160*(cast({BOX[2]} as double)-cast({BOX[0]} as double)))*180/cast({C} as double)+10)/20*(w-1) as col,
    (1-({LAT.format(y=f"(cast({BOX[3]} as double)-(ty+cast(0.5 as double))/120*(cast({BOX[3]} as double)-cast({BOX[1]} as double)))")}+8)/16)*(h-1) as row
    from (select unnest(range(0,120)) as ty), (select unnest(range(0,160)) as tx), {SIZE})) left join (select * from ({MOSAIC}), {_LIM}) using (row, col)""".replace(f"coalesce({BYTE},255)", f"case when v is null then 255 else {BYTE} end"),
)
def map_bbox_pixels(spark, sf_dir):
    w, h = fixtures.mosaic_size(spark, sf_dir)
    box = spark.createDataFrame([BOX], "x0 double, y0 double, x1 double, y1 double")
    return raster.map_image(fixtures.mosaic(spark, sf_dir), box, _limits(spark, sf_dir), PLACE, (160, 120), (w, h), [])


_LEVELS = [(0, 4096), (1, 2048), (2, 1024), (3, 512), (4, 256)]


@query(
    "level_choice",
    f"""select raster, z, cast(arg_min(idx, d*1000+idx) as int) as idx from (select raster, z, idx, case when metres > 0 then abs(metres*4096/width-2*cast({C} as double)/(256*power(cast(2 as double),z))) else 0 end as d
    from (select p_partkey as raster, p_retailprice/10 as metres from part), (select unnest(range(0,23)) as z), (values {", ".join(map(str, _LEVELS))}) l(idx, width)) group by raster, z""".replace("arg_min(idx, d*1000+idx)", "arg_min(idx, row(d, idx))").replace("select raster, z, cast", "select raster, cast(z as int) as z, cast", 1),
)
def level_choice(spark, sf_dir):
    images = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("raster"), (F.col("p_retailprice") / 10).alias("metres"), F.lit(4096).alias("base_width"))
    shapes = F.explode(F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(w).alias("width")) for i, w in _LEVELS)))
    levels = images.withColumn("l", shapes).select("raster", "metres", "base_width", "l.idx", "l.width")
    tiles = images.select("raster", F.explode(F.sequence(F.lit(0), F.lit(22))).alias("z"))
    return raster.choose_level(levels, tiles, ["raster"])


@query("tile_bytes_png")
def tile_bytes_png(spark, sf_dir):
    w, h = fixtures.mosaic_size(spark, sf_dir)
    px = raster.grey_tile(fixtures.mosaic(spark, sf_dir), tiles_of(spark, AROUND), _limits(spark, sf_dir), PLACE, w, h)
    return render.png_tiles(px.select("z", "x", "y", "ty", "tx", *(F.col("grey").alias(n) for n in ("red", "green", "blue"))), ["z", "x", "y"])


@query("batch_tiles", f"select j.i, z, x, y, coalesce(n, 0) as rendered from (select cast(row_number() over () - 1 as int) as i, z, x, y from (values {', '.join(map(str, AROUND))}) t(z, x, y)) j left join (select z, x, y, count(*) as n from ({_tile_sql(AROUND)}) group by z, x, y) using (z, x, y)".replace("select j.i, z, x, y,", "select j.i as i, cast(z as int) as z, cast(x as bigint) as x, cast(y as bigint) as y,"))
def batch_tiles(spark, sf_dir):
    w, h = fixtures.mosaic_size(spark, sf_dir)
    jobs = spark.createDataFrame([(i, *t) for i, t in enumerate(AROUND)], "i int, z int, x long, y long")
    chunks = render.chunks(fixtures.mosaic(spark, sf_dir), [], 64)
    lo, hi = (float(x) for x in fixtures.mosaic(spark, sf_dir).agg(F.min("v"), F.max("v")).first())
    done = render.batch(jobs, chunks, render.Image(PLACE, w, h, [(lo, hi)]), 64)
    return done.select("i", "z", "x", "y", F.col("rendered").cast("long").alias("rendered"))


#: An image of this size at PLACE, for the planning of reads.
BIG = (6000, 4800)


def _window_sql() -> str:
    w, h = BIG
    lng, lat = "({v}*180/cast(" + C + " as double))", LAT.replace("{y}", "{v}")
    col = lambda v: f"cast(round(({lng.format(v=v)}+10)/20*{w - 1}) as bigint)"
    row = lambda v: f"cast(round((1-({lat.format(v=v)}+8)/16)*{h - 1}) as bigint)"
    tiles = "select distinct z, x, y from (" + fixtures.SQL_REQS + ")"
    return f"""select z, x, y, col_off, row_off, src_w, src_h, cast(case when src_w*src_h > 1048576 then ceil(sqrt(src_w*src_h/cast(1048576 as double))) else 1 end as int) as step from (
    select z, x, y, col_off, row_off, least(greatest(c1-c0+20,1),{w}-col_off) as src_w, least(greatest(r1-r0+20,1),{h}-row_off) as src_h from (
    select *, least(greatest(c0-10,0),{w - 1}) as col_off, least(greatest(r0-10,0),{h - 1}) as row_off from (
    select z, x, y, greatest({col("x0")},0) as c0, {col("x1")} as c1, greatest({row("y1")},0) as r0, {row("y0")} as r1 from ({rect_sql(tiles)}))))"""


@query("tile_window", _window_sql())
def tile_window(spark, sf_dir):
    tiles = fixtures.reqs(spark, sf_dir).select("z", "x", "y").distinct()
    return raster.window(tiles, PLACE, *BIG)


@query("raster_tile_bilinear", _bilinear_sql([TILE]))
def raster_tile_bilinear(spark, sf_dir):
    w, h = fixtures.mosaic_size(spark, sf_dir)
    return raster.grey_tile(fixtures.mosaic(spark, sf_dir), tiles_of(spark, [TILE]), _limits(spark, sf_dir), PLACE, w, h, "bilinear")
