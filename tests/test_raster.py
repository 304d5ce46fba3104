import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.functions import paths
from quadrel.operators import raster, render
from quadrel.sources import png, tiff


def table(spark, a, **more):
    rows = [(r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    df = spark.createDataFrame(rows, "row long, col long, v double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()}) if more else df


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(3).integers(0, 200, (40, 48)).astype(float)


def test_empty_band_is_zero(spark):
    px = spark.createDataFrame([("a", 0, 0, -1.0), ("a", 0, 1, float("nan"))], "raster string, row int, col int, v double")
    assert raster.band_stats(px, ["raster"], F.lit(-1.0)).first()[1:] == (0, 0.0, 0.0, 0.0, 0.0)


def test_nodata(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (nan, 2.0), (inf, 2.0), (1.0, nan), (1.0, None), (None, 1.0)], "v double, s double")
    assert [r[0] for r in df.select(paths.is_nodata(F.col("v"), F.col("s"))).collect()] == [True, False, True, True, False, False, True]


def test_stretch_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0), (10.0, 0.0, 10.0), (-5.0, 0.0, 10.0), (50.0, 0.0, 10.0), (9.99, 0.0, 10.0), (1.0, 1.0, 1.0)], "v double, lo double, hi double")
    assert [r[0] for r in df.select(raster.to_byte(F.col("v"), F.col("lo"), F.col("hi"))).collect()] == [0, 255, 0, 255, 254, 0]


@pytest.mark.parametrize("mode", ["nearest", "bilinear", "bicubic", "lanczos3"])
def test_relational_and_vectorised_samples_agree(spark, picture, mode):
    h, w = picture.shape
    at = [(r, c, r * 1.37 + 0.21, c * 1.61 - 0.4) for r in range(30) for c in range(32)]
    df = spark.createDataFrame(at, "i long, j long, row double, col double")
    got = {(r.i, r.j): r.v for r in raster.resample(table(spark, picture), df, [], ["i", "j"], mode, w, h).collect()}
    rows, cols = np.meshgrid(np.arange(30) * 1.37 + 0.21, np.arange(32) * 1.61 - 0.4, indexing="ij")
    want = render.sample(picture, rows, cols, mode)
    for i, j, _, _ in at:
        if np.isnan(want[i, j]):
            assert (i, j) not in got
        else:
            assert got[i, j] == pytest.approx(want[i, j], abs=1e-9)


def test_pyramid_chains_and_takes_odd_sizes(spark, picture):
    odd = picture[:37, :45]
    want = odd[:, :, None]
    for df, w, h in raster.pyramid(table(spark, odd), [], 45, 37, smallest=10):
        want = tiff.halve(want)
        got = np.full((h, w), np.nan)
        for r in df.collect():
            got[r.row, r.col] = r.v
        assert got.shape == want.shape[:2] and np.allclose(got, want[:, :, 0])


def test_percentiles_are_exact(spark, picture):
    got = raster.percentiles(table(spark, picture, raster="a"), ["raster"], 0.1, 0.75).first()
    s = np.sort(picture.ravel())
    assert (got.lo, got.hi) == (s[int(0.1 * (s.size - 1))], s[int(0.75 * (s.size - 1))])


def test_blocks_cover_each_pixel_once(spark):
    rows = raster.blocks(spark.createDataFrame([(130, 70), (64, 64), (1, 1), (0, 5)], "width int, height int"), 64, 3).collect()
    for w, h in ((130, 70), (64, 64), (1, 1)):
        assert sum(r.w * r.h for r in rows if (r.width, r.height) == (w, h)) == w * h
    assert all(r.halo_col >= 0 and r.halo_col + r.halo_w <= r.width for r in rows) and not [r for r in rows if r.width == 0]


PLACE = (-10.0, -8.0, 10.0, 8.0)


@pytest.mark.parametrize("mode", ["nearest", "bilinear"])
def test_both_tile_paths_agree(spark, picture, mode):
    h, w = picture.shape
    px = table(spark, picture)
    tiles = [(5, 16, 15), (5, 15, 16), (5, 0, 0)]
    lo, hi = picture.min(), picture.max()
    rows = raster.grey_tile(px, spark.createDataFrame(tiles, "z int, x long, y long"), (F.lit(lo), F.lit(hi)), PLACE, w, h, mode, 32).collect()
    jobs = spark.createDataFrame([(i, *t) for i, t in enumerate(tiles)], "i int, z int, x long, y long")
    done = {(r.z, r.x, r.y): r for r in render.batch(jobs, render.chunks(px, [], 16), render.Image(PLACE, w, h, [(lo, hi)]), 16, mode, 32).collect()}
    for t in tiles:
        image = png.decode(done[t].data)
        mine = {(r.ty, r.tx): r.grey for r in rows if (r.z, r.x, r.y) == t}
        assert done[t].error is None and done[t].rendered == len(mine) == int((image[:, :, 3] > 0).sum())
        assert all(image[y, x, 0] == g for (y, x), g in mine.items())
    assert done[(5, 0, 0)].rendered == 0


def test_a_failing_job_does_not_stop_others(spark, picture):
    px = table(spark, picture)
    jobs = spark.createDataFrame([(0, 5, 16, 15)], "i int, z int, x long, y long")
    out = render.batch(jobs, render.chunks(px, [], 16), render.Image(PLACE, 48, 40, []), 16).first()
    assert out.data is None and "IndexError" in out.error


def test_rgb_rules(spark):
    rows = [(0, 1, 10), (0, 2, 20), (0, 3, 30), (1, 1, 10), (1, 2, None), (1, 3, 30)]
    df = spark.createDataFrame(rows, "p int, band int, byte int")
    assert [tuple(r) for r in raster.compose_rgb(df, ["p"], [3, 2, 1]).collect()] == [(0, 30, 20, 10)]
    assert sorted(tuple(r) for r in raster.compose_rgb(df, ["p"], [1]).collect()) == [(0, 10, 0, 0), (1, 10, 0, 0)]
    for bad in ([], [0]):
        with pytest.raises(ValueError):
            raster.compose_rgb(df, ["p"], bad)


def test_map_background(spark, picture):
    box = spark.createDataFrame([(-4e6, -4e6, 4e6, 4e6)], "x0 double, y0 double, x1 double, y1 double")
    for transparent, alpha in ((False, 255), (True, 0)):
        rows = raster.map_image(table(spark, picture), box, (F.lit(0.0), F.lit(200.0)), PLACE, (16, 12), (48, 40), [], transparent).collect()
        assert len(rows) == 192 and {r.alpha for r in rows if (r.ty, r.tx) == (0, 0)} == {alpha}


def test_decimation(spark):
    df = spark.createDataFrame([(1,), (1 << 20,), ((1 << 20) + 1,), (1 << 24,)], "n long")
    assert [r[0] for r in df.select(raster.decimation(F.col("n"))).collect()] == [1, 1, 2, 4]


def test_percentiles_of_far_values(spark):
    """A few values far out neither change the rank nor put all others into one part."""
    v = [float(i % 1000) for i in range(5000)] + [1e300, -1e300, 1e12]
    px = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)] + [(2, 0, 7.0)], "band int, i long, v double")
    got = {r.band: (r.lo, r.hi) for r in raster.percentiles(px, ["band"]).collect()}
    v.sort()
    assert got == {1: (v[int(0.02 * (len(v) - 1))], v[int(0.98 * (len(v) - 1))]), 2: (7.0, 7.0)}


@pytest.mark.parametrize("n", [1, 9, 10, 25, 1000])
def test_first_n(spark, n):
    rows = [(b, r, c, float(r * 10 + c)) for b in (1, 2) for r in range(7) for c in range(9) if (r + c + b) % 5]
    got = raster.first_n(spark.createDataFrame(rows, "band int, row long, col long, v double"), ["band"], ["row", "col"], n).collect()
    assert sorted(map(tuple, got)) == sorted(x for b in (1, 2) for x in sorted(y for y in rows if y[0] == b)[:n])


def test_level_choice_broadcasts_nothing(spark):
    """The sizes expected behind an explode are too low: a broadcast of levels or tiles does not fit a driver."""
    one = spark.range(3).select(F.col("id").alias("raster"), (F.col("id") * 100.0).alias("metres"), F.lit(4).alias("base_width"))
    levels = one.withColumn("l", F.explode(F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(4 >> i).alias("width")) for i in range(3))))).select("raster", "metres", "base_width", "l.*")
    tiles = one.select("raster", F.explode(F.array(*map(F.lit, (0, 10, 10, 9, 9)))).alias("z"))
    got = raster.choose_level(levels, tiles.union(tiles.where("raster = 1")), ["raster"])
    assert "BroadcastExchange" not in got._jdf.queryExecution().toString()
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(0, 0, 0), (0, 9, 0), (0, 10, 0), (1, 0, 2), (1, 9, 2), (1, 10, 1), (2, 0, 2), (2, 9, 1), (2, 10, 0)]


def test_nearest_broadcasts_no_targets(spark, picture):
    h, w = picture.shape
    targets = spark.range(h).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("j")).select("i", "j", (F.col("i") + 0.75).alias("row"), (F.col("j") + 0.25).alias("col"))
    got = raster.resample(table(spark, picture), targets, [], ["i", "j"], "nearest", w, h)
    assert "BroadcastExchange" not in got._jdf.queryExecution().toString()
    assert {(r.i, r.j): r.v for r in got.collect()} == {(i, j): picture[i, j] for i in range(h) for j in range(w)}


@pytest.mark.parametrize("mode", ["bicubic", "bilinear", "lanczos3"])
def test_kernels_meet_targets_once(spark, picture, mode):
    """No row a tap and no broadcast; holes, nulls, repeated pixels and several images give the sums over the taps that are there."""
    rng = np.random.default_rng(5)
    h, w = picture.shape
    pixels = [(k, r, c, None if 20 < r < 32 and 28 < c < 42 or rng.random() < 0.05 else float(picture[r, c]) + k) for k in (0, 1) for r in range(h) for c in range(w) if rng.random() < 0.8 or r > 30]
    pixels = [p for p in pixels if not (p[1] < 12 and p[2] < 12)] + [p for p in pixels if p[1] == 20]
    px = spark.createDataFrame(pixels, "k int, row long, col long, v double")
    at = [(k, i, float(rng.uniform(-1, h + 1)), float(rng.uniform(-1, w + 1))) for k in (0, 1) for i in range(400)]
    at += [(0, 400, 0.0, 0.0), (0, 401, h - 1.0, w - 1.0), (1, 402, 16.0, 31.999), (2, 403, 5.0, 5.0)]
    out = raster.resample(px, spark.createDataFrame(at, "k int, i int, row double, col double"), ["k"], ["k", "i"], mode, w, h)
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastExchange" not in plan and "explode(_t" not in plan
    lo, hi = raster.REACH[mode]
    cubic = lambda t: [0.5 * x for x in (-t + 2 * t * t - t**3, 2 - 5 * t * t + 3 * t**3, t + 4 * t * t - 3 * t**3, t**3 - t * t)]
    lanczos = lambda t: [float(np.sinc(d - t) * np.sinc((d - t) / 3)) if abs(d - t) < 3 else 0.0 for d in range(-2, 4)]
    weights = {"bilinear": lambda t: [1 - t, t], "bicubic": cubic, "lanczos3": lanczos}[mode]
    held = {}
    for k, r, c, v in pixels:
        held.setdefault((k, r, c), []).append(v)
    want = {}
    for k, i, y, x in at:
        if not (0 <= y < h and 0 <= x < w):
            continue
        found = []
        for dy, wy in zip(range(-lo, hi + 1), weights(y - int(y)), strict=True):
            for dx, wx in zip(range(-lo, hi + 1), weights(x - int(x)), strict=True):
                r, c = int(y) + dy, int(x) + dx
                if mode != "lanczos3":
                    r, c = min(max(r, 0), h - 1), min(max(c, 0), w - 1)
                found += [(wy * wx, v) for v in held.get((k, r, c), [])]
        if found:
            there = [a * v for a, v in found if v is not None]
            want[k, i] = None if not there else sum(there) / (sum(a for a, _ in found) if mode == "lanczos3" else 1)
    got = {(r.k, r.i): r.v for r in out.collect()}
    assert got.keys() == want.keys() and None in want.values()
    assert all(got[x] is None if v is None else got[x] == pytest.approx(v, rel=1e-6, abs=1e-6) for x, v in want.items())


def test_percentile_parts_do_not_depend_on_the_order_of_rows(spark):
    """The parts are read twice in the plan; parts that a sketch cuts anew each time give wrong ranks."""
    n = 60_000
    v = np.random.default_rng(9).normal(size=n)
    px = spark.createDataFrame([(None if i % 2 else "a", float(x)) for i, x in enumerate(v)], "raster string, v double")
    got = raster.percentiles(px.repartition(7), ["raster"])
    assert "percentile_approx" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        s = np.sort(v[0::2] if r.raster else v[1::2])
        assert (r.lo, r.hi) == (s[int(0.02 * (s.size - 1))], s[int(0.98 * (s.size - 1))])
    assert got.count() == 2


def test_stretch_by_percentiles_of_bands_with_many_values(spark):
    v = np.random.default_rng(10).normal(size=40_000)
    px = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "raster string, i long, v double").repartition(5)
    limits = raster.bounds(px, ["raster"], "percentile", percentile=raster.percentiles(px, ["raster"]))
    s = np.sort(v)
    lo, hi = s[int(0.02 * (s.size - 1))], s[int(0.98 * (s.size - 1))]
    got = {r.i: r.byte for r in raster.stretch(px, limits, ["raster"]).collect()}
    want = np.floor(np.clip((v - lo) / (hi - lo) * 255.0, 0, 255)).astype(int)
    assert [got[i] for i in range(v.size)] == want.tolist()
