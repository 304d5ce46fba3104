import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.functions import grid, projection
from quadrel.operators import catalog
from quadrel.service import Options, TileService
from quadrel.sources import png, tiff

from test_webp import pixels as webp_pixels


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("mounted")
    rng = np.random.default_rng(4)
    base = rng.integers(1, 250, (300, 400, 3)).astype("uint8")
    base[:30, :30] = 0
    (d / "rgb.tif").write_bytes(tiff.write([base, base[::2, ::2]], [10.0, 0.01, 0.0, 50.0, 0.0, -0.01], 4326, "0", tile=64))
    grey = np.add.outer(np.arange(200.0), np.arange(240.0))[:, :, None].astype("float32")
    (d / "utm.tif").write_bytes(tiff.write([grey], [500000.0, 100.0, 0.0, 5000000.0, 0.0, -100.0], 32631, planar=True))
    (d / "bad.tif").write_bytes(b"x")
    (d / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": 'a"b', "geometry": {"type": "Point", "coordinates": [11, 49]}, "properties": {"k": [1]}}]}))
    return TileService(spark, [str(d)])


def tile_of(lng, lat, z):
    n = 2**z
    return z, int((lng + 180) / 360 * n), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)


def test_tiles_inside_and_outside(service):
    inside, outside = tile_of(12, 48.5, 8), tile_of(100, 0, 8)
    rows = service.raster_tiles("rgb.tif", [inside, outside]).collect()
    assert [(r.i, r.error) for r in rows] == [(0, None), (1, None)]
    assert rows[0].rendered > 0 and rows[1].rendered == 0
    picture = png.decode(rows[0].data)
    assert picture.shape == (256, 256, 4) and int((picture[:, :, 3] > 0).sum()) == rows[0].rendered
    assert not png.decode(rows[1].data).any()


@pytest.mark.parametrize("mode", ["nearest", "bilinear", "bicubic", "lanczos3"])
def test_projected_tile_against_its_formula(service, mode):
    z, x, y = tile_of(3.1, 45.08, 10)
    row = service.raster_tiles("utm.tif", [(z, x, y)], Options(resampling=mode)).first()
    picture = png.decode(row.data)
    side = 2 * grid.HALF / 2**z
    at = (np.arange(256) + 0.5) / 256
    mx, my = np.broadcast_arrays((-grid.HALF + (x + at) * side)[None, :], (grid.HALF - (y + at) * side)[:, None])
    e, n = projection.forward(*projection.inverse(mx, my, 3857), 32631)
    col, r = (e - 500000) / 24000 * 239, (1 - (n - 4980000) / 20000) * 199
    ok = (col >= 6) & (r >= 6) & (col < 233) & (r < 193)
    value = np.floor(r) + np.floor(col) if mode == "nearest" else r + col  # a plane is kept by every kernel, but nearly by lanczos
    want = np.floor(value / 438 * 255)
    assert ok.any() and np.abs(picture[:, :, 0][ok] - want[ok]).max() <= (0 if mode == "nearest" else 1)
    near = service.raster_tiles("utm.tif", [(z, x, y)], Options(resampling=mode, affine=True)).first()
    assert np.abs(png.decode(near.data)[:, :, 0][ok].astype(int) - want[ok]).max() <= 3


def test_level_follows_zoom(service):
    r = service.raster("rgb.tif")
    assert service.level(r, 12) == 0 and service.level(r, 3) == 1


def test_stretches_and_cache(service):
    t = tile_of(12, 48.5, 8)
    pictures = {s: service.raster_tile("rgb.tif", *t, Options(stretch=s)) for s in ("minmax", "stddev", "percentile")}
    assert len(set(pictures.values())) == 3
    hits = service.cache.hits
    assert service.raster_tile("rgb.tif", *t, Options(stretch="stddev")) == pictures["stddev"] and service.cache.hits == hits + 1
    z, x, y = t
    assert service.tms_tile("rgb.tif", z, x, 2**z - 1 - y) == pictures["minmax"]
    one = png.decode(service.raster_tile("rgb.tif", *t, Options(bands=[2])))
    assert one[:, :, 0].any() and not one[:, :, 1:3].any()
    for bad in (dict(bands=[0]), dict(bands=[])):
        with pytest.raises(ValueError):
            service.raster_tile("rgb.tif", *t, Options(**bad))
    with pytest.raises(ValueError):
        service.raster_tile("rgb.tif", 3, 8, 0)
    lossless = webp_pixels(service.raster_tile_webp("rgb.tif", *t))
    assert (lossless == png.decode(pictures["minmax"])).all()


def test_map(service):
    box = (1000000.0, 5800000.0, 1700000.0, 6500000.0)
    clear, white = (png.decode(service.map("rgb.tif", box, 120, 100, transparent=t)) for t in (True, False))
    assert clear.shape == (100, 120, 4) and 0 < (clear[:, :, 3] > 0).sum() < 12000
    assert (white[clear[:, :, 3] == 0] == 255).all() and (white[clear[:, :, 3] > 0] == clear[clear[:, :, 3] > 0]).all()
    far = png.decode(service.map("rgb.tif", (-9e6, -9e6, -8e6, -8e6), 10, 10))
    assert not far.any()
    with pytest.raises(ValueError):
        service.map("rgb.tif", box, 0, 10)


def test_info_and_documents(service):
    i = service.info("utm.tif")
    assert i["native_crs"] == "EPSG:32631" and i["native_extent"] == [500000.0, 4980000.0, 524000.0, 5000000.0] and i["error"] is None
    assert service.info("bad.tif")["error"] and service.info("f.geojson")["extent"] == [11.0, 49.0, 11.0, 49.0]
    assert json.loads(service.tilejson("utm.tif"))["format"] == "png"
    assert "rgb.tif" in service.wms_capabilities() and "bad.tif" not in service.wmts_capabilities()
    assert "units-per-pixel" in service.tms_layer("rgb.tif") and "global-mercator" in service.tms_root()
    assert service.api_spec().count() == 3 * 3 + 2 and service.geo_files().count() == 4 and service.health() == "ok"
    with pytest.raises(catalog.WrongKind):
        service.tms_layer("f.geojson")
    with pytest.raises(catalog.WrongKind):
        service.features("rgb.tif")


def test_openapi(service):
    doc = json.loads(service.openapi())
    assert doc["openapi"].startswith("3.") and "/api/batch-tiles" in doc["paths"]
    tile = doc["paths"]["/api/tiles/rgb.tif/webp/{z}/{x}/{y}"]["get"]
    assert [p["name"] for p in tile["parameters"]] == ["z", "x", "y"] and "image/webp" in tile["responses"]["200"]["content"]
    names = [o["operationId"] for p in doc["paths"].values() for o in p.values()]
    assert len(names) == len(set(names)) == 6 + 11


def test_tiles_on_disk_and_content_in_the_key(spark, tmp_path):
    a = np.arange(64, dtype="uint8").reshape(8, 8, 1)
    file = tmp_path / "a.tif"
    file.write_bytes(tiff.write([a], [0.0, 1.0, 0.0, 8.0, 0.0, -1.0], 4326))
    one = TileService(spark, [str(tmp_path)], tile_folder=str(tmp_path / "tiles"))
    first = one.raster_tile("a.tif", 3, 4, 3)
    assert one.content_hash("a.tif") == {r.path.rsplit("/", 1)[-1]: r.content_hash for r in one.hashes(str(tmp_path)).collect()}["a.tif"]
    two = TileService(spark, [str(tmp_path)], tile_folder=str(tmp_path / "tiles"))
    assert two.raster_tile("a.tif", 3, 4, 3) == first and two.disk.hits == 1 and not two._rasters
    file.write_bytes(tiff.write([a[::-1]], [0.0, 1.0, 0.0, 8.0, 0.0, -1.0], 4326))
    three = TileService(spark, [str(tmp_path)], tile_folder=str(tmp_path / "tiles"))
    assert three.raster_tile("a.tif", 3, 4, 3) != first and three.disk.misses == 1
    assert three.disk.files().count() == 2
    three.disk.max_bytes = len(first)
    assert three.disk.trim() >= 1 and three.disk.files().count() <= 1


def test_rasters_are_closed_in_turn(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.tif").write_bytes(tiff.write([np.ones((4, 4, 1), "uint8")], [0.0, 1.0, 0.0, 4.0, 0.0, -1.0], 4326))
    s = TileService(spark, [str(tmp_path)])
    s.MOST_RASTERS = 2
    for n in ("a.tif", "b.tif", "a.tif", "c.tif"):
        s.raster(n)
    assert list(s._rasters) == ["a.tif", "c.tif"]


def test_external_overviews(spark, tmp_path):
    a = np.random.default_rng(1).integers(1, 255, (600, 520, 1)).astype("uint8")
    place = [10.0, 0.01, 0.0, 50.0, 0.0, -0.01]
    for name, ovr in (("x[1].tif", "x[1].tif.ovr"), ("y.tif", "y.ovr")):
        (tmp_path / name).write_bytes(tiff.write([a], place, 4326))
        (tmp_path / ovr).write_bytes(tiff.write_overviews(a))
    (tmp_path / "z.tif").write_bytes(tiff.write([a], place, 4326))
    (tmp_path / "z.tif.ovr").write_bytes(b"no overviews")
    s = TileService(spark)
    for name, n in (("y.tif", 3), ("z.tif", 1)):
        s.catalog.mount(name, str(tmp_path / name))
        r = s.raster(name)
        assert len(r.levels) == n
    r = s.raster("y.tif")
    assert [x["external"] for x in r.levels] == [False, True, True] and s.level(r, 2) == 2
    small = {(p.row, p.col): p.v for p in r.chunks[1].select("chunk_row", "chunk_col", F.explode("pixels").alias("p")).selectExpr("chunk_row * 256 + p.p div 256 as row", "chunk_col * 256 + p.p % 256 as col", "p.v as v").collect()}
    assert len(small) == 260 * 300
    assert abs(small[10, 10] - a[20:22, 20:22].mean()) <= 1


def test_static_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p.html").write_bytes(b"<p>")
    (tmp_path / ".secret").write_bytes(b"x")
    s = TileService(spark)
    r = s.static([str(tmp_path)], "d/p.html").first()
    assert (r.mime, r.size, bytes(r.content)) == ("text/html", 3, b"<p>")
    for bad, error in (("", ValueError), (".", ValueError), ("..", ValueError), ("/etc/hosts", ValueError), ("../x", ValueError), ("d", FileNotFoundError), (".secret", FileNotFoundError)):
        with pytest.raises(error):
            s.static([str(tmp_path)], bad)


def test_vector_tiles(service):
    rows = service.vector_tiles("f.geojson", [tile_of(11, 49, 6), (6, 0, 0)]).collect()
    docs = {r.n_features: json.loads(r.geojson) for r in rows}
    assert docs[1]["features"][0]["id"] == 'a"b' and docs[1]["features"][0]["properties"] == {"k": [1]} and docs[0]["features"] == []


def test_vector_map(service):
    at = [float(v) for v in projection.forward(np.float64(11.0), np.float64(49.0), 3857)]
    hit = json.loads(service.vector_map("f.geojson", (at[0] - 10, at[1] - 10, at[0] + 10, at[1] + 10)))
    assert len(hit["features"]) == 1 and hit["features"][0]["id"] == 'a"b'
    assert json.loads(service.vector_map("f.geojson", (0, 0, 10, 10)))["features"] == []


def test_progress_and_remount(service, tmp_path):
    (tmp_path / "n.tif").write_bytes(tiff.write([np.ones((4, 4, 1), "uint8")], [0.0, 1.0, 0.0, 4.0, 0.0, -1.0]))
    service.catalog.mount("n.tif", str(tmp_path / "n.tif"))
    seen = []
    service.raster("n.tif", lambda e, _: seen.append(e))
    assert seen == ["file_opened", "geo_info_ready", "overviews_ready", "chunks_loaded", "stats_complete", "ready"]
    assert service.raster("n.tif").code == 4326
    service.catalog.unmount("n.tif")
    assert "n.tif" not in service._rasters


def test_batch_takes_paths_below_its_bases(service):
    folder = service.catalog.get("rgb.tif")["path"].removeprefix("file:").rsplit("/", 1)[0]
    rows = service.batch([folder], "rgb.tif", [tile_of(12, 48.5, 8), (0, 0, 0)]).collect()
    assert [r.i for r in rows] == [0, 1] and rows[0].n_bytes == len(rows[0].data) and rows[0].rendered > 0
    with pytest.raises(ValueError):
        service.batch([folder], "../rgb.tif", [(0, 0, 0)])
    with pytest.raises(FileNotFoundError):
        service.batch([folder], "none.tif", [(0, 0, 0)])


@pytest.mark.parametrize("code", [2154, None])
def test_rasters_in_national_grids(spark, tmp_path, code):
    """By code, and by the parameters of the British grid on this ellipsoid."""
    tm = None if code else [-2.0, 49.0, 0.9996012717, 400000.0, -100000.0]
    place = (2.4, 47.0) if code else (-1.5, 52.0)
    system = code or projection.declared(None, tm)
    e0, n0 = (round(float(v), -3) for v in projection.forward(*map(np.float64, place), system))
    grey = np.add.outer(np.arange(200.0), np.arange(240.0))[:, :, None].astype("float32")
    (tmp_path / "grid.tif").write_bytes(tiff.write([grey], [e0, 100.0, 0.0, n0, 0.0, -100.0], code, tm=tm))
    service = TileService(spark, [str(tmp_path)])
    info = service.info("grid.tif")
    west, south, east, north = info["extent"]
    assert info["error"] is None and west < place[0] + 0.02 < east and south < place[1] - 0.05 < north
    z, x, y = tile_of(place[0] + 0.15, place[1] - 0.1, 11)
    picture = png.decode(service.raster_tiles("grid.tif", [(z, x, y)]).first().data)
    side, at = 2 * grid.HALF / 2**z, (np.arange(256) + 0.5) / 256
    mx, my = np.broadcast_arrays((-grid.HALF + (x + at) * side)[None, :], (grid.HALF - (y + at) * side)[:, None])
    e, n = projection.forward(*projection.inverse(mx, my, 3857), system)
    col, r = (e - e0) / 24000 * 239, (1 - (n - n0 + 20000) / 20000) * 199
    ok = (col >= 1) & (r >= 1) & (col < 238) & (r < 198)
    assert ok.any() and np.array_equal(picture[:, :, 0][ok], np.floor((np.floor(r) + np.floor(col))[ok] / 438 * 255))


def test_features_in_any_known_system(spark, tmp_path):
    places = {"a": ("urn:ogc:def:crs:EPSG::2154", 2154, (2.35, 48.85)), "b": ("EPSG:3035", 3035, (5.0, 50.0)), "c": ("EPSG:4258", 4258, (5.5, 50.5)), "d": ("EPSG:27700", None, (1.0, 1.0))}
    for name, (crs, code, place) in places.items():
        x, y = projection.forward(*map(np.float64, place), code) if code else place
        feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [float(x), float(y)]}, "properties": {}}
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}}, "features": [feature]}))
    service = TileService(spark, [str(tmp_path)])
    for name, (_, code, place) in places.items():
        got = [json.loads(r.geometry)["coordinates"] for r in service.features(f"{name}.geojson").collect()]
        assert got == ([pytest.approx(place, abs=1e-7)] if code else [])  # never a guess
