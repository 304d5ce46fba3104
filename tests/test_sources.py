import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.sources import png, ranges, readers, shapefile, tiff


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize("options", [{}, {"tile": 16}, {"planar": True}, {"compress": True}, {"order": ">"}, {"tile": 16, "planar": True, "compress": True}])
def test_tiff_round_trip(kind, options):
    a = np.random.default_rng(1).integers(0, 200, (45, 37, 3)).astype(kind)
    data = tiff.write([a], [5.0, 0.5, 0.0, 50.0, 0.0, -0.5], 32633, "-9999", **options)
    info = tiff.read_info(data)
    assert (tiff.read_image(data, info.levels[0]) == a).all()
    assert (info.transform, info.epsg, info.crs_class, info.nodata.strip("\0")) == ([5.0, 0.5, 0.0, 50.0, 0.0, -0.5], 32633, "Projected", "-9999")


def test_tiff_predictor():
    a = np.random.default_rng(1).integers(0, 255, (20, 20, 1)).astype("uint8")
    data = tiff.write([a], predictor=True, compress=True)
    assert (tiff.read_image(data, tiff.read_info(data).levels[0]) == a).all()


def test_lzw_and_packbits():
    # Codes of nine bits: clear, 7, the code just being made, 8, end.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257))
    packed = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff._lzw(packed) == bytes([7, 7, 7, 8])
    assert tiff._packbits(bytes([2, 1, 2, 3, 0xFE, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])


def test_overviews_and_world_file():
    a = np.random.default_rng(1).integers(0, 255, (600, 520, 1)).astype("uint8")
    ovr = tiff.write_overviews(a)
    info = tiff.read_info(tiff.write([a]), "0.5\n0\nnote\n0\n-0.5\n10\n50\n", ovr)
    assert [(x.width, x.height, x.external) for x in info.levels] == [(520, 600, False), (260, 300, True), (130, 150, True)]
    assert info.transform == [10.0, 0.5, 0.0, 50.0, 0.0, -0.5]
    assert tiff.read_info(tiff.write([a]), "not numbers").transform[0] == 0.0
    with pytest.raises(tiff.Unsupported):
        tiff.write_overviews(np.zeros((9, 9, 5)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    a = np.arange(40 * 30, dtype="float32").reshape(40, 30, 1)
    (d / "a.tif").write_bytes(tiff.write([a, a[::2, ::2]], [10.0, 0.1, 0.0, 50.0, 0.0, -0.1], 4326))
    (d / "bad.tif").write_bytes(b"no picture")
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    features = [
        {"type": "Feature", "id": 7, "geometry": {"type": "Polygon", "coordinates": [square]}, "properties": {"k": 1}},
        {"type": "Feature", "geometry": None, "properties": {}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": ["x"]}, "properties": {}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": None},
    ]
    (d / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (d / "m.json").write_text(json.dumps({"type": "Feature", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "geometry": {"type": "Point", "coordinates": [1113194.9079327357, 0]}, "properties": {}}))
    (d / "u.json").write_text(json.dumps({"type": "Feature", "crs": {"properties": {"name": "local"}}, "geometry": {"type": "Point", "coordinates": [1, 1]}}))
    (d / "broken.json").write_text("{")
    (d / "w.wkt").write_text("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")
    kml = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><Placemark id="p"><name>n</name><Point><coordinates>3,4,0</coordinates></Point></Placemark></Folder><Placemark><LineString><coordinates>0,0 1,1</coordinates></LineString></Placemark></Document></kml>'
    (d / "k.kml").write_text(kml)
    with zipfile.ZipFile(d / "z.kmz", "w") as z:
        z.writestr("doc.kml", kml)
    (d / "s.shp").write_bytes(shapefile.write([("Point", (500000.0, 4982950.4)), None, ("Point", (600000.0, 5000000.0))]))
    (d / "s.dbf").write_bytes(shapefile.write_table([("NAME", "C", 8, 0), ("N", "N", 6, 0)], [("one", 1), ("two", 2), ("three", "")]))
    (d / "s.prj").write_text('PROJCS["x",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32631"]]')
    (d / "sub").mkdir()
    (d / "sub" / "b.json").write_text("{}")
    return str(d)


def test_geotiff(spark, folder):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in readers.geotiff_meta(spark, folder).collect()}
    a = rows["a.tif"]
    assert (a.width, a.height, a.bands, a.dtype, a.epsg, a.n_levels) == (30, 40, 1, "f4", 4326, 2)
    assert a.extent == pytest.approx([10.0, 46.0, 13.0, 50.0])
    assert rows["bad.tif"].error and rows["bad.tif"].width is None
    assert readers.geotiff_levels(spark, folder).count() == 2
    px = readers.pixels(readers.geotiff_chunks(spark, folder))
    assert px.count() == 1200 and px.where(F.col("v") != F.col("row") * 30 + F.col("col")).count() == 0
    assert readers.pixels(readers.geotiff_chunks(spark, folder, 1)).count() == 300


def test_ranges_read_what_is_asked(tmp_path):
    a = np.random.default_rng(3).integers(0, 255, (2048, 1024, 1)).astype("uint8")
    path = tmp_path / "big.tif"
    path.write_bytes(tiff.write([a], tile=256))
    data = ranges.Ranged(str(path))
    level = tiff.read_info(data).levels[0]
    found = tiff.overlapping(level, (300, 310), (250, 260))
    assert found == [4, 5]
    r, c, _, part = tiff.read_chunk(data, level, found[1])
    assert (part[:, :, 0] == a[r : r + 256, c : c + 256, 0]).all()
    assert data.bytes_read <= 4 * ranges.PAGE < len(data) // 4
    whole = path.read_bytes()
    for start, end in [(0, 10), (ranges.PAGE - 3, ranges.PAGE + 3), (5, 3 * ranges.PAGE), (len(whole) - 4, len(whole) + 9), (9, 9)]:
        assert data[start:end] == whole[start:end]
    for p in range(0, len(whole), ranges.PAGE):
        assert data[p : p + 5] == whole[p : p + 5]
    assert len(data.pages) <= ranges.KEPT


def test_local_paths():
    assert [ranges.local_path(p) for p in ("/a/b c.tif", "file:/a/b.tif", "file:///a/b.tif", "hdfs://h/a.tif", "s3a://b/a.tif")] == ["/a/b c.tif", "/a/b.tif", "/a/b.tif", None, None]


@pytest.mark.parametrize("options", [{}, {"tile": 64}, {"tile": 64, "planar": True, "compress": True}])
def test_windows_of_files(spark, tmp_path, options, monkeypatch):
    a = np.random.default_rng(4).integers(0, 60000, (300, 200, 2)).astype("uint16")
    (tmp_path / "a b.tif").write_bytes(tiff.write([a], **options))
    (tmp_path / "a b.tif.ovr").write_bytes(tiff.write([a[::2, ::2]], **options))
    (tmp_path / "cut.tif").write_bytes(tiff.write([a])[:6] + b"\xff")
    (tmp_path / "a b.TFW").write_text("0.5\n0\n0\n-0.5\n10\n50\n")

    def window(level, rows, cols):
        px = readers.geotiff_window(spark, str(tmp_path), rows, cols, level).collect()
        return {(p.band, p.row, p.col): p.v for p in px}

    def expected(image, rows, cols):
        return {(b + 1, r, c): float(image[r, c, b]) for b in range(2) for r in range(max(rows[0], 0), min(rows[1], image.shape[0])) for c in range(max(cols[0], 0), min(cols[1], image.shape[1]))}

    for whole in (False, True):
        monkeypatch.setattr(readers, "_whole", lambda *_, whole=whole: whole)
        for rows, cols in [((60, 70), (120, 135)), ((-5, 3), (190, 400)), ((300, 310), (0, 5)), ((9, 9), (0, 5))]:
            assert window(0, rows, cols) == expected(a, rows, cols)
        assert window(1, (60, 70), (30, 70)) == expected(a[::2, ::2], (60, 70), (30, 70))
        assert window(2, (0, 9), (0, 9)) == {}
        meta = {m.path.rsplit("/", 1)[-1]: m for m in readers.geotiff_meta(spark, str(tmp_path)).collect()}
        assert meta["cut.tif"].error and (meta["a b.tif"].n_levels, meta["a b.tif"].gt[0]) == (2, 10.0)
        assert readers.geotiff_levels(spark, str(tmp_path)).count() == 2
    few = readers.geotiff_chunks(spark, str(tmp_path), 0, (60, 63), (120, 125)).count()
    assert few < readers.geotiff_chunks(spark, str(tmp_path)).count()


def test_headers_are_read_without_contents(spark, folder):
    plan = readers.geotiff_meta(spark, folder)._jdf.queryExecution().executedPlan().toString()
    reads = [p.split(">")[0] for p in plan.split("ReadSchema: struct<")[1:]]
    assert reads and all("content" not in r for r in reads if "path" in r and "length" in r) and sum("content" in r for r in reads) <= 1


def test_vector_files(spark, folder):
    rows = readers.vector(spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    assert [(r.id, r.xmin, r.xmax) for r in sorted(by["f.geojson"], key=lambda r: r.ord)] == [("7", 0.0, 2.0), (None, 5.0, 5.0)]
    assert by["m.json"][0].xmin == pytest.approx(10.0) and "u.json" not in by and "b.json" not in by
    assert by["w.wkt"][0].xmax == 6.0 and len(by["k.kml"]) == len(by["z.kmz"]) == 2
    s = sorted(by["s.shp"], key=lambda r: r.ord)
    assert [json.loads(r.props) for r in s] == [{"NAME": "one", "N": 1}, {"NAME": "three", "N": None}]
    assert (s[0].xmin, s[0].ymin) == pytest.approx((3.0, 45.0), abs=1e-6)
    bad = {r.path.rsplit("/", 1)[-1] for r in readers.rejects(spark, folder, readers.vector(spark, folder)).collect()}
    assert bad == {"u.json", "broken.json"}


def test_png_round_trip():
    a = np.random.default_rng(2).integers(0, 255, (9, 7, 4)).astype("uint8")
    assert (png.decode(png.encode(a)) == a).all()
