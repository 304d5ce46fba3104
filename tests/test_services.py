import datetime
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quadrel.functions import paths
from quadrel.operators import catalog, ogc, tilestore
from quadrel.sources import fixtures
from quadrel.streaming import requests


def test_catalog(spark):
    c, seen = catalog.Catalog(spark), []
    c.subscribe(lambda e, n: seen.append((e, n)))
    c.mount("b.tif", "/data/b.tif")
    c.mount("a.json", "/data/a.json")
    with pytest.raises(catalog.DuplicateSource):
        c.mount("b.tif", "/other/b.tif")
    with pytest.raises(catalog.WrongKind):
        c.get("a.json", "raster")
    with pytest.raises(catalog.UnknownSource):
        c.get("c.tif")
    with pytest.raises(ValueError):
        c.mount("t", "/data/t.txt")
    c.mount_or_replace("b.tif", "/other/b.tif")
    assert [r.name for r in c.sources().collect()] == ["a.json", "b.tif"] and len(c) == 2 and "b.tif" in c
    c.unmount("a.json")
    assert seen == [("mount", "b.tif"), ("mount", "a.json"), ("mount", "b.tif"), ("unmount", "a.json")]


def test_scan_and_config(spark, tmp_path):
    for n in ("x.tif", "openapi.json", "y.geojson", "z.txt"):
        (tmp_path / n).write_text("-")
    c = catalog.Catalog(spark)
    c.configure({"sources": [{"name": "x.tif", "path": "/elsewhere/x.tif"}]})
    failed = c.scan([str(tmp_path)])
    assert c.names() == ["x.tif", "y.geojson"] and c.get("x.tif")["path"] == "/elsewhere/x.tif" and len(failed) == 1
    catalog.write_default_config(str(tmp_path / "c.yaml"))
    assert catalog.load_config(str(tmp_path / "c.yaml")) == catalog.DEFAULT_CONFIG and catalog.load_config("/no/such") == {}
    assert catalog.option(None, 0, 5) == 0


def test_path_validation(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        (d / "n").mkdir(parents=True)
        (d / "n" / "f.tif").write_text(str(d))
    (b / "only.tif").write_text("b")
    (tmp_path / "secret").write_text("s")
    os.symlink(tmp_path / "secret", a / "link")
    bases = [str(a), str(b)]
    assert catalog.validate_path(bases, "n/f.tif") == str(a / "n" / "f.tif")
    assert catalog.validate_path(bases, "only.tif") == str(b / "only.tif")
    for bad in ("../secret", "/etc/passwd", "n/../../secret"):
        with pytest.raises(ValueError):
            catalog.validate_path(bases, bad)
    for gone in ("no.tif", "link"):
        with pytest.raises(FileNotFoundError):
            catalog.validate_path(bases, gone)


def test_documents(spark, sf_dir):
    layers = fixtures.layers(spark, sf_dir)
    n = ogc.rasters(layers).count()
    ns = {"w": "http://www.opengis.net/wms", "t": "http://www.opengis.net/wmts/1.0"}
    wms = ElementTree.fromstring(ogc.wms_capabilities(layers).split("?>", 1)[1])
    assert len(wms.findall("w:Capability/w:Layer/w:Layer", ns)) == n
    wmts = ElementTree.fromstring(ogc.wmts_capabilities(layers).split("?>", 1)[1])
    assert len(wmts.findall("t:Contents/t:Layer", ns)) == n and len(wmts.findall(".//t:TileMatrix", ns)) == 23
    assert len(ElementTree.fromstring(ogc.tms_root(layers).split("?>", 1)[1]).findall(".//{*}TileMap")) == n
    row = ogc.tms_layer(layers).join(layers, "name").first()
    assert len(ElementTree.fromstring(row.xml.split("?>", 1)[1]).findall(".//{*}TileSet")) == min(row.max_zoom, 22) + 1
    none = ElementTree.fromstring(ogc.wms_capabilities(layers.where("false")).split("?>", 1)[1])
    assert none.find(".//{*}EX_GeographicBoundingBox") is None
    assert "&lt;" in ogc.exception_xml("Code", "<x>")


def test_names_are_escaped(spark):
    layers = spark.createDataFrame([("a<&>.tif", "raster", 0.0, 0.0, 1.0, 1.0, 3)], "name string, kind string, w double, s double, e double, n double, max_zoom int")
    assert ElementTree.fromstring(ogc.wms_layer(layers).first().xml).find("Name").text == "a<&>.tif"


@pytest.mark.parametrize(
    ("change", "verdict"),
    [({}, "ok"), ({"SERVICE": "WFS"}, "InvalidService"), ({"REQUEST": None}, "OperationNotSupported"), ({"LAYERS": ""}, "LayerNotDefined"), ({"CRS": "EPSG:4326"}, "InvalidCRS"), ({"BBOX": "1,2,3"}, "InvalidBBox"), ({"BBOX": "1,2,3,x"}, "InvalidBBox"), ({"WIDTH": "0"}, "InvalidDimensionValue"), ({"HEIGHT": "4097"}, "InvalidDimensionValue")],
)
def test_map_request(spark, change, verdict):
    p = {"SERVICE": "WMS", "REQUEST": "GetMap", "LAYERS": "a,b", "CRS": "EPSG:3857", "BBOX": "0,0,1,1", "WIDTH": "256", "HEIGHT": "256"} | change
    df = spark.createDataFrame([({k.lower() if k == "BBOX" else k: v for k, v in p.items() if v is not None},)], "p map<string,string>")
    assert df.select(ogc.check_map_request(F.col("p"))).first()[0] == verdict


def test_eviction(spark):
    t = datetime.datetime(2024, 1, 1)
    files = spark.createDataFrame([(f"{i:02}", t + datetime.timedelta(hours=7 * i), 100) for i in range(20)], "path string, mtime timestamp, size long")
    assert sorted(r.path for r in tilestore.evict(files, 1500).collect()) == [f"{i:02}" for i in range(8)]
    assert tilestore.evict(files, 2000).count() == 0


def test_store_round_trip(spark, tmp_path):
    tiles = spark.createDataFrame([("a", 1, 0, 0, b"x"), ("a", 1, 0, 1, b"y")], "layer string, z int, x int, y int, data binary")
    tilestore.write(tiles, str(tmp_path / "store"))
    asked = spark.createDataFrame([("a", 1, 0, 1), ("a", 2, 0, 1)], "layer string, z int, x int, y int")
    hits, misses = tilestore.lookup(asked, spark.read.parquet(str(tmp_path / "store")), ["layer", "z", "x", "y"])
    assert [bytes(r.data) for r in hits.collect()] == [b"y"] and [r.z for r in misses.collect()] == [2]


def test_lru():
    c = tilestore.LruCache(10)
    c.put("a", b"12345")
    c.put("b", b"1234")
    assert c.get("a") == b"12345"
    c.put("a", b"123456")  # a key that is put again counts once
    assert c.bytes == 10 and c.get("b")
    c.put("c", b"1234")
    assert c.get("a") is None and c.get("b") and len(c) == 2 and (c.hits, c.misses) == (3, 1)
    c.put("d", b"x" * 11)
    assert c.get("d") is None
    c.clear()
    assert len(c) == c.bytes == 0


def test_content_hash(spark):
    df = spark.createDataFrame([(b"",), (b"a" * 10000,), (b"a" * 9999 + b"b",), (b"a" * 10000,)], "c binary")
    h = [r[0] for r in df.select(paths.content_hash(F.col("c"))).collect()]
    assert h[1] == h[3] and len(set(h)) == 3


def test_stream(spark, sf_dir, tmp_path):
    rows = fixtures.reqs(spark, sf_dir)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = requests.read(spark, str(tmp_path / "in"))
    q = requests.hourly(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.window.start, r.layer, r.n) for r in spark.table("hourly").collect())
    assert got == sorted((r.window.start, r.layer, r.n) for r in requests.hourly(rows).collect())
    requests.write(requests.distinct_tiles(requests.read(spark, str(tmp_path / "in")), "1000 days"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.dropDuplicates(["layer", "z", "x", "y"]).count()


def test_documents_of_odd_names(spark):
    import json
    from xml.etree import ElementTree

    rows = spark.createDataFrame([('a"b\\c<&>.tif', "raster", 1.0, 2.0, 3.0, 4.0, 9)], "name string, kind string, w double, s double, e double, n double, max_zoom int")
    assert json.loads(ogc.tilejson(rows).first().json)["name"] == 'a"b\\c<&>.tif'
    for text in (ogc.wms_capabilities(rows), ogc.wmts_capabilities(rows), ogc.tms_root(rows), ogc.tms_layer(rows).first().xml):
        ElementTree.fromstring(text)
    error = ElementTree.fromstring(ogc.exception_xml('a" b="c', "x < y"))[0]
    assert error.attrib == {"code": 'a" b="c'} and error.text == "x < y"
