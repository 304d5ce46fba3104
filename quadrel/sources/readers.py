"""Readers of raster and vector files as DataFrames.

Files are listed by Spark's binaryFile source, so any of its file systems will do. Of a
raster that tasks can open by its path (a local or mounted file), only the header and the wanted
strips or tiles are read, each by the task that decodes it. Other rasters and vector
files are read whole by that source, one file at a time, and must fit a task's memory;
larger ones belong into a chunk table (`render.chunks`). Files that cannot be parsed
give a row with an error in the catalogue readers and no features in the others;
`rejects` lists them.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import fields
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions import crs, geometry, grid, projection
from quadrel.sources import ranges, shapefile, tiff


def files(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """path, mtime, size, content; not of subfolders."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.load(paths).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def stem(path):
    return F.regexp_replace(path, "[.][^./]*$", "")


def _rows(parse: Callable[..., Iterator[tuple]], cols: list[str], names: list[str], types: list[pa.DataType]):
    """An Arrow function that parses a file at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                held: list[tuple] = []
                for row in parse(*(rb.column(c)[i].as_py() for c in cols)):
                    held.append(row)
                    if len(held) >= 2048:
                        yield _batch(held, names, types)
                        held = []
                if held:
                    yield _batch(held, names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


# ---------------------------------------------------------------- rasters

_META = "path string, width int, height int, bands int, dtype string, nodata string, gt array<double>, crs_class string, epsg int, n_levels int, error string, tm array<double>, extent array<double>"


#: What broken files raise.
_BROKEN = (ValueError, IndexError, KeyError, struct.error)
#: Bytes of pixels in an Arrow batch, and of stored chunks that one task reads, about.
BATCH_BYTES = 16 << 20
TASK_BYTES = 64 << 20


def _opened(path: str | None, content: bytes | None):
    """The bytes of a file that was read, or else its ranges."""
    if content is not None or path is None:
        return content
    return ranges.Ranged(ranges.local_path(path))


def _info(path: str, content: bytes | None, ovr: str | None, ovr_content: bytes | None, world: bytes | None = None) -> tiff.Info:
    """Images of a file, with those beside it unless that file cannot be read."""
    text = world.decode("latin-1") if world else None
    try:
        return tiff.read_info(_opened(path, content), text, _opened(ovr, ovr_content))
    except _BROKEN:
        return tiff.read_info(_opened(path, content), text)


_FILE = ["path", "content", "ovr", "ovr_content"]


def _meta(path: str, content: bytes | None, ovr: str | None, ovr_content: bytes | None, world: bytes | None) -> Iterator[tuple]:
    try:
        x = _info(path, content, ovr, ovr_content, world)
        b = x.levels[0]
        yield (path, b.width, b.height, b.bands, b.dtype[1:], x.nodata, x.transform, x.crs_class, x.epsg, len(x.levels), None, x.tm, projection.extent(x.transform, b.width, b.height, projection.declared(x.epsg, x.tm)))
    except Exception as e:  # noqa: BLE001  the file's fault is its row's error
        yield (path, *[None] * 9, f"{type(e).__name__}: {e}", None, None)


def _with_world(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """TIFF files with the world files and external overviews beside them: a.tif, a.tfw, a.tif.ovr or a.ovr.

    Columns path, content, ovr, ovr_content, world; the contents are null for files that tasks open themselves.
    """
    none = F.lit(None).cast("binary")
    whole = _whole(spark, paths)
    every = files(spark, paths) if whole else files(spark, paths).withColumn("content", none)
    tifs = every.where(F.lower("path").rlike("[.]tiff?$")).withColumn("stem", stem(F.col("path")))
    worlds = files(spark, paths, "*.[tT][fF][wW]").select(stem(F.col("path")).alias("stem"), F.col("content").alias("world"))
    ovrs = every.where(F.lower("path").rlike("[.]ovr$")).select(stem(F.col("path")).alias("of"), F.struct(F.col("path").alias("ovr"), F.col("content").alias("ovr_content")).alias("beside"))
    own = ovrs.where(F.lower("of").rlike("[.]tiff?$")).select(F.col("of").alias("path"), F.col("beside").alias("own"))
    plain = ovrs.where(~F.lower("of").rlike("[.]tiff?$")).withColumnRenamed("of", "stem")
    found = tifs.join(worlds, "stem", "left").join(plain, "stem", "left").join(own, "path", "left").withColumn("beside", F.coalesce("own", "beside"))
    return found.select("path", "content", "beside.ovr", "beside.ovr_content", "world")


def _whole(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether some files are where only Spark's readers can open them. Lists names; reads no content."""
    return bool(files(spark, paths).select("path").where(~F.col("path").startswith("file:")).head(1))


def geotiff_meta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each TIFF: its size, georeference, extent in degrees, greatest zoom, or the error."""
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = [c.split()[0] for c in _META.split(", ")]
    rows = _with_world(spark, paths).mapInArrow(_rows(_meta, [*_FILE, "world"], names, types), _META)
    degrees = F.col("crs_class") != "Projected"
    return rows.withColumn("max_zoom", grid.max_zoom(F.get("gt", F.lit(1)), degrees))


def _levels(path: str, *rest) -> Iterator[tuple]:
    try:
        for i, x in enumerate(_info(path, *rest).levels):
            yield (path, i, x.width, x.height, "tile" if x.tiled else "strip", x.chunk_w, x.chunk_h, x.external)
    except _BROKEN:
        return


def geotiff_levels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each image of each TIFF."""
    names = ["path", "idx", "width", "height", "chunk_type", "chunk_w", "chunk_h", "external"]
    kinds = ["string", "int", "int", "int", "string", "int", "int", "boolean"]
    types = [pa.string(), *[pa.int32()] * 3, pa.string(), *[pa.int32()] * 2, pa.bool_()]
    return _with_world(spark, paths).mapInArrow(_rows(_levels, _FILE, names, types), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


_CHUNK = "path string, band int, row0 long, col0 long, w int, h int, values array<double>"
_PLACE = "path string, source string, spec string, idx long, offset long, count long"


def _decoded(path: str, data, level: tiff.Level, index: int) -> Iterator[tuple]:
    """Rows of one strip or tile, one for each of its bands."""
    r, c, band, a = tiff.read_chunk(data, level, index)
    for b in range(a.shape[2]):
        yield (path, (b if band is None else band) + 1, r, c, a.shape[1], a.shape[0], np.ascontiguousarray(a[:, :, b]).ravel())


def _chunk_batches(parse: Callable[..., Iterator[tuple]], cols: list[str]):
    """An Arrow function of rows of pixels, in batches of about BATCH_BYTES."""
    names = [c.split()[0] for c in _CHUNK.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for rb in batches:
            for i in range(rb.num_rows):
                for row in parse(*(rb.column(c)[i].as_py() for c in cols)):
                    held.append(row)
                    size += row[-1].nbytes
                    if size >= BATCH_BYTES:
                        yield _batch(held, names, types)
                        held, size = [], 0
        if held:
            yield _batch(held, names, types)

    return run


def geotiff_chunks(spark: SparkSession, paths: str | list[str], level: int = 0, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """A row for each stored chunk and band of a level: path, band, row0, col0, w, h, values (row by row).

    rows, cols: a window (first, end) of the level; only strips or tiles that touch it are read and decoded.
    Files that tasks can open are listed by their headers first and then dealt by chunks, so a
    file may be larger than a task.
    """

    def of_level(path: str, *rest) -> tiff.Level | None:
        try:
            levels = _info(path, *rest).levels
        except _BROKEN:
            return None
        return levels[level] if level < len(levels) else None

    def parse(path: str, content: bytes, ovr: str | None, ovr_content: bytes | None) -> Iterator[tuple]:
        x = of_level(path, content, ovr, ovr_content)
        for i in tiff.overlapping(x, rows, cols) if x else []:
            yield from _decoded(path, ovr_content if x.external else content, x, i)

    def places(path: str, content: None, ovr: str | None, ovr_content: None) -> Iterator[tuple]:
        x = of_level(path, content, ovr, ovr_content)
        if x:
            spec = json.dumps({f.name: getattr(x, f.name) for f in fields(x) if f.name not in ("offsets", "counts")})
            for i in tiff.overlapping(x, rows, cols):
                yield (path, ovr if x.external else path, spec, i, x.offsets[i], x.counts[i])

    def read(path: str, source: str, spec: str, idx: int, offset: int, count: int) -> Iterator[tuple]:
        x = tiff.Level(**json.loads(spec), offsets={idx: offset}, counts={idx: count})
        yield from _decoded(path, _opened(source, None), x, idx)

    inputs = _with_world(spark, paths)
    if _whole(spark, paths):
        return inputs.mapInArrow(_chunk_batches(parse, _FILE), _CHUNK)
    names = [c.split()[0] for c in _PLACE.split(", ")]
    found = inputs.mapInArrow(_rows(places, _FILE, names, [*[pa.string()] * 3, *[pa.int64()] * 3]), _PLACE)
    total = found.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # Neighbours in a file go to one task. The number is given, as adaptive execution sees places, not pixels.
    dealt = found.repartition(int(total // TASK_BYTES) + spark.sparkContext.defaultParallelism, "path", F.expr(f"offset div {TASK_BYTES // 16}"))
    return dealt.mapInArrow(_chunk_batches(read, names), _CHUNK)


def geotiff_window(spark: SparkSession, paths: str | list[str], rows: tuple[int, int], cols: tuple[int, int], level: int = 0) -> DataFrame:
    """Pixels (path, band, row, col, v) of a window (first, end) of a level; none outside the image."""
    inside = (F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
    return pixels(geotiff_chunks(spark, paths, level, rows, cols)).where(inside)


def pixels(chunks: DataFrame) -> DataFrame:
    """The pixel table of stored chunks: path, band, row, col, v."""
    rows = chunks.select("path", "band", "row0", "col0", "w", F.posexplode("values").alias("p", "v"))
    return rows.select("path", "band", (F.col("row0") + F.expr("p div w")).alias("row"), (F.col("col0") + F.col("p") % F.col("w")).alias("col"), "v")


# ---------------------------------------------------------------- vectors

_FEATURE = "path string, ord long, id string, geometry string, props string, xmin double, ymin double, xmax double, ymax double, epsg int"
_NAMES = [c.split()[0] for c in _FEATURE.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4, pa.int32()]


def _feature(path: str, n: int, id_, shape, props, epsg: int | None) -> tuple | None:
    box = geometry.bbox(*shape) if shape else None
    if box is None:
        return None
    text = lambda v: None if v is None else json.dumps(v, ensure_ascii=False)
    return (path, n, None if id_ is None else str(id_), json.dumps(geometry.to_geojson(*shape)), text(props), *box, epsg)


def _features(read: Callable[..., Iterator[tuple]]):
    """Features of a file; a file that cannot be read has none, a bad feature is left out."""

    def parse(path: str, *content) -> Iterator[tuple]:
        try:
            found = list(read(*content))
        except (ValueError, KeyError, TypeError, IndexError, UnicodeDecodeError, ElementTree.ParseError, zipfile.BadZipFile):
            return
        for n, (id_, shape, props, epsg) in enumerate(found):
            row = _feature(path, n, id_, shape, props, epsg)
            if row:
                yield row

    return parse


def crs_name(value: dict) -> str | None:
    """Name of the legacy crs member."""
    c = value.get("crs")
    return ((c or {}).get("properties") or {}).get("name") if isinstance(c, dict) else None


def _geojson(content: bytes) -> Iterator[tuple]:
    doc = json.loads(content)
    kind = doc.get("type")
    parts = doc["features"] if kind == "FeatureCollection" else [doc] if kind == "Feature" else [{"geometry": doc}]
    whole = crs_name(doc)
    for f in parts:
        yield f.get("id"), geometry.from_geojson(f.get("geometry")), f.get("properties"), crs_name(f) or whole


def _kml_number(text: str):
    return [tuple(float(v) for v in p.split(",")[:2]) for p in (text or "").split()]


def _kml_shape(e):
    tag = e.tag.rsplit("}", 1)[-1]
    kids = {}
    for c in e:
        kids.setdefault(c.tag.rsplit("}", 1)[-1], []).append(c)
    if tag == "Point":
        return ("Point", _kml_number(kids["coordinates"][0].text)[0])
    if tag == "LineString":
        return ("LineString", _kml_number(kids["coordinates"][0].text))
    if tag == "LinearRing":
        return ("LineString", _kml_number(kids["coordinates"][0].text))
    if tag == "Polygon":
        rings = [r for k in ("outerBoundaryIs", "innerBoundaryIs") for b in kids.get(k, []) for r in b]
        return ("Polygon", [_kml_shape(r)[1] for r in rings])
    if tag == "MultiGeometry":
        return ("GeometryCollection", [s for c in e if (s := _kml_shape(c))])
    return None


def _kml(content: bytes) -> Iterator[tuple]:
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))
    for mark in ElementTree.fromstring(content).iter():
        if mark.tag.rsplit("}", 1)[-1] != "Placemark":
            continue
        shape, props = None, {}
        for c in mark:
            tag = c.tag.rsplit("}", 1)[-1]
            if tag in ("name", "description"):
                props[tag] = c.text
            else:
                try:
                    shape = _kml_shape(c) or shape
                except (ValueError, KeyError, IndexError):
                    continue
        yield mark.get("id"), shape, props, None


def _wkt(content: bytes) -> Iterator[tuple]:
    yield None, geometry.from_wkt(content.decode("utf-8")), None, None


def _to_degrees(rows: DataFrame, name: str) -> DataFrame:
    """Features in degrees: those of known CRS names are moved, those of unknown ones left out."""
    code = F.when(F.col(name).isNull(), 4326).otherwise(crs.parse(F.col(name)))
    rows = rows.withColumn("epsg", code).drop(name)
    plain = rows.where("epsg = 4326")
    moved = rows.where("epsg is not null and epsg <> 4326").mapInArrow(_move, _FEATURE)
    return plain.select(*_NAMES).unionByName(moved)


def inverse(code: int) -> Callable[[float, float], tuple[float, float]]:
    """Longitude and latitude of a point in a known CRS."""

    def f(x: float, y: float) -> tuple[float, float]:
        lng, lat = projection.inverse(np.float64(x), np.float64(y), code)
        return float(lng), float(lat)

    return f


def _move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        out = []
        for row in rb.to_pylist():
            shape = geometry.reproject(*geometry.from_geojson(json.loads(row["geometry"])), inverse(row["epsg"]))
            box = geometry.bbox(*shape) if shape else None
            if box:
                out.append((row["path"], row["ord"], row["id"], json.dumps(geometry.to_geojson(*shape)), row["props"], *box, 4326))
        if out:
            yield _batch(out, _NAMES, _TYPES)


def _read(rows: DataFrame, read, cols: list[str]) -> DataFrame:
    names = [*_NAMES[:-1], "crs"]
    schema = _FEATURE.replace("epsg int", "crs string")
    return _to_degrees(rows.mapInArrow(_rows(_features(read), ["path", *cols], names, [*_TYPES[:-1], pa.string()]), schema), "crs")


def geojson(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Features of GeoJSON files, in degrees: path, ord, id, geometry and props as JSON, bounds, epsg."""
    return _read(files(spark, paths).where(F.lower("path").rlike("[.](geo)?json$")), _geojson, ["content"])


def wkt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The geometry of each WKT file."""
    return _read(files(spark, paths).where(F.lower("path").endswith(".wkt")), _wkt, ["content"])


def kml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Placemarks of KML and KMZ files."""
    return _read(files(spark, paths).where(F.lower("path").rlike("[.]km[lz]$")), _kml, ["content"])


def shp(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of shapefiles with the attributes of the same record number; the .prj gives the CRS."""
    every = files(spark, paths).withColumn("stem", stem(F.col("path"))).withColumn("ext", F.lower(F.regexp_extract("path", "[.]([^./]*)$", 1)))
    part = lambda e: every.where(F.col("ext") == e).select("stem", F.col("content").alias(e))
    rows = every.where("ext = 'shp'").join(part("dbf"), "stem", "left").join(part("prj"), "stem", "left")
    code = crs.prj(F.decode("prj", "UTF-8"))
    name = F.when(F.col("prj").isNull(), "EPSG:4326").otherwise(F.coalesce(F.concat(F.lit("EPSG:"), code.cast("string")), F.lit("unknown")))
    return _read(rows.select("path", F.col("content"), "dbf", name.alias("crs")), shapefile.read, ["content", "dbf", "crs"])


def vector(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Features of all supported vector files."""
    out = geojson(spark, paths)
    for read in (wkt, kml, shp):
        out = out.unionByName(read(spark, paths))
    return out


def rejects(spark: SparkSession, paths: str | list[str], features: DataFrame) -> DataFrame:
    """Supported vector files of which no feature was read."""
    known = files(spark, paths).where(F.lower("path").rlike("[.](geojson|json|wkt|kml|kmz|shp)$")).select("path")
    return known.join(features.select("path").distinct(), "path", "left_anti")
