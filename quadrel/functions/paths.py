"""Names, kinds, paths and option strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind and media types.
RASTER = ["tif", "tiff"]
VECTOR = ["geojson", "json", "shp", "wkt", "kml", "kmz"]
MIME = {
    "html": "text/html",
    "js": "application/javascript",
    "css": "text/css",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "json": "application/json",
    "xml": "application/xml",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "geojson": "application/geo+json",
    "webp": "image/webp",
    "ico": "image/x-icon",
    "woff2": "font/woff2",
}
# Names of modes in requests; anything else is nearest or minmax.
RESAMPLING = {"nearest": "nearest", "nearest-neighbor": "nearest", "bilinear": "bilinear", "bicubic": "bicubic", "lanczos": "lanczos3", "lanczos3": "lanczos3"}
STRETCH = {"percentile": "percentile", "stddev": "stddev", "standard-deviation": "stddev"}


def _lookup(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def extension(path: Column) -> Column:
    """Lower-cased extension, '' if there is none."""
    return F.lower(F.regexp_extract(path, "[.]([^./]+)$", 1))


def is_raster(ext: Column) -> Column:
    return ext.isin(RASTER)


def is_vector(ext: Column) -> Column:
    return ext.isin(VECTOR)


def kind(ext: Column) -> Column:
    """raster, vector, or null for unsupported files."""
    return F.when(is_raster(ext), "raster").when(is_vector(ext), "vector")


def mime(path: Column) -> Column:
    return _lookup(MIME, extension(path), "application/octet-stream")


def hidden(path: Column) -> Column:
    """Whether any part of the path is a dotfile."""
    return F.exists(F.split(path, "/"), lambda s: s.startswith("."))


def check(path: Column) -> Column:
    """ok, traversal or absolute: the rules that need no file system."""
    parts = F.split(path, "[/]")
    return F.when(F.array_contains(parts, ".."), "traversal").when(path.startswith("/"), "absolute").otherwise("ok")


def operation_id(base: Column, name: Column) -> Column:
    return F.concat(base, F.lit("_"), F.regexp_replace(name, "[^A-Za-z0-9_]", "_"))


def band_list(text: Column) -> Column:
    """Band numbers of a list like '1, 2,x,3': parts that are no number from 1 to 2**32 - 1 are left out."""
    numbers = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("bigint"))
    return F.filter(numbers, lambda n: n.isNotNull() & n.between(1, 4294967295))


def resampling(text: Column) -> Column:
    return _lookup(RESAMPLING, F.lower(text), "nearest")


def stretch(text: Column) -> Column:
    return _lookup(STRETCH, F.lower(text), "minmax")


def nodata(text: Column) -> Column:
    """Value of a nodata tag: the first word, NaN and infinities included; null if it is no number."""
    word = F.lower(F.regexp_extract(F.regexp_replace(text, "[\\x00]", " "), "([^ \\t\\r\\n]+)", 1))
    return (
        F.when(word == "nan", F.lit(float("nan")))
        .when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
        .when(word.isin("-inf", "-infinity"), F.lit(float("-inf")))
        .when(word.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$"), word.try_cast("double"))
    )


def is_nodata(v: Column, sentinel: Column) -> Column:
    """Not finite, or equal to a finite sentinel."""
    odd = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    marked = ~F.isnan(sentinel) & (F.abs(sentinel) != F.lit(float("inf"))) & (v == sentinel)
    return F.coalesce(odd, F.lit(True)) | F.coalesce(marked, F.lit(False))


def file_hash(spark, path: str) -> str:
    """`content_hash` of a file of any Hadoop file system, from its length and two reads of 4 KiB."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    n = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        read = spark._jvm.org.apache.commons.io.IOUtils.toByteArray
        first = bytes(read(stream, min(n, 4096)))
        stream.seek(max(n - 4096, 0))
        last = bytes(read(stream, min(n, 4096)))
    finally:
        stream.close()
    row = spark.createDataFrame([(n, bytearray(first), bytearray(last))], "n int, first binary, last binary")
    return row.select(F.lower(F.hex(F.xxhash64("n", "first", "last"))).alias("h")).first().h


def content_hash(content: Column) -> Column:
    """Identity of a file's bytes: length, first and last 4 KiB."""
    n = F.octet_length(content)
    last = F.substr(content, F.greatest(n - 4095, F.lit(1)), F.lit(4096))
    return F.lower(F.hex(F.xxhash64(n, F.substring(content, 1, 4096), last)))
