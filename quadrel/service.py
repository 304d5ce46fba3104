"""The library's front door: mounted files, tiles, maps and documents.

What a tile server offers as routes are methods here. Tiles are asked for as tables, so
one call renders one or a million; nothing is rendered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions import grid, paths, projection, systems
from quadrel.operators import catalog, ogc, raster, render, tilestore, vector
from quadrel.sources import readers

CHUNK = 256


@dataclass
class Options:
    """How a raster is drawn."""

    bands: list[int] = field(default_factory=lambda: [1, 2, 3])
    resampling: str = "nearest"
    stretch: str = "minmax"
    std_dev_factor: float = 2.0
    min_percent: float = 2.0
    max_percent: float = 98.0
    affine: bool = False

    def __post_init__(self) -> None:
        self.resampling = paths.RESAMPLING.get(self.resampling.lower(), "nearest")
        self.stretch = paths.STRETCH.get(self.stretch.lower(), "minmax")


@dataclass
class Raster:
    """An opened raster: its metadata row, images, and a chunk table of each image."""

    meta: dict
    levels: list[dict]
    chunks: dict[int, DataFrame]
    stats: DataFrame
    limits: dict[tuple, dict] = field(default_factory=dict)

    def close(self) -> None:
        """Give back what is kept of it."""
        for table in (*self.chunks.values(), self.stats):
            table.unpersist()

    @property
    def code(self) -> int | systems.System | None:
        """CRS of the transform: declared by code or parameters, or told by the range of the corners."""
        return projection.declared(self.meta["epsg"], self.meta["tm"]) or projection.guess(self.corners)

    @property
    def corners(self) -> tuple[float, float, float, float]:
        return projection.corners(self.meta["gt"], self.meta["width"], self.meta["height"])


class TileService:
    """Files by name, and what can be asked of them."""

    #: Opened rasters; the one that was not asked for the longest is closed first.
    MOST_RASTERS = 50

    def __init__(self, spark: SparkSession, folders: list[str] | None = None, config: dict | None = None, tile_folder: str | None = None):
        self.spark = spark
        self.catalog = catalog.Catalog(spark)
        self.cache = tilestore.LruCache()
        self.disk = tilestore.DiskCache(spark, tile_folder) if tile_folder else None
        self._rasters: dict[str, Raster] = {}
        self._hashes: dict[str, str] = {}
        self._features: dict[str, DataFrame] = {}
        self.catalog.subscribe(lambda _, name: self._forget(name))
        if config:
            self.catalog.configure(config)
        if folders:
            self.catalog.scan(folders)

    def _forget(self, name: str) -> None:
        if name in self._rasters:
            self._rasters.pop(name).close()
        self._features.pop(name, None)
        self._hashes.pop(name, None)
        self.cache.clear()

    def health(self) -> str:
        return "ok"

    # ------------------------------------------------------------ sources

    def raster(self, name: str, on_progress=lambda event, detail: None) -> Raster:
        """Open a raster; on_progress(event, detail) follows its steps."""
        if name in self._rasters:
            self._rasters[name] = found = self._rasters.pop(name)  # the last one asked for
            return found
        path = self.catalog.get(name, "raster")["path"]
        on_progress("file_opened", path)
        self.spark.catalog.refreshByPath(path)  # what was kept of the file as it was before
        path = self._parts(path)
        meta = readers.geotiff_meta(self.spark, path).first().asDict()
        if meta["error"]:
            raise ValueError(meta["error"])
        on_progress("geo_info_ready", meta["epsg"])
        levels = [r.asDict() for r in readers.geotiff_levels(self.spark, path).orderBy("idx").collect()]
        on_progress("overviews_ready", len(levels) - 1)
        tables = {x["idx"]: render.chunks(readers.pixels(readers.geotiff_chunks(self.spark, path, x["idx"])), [], CHUNK).cache() for x in levels}
        sentinel = self.sentinel(meta)
        pixels = tables[0].select("band", F.explode("pixels").alias("p")).select("band", "p.v")
        found = Raster(meta, levels, tables, raster.band_stats(pixels, ["band"], F.lit(sentinel).cast("double")).cache())
        on_progress("chunks_loaded", tables[0].count())
        on_progress("stats_complete", found.stats.count())
        self._rasters[name] = found
        while len(self._rasters) > self.MOST_RASTERS:
            self._rasters.pop(next(iter(self._rasters))).close()
        on_progress("ready", name)
        return found

    @staticmethod
    def sentinel(meta: dict) -> float | None:
        """The finite value that stands for no data."""
        text = (meta["nodata"] or "").replace("\0", " ").split()
        try:
            return float(text[0]) if text else None
        except ValueError:
            return None

    def features(self, name: str) -> DataFrame:
        """All features of a vector source, in degrees."""
        if name not in self._features:
            self._features[name] = readers.vector(self.spark, self._parts(self.catalog.get(name, "vector")["path"])).cache()
        return self._features[name]

    def _parts(self, path: str) -> list[str]:
        """A file and, for a shapefile or a TIFF, the files beside it that are there."""
        stem, _, end = path.rpartition(".")
        own = {"shp": ("shp", "dbf", "prj"), "tif": ("tfw", "ovr"), "tiff": ("tfw", "ovr")}.get(end.lower())
        if own is None:
            return [path]
        folder, _, base = stem.rpartition("/")
        for c in "\\[]{}*?":  # a file's name is no pattern
            base = base.replace(c, "\\" + c)
        beside = readers.files(self.spark, folder or "/", f"{base}.*").select("path").collect()
        names = {f"{path.rpartition('/')[2]}"} | {f"{x}.{e}" for x in (stem.rpartition("/")[2], path.rpartition("/")[2]) for e in own}
        return [r.path for r in beside if _file_name(r.path).lower() in {n.lower() for n in names} and (end.lower() == "shp" or _file_name(r.path) == path.rpartition("/")[2] or _file_name(r.path).rsplit(".", 1)[-1].lower() in own)]

    def info(self, name: str) -> dict:
        """Kind, zooms, extent in degrees and in the source's own CRS, or the error."""
        row = self.catalog.get(name)
        if row["kind"] == "vector":
            e = vector.extent(self.features(name), []).first()
            box = list(e) if e is not None else [0.0] * 4
            return {"name": name, "kind": "vector", "min_zoom": 0, "max_zoom": ogc.TOP_ZOOM, "crs": "EPSG:4326", "extent": box, "native_crs": "EPSG:4326", "native_extent": box, "error": None}
        return self._raster_info(name, readers.geotiff_meta(self.spark, self._parts(row["path"])).first())

    @staticmethod
    def _raster_info(name: str, meta) -> dict:
        code = meta["epsg"]
        native = None
        if meta["gt"]:
            native = list(projection.corners(meta["gt"], meta["width"], meta["height"]))
        return {"name": name, "kind": "raster", "min_zoom": 0, "max_zoom": meta["max_zoom"], "crs": "EPSG:4326", "extent": meta["extent"], "native_crs": f"EPSG:{code}" if code else meta["crs_class"], "native_extent": native, "error": meta["error"]}

    def sources(self) -> DataFrame:
        return self.catalog.sources()

    def geo_files(self) -> DataFrame:
        """name, path and kind of all sources."""
        return self.sources().select("name", "path", "kind")

    def layers(self) -> DataFrame:
        """The table that service documents are made of; sources that cannot be read are left out."""
        rows = []
        listed = {r.name: r for r in self.sources().select("name", "path", "kind").collect()}  # the catalogue
        rasters = [r.path for r in listed.values() if r.kind == "raster"]
        # One job reads the headers of all rasters.
        metas = {_plain(m.path): m for m in readers.geotiff_meta(self.spark, rasters).collect()} if rasters else {}
        for name in self.catalog.names():
            row = listed[name]
            i = self._raster_info(name, metas[_plain(row.path)]) if row.kind == "raster" and _plain(row.path) in metas else self.info(name)
            if i["extent"] and i["error"] is None:
                rows.append((name, i["kind"], *(float(v) for v in i["extent"]), int(i["max_zoom"])))
        return self.spark.createDataFrame(rows, "name string, kind string, w double, s double, e double, n double, max_zoom int")

    # ------------------------------------------------------------ images

    def _image(self, r: Raster, level: int, o: Options) -> render.Image:
        if r.code is None:
            raise ValueError("the raster's CRS is unknown")
        by = ["band"]
        key = (o.stretch, o.std_dev_factor, o.min_percent, o.max_percent)
        if key not in r.limits:
            share = None
            if o.stretch == "percentile":
                pixels = r.chunks[0].select("band", F.explode("pixels").alias("p")).select("band", "p.v")
                share = raster.percentiles(raster.valid(pixels, F.lit(self.sentinel(r.meta)).cast("double")), by, o.min_percent / 100, o.max_percent / 100)
            r.limits[key] = {row.band: (row.lo, row.hi) for row in raster.bounds(r.stats, by, o.stretch, o.std_dev_factor, share).collect()}  # a row for each band
        limits = r.limits[key]
        x = r.levels[level]
        return render.Image(r.corners, x["width"], x["height"], [limits.get(b, (0.0, 0.0)) for b in range(1, r.meta["bands"] + 1)], self.sentinel(r.meta), o.bands, r.code, o.affine)

    @staticmethod
    def level(r: Raster, z: int) -> int:
        """The image whose resolution is nearest to a zoom's."""
        base = abs(r.meta["gt"][1]) * (111320.0 if r.meta["crs_class"] != "Projected" else 1.0)
        tile = 2 * grid.HALF / (256 * 2**z)
        if base <= 0:
            return 0
        return min(range(len(r.levels)), key=lambda i: (abs(base * r.meta["width"] / r.levels[i]["width"] - tile), i))

    def raster_tiles(self, name: str, tiles: list[tuple[int, int, int]], options: Options | None = None, raw: bool = False, form: str = "png") -> DataFrame:
        """Tiles (z, x, y) of a raster in the order asked: i, z, x, y, data, rendered, error."""
        o = options or Options()
        if not o.bands or min(o.bands) < 1:
            raise ValueError("bands count from 1, and one is needed")
        r = self.raster(name)
        parts = None
        by_level: dict[int, list[tuple[int, int, int, int]]] = {}
        for i, (z, x, y) in enumerate(tiles):
            if not (0 <= z <= grid.MAX_ZOOM and 0 <= x < 1 << z and 0 <= y < 1 << z):
                raise ValueError(f"no such tile: {z}/{x}/{y}")
            by_level.setdefault(self.level(r, z), []).append((i, z, x, y))
        for level, asked in by_level.items():
            jobs = self.spark.createDataFrame(asked, "i int, z int, x long, y long")
            done = render.batch(jobs, r.chunks[level], self._image(r, level, o), CHUNK, o.resampling, 256, raw, form)
            parts = done if parts is None else parts.unionByName(done)
        return parts.orderBy("i")

    def content_hash(self, name: str) -> str:
        """Identity of a source's bytes, from its length and its ends; read once while it is mounted."""
        if name not in self._hashes:
            self._hashes[name] = paths.file_hash(self.spark, self.catalog.get(name)["path"])
        return self._hashes[name]

    def raster_tile(self, name: str, z: int, x: int, y: int, options: Options | None = None, form: str = "png") -> bytes:
        """One tile, kept in memory, and on disk if there is a folder for it, by all that it depends on."""
        o = options or Options()
        key = (name, self.content_hash(name), form, z, x, y, tuple(o.bands), o.resampling, o.stretch, o.std_dev_factor, o.min_percent, o.max_percent, o.affine)
        data = self.cache.get(key)
        if data is None and self.disk:
            data = self.disk.get(key)
            if data is not None:
                self.cache.put(key, data)
        if data is None:
            row = self.raster_tiles(name, [(z, x, y)], o, form=form).first()
            if row.error:
                raise RuntimeError(row.error)
            data = bytes(row.data)
            self.cache.put(key, data)
            if self.disk:
                self.disk.put(key, data)
        return data

    def batch(self, bases: list[str], filename: str, tiles: list[tuple[int, int, int]], options: Options | None = None) -> DataFrame:
        """Tiles of a file below one of the bases, mounted or not: i, z, x, y, data, rendered, error, n_bytes."""
        path = catalog.validate_path(bases, filename)
        name = f"batch:{path}"
        if name not in self.catalog:
            self.catalog.mount(name, path)
        return self.raster_tiles(name, tiles, options).withColumn("n_bytes", F.coalesce(F.octet_length("data"), F.lit(0)))

    def raster_tile_webp(self, name: str, z: int, x: int, y: int, options: Options | None = None) -> bytes:
        """One tile as lossless WebP."""
        return self.raster_tile(name, z, x, y, options, "webp")

    def static(self, bases: list[str], name: str) -> DataFrame:
        """One row: path, mime, size, content of a file below the bases."""
        return catalog.static_file(self.spark, bases, name)

    def tms_tile(self, name: str, z: int, x: int, y: int, options: Options | None = None) -> bytes:
        """A tile counted from the south."""
        if not 0 <= y < 1 << z:
            raise ValueError(f"no such tile: {z}/{x}/{y}")
        return self.raster_tile(name, z, x, (1 << z) - 1 - y, options)

    def map(self, name: str, bbox: tuple[float, float, float, float], width: int, height: int, bands: list[int] | None = None, transparent: bool = True) -> bytes:
        """A PNG map of a box in Mercator metres."""
        if not (1 <= width <= 4096 and 1 <= height <= 4096):
            raise ValueError("a map has 1 to 4096 pixels a side")
        r = self.raster(name)
        across = bbox[2] - bbox[0]
        z = grid_zoom(across, width)
        level = self.level(r, z)
        image = self._image(r, level, Options(bands=bands or [1, 2, 3]))
        return bytes(render.map_image(r.chunks[level], image, CHUNK, bbox, width, height, transparent).first().data)

    # ------------------------------------------------------------ features

    def vector_tiles(self, name: str, tiles: list[tuple[int, int, int]]) -> DataFrame:
        """GeoJSON of each tile: z, x, y, geojson, n_features. Whole geometries that meet the tile, exactly."""
        asked = self.spark.createDataFrame(tiles, "z int, x long, y long")
        hits = vector.exact_join(self.features(name), asked)
        hits = hits.withColumn("feature", self._feature())
        done = vector.collections(hits, ["z", "x", "y"], "ord")
        empty = F.lit('{"type":"FeatureCollection","features":[]}')
        return asked.join(done, ["z", "x", "y"], "left").select("z", "x", "y", F.coalesce("geojson", empty).alias("geojson"), F.coalesce("n_features", F.lit(0)).alias("n_features"))

    def vector_map(self, name: str, bbox: tuple[float, float, float, float]) -> str:
        """GeoJSON of the features that meet a box in Mercator metres."""
        (w, e), (s, n) = projection.inverse(np.array([bbox[0], bbox[2]]), np.array([bbox[1], bbox[3]]), 3857)
        near = self.features(name).where((F.col("xmin") <= float(e)) & (F.col("xmax") >= float(w)) & (F.col("ymin") <= float(n)) & (F.col("ymax") >= float(s)))
        rect = {k: F.lit(float(v)) for k, v in (("west", w), ("south", s), ("east", e), ("north", n))}
        near = near.withColumns(rect)
        hits = near.mapInArrow(vector.meets(), near.schema).withColumn("feature", self._feature())
        row = vector.collections(hits.withColumn("one", F.lit(0)), ["one"], "ord").first()
        return row.geojson if row else '{"type":"FeatureCollection","features":[]}'

    @staticmethod
    def _feature():
        """Text of a feature; ids are texts."""
        id_ = F.to_json(F.struct("id"))  # {"id":"..."}
        return vector.feature_json(F.col("geometry"), F.when(F.col("id").isNotNull(), id_.substr(F.lit(7), F.length(id_) - 7)), F.col("props"))

    # ------------------------------------------------------------ documents

    def wms_capabilities(self) -> str:
        return ogc.wms_capabilities(self.layers())

    def wmts_capabilities(self) -> str:
        return ogc.wmts_capabilities(self.layers())

    def tms_root(self) -> str:
        return ogc.tms_root(self.layers())

    def tms_layer(self, name: str) -> str:
        self.catalog.get(name, "raster")
        return ogc.tms_layer(self.layers().where(F.col("name") == name)).first().xml

    def tilejson(self, name: str) -> str:
        self.catalog.get(name)
        return ogc.tilejson(self.layers().where(F.col("name") == name)).first().json

    def api_spec(self) -> DataFrame:
        """Concrete paths of all sources."""
        return ogc.api_paths(self.geo_files()).orderBy("path")

    def openapi(self) -> str:
        """The OpenAPI document of the service and its sources."""
        return ogc.openapi(self.geo_files())

    def hashes(self, folder: str) -> DataFrame:
        """Content identity of the files of a folder, for the keys of a tile store."""
        return readers.files(self.spark, folder).select("path", "size", paths.content_hash(F.col("content")).alias("content_hash"))


def _file_name(path: str) -> str:
    """Last part of a path or of a URI as Spark gives it."""
    from urllib.parse import unquote

    last = path.rpartition("/")[2]
    return unquote(last) if path.startswith("file:") and "%" in last else last


def _plain(path: str) -> str:
    """A local path without its scheme; other URIs as they are."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def grid_zoom(across: float, width: int) -> int:
    """Zoom whose pixels are nearest to those of a map, 0 to 22."""
    import math

    if across <= 0:
        return 0
    return max(0, min(ogc.TOP_ZOOM, math.floor(math.log2(width * 2 * grid.HALF / (across * 256)) + 0.5)))
