"""The catalogue of sources: a small driver-side registry and its relations."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions import paths

SCHEMA = "name string, kind string, path string, min_zoom int, max_zoom int, crs string, extent array<double>, native_crs string, native_extent array<double>, error string"


class DuplicateSource(ValueError):
    """A source of this name is mounted."""


class UnknownSource(KeyError):
    """No source of this name is mounted."""


class WrongKind(TypeError):
    """A raster was asked of a vector source, or the other way round."""


def create_source(name: str, path: str) -> dict | None:
    """The catalogue row of a file by its extension, or None if it is not supported."""
    ext = os.path.splitext(path)[1].lower().lstrip(".")
    kind = "raster" if ext in paths.RASTER else "vector" if ext in paths.VECTOR else None
    return None if kind is None else {"name": name, "kind": kind, "path": path}


class Catalog:
    """Mounted sources by name. Mounting does not open the file."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._rows: dict[str, dict] = {}
        self._callbacks: list[Callable[[str, str], None]] = []

    def _tell(self, event: str, name: str) -> None:
        for f in self._callbacks:
            f(event, name)

    def subscribe(self, callback: Callable[[str, str], None]) -> None:
        """Call callback(event, name) after each mount and unmount."""
        self._callbacks.append(callback)

    def mount(self, name: str, path: str) -> None:
        if name in self._rows:
            raise DuplicateSource(name)
        self.mount_or_replace(name, path)

    def mount_or_replace(self, name: str, path: str) -> None:
        row = create_source(name, path)
        if row is None:
            raise ValueError(f"not a supported file: {path}")
        self._rows[name] = row
        self._tell("mount", name)

    def unmount(self, name: str) -> None:
        if self._rows.pop(name, None) is None:
            raise UnknownSource(name)
        self._tell("unmount", name)

    def describe(self, name: str, **info) -> None:
        """Add metadata (the columns of SCHEMA) to a source."""
        self.get(name).update(info)

    def get(self, name: str, kind: str | None = None) -> dict:
        if name not in self._rows:
            raise UnknownSource(name)
        row = self._rows[name]
        if kind and row["kind"] != kind:
            raise WrongKind(f"{name} is a {row['kind']} source")
        return row

    def __contains__(self, name: str) -> bool:
        return name in self._rows

    def __len__(self) -> int:
        return len(self._rows)

    def names(self) -> list[str]:
        return sorted(self._rows)

    def sources(self) -> DataFrame:
        """All sources by name."""
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        return self.spark.createDataFrame([tuple(self._rows[n].get(c) for c in cols) for n in self.names()], SCHEMA)

    def scan(self, folders: list[str], skip: tuple[str, ...] = ("openapi.json",)) -> list[str]:
        """Mount the supported files of folders, not of their subfolders; returns what could not be mounted."""
        failed = []
        for folder in folders:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(os.path.join(folder, "*")).select("path")
            for (path,) in files.orderBy("path").collect():  # a listing, without contents
                name = path.rsplit("/", 1)[-1]
                if name in skip or create_source(name, path) is None:
                    continue
                try:
                    self.mount(name, path)
                except DuplicateSource:
                    failed.append(path)
        return failed

    def configure(self, config: dict) -> None:
        """Mount the sources of a configuration; do so before a scan, so that its names win."""
        for row in config.get("sources") or []:
            if row["name"] not in self:
                self.mount(row["name"], row["path"])


def listing(sources: DataFrame) -> DataFrame:
    """Supported sources by name."""
    return sources.where("kind is not null").orderBy("name")


def first_by_priority(*tables: DataFrame) -> DataFrame:
    """Union of tables of sources, where the first table that has a name wins."""
    ranked = None
    for i, t in enumerate(tables):
        t = t.withColumn("priority", F.lit(i))
        ranked = t if ranked is None else ranked.unionByName(t)
    cols = [c for c in ranked.columns if c != "priority"]
    best = ranked.groupBy("name").agg(F.min_by(F.struct(*cols), F.struct("priority", *[c for c in cols if c != "name"])).alias("s"))
    return best.select("s.*")


def resolve(requests: DataFrame, sources: DataFrame, on: str = "layer") -> DataFrame:
    """Requests with their sources; a request without one is left out."""
    return requests.join(sources.withColumnRenamed("name", on), on)


def missing(requests: DataFrame, sources: DataFrame, on: str = "layer") -> DataFrame:
    """Requests for sources that are not there."""
    return requests.join(sources.select(F.col("name").alias(on)), on, "left_anti")


def option(*values):
    """The first value that is given: command line, file, default."""
    return next((v for v in values if v is not None), None)


def validate_path(bases: list[str], name: str) -> str:
    """Path of an existing file below the first base that has it; ValueError for a bad name, FileNotFoundError else."""
    if not name.strip("/. \t") or "\0" in name or os.path.isabs(name) or ".." in name.split("/"):
        raise ValueError(f"not a relative path below the base: {name}")
    for base in bases:
        root, path = os.path.realpath(base), os.path.realpath(os.path.join(base, name))
        if os.path.isfile(path) and path.startswith(root.rstrip(os.sep) + os.sep):
            return path
    raise FileNotFoundError(name)


def static_file(spark: SparkSession, bases: list[str], name: str, no_dotfiles: bool = True) -> DataFrame:
    """One row: path, mime, size, content of a file below the bases."""
    path = validate_path(bases, name)
    if no_dotfiles and any(part.startswith(".") for part in name.split("/")):
        raise FileNotFoundError(name)
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", paths.mime(F.col("path")).alias("mime"), F.col("length").alias("size"), "content")


def load_config(path: str) -> dict:
    """A YAML configuration; {} if it cannot be read."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    except (OSError, yaml.YAMLError):
        return {}


DEFAULT_CONFIG = {"server": {"port": 8080, "address": "0.0.0.0", "threads": 4, "root": ".", "cache_max_age": 3600, "cors": True, "gzip": True, "no_dotfiles": True, "allowed_paths": []}, "sources": [], "cache": {"l2_size_mb": 512, "disk_dir": "tile_cache"}}


def write_default_config(path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(DEFAULT_CONFIG, f, sort_keys=False)
