"""Stored tiles, request logs and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All that an image depends on: two requests that differ in any of these are two tiles.
KEY = ["layer", "content_hash", "z", "x", "y", "bands", "resampling", "stretch", "format"]


def write(tiles: DataFrame, path: str) -> None:
    """Append tiles (KEY columns and data) to a store, in folders by layer and zoom."""
    tiles.repartition("layer", "z").sortWithinPartitions("x", "y").write.mode("append").partitionBy("layer", "z").parquet(path)


def lookup(requests: DataFrame, store: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with their data, misses without)."""
    return requests.join(store, key), requests.join(store.select(*key), key, "left_anti")


def dedupe(requests: DataFrame, key: list[str]) -> DataFrame:
    """One request for each tile, with how many asked for it."""
    return requests.groupBy(*key).agg(F.count(F.lit(1)).alias("n_requests"))


def priority(z: Column, x: Column, y: Column) -> Column:
    """The order of render jobs, least first: the coarsest zoom, then columns, then rows (bits may overlap beyond 2^20 tiles)."""
    return F.shiftleft(z.cast("long"), 40).bitwiseOR(F.shiftleft(x.cast("long"), 20)).bitwiseOR(y.cast("long"))


def queue(requests: DataFrame, key: list[str]) -> DataFrame:
    """The jobs of a render farm: each tile once, with how many wait for it and its priority, in that order."""
    jobs = dedupe(requests, key).withColumn("priority", priority(F.col("z"), F.col("x"), F.col("y")))
    return jobs.orderBy("priority", *key)


def outcomes(requests: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds outcome: the first request of a tile is a miss, others hit.

    The first is found by a partial aggregate and an equi-join, not by a window, so a tile
    that a third of all requests ask for has no task of its own.
    """
    first = requests.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    joined = requests.join(first, key)
    return joined.withColumn("outcome", F.when(F.struct(*order) == F.col("_first"), "miss").otherwise("hit")).drop("_first")


def evict(files: DataFrame, cap: int, share: float = 0.8, part: str = "date") -> DataFrame:
    """Files (path, mtime, size) to remove, oldest first, if all exceed cap: until at most share * cap is left.

    The running sum is taken over days first, then within a day, so no task sorts all files.
    """
    rows = files.withColumn("_part", F.to_date("mtime"))
    days = rows.groupBy("_part").agg(F.sum("size").alias("_size"))
    days = days.withColumn("_start", F.expr("coalesce(sum(_size) over (order by _part rows between unbounded preceding and 1 preceding), 0)"))
    total = F.expr("sum(_size) over ()")
    days = days.withColumn("_excess", F.when(total > cap, total - F.lit(int(cap * share))).otherwise(0))
    rows = rows.join(days.drop("_size"), "_part").where("_start < _excess")
    before = F.expr("_start + coalesce(sum(size) over (partition by _part order by mtime, path rows between unbounded preceding and 1 preceding), 0)")
    return rows.withColumn("freed_before", before).where("freed_before < _excess").drop("_part", "_start", "_excess")


def size(files: DataFrame) -> DataFrame:
    """Files and bytes of a store."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def remove(doomed: DataFrame) -> int:
    """Delete the files of `evict` (path) through Hadoop's file system; returns how many went."""
    spark, n = doomed.sparkSession, 0
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in doomed.select("path").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(r.path)
        n += bool(path.getFileSystem(conf).delete(path, False))
    return n


class DiskCache:
    """Encoded tiles as files of any Hadoop file system, below one folder; the tier behind `LruCache`.

    Each `every` writes the folder is measured; above `max_bytes` the oldest files go until 80 % is left.
    """

    def __init__(self, spark, folder: str, max_bytes: int = 2 << 30, every: int = 10):
        self.spark, self.folder, self.max_bytes, self.every = spark, folder.rstrip("/"), max_bytes, every
        self.hits = self.misses = self._writes = 0

    def _path(self, key):
        import hashlib

        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{hashlib.sha1(repr(key).encode()).hexdigest()}.tile")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def get(self, key) -> bytes | None:
        path, fs = self._path(key)
        if not fs.exists(path):
            self.misses += 1
            return None
        self.hits += 1
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put(self, key, data: bytes) -> None:
        path, fs = self._path(key)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self._writes += 1
        if self._writes % self.every == 0:
            self.trim()

    def files(self) -> DataFrame:
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.tile").load(self.folder)
        return rows.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))

    def trim(self) -> int:
        return remove(evict(self.files(), self.max_bytes))

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class LruCache:
    """A byte-bounded cache of encoded tiles on the driver; counts hits and misses."""

    def __init__(self, max_bytes: int = 512 << 20):
        self.max_bytes, self.bytes, self.hits, self.misses = max_bytes, 0, 0, 0
        self._held: dict = {}

    def get(self, key):
        if key not in self._held:
            self.misses += 1
            return None
        self.hits += 1
        self._held[key] = data = self._held.pop(key)
        return data

    def put(self, key, data: bytes) -> None:
        if key in self._held:
            self.bytes -= len(self._held.pop(key))
        if len(data) > self.max_bytes:
            return
        self._held[key] = data
        self.bytes += len(data)
        while self.bytes > self.max_bytes:
            self.bytes -= len(self._held.pop(next(iter(self._held))))

    def clear(self) -> None:
        self._held.clear()
        self.bytes = 0

    def __len__(self) -> int:
        return len(self._held)
