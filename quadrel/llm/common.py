"""Shared pieces: scratch tables, tokens, hashes, batches, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch between the JVM and Python. Whole texts travel, so the
#: default of 10,000 rows could be a gigabyte of long documents.
BATCH_ROWS = 512
#: Spark's own default, which `prepare` lowers; other settings of a user are left alone.
_DEFAULT_ROWS = "10000"
#: Where `store` notes its tables, if a scope is open.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows, unless the user already chose a bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == _DEFAULT_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session may leave that setting empty; a folder is made for it here. Hadoop deletes
    all paths when the application ends, if nothing has done so before.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quadrel-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quadrel-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of the scratch tables that are made inside; for `release`, once what reads them is written."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def store(df: DataFrame, tag: str, few: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    few: a table of ids, sums or links that is small beside the texts. It is written as a file for
    each core, not for each shuffle partition, so that later scans do not open thousands of tiny files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    (df.repartition(max(1, spark.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables. Results that still read them must have been written before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def text_bytes(df: DataFrame, col: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a column; used to size buckets, chunks and shards."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()
    return int(row[0]), int(row[1])


#: Values of a table that may be broadcast, as measured; Spark holds some three times this.
BROADCAST_BYTES = 8 << 20


def width(df: DataFrame) -> Column:
    """Bytes of the values of a row."""
    out = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        size = F.octet_length(f.name) if kind in ("string", "binary") else 8 * F.size(f.name) if kind == "array" else F.lit(8)
        out = out + F.coalesce(size, F.lit(0))
    return out


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its values are measured to be few bytes; else Spark joins it as it sees fit."""
    size = df.select(width(df).alias("w")).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


# ---------------------------------------------------------------- batches


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library

def rebatch(batches: Iterable[pa.RecordBatch], cols: list[str], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Merge small batches and cut large ones so that each holds about max_bytes of cols.

    One row above the limit is a batch of its own.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for rb in batches:
        if not rb.num_rows:
            continue
        widths = np.zeros(rb.num_rows, np.int64)
        for c in cols:
            widths += pc.fill_null(pc.binary_length(rb.column(c)), 0).to_numpy(zero_copy_only=False)
        start = 0
        ends = np.cumsum(widths)
        while start < rb.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, base + max_bytes - size, side="right")), start + (not held))
            if stop > start:
                held.append(rb.slice(start, stop - start))
                size += int(ends[stop - 1] - base)
                start = stop
            if start < rb.num_rows or size >= max_bytes:
                yield _join(held)
                held, size = [], 0
                trim()
    if held:
        yield _join(held)
        held = []
        trim()


def _join(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


# ---------------------------------------------------------------- tokens


@dataclass
class Tokens:
    """Words of a batch of texts: ids[starts[d]:starts[d + 1]] index `words` for text d."""

    ids: np.ndarray
    starts: np.ndarray
    words: pa.Array

    def __len__(self) -> int:
        return len(self.starts) - 1


def compact(texts: pa.Array) -> pa.Array:
    """Texts in buffers of their own, '' for null.

    The string kernels of this pyarrow read the wrong bytes of a slice that was cast.
    """
    return pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


def tokenize(texts: pa.Array) -> Tokens:
    """Lower-case A-Z and take words [^\\x20\\x09-\\x0D]+; null is a text without words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(compact(texts)))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        offsets, flat = before[offsets], flat.filter(pa.array(full))
    coded = pc.dictionary_encode(flat)
    return Tokens(coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i + k] for each i (values: uint64)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc *= _STEP
        acc += values[j : j + n]
    return mix(acc)


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i + 1]], 0 for an empty segment."""
    out = np.zeros(len(starts) - 1, values.dtype)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


# ---------------------------------------------------------------- components


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a partition by stars with the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = p
        return x

    for rb in batches:
        for a, b in zip(rb.column("a").to_pylist(), rb.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    stars = [(x, r) for x in nodes if (r := root(x)) != x]
    for i in range(0, len(stars), 50_000):
        part = stars[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in part], pa.int64()), pa.array([s[1] for s in part], pa.int64())], names=["a", "b"])


#: Edges that one task contracts at a time (about 100 bytes each in Python).
CONTRACT_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component = smallest id.

    Each task contracts its edges to stars (all of them at once, if there are few); then
    alternating large-star and small-star rounds over stored edge tables. Every
    step is a partial aggregate and a join that adaptive execution may split, so a
    component with a third of all nodes has no task of its own. Nodes without an
    edge have no row. Self-loops and repeated edges change nothing.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tasks = cur.count() // CONTRACT_EDGES + 1
    cur = store(cur.repartition(tasks).mapInArrow(_contract, "a long, b long"), "edges")
    seen = None
    while tasks > 1:  # one task leaves stars
        sign = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if sign == seen or sign[0] < 2:
            break
        seen = sign
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        cur = store(small.where("a <> b").distinct(), "edges", few=True)
    ids = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return ids.union(roots)
