"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

Rows of equal text form a group that is not split. A partial partition is a vector of
shard sizes; differencing takes the two with the largest spread and adds them in
opposite order, until one is left. Any order of such steps gives a partition, so
the work is a tree: each task differences the groups of one bucket into one partial
partition, and these are differenced again, level by level, in tasks of bounded size.
Only ids, sizes and digests are shuffled, never texts. Rows join their group's
shard by digest, a join that adaptive execution may split for a hot text.

Defined results. Null text: no bytes, size 1, crc32 of the empty text, all one group.
Empty text is another group of size 1. A text larger than a shard's share has its shard to itself. Null or repeated ids are rows like others.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Groups or partial partitions that one task differences at a time.
FAN_IN = 20_000
#: Rows of one window for the slots of a shard.
SLOT_ROWS = 200_000


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions (n, shards).

    Returns perm (n, shards), where column j of vector i goes to shard perm[i, j], and
    the shard sizes.
    """
    n, k = vectors.shape
    sums: list[list[int]] = vectors.tolist()
    heap = [(min(v) - max(v), i) for i, v in enumerate(sums)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, list[int], list[int]]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        va, vb = sums[a], sums[b]
        up = sorted(range(k), key=va.__getitem__)
        down = sorted(range(k), key=vb.__getitem__, reverse=True)
        new = [va[i] + vb[j] for i, j in zip(up, down, strict=True)]
        sums[a] = sums[b] = []  # free
        merged.append((a, b, up, down))
        sums.append(new)
        heapq.heappush(heap, (min(new) - max(new), len(sums) - 1))
    perm: dict[int, list[int]] = {len(sums) - 1: list(range(k))}
    for at in range(len(merged) - 1, -1, -1):
        a, b, up, down = merged[at]
        own = perm.pop(n + at)
        for child, cols in ((a, up), (b, down)):
            p = [0] * k
            for shard, col in zip(own, cols, strict=True):
                p[col] = shard
            perm[child] = p
    return np.array([perm[i] for i in range(n)], np.int64).reshape(n, k), np.array(sums[-1] if sums else [0] * k, np.int64)


def _leaves(shards: int) -> Callable[[pa.Table], pa.Table]:
    """Groups of a bucket: a column for each, and the bucket's vector in the first row."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_pylist()
        order = sorted(range(len(key)), key=lambda i: key[i])
        table = table.take(order)
        sizes = table.column("total").to_numpy()
        vectors = np.zeros((len(sizes), shards), np.int64)
        vectors[:, -1] = sizes
        perm, sums = difference(vectors)
        return pa.table({"bucket": table.column("bucket"), "key": table.column("key"), "col": pa.array(perm[:, -1], pa.int32()), "sums": pa.array([sums.tolist()] + [None] * (len(sizes) - 1), pa.list_(pa.int64()))})

    return run


def _inner(table: pa.Table) -> pa.Table:
    """Partial partitions of a bucket of buckets: their permutations, and the vector in the first row."""
    table = table.take(np.argsort(table.column("node").to_numpy(), kind="stable"))
    perm, sums = difference(np.array(table.column("sums").to_pylist(), np.int64))
    n = len(perm)
    return pa.table({"bucket": table.column("bucket"), "node": table.column("node"), "perm": pa.array(perm.tolist(), pa.list_(pa.int64())), "sums": pa.array([sums.tolist()] + [None] * (n - 1), pa.list_(pa.int64()))})


def assign_groups(groups: DataFrame, shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """(key, shard) for groups (key string, total long)."""
    n = groups.count()
    buckets = max(1, -(-n // fan_in))
    rows = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    done = common.store(rows.groupBy("bucket").applyInArrow(_leaves(shards), "bucket long, key string, col int, sums array<long>"), "leaves", few=True)
    sums = done.where("sums is not null").select(F.col("bucket").alias("node"), "sums")
    # Each level maps a node's columns to those of its parent; the last one's are the shards.
    path = sums.select("node", F.col("node").alias("up"), F.expr(f"transform(sequence(0, {shards - 1}), i -> cast(i as long))").alias("cols"))
    while buckets > 1:
        buckets = -(-buckets // fan_in)
        step = common.store(sums.withColumn("bucket", F.pmod("node", F.lit(buckets))).groupBy("bucket").applyInArrow(_inner, "bucket long, node long, perm array<long>, sums array<long>"), "inner", few=True)
        path = path.join(step.select(F.col("node").alias("up"), "bucket", "perm"), "up").select("node", F.col("bucket").alias("up"), F.transform("cols", lambda c: F.get("perm", c.cast("int"))).alias("cols"))
        sums = step.where("sums is not null").select(F.col("bucket").alias("node"), "sums")
    path = path.select(F.col("node").alias("bucket"), "cols")
    return done.select("bucket", "key", "col").join(common.small(path), "bucket").select("key", F.get("cols", F.col("col")).cast("int").alias("shard"))


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds slot: gapless from 0 in each shard, in tasks of bounded size.

    A shard is cut into parts by a hash of the row; the parts' counts are summed up
    over the few (shard, part) rows, and rows are numbered within their part.
    """
    n = rows.count()
    parts = max(1, -(-n // SLOT_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding), 0)")
    counts = counts.select("shard", "part", before.alias("start"))
    keys = ", ".join(order)
    numbered = rows.withColumn("rank", F.expr(f"row_number() over (partition by shard, part order by {keys})"))
    return numbered.join(common.small(counts), ["shard", "part"]).withColumn("slot", F.col("start") + F.col("rank") - 1).drop("part", "start", "rank")


def balance_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, text_digest, shard, slot."""
    text = F.col(text_col).cast("string")
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.sha1(text.cast("binary")), F.lit("null")).alias("text_digest"),
    )
    rows = common.store(rows, "sizes")
    groups = rows.groupBy(F.col("text_digest").alias("key")).agg(F.sum("size").alias("total"))
    named = assign_groups(groups, shards).withColumnRenamed("key", "text_digest")
    placed = common.store(rows.join(named, "text_digest"), "placed")
    return slots(placed, ["doc_id", "text_digest"])
