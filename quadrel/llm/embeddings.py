"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves; each half has its own codebook,
fitted on a bounded sample. The pairs of codewords are the cells of a product grid. A
vector lives in the cell of its nearest codewords and visits cells in the order of the
sum of both halves' squared distances (the multi-sequence traversal), as far as
`reach` beyond its own cell. `reach` is set on the sample: of neighbours at exactly the
threshold, made by turning sample vectors at random, a share `recall` must live in
visited cells. Two vectors are compared if either visits the other's cell, so a pair is
missed only if both miss (measured on random pairs at the threshold: under one in a thousand;
closer pairs are found more surely). All that meet are verified by cosine in double.

Equal vectors form a class first, so copies are never compared. A cell's members and its
visitors are dealt into blocks of at most `BLOCK` each, and each pair of blocks is one
matrix product; no task holds a whole hot cell. A task gives sums of links and a
spanning star for each group it finds, never the pairs.

Defined results. Only vectors of equal, non-null labels are compared. Null or zero
vectors, and those with null or non-finite components, link with nothing, also
not with copies. Vectors are compared within their length, each length by an index of its
own; those of one component link if they have one sign. Null ids link
with nothing and have a null component. Rows that repeat an id are counted each; an id
with several vectors is one node, and each of its rows has the links of all of them. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors that fit the codebooks, taken by a hash of the id.
SAMPLE = 8192
#: Vectors of a cell that the grid aims at; the codebooks follow the root of the number of vectors.
#: With smaller cells a vector visits a larger share of them for the same recall, and is copied to each.
CELL = 400
#: Vectors of the sample for each codeword, where that is more than SAMPLE.
FIT = 8
#: Share of a vector's neighbours at the threshold that live in the cells it visits.
RECALL = 0.995
BLOCK = 1024
ROUNDS = 12


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None, :], 0.0)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _distances(x, codes).argmin(1)
        sums, n = np.zeros_like(codes), np.bincount(near, minlength=len(codes))
        np.add.at(sums, near, x)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


class MultiIndex:
    """Codebooks of both halves and how far a vector visits."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float, seed: int = 0):
        x = unit(sample)
        self.half = x.shape[1] // 2
        self.codes = [kmeans(x[:, : self.half], codes, seed), kmeans(x[:, self.half :], codes, seed + 1)]
        rng = np.random.default_rng(seed + 2)
        turn = rng.standard_normal(x.shape)
        turn = unit(turn - (turn * x).sum(1, keepdims=True) * x)
        y = threshold * x + (1 - threshold * threshold) ** 0.5 * turn
        d = self.distances(x)
        home, theirs = self.homes(d), self.homes(self.distances(y))
        at = np.arange(len(x))
        beyond = sum(di[at, t] - di[at, h] for di, t, h in zip(d, theirs, home, strict=True))
        self.reach = float(np.quantile(beyond, recall)) + 1e-12

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(x[:, : self.half], self.codes[0]), _distances(x[:, self.half :], self.codes[1])]

    @staticmethod
    def homes(d: list[np.ndarray]) -> list[np.ndarray]:
        return [x.argmin(1) for x in d]

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells by ascending distance, to `reach` beyond the first: the multi-sequence traversal."""
        one, two = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        a, b = (d1[one] - d1[one[0]]).tolist(), (d2[two] - d2[two[0]]).tolist()
        heap, seen = [(0.0, 0, 0)], {(0, 0)}
        while heap:
            far, i, j = heapq.heappop(heap)
            if far > self.reach:
                return
            yield int(one[i]), int(two[j])
            for m, n in ((i + 1, j), (i, j + 1)):
                if m < len(a) and n < len(b) and (m, n) not in seen:
                    seen.add((m, n))
                    heapq.heappush(heap, (a[m] + b[n], m, n))


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


_VISIT = "label long, c1 int, c2 int, vec_id long, ck long, home boolean, h1 int, h2 int"


def _visit(index: MultiIndex):
    """A row for each cell that a vector visits, with its own cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            d = index.distances(unit(_matrix(rb.column("embedding"))))
            h1, h2 = index.homes(d)
            at, cells = [], []
            for i in range(rb.num_rows):
                for cell in index.visits(d[0][i], d[1][i]):
                    at.append(i)
                    cells.append(cell)
            at, cells = np.array(at), np.array(cells)
            home = (cells[:, 0] == h1[at]) & (cells[:, 1] == h2[at])
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [rb.column("label").take(rows), *(pa.array(cells[:, i].astype(np.int32)) for i in (0, 1)), rb.column("vec_id").take(rows), rb.column("ck").take(rows), pa.array(home), pa.array(h1[at].astype(np.int32)), pa.array(h2[at].astype(np.int32))],
                names=[x.split()[0] for x in _VISIT.split(", ")],
            )

    return run


_FOUND = "vec_id long, links long, root long"


def _pairs(index: MultiIndex, threshold: float):
    """Members and visitors of one cell, or of a pair of blocks of it."""

    def join(vec_id: np.ndarray, n: np.ndarray, home: np.ndarray, h1: np.ndarray, h2: np.ndarray, x: np.ndarray, member: np.ndarray, visitor: np.ndarray) -> list[tuple[int, int, int]]:
        m, v = np.flatnonzero(member), np.flatnonzero(visitor)
        if not len(m) or not len(v):
            return []
        link = (x[v] @ x[m].T >= threshold) & (vec_id[v][:, None] != vec_id[m][None, :])
        rows, cols = np.nonzero(link)
        if not len(rows):
            return []
        links = np.zeros(len(vec_id), np.int64)
        links[v] += (link * n[m][None, :]).sum(1)
        # A member that does not visit the visitor's own cell will not count it there.
        away = ~home[v[rows]]
        a, b = v[rows[away]], m[cols[away]]
        if len(a):
            d = sum(((x[b][:, part] - code[h[a]]) ** 2).sum(1) - ((x[b][:, part] - code[h[b]]) ** 2).sum(1) for part, code, h in ((slice(0, index.half), index.codes[0], h1), (slice(index.half, None), index.codes[1], h2)))
            alone = d > index.reach + 1e-9
            np.add.at(links, b[alone], n[a[alone]])
        root = vec_id.copy()
        while True:  # the smallest id of each group, over the links
            old = root.copy()
            np.minimum.at(root, v[rows], root[m[cols]])
            np.minimum.at(root, m[cols], root[v[rows]])
            if (old == root).all():
                break
        touched = np.zeros(len(vec_id), bool)
        touched[v[rows]] = touched[m[cols]] = True
        at = np.flatnonzero(touched)
        return list(zip(vec_id[at].tolist(), links[at].tolist(), root[at].tolist(), strict=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch has whole groups: one row for each, with lists."""
        for rb in batches:
            out: list[tuple[int, int, int]] = []
            for i in range(rb.num_rows):
                rows = rb.column("rows")[i].values
                col = lambda c: rows.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                x = unit(_matrix(rows.field("embedding")))
                out += join(col("vec_id"), col("n"), col("home"), col("h1"), col("h2"), x, col("member"), col("visitor"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["vec_id", "links", "root"])

    return run


def _valid(vector):
    """Vectors of finite components that are not all zero."""
    odd = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    some = F.exists(vector, lambda e: e != 0)
    return F.coalesce(~odd & some, F.lit(False))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = table.sparkSession
    common.prepare(spark)
    kind = table.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"  # floats travel as floats, and are compared as doubles
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    able = _valid(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    same = F.when(F.size("embedding") == 1, F.concat_ws(",", F.col("label"), F.signum(F.element_at("embedding", 1)))).otherwise(F.concat_ws(",", F.col("label"), F.col("embedding")))
    rows = rows.withColumn("class", F.when(able, F.concat_ws(":", F.size("embedding"), F.sha1(same.cast("binary")))))
    full = rows.where("class is not null")
    classes = common.store(full.groupBy("class").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.first(F.size("embedding")).alias("size")), "classes")
    own = rows.select("vec_id", "class")
    alone = own.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    totals = classes.where("size > 1").groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()  # a row for each length
    found = None
    for size, total in totals:
        part = classes.where(F.col("size") == size).drop("size")
        codes = 2 ** int(np.log2(max(1.0, total / cell)) / 2)
        sample = part.orderBy(F.xxhash64("vec_id"), "class").limit(max(SAMPLE, FIT * codes)).select("embedding").toArrow()
        index = MultiIndex(_matrix(sample.column("embedding")), codes, threshold, recall)
        one = _linked(part, index, threshold)
        found = one if found is None else found.union(one)
    if found is not None:
        links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
        comps = common.components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
        named = classes.select("class", "vec_id", "n").join(links, "vec_id", "left").join(comps.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        named = named.select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    else:
        named = classes.select("class", (F.col("n") - 1).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = own.where("class is not null").join(named, "class").select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(classes: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    """(vec_id, links, root): sums of links found by a task, and a member of the same group."""
    classes = classes.withColumn("ck", F.xxhash64("class"))
    visits = common.store(classes.select("vec_id", "ck", "label", "embedding").mapInArrow(_visit(index), _VISIT), "visits")
    key = ["label", "c1", "c2"]
    sizes = visits.groupBy(*key).agg(F.count_if("home").alias("members"), F.count(F.lit(1)).alias("visitors"))
    # A cell without members, or whose one member is the only visitor, has no pairs.
    sizes = sizes.where("members > 0 and visitors > 1").select(*key, F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("vb"))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    visits = visits.join(common.small(sizes), key).withColumn("own_p", deal("mb")).withColumn("own_q", deal("vb"))
    # As visitor, of block q, a vector meets each block p of members; as member each other block of visitors.
    as_visitor = "transform(sequence(0, mb - 1), p -> named_struct('p', p, 'q', own_q, 'member', home and p = own_p, 'visitor', true))"
    as_member = "transform(filter(sequence(0, vb - 1), q -> home and q <> own_q), q -> named_struct('p', own_p, 'q', q, 'member', true, 'visitor', false))"
    both = visits.withColumn("role", F.explode(F.expr(f"concat({as_visitor}, {as_member})"))).select(*key, "vec_id", "ck", "home", "h1", "h2", "role.*")
    both = both.join(classes.select("vec_id", "ck", "n", "embedding"), ["vec_id", "ck"])
    row = F.struct("vec_id", "n", "home", "h1", "h2", "visitor", "member", "embedding")
    # At most 2 * BLOCK rows, about, in a group.
    groups = both.groupBy(*key, "p", "q").agg(F.collect_list(row).alias("rows")).where("size(rows) > 1").select("rows")
    return common.store(groups.mapInArrow(_pairs(index, threshold), _FOUND), "links", few=True)
