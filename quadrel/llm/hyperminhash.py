"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct word shingles. Each shingle hash falls into one
of 256 buckets by its leading bits; a bucket keeps its smallest remainder in 16
bits: 6 bits for the count of leading zeros, 10 for the mantissa behind the first
one. Empty buckets take the register of the first full bucket on a fixed probe
path, so that two registers agree with the probability of the sets' Jaccard
similarity, whatever the size of the sets. Bands of four compressed registers
give candidates; the collision-corrected estimate drops the hopeless ones; the
rest is confirmed on the full sets.

Hot groups: documents with equal sets form one class, and only its smallest id
goes on. In a band's bucket every member is paired with the smallest member only,
so a bucket of n gives n - 1 pairs, which are stored; the smallest member is done with. What this star
leaves open are the others, where they lie in different components. Rounds deal each member of a bucket above
`BLOCK` once, into a block of its largest bucket, anew each time, and verify each component's most similar
hopeful pair there, as in a step of Boruvka's algorithm, so that a large group joins while rows grow with its size only.
What is left in several components then meets as sketches, of 512 bytes a member: a bucket of up to `BLOCK`
members in one task, with one row for each. A larger one is dealt into blocks, `MOST_BLOCKS` at most of its largest
component and as many of the others; the largest meets the others, never itself. So rows grow with its size and not
with the square. Members of hopeful pairs go on with their texts, cut further only where texts need the memory, and
are decided, the most similar first, until no pair joins two components; tasks return links only, never pairs.
A pair that shares several bands is taken in the first. Nothing is capped.

Defined results. Null or empty text: empty set, linked with nothing. Null id:
`component_id` is null, `kept` is true, linked with nothing. Rows that repeat an
id are one node. A long text is a set like others, made in one piece. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K_BITS = 8
K = 1 << K_BITS
MANTISSA = 10
#: Bands of compressed registers: a pair of similarity 0.8 shares none in 5 of 10^8 cases.
ROWS = 4
BANDS = 32
#: An estimate this far (in standard deviations of K registers) below the threshold is hopeless.
SIGMAS = 4.5
#: Bytes of text that a Python worker holds at a time.
BATCH_BYTES = 2 << 20
#: Members of an open bucket whose sketches one task compares with as many others.
BLOCK = 4096
#: Shingles of hopeful members, about, whose texts one task compares with as many others.
BLOCK_SHINGLES = 2_000_000
#: Blocks of a bucket's members; above so many times `BLOCK` members the blocks grow. All of them meet.
MOST_BLOCKS = 8
#: Hopeful pairs that a task holds at a time.
PAIRS = 1 << 20
#: Rounds in which each member of a large open bucket is in one block, before all its blocks meet.
ROUNDS = 3
#: A round that links less than this share of the pairs that it tests is the last one.
LEAST_LINKED = 0.1


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the starts of the texts in them."""
    tok = common.tokenize(texts)
    hashes = common.word_hashes(tok.words)[tok.ids] if len(tok.ids) else np.empty(0, np.uint64)
    full = common.windows(hashes, k)
    out, starts = [], [0]
    for a, b in zip(tok.starts[:-1].tolist(), tok.starts[1:].tolist(), strict=True):
        if b - a >= k:
            u = np.unique(full[a : b - k + 1])
        else:
            u = common.windows(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64)
        out.append(u)
        starts.append(starts[-1] + len(u))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.array(starts, np.int64)


def _registers(rest: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits, plus one so that 0 means empty) and mantissa of 64-bit remainders."""
    exact = (rest >> np.uint64(11)).astype(np.float64)  # 53 bits are exact in a double
    zeros = np.where(exact > 0, 53 - np.frexp(exact)[1], 53).astype(np.uint64)
    mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    return (((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """probes[i, b]: the i-th bucket that an empty bucket b looks into."""
    keys = common.mix(np.arange(K * K, dtype=np.uint64) + np.uint64(0x5EED)).reshape(K, K)
    return np.argsort(keys, axis=1, kind="stable").T.copy()


def sketches(u: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (n, K) of n sets of ascending 64-bit hashes; a row of zeros for an empty set."""
    n = len(starts) - 1
    flat = np.zeros(n * K, np.uint16)
    if len(u):
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts))
        key = doc * K + (u >> np.uint64(64 - K_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        flat[key[first]] = _registers(u[first] << np.uint64(K_BITS))
    own = flat.reshape(n, K)
    out = own.copy()
    docs, buckets = np.nonzero((own == 0) & (np.diff(starts) > 0)[:, None])
    for probe in _probes():
        if not len(docs):
            break
        got = own[docs, probe[buckets]]
        out[docs, buckets] = got
        left = got == 0
        docs, buckets = docs[left], buckets[left]
    return out


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of two unrelated sets of n and m elements agree.

    Both minima lie in the same cell: the sum over cells of the product of the
    two chances, taken as an integral over each level of leading zeros.
    """
    a, b = np.maximum(n, 1)[:, None] / K, np.maximum(m, 1)[:, None] / K
    levels = np.arange(40)
    mid = (np.arange(4) + 0.5) / 4
    x = (2.0 ** -(levels[:, None] + 1.0) * (1 + mid)).ravel()[None, :]
    width = np.repeat(2.0 ** -(levels + 1.0), 4)[None, :]  # of a level
    fa, fb = a * np.exp(-a * x), b * np.exp(-b * x)
    return np.minimum((fa * fb * width * width / 4 / 2**MANTISSA).sum(1), 0.5)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of rows of registers."""
    same = ((x == y) & (x != 0)).mean(axis=1)
    p = collision_rate(n, m)
    return np.maximum((same - p) / (1 - p), 0.0)


def hopeful(threshold: float) -> float:
    return threshold - SIGMAS * (threshold * (1 - threshold) / K) ** 0.5


def _sketch_rows(k: int, id_col: str, text_col: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in common.rebatch(batches, [text_col], BATCH_BYTES):
            u, starts = shingle_sets(rb.column(text_col), k)
            one = common.segment_sums(common.mix(u + np.uint64(0xA5A5)), starts).view(np.int64)
            two = common.segment_sums(common.mix(~u), starts).view(np.int64)
            regs = sketches(u, starts)
            yield pa.RecordBatch.from_arrays(
                [rb.column(id_col).cast(pa.int64()), pa.array(np.diff(starts)), pa.array(one), pa.array(two), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", "n_shingles", "fp1", "fp2", "sketch"],
            )

    return run


_SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary"


def _estimate_rows(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            regs = [np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint16).reshape(-1, K) for c in ("sa", "sb")]
            sizes = [rb.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
            ok = estimate(*regs, *sizes) >= least
            yield pa.RecordBatch.from_arrays([rb.column("a").filter(pa.array(ok)), rb.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for ascending distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter)


def _verify_rows(k: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in common.rebatch(batches, ["ta", "tb"], BATCH_BYTES):
            n = rb.num_rows
            both = pa.concat_arrays([rb.column("ta").cast(pa.large_string()), rb.column("tb").cast(pa.large_string())])
            u, s = shingle_sets(both, k)
            ok = pa.array([linked(u[s[i] : s[i + 1]], u[s[n + i] : s[n + i + 1]], percent) for i in range(n)], pa.bool_())
            yield pa.RecordBatch.from_arrays([rb.column("a").filter(ok), rb.column("b").filter(ok)], names=["a", "b"])

    return run


def _hopeful_pairs(table: pa.Table, least: float, once: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows x, y of hopeful pairs of different components in two blocks, and their estimates: about `PAIRS` at a time, the most similar first.

    once: only the pairs whose first shared band is that of the bucket, so that no other bucket gives them too.
    """
    rep, comp, block = (table.column(c).to_numpy() for c in ("rep", "comp", "block"))
    band, p, q = (table.column(c)[0].as_py() for c in ("band", "p", "q"))
    size = table.column("n_shingles").to_numpy().astype(float)
    regs = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, K)
    one, two = np.flatnonzero(block == p), np.flatnonzero(block == q)
    if p == q:  # the largest component meets the others, as in blocks of its own
        names, counts = np.unique(comp[one], return_counts=True)
        largest = names[counts.argmax()]
        one = one[comp[one] != largest]
    found: list[tuple[np.ndarray, ...]] = []
    held = 0
    step = max(1, (8 << 20) // (K * max(1, len(two))))
    for i in range(0, len(one), step):
        part = one[i : i + step]
        same = (regs[part, None, :] == regs[None, two, :]).mean(axis=2)
        x, y = np.nonzero((same >= least) & (comp[part][:, None] != comp[two][None, :]))
        same, x, y = same[x, y], part[x], two[y]
        keep = (comp[y] == largest) | (rep[x] < rep[y]) if p == q else np.ones(len(x), bool)
        sizes, which = np.unique(size[x] + 1j * size[y], return_inverse=True)  # copies have few sizes
        chance = collision_rate(sizes.real, sizes.imag)[which]
        est = (same - chance) / (1 - chance)
        keep &= est >= least
        if once and len(x):
            shared = (regs[x, : BANDS * ROWS] == regs[y, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2)
            keep &= shared.argmax(axis=1) == band
        found.append((x[keep], y[keep], est[keep]))
        held += int(keep.sum())
        if held and (held >= PAIRS or i + step >= len(one)):
            x, y, est = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((rep[y], rep[x], -est))
            yield x[order], y[order], est[order]
            found, held = [], 0


def _links(a: Iterable[int], b: Iterable[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _best_rows(least: float):
    """The most similar hopeful pair of each component in a block."""

    def run(table: pa.Table) -> pa.Table:
        rep, comp = (table.column(c).to_numpy() for c in ("rep", "comp"))
        best: dict[int, tuple[float, int, int]] = {}
        for x, y, est in _hopeful_pairs(table, least, once=False):
            for side in (x, y):
                for c, i in zip(*(v.tolist() for v in np.unique(comp[side], return_index=True)), strict=True):
                    new = (-float(est[i]), int(rep[x[i]]), int(rep[y[i]]))
                    best[c] = min(best.get(c, new), new)
        pairs = sorted({b[1:] for b in best.values()})
        return _links([b[0] for b in pairs], [b[1] for b in pairs])

    return run


def _hopeful_rows(least: float):
    """The members of two blocks that are in a hopeful pair, without their sketches.

    Where their texts are too many for one task, each block is cut, and two cuts meet if a hopeful pair lies in them; `cut` then names the two blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        size, block = (table.column(c).to_numpy() for c in ("n_shingles", "block"))
        hit = np.zeros(table.num_rows, bool)
        for x, y, _ in _hopeful_pairs(table, least):
            hit[x] = hit[y] = True
        rows = table.append_column("cut", pa.array(np.zeros(table.num_rows, np.int64)))
        if size[hit].sum() <= 2 * BLOCK_SHINGLES:
            return rows.select(_MET_COLUMNS).filter(pa.array(hit))
        p, q = (table.column(c)[0].as_py() for c in ("p", "q"))
        cuts = np.full(table.num_rows, -1)
        for b in sorted({p, q}):
            own = np.flatnonzero(hit & (block == b))
            cuts[own] = cuts.max() + 1 + (np.cumsum(size[own]) - size[own]) // BLOCK_SHINGLES
        many = int(cuts.max()) + 1
        meets: dict[int, np.ndarray] = {}
        for x, y, _ in _hopeful_pairs(table, least):
            both = np.minimum(cuts[x], cuts[y]) * many + np.maximum(cuts[x], cuts[y])
            for m in np.unique(both).tolist():
                members = meets.setdefault(m, np.zeros(table.num_rows, bool))
                members[x[both == m]] = members[y[both == m]] = True
        out = []
        for m, members in sorted(meets.items()):
            at = np.flatnonzero(members)
            new = {"block": cuts[at], "p": np.full(len(at), m // many), "q": np.full(len(at), m % many), "cut": np.full(len(at), 1 + (p << 32) + q)}
            part = rows.select(_MET_COLUMNS).take(pa.array(at))
            for c, v in new.items():
                part = part.set_column(_MET_COLUMNS.index(c), c, pa.array(v, part.schema.field(c).type))
            out.append(part)
        return pa.concat_tables(out)

    return run


_MET = "key long, band int, rep long, comp long, block int, p int, q int, cut long"
_MET_COLUMNS = [c.split()[0] for c in _MET.split(", ")]


def _decide_rows(least: float, k: int, percent: int):
    """Links that join components of two blocks, by the full sets."""

    def run(table: pa.Table) -> pa.Table:
        rep, comp = (table.column(c).to_numpy() for c in ("rep", "comp"))
        sets: list[np.ndarray] = []
        texts = table.column("text").combine_chunks()
        size = np.zeros(len(texts), np.int64)
        for i in range(0, len(texts), 64):  # all are in a hopeful pair
            u, s = shingle_sets(texts.slice(i, 64), k)
            sets.append(u)
            size[i : i + 64] = np.diff(s)
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)  # a number for each shingle
        del sets, texts
        ends = np.cumsum(size)
        starts = ends - size
        marked = np.zeros(len(ids), bool)
        comp = comp.copy()
        links: list[tuple[int, int]] = []

        def shared(ys: np.ndarray) -> np.ndarray:
            """Marked shingles of each of the sets ys; none is empty."""
            at = np.cumsum(size[ys]) - size[ys]
            return np.add.reduceat(marked[ids[np.repeat(starts[ys] - at, size[ys]) + np.arange(size[ys].sum())]], at, dtype=np.int64)

        for x, y, _ in _hopeful_pairs(table, least):
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            for ys in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1):
                i, ys = int(x[ys[0]]), y[ys]
                own = ids[starts[i] : ends[i]]
                marked[own] = True
                step = 16
                while len(ys := ys[comp[ys] != comp[i]]):
                    some, ys = ys[:step], ys[step:]
                    step *= 4
                    inter = shared(some)
                    for j in some[(inter > 0) & (100 * inter >= percent * (size[i] + size[some] - inter))].tolist():
                        if comp[i] != comp[j]:
                            links.append((int(rep[j]), int(rep[i])))
                            comp[comp == comp[j]] = comp[i]
                marked[own] = False
        del ids, marked, table
        common.trim()
        return _links([p[0] for p in links], [p[1] for p in links])

    return run


def _bands(classes: DataFrame) -> DataFrame:
    """(band, key, rep): a 64-bit key for each band of registers."""
    key = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sketch, i * {2 * ROWS} + 1, {2 * ROWS})))")
    return classes.select(F.posexplode(key).alias("band", "key"), "rep")


class NearDuplicates:
    """The steps of `near_duplicates`, with what they share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int):
        common.prepare(docs.sparkSession)
        self.k, self.percent, self.least = k, percent, hopeful(percent / 100)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.rows = common.store(self.docs.mapInArrow(_sketch_rows(k, "doc_id", "text"), _SKETCH), "sketches")
        full = self.rows.where("n_shingles > 0 and doc_id is not null")
        by = ["fp1", "fp2", "n_shingles"]
        self.classes = common.store(full.groupBy(*by).agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")), "classes")
        named = self.classes.select(*by, "rep")
        self.members = common.store(full.select("doc_id", *by).join(named, by).select("doc_id", "n_shingles", "rep"), "members", few=True)
        # An id with several texts joins their classes.
        several = self.members.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc_id")
        self.tied = self.members.join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        self.bands = _bands(self.classes)

    def texts(self, ids: DataFrame) -> DataFrame:
        """(doc_id, text) of some ids; few ids go to the texts, not the texts to the ids."""
        return self.docs.where("doc_id is not null and text is not null").join(common.small(ids), "doc_id", "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of class representatives that are linked, by their full sets."""
        pairs = common.store(pairs, "pairs", few=True)
        texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
        return common.store(both.mapInArrow(_verify_rows(self.k, self.percent), "a long, b long").distinct(), "verified", few=True)

    def star(self) -> DataFrame:
        """Each member of a bucket with the bucket's smallest member, if the estimate allows."""
        low = self.bands.groupBy("key").agg(F.min("rep").alias("b"), (F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
        self.shared = common.store(self.bands.join(low, "key").where("rep <> b").select("band", "key", "rep", "b", "n"), "shared", few=True)
        pairs = self.shared.select(F.col("rep").alias("a"), "b").distinct()
        one = self.classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
        two = self.classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_estimate_rows(self.least), "a long, b long").distinct()

    def named(self, rows: DataFrame, comps: DataFrame) -> DataFrame:
        """The rows (band, key, rep, n) with their components."""
        comps = comps.select(F.col("id").alias("rep"), "component")
        return rows.join(comps, "rep", "left").select("band", "key", "rep", "n", F.coalesce("component", "rep").alias("comp"))

    def open_buckets(self, comps: DataFrame) -> DataFrame:
        """Members (band, key, rep, comp) of buckets that lie in several components, but for the smallest, whose pairs the star has tested; n: of these."""
        named = self.named(self.shared.where("n > 1"), comps)
        keys = common.store(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "keys", few=True)
        return common.store(named.join(common.small(keys), "key", "left_semi"), "open", few=True)

    def blocks(self, rows: DataFrame) -> DataFrame:
        """The rows once for each two blocks (p, q) of their bucket in which they meet others."""
        each = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
        most = each.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("members"))
        need = lambda n: F.least(F.ceil(n / BLOCK), F.lit(MOST_BLOCKS)).cast("int")
        # Blocks of the other components, then those of the largest one; a small bucket is one block. Rounds may have closed a bucket.
        most = most.where((F.col("members") > BLOCK) | (F.col("members") == F.col("most.m")))
        most = most.select("key", F.col("most.comp").alias("largest"), need(F.col("most.m")).alias("own"), need(F.col("members") - F.col("most.m")).alias("others"))
        rows = rows.join(most, "key", "left").withColumn("inner", F.coalesce(F.col("comp") == F.col("largest"), F.lit(False)))
        rows = rows.withColumns({"others": F.coalesce("others", F.lit(1)), "own": F.coalesce("own", F.lit(0))}).where("others > 0")
        place = F.xxhash64("rep")
        rows = rows.withColumn("block", F.when(F.col("inner"), F.col("others") + F.pmod(place, F.col("own"))).otherwise(F.pmod(place, F.col("others"))).cast("int"))
        meets = "if(inner, transform(sequence(0, others - 1), i -> struct(i as p, block as q)), transform(sequence(0, others + own - 1), i -> struct(least(i, block) as p, greatest(i, block) as q)))"
        return rows.withColumn("meets", F.explode(F.expr(meets))).select("key", "band", "rep", "comp", "block", "meets.p", "meets.q")

    def once(self, rows: DataFrame) -> DataFrame:
        """One row for each member: that of its largest bucket."""
        return rows.groupBy("rep").agg(F.max(F.struct("n", "key", "band", "comp")).alias("r")).select("rep", "r.*")

    def dealt(self, rows: DataFrame, turn: int) -> DataFrame:
        """The rows, each in one block of its bucket, by the turn."""
        sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("many"))
        block = F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("many")).cast("int")
        return rows.join(sizes, "key").select("key", "band", "rep", "comp", block.alias("block"), block.alias("p"), block.alias("q"))

    def sketched(self, rows: DataFrame) -> DataFrame:
        """The rows with their sketches; few ids go to the sketches, so that only those are shuffled."""
        ids = common.small(rows.select("rep").distinct())
        return rows.join(self.classes.select("rep", "sketch", "n_shingles").join(ids, "rep", "left_semi").hint("merge"), "rep")

    def undecided(self, rows: DataFrame) -> DataFrame:
        """Links (a, b) that join components, among hopeful members of the open buckets."""
        blocks = common.store(self.blocks(rows), "blocks", few=True)  # read twice
        met = self.sketched(blocks).groupBy("key", "p", "q").applyInArrow(_hopeful_rows(self.least), _MET)
        met = common.store(met, "met", few=True)  # only these need their texts
        texts = self.texts(met.select(F.col("rep").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "rep")
        links = self.sketched(met).join(texts.hint("merge"), "rep").groupBy("key", "cut", "p", "q").applyInArrow(_decide_rows(self.least, self.k, self.percent), "a long, b long")
        return common.store(links.distinct(), "more", few=True)

    def components(self) -> DataFrame:
        links = self.verified(self.star()).union(self.tied)
        comps = common.store(common.components(links), "components", few=True)
        rows = self.open_buckets(comps)
        for turn in range(ROUNDS):
            large = rows.where(F.col("n") > BLOCK)
            if not large.head(1):
                break
            pairs = self.sketched(self.dealt(self.once(large), turn)).groupBy("key", "p", "q").applyInArrow(_best_rows(self.least), "a long, b long")
            pairs = common.store(pairs.distinct(), "best", few=True)
            found = self.verified(pairs)
            linked_pairs = found.count()
            if not linked_pairs:
                break
            links = links.union(found)
            comps = common.store(common.components(links), "components", few=True)
            rows = common.store(self.named(rows.drop("comp"), comps), "open", few=True)
            if linked_pairs < LEAST_LINKED * pairs.count():
                break
        more = self.undecided(rows)
        return common.store(common.components(links.union(more)), "components", few=True) if more.head(1) else comps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets
    of k-word shingles; component_id is the smallest id reachable over links.
    """
    run = NearDuplicates(docs, id_col, text_col, k, percent)
    comps = run.components().select(F.col("id").alias("rep"), "component")
    found = run.members.join(comps, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = run.rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
