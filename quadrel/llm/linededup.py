"""Line deduplication by pairwise alignment.

Lines become 64-bit hashes. A line held by two documents or more is a seed: a later
document is paired with the seed's first holder and, if the line is rare, also with the
holder before it. The first holder of a line need not hold the lines around it, so runs
of lines that just reach `min_words` are seeds as well, whatever their number of holders:
each holder is paired with the run's first. Where that alignment leaves a run in the
later document (moved or repeated lines), the run's other earlier holders follow, all at
once if they are few, else in rounds that grow, until one takes the run or all were tried. So the deleted lines are
those that all pairs of documents would give, without pairing all; only a run that
no alignment takes meets all its earlier holders. Each pair is aligned by patience diff on the hashes: lines that are
unique on both sides are anchors, their longest increasing run is kept, and the gaps
are aligned in the same way. Runs of adjacent aligned lines of at least `min_words`
words are common blocks; they are deleted from the later document. Equal texts
form a class first; copies align in full with their first holder, without a pair each.

Defined results. "Later" is by id: the larger of two. Null or empty text: no lines, kept
as it is. A long text is aligned whole. Lines are compared without blanks at their ends; blank lines are no seeds.
Rows with a null id are kept whole. Rows that repeat id and text are kept
alike; an id with several texts is several documents, in the order of their digests.
A text whose lines are all deleted becomes empty. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a common block. Notices and titles that many clean documents share are shorter.
MIN_WORDS = 20
#: Documents that hold a line up to which it is rare.
RARE = 64
#: Holders of a run that the first round after the first holder tries; each later round tries so many times more.
ROUND = 8
#: Pairs that need no more rounds, and whose ids may be broadcast (some 40 bytes each).
SMALL_PAIRS = 100_000
BATCH_BYTES = 2 << 20


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a line without blanks at its ends; 0 for a blank line."""
    line = line.strip()
    h = xxhash.xxh64_intdigest(line.encode()) if line else 0
    return h - (1 << 64) if h >= 1 << 63 else h


def runs(hashes: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """Shortest runs of lines with min_words: (first, last, hash), from each line on and up to each line.

    Every common block is a union of such runs: its lines have one from them on or one up to
    its last line. Blank lines between two lines that are long enough alone have a run too.
    """
    full = [i for i, x in enumerate(hashes) if x]
    found = {(i, j) for i, j in zip(full, full[1:], strict=False) if j > i + 1 and words[i] >= min_words and words[j] >= min_words}
    lo = n = 0
    for hi, j in enumerate(full):
        n += words[j]
        while lo < hi and n - words[full[lo]] >= min_words:
            n -= words[full[lo]]
            lo += 1
        if n >= min_words:
            found.add((full[lo], j))
    hi = n = 0
    for lo, i in enumerate(full):
        while hi < len(full) and (n < min_words or hi <= lo):
            n += words[full[hi]]
            hi += 1
        if n < min_words:
            break
        found.add((i, full[hi - 1]))
        n -= words[i]
    raw = np.array(hashes, np.int64).tobytes()
    keys = ((i, j, xxhash.xxh64_intdigest(raw[8 * i : 8 * j + 8])) for i, j in found)
    return [(i, j, h - (1 << 64) if h >= 1 << 63 else h) for i, j, h in keys]


def _lines(min_words: int):
    """Hashes and word counts of each document's lines, and the hashes of its runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in common.rebatch(batches, ["text"], BATCH_BYTES):
            hashes, words, keys = [], [], []
            for t in rb.column("text").to_pylist():
                lines = t.split("\n") if t else []
                hashes.append([line_hash(x) for x in lines])
                words.append([len(x.split()) for x in lines])
                keys.append(list({k for _, _, k in runs(hashes[-1], words[-1], min_words)}))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("digest"), pa.array(hashes, longs), pa.array(words, pa.list_(pa.int32())), pa.array(keys, longs)], names=["doc_id", "digest", "hashes", "words", "runs"])

    return run


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal items, ascending in both: patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        na, nb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {x: i for i, x in enumerate(a[alo:ahi], alo) if na[x] == 1 and nb.get(x) == 1}
        pairs = [(place[x], j) for j, x in enumerate(b[blo:bhi], blo) if x in place]
        if not pairs:
            continue
        tops: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for n, (i, _) in enumerate(pairs):
            k = bisect_left(tops, i)
            if k == len(tops):
                tops.append(i)
                at.append(n)
            else:
                tops[k], at[k] = i, n
            back.append(at[k - 1] if k else -1)
        n, anchors = at[-1], []
        while n >= 0:
            anchors.append(pairs[n])
            n = back[n]
        anchors.reverse()
        out += anchors
        for (i, j), (k, m) in zip([(alo - 1, blo - 1), *anchors], [*anchors, (ahi, bhi)], strict=True):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Positions in b of aligned adjacent lines, in blocks of at least min_words (words: of b's lines)."""
    shared = (set(a) & set(b)) - {0}
    ia, ib = [i for i, x in enumerate(a) if x in shared or not x], [j for j, x in enumerate(b) if x in shared or not x]
    aligned = [(ia[i], ib[j]) for i, j in patience([a[i] for i in ia], [b[j] for j in ib])]
    out: list[int] = []
    block: list[tuple[int, int]] = []
    for pair in [*aligned, (-9, -9)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            while block and not a[block[-1][0]]:  # blank lines belong to no block's ends
                block.pop()
            while block and not a[block[0][0]]:
                block.pop(0)
            if sum(words[j] for _, j in block) >= min_words:
                out += [j for _, j in block]
            block = []
        block.append(pair)
    return out


def _taken(hashes: list[int], words: list[int], min_words: int, gone: list[int]) -> list[int]:
    """Runs all of whose places are deleted."""
    drop = set(gone)
    found = [(k, all(x in drop for x in range(i, j + 1))) for i, j, k in runs(hashes, words, min_words)]
    return list({k for k, whole in found if whole} - {k for k, whole in found if not whole})


def _align(min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = list(zip(*(rb.column(c).to_pylist() for c in ("early_hashes", "late_hashes", "late_words")), strict=True))
            found = [common_blocks(a, b, w, min_words) for a, b, w in rows]
            keep = pa.array([bool(f) for f in found], pa.bool_())
            taken = [_taken(b, w, min_words, f) for (_, b, w), f in zip(rows, found, strict=True) if f]
            yield pa.RecordBatch.from_arrays([rb.column("late").filter(keep), rb.column("early").filter(keep), pa.array([f for f in found if f], pa.list_(pa.int32())), pa.array(taken, pa.list_(pa.int64()))], names=["late", "early", "gone", "taken"])

    return run


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their deleted lines."""
    for rb in common.rebatch(batches, ["text"], BATCH_BYTES):
        out, n_lines, n_gone = [], [], []
        for t, whole, gone in zip(*(rb.column(c).to_pylist() for c in ("text", "whole", "gone")), strict=True):
            lines = t.split("\n") if t else []
            drop = set(range(len(lines))) if whole else {j for g in gone or () for j in g}
            n_lines.append(len(lines))
            n_gone.append(len(drop))
            out.append("\n".join(x for j, x in enumerate(lines) if j not in drop) if drop else t)
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(n_lines, pa.int32()), pa.array(n_gone, pa.int32()), rb.column("partners"), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_deleted", "partners", "kept_text"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """One row per document: doc_id, n_lines, n_deleted, partners (ids of the earlier documents), kept_text."""
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("digest", F.substring(F.sha1(F.col("text").cast("binary")), 1, 16))
    rows = common.store(docs.mapInArrow(_lines(min_words), "doc_id long, digest string, hashes array<long>, words array<int>, runs array<long>"), "lines")

    # One document of each text goes on; it is known by (id, digest), in this order.
    full = rows.where("doc_id is not null and size(hashes) > 0")
    firsts = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("hashes", "words", "runs")))
    firsts = common.store(firsts.select(F.struct("doc_id", "digest").alias("doc"), "hashes", "words", "runs"), "firsts")

    def shared(col: str, key: str) -> DataFrame:
        """Holders of the items that several documents hold, with the first of them and their number."""
        held = firsts.select("doc", F.explode(F.array_distinct(col)).alias(key)).where(f"{key} <> 0")
        return held.groupBy(key).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").join(held, key)

    held, blocks = shared("hashes", "line"), common.store(shared("runs", "run"), "runs", few=True)
    stars = held.select("doc", "first").union(blocks.select("doc", "first")).where("doc <> first").select(F.col("doc").alias("late"), F.col("first").alias("early"))
    before = F.expr("lag(doc) over (partition by line order by doc)")
    chain = held.where(F.col("n").between(3, rare)).withColumn("early", before).where("early is not null").select(F.col("doc").alias("late"), "early")
    pairs = stars.union(chain).distinct()

    doc = "struct<doc_id:long,digest:string>"

    def aligned(pairs: DataFrame, docs: DataFrame) -> DataFrame:
        late = docs.select(F.col("doc").alias("late"), F.col("hashes").alias("late_hashes"), F.col("words").alias("late_words"))
        early = docs.select(F.col("doc").alias("early"), F.col("hashes").alias("early_hashes"))
        rows = pairs.join(late, "late").join(early, "early").select("late", "early", "late_hashes", "late_words", "early_hashes")
        return common.store(rows.mapInArrow(_align(min_words), f"late {doc}, early {doc}, gone array<int>, taken array<long>"), "aligned", few=True)

    gone = found = aligned(pairs, firsts)
    left = blocks.where("doc <> first").select("run", "n", F.col("doc").alias("late"))
    # A hash deals a run's holders to the rounds: no order over the holders of a hot run.
    place = F.pmod(F.xxhash64("early"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n")
    low, high = 0, ROUND
    while True:
        left = left.where(F.col("n") > low).join(found.select("late", F.explode("taken").alias("run")), ["late", "run"], "left_anti")
        most, pairs = left.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not most:
            break
        few = F.broadcast if pairs <= SMALL_PAIRS else lambda df: df
        high = most if pairs <= SMALL_PAIRS else high  # few pairs need no more rounds
        more = blocks.select("run", F.col("doc").alias("early")).join(few(left), "run").where("early < late").where((place >= low) & (place < high)).select("late", "early").distinct()
        some = more.select(F.col("late").alias("doc")).union(more.select(F.col("early").alias("doc"))).distinct()
        found = aligned(more, firsts.join(few(some), "doc", "left_semi"))
        gone = gone.union(found)
        if high >= most:
            break
        low, high = high, high * ROUND
    gone = gone.groupBy("late").agg(F.collect_set("gone").alias("gone"), F.sort_array(F.collect_set("early.doc_id")).alias("partners"))

    # All rows of a text but the first lose it all; the words decide whether that is a block.
    owners = firsts.select(F.col("doc.digest").alias("digest"), F.col("doc.doc_id").alias("owner"), (F.aggregate("words", F.lit(0), lambda x, y: x + y) >= min_words).alias("long"))
    cuts = owners.join(gone.select(F.col("late.digest").alias("digest"), "gone", "partners"), "digest", "left")
    whole = F.coalesce(F.col("long") & (F.col("doc_id") != F.col("owner")), F.lit(False))
    joined = docs.join(cuts, "digest", "left").withColumn("whole", whole)
    partners = F.when(F.col("whole"), F.array("owner")).when(F.col("doc_id").isNotNull(), F.col("partners"))
    gone = F.when(F.col("doc_id").isNotNull(), F.col("gone"))
    joined = joined.select("doc_id", "text", "whole", gone.alias("gone"), F.coalesce(partners, F.array().cast("array<long>")).alias("partners"))
    return joined.mapInArrow(_cut, "doc_id long, n_lines int, n_deleted int, partners array<long>, kept_text string")
