"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of `min_match` words (a seed) are
compared by Running-Karp-Rabin greedy string tiling: the longest common unmarked runs
are marked first, then shorter ones, down to min_match; marked words are not used
again. The share of an item's words under tiles is its coverage, which does not
depend on the order of the passages. Pairs of at least `threshold` coverage are
reported. Texts of any length are searched whole; only their words under seeds are tiled.

The benchmark is the stated side: the inverted index of its seeds goes to the tasks in blocks
of at most `BLOCK_BYTES` of text, each of which meets all documents in one pass without a shuffle. Its size is
measured first; a larger benchmark takes more passes, one after the other, so that the driver
holds one block's index at a time.

Defined results. Null or empty texts, and items below min_match words, match nothing.
Repeated items or documents are compared each. An empty table gives an empty
result. Extra columns are ignored. A document may match several items.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_MATCH = 5
THRESHOLD = 0.5
#: Text of the benchmark that is sent to the tasks at a time.
BLOCK_BYTES = 8 << 20
BATCH_BYTES = 2 << 20
#: First length searched for; longer matches raise it.
FIRST_LENGTH = 20


class _Rolling:
    """Karp-Rabin hashes of all windows of a word sequence, modulo 2**64, then checked on the words."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: list[int]):
        self.words = words

    def windows(self, length: int, marked: bytearray) -> Iterator[tuple[int, int]]:
        """(position, hash) of each window of this length without a marked word."""
        top = pow(self.BASE, length, 1 << 64)
        value, run = 0, 0
        mask = (1 << 64) - 1
        for i, w in enumerate(self.words):
            if marked[i] or not w:
                value, run = 0, 0
                continue
            value = (value * self.BASE + w) & mask
            run += 1
            if run > length:
                value = (value - self.words[i - length] * top) & mask
            if run >= length:
                yield i - length + 1, value


def tile(item: list[int], doc: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, length); the word 0 matches nothing.

    As greedy string tiling is defined: the longest match of unmarked words is marked first, of
    equal ones the first in the item, then in the document. A match that a tile has covered in
    part goes back to the queue with what is left of it.
    """
    a, b = _Rolling(item), _Rolling(doc)
    in_a, in_b = bytearray(len(item)), bytearray(len(doc))
    tiles: list[tuple[int, int, int]] = []
    length = max(min_match, min(FIRST_LENGTH, len(item), len(doc)))

    def alike(i: int, j: int) -> bool:
        return 0 <= i < len(item) and 0 <= j < len(doc) and item[i] == doc[j] and bool(item[i]) and not in_a[i] and not in_b[j]

    while True:
        places: dict[int, list[int]] = {}
        for i, h in a.windows(length, in_a):
            places.setdefault(h, []).append(i)
        queue: list[tuple[int, int, int]] = []
        for j, h in b.windows(length, in_b) if places else ():
            for i in places.get(h, ()):
                if alike(i - 1, j - 1):
                    continue  # part of the match that begins before
                n = 0
                while alike(i + n, j + n):
                    n += 1
                if n >= length:
                    queue.append((-n, i, j))
        longest = -min(queue)[0] if queue else 0
        if longest > 2 * length:
            length = longest
            continue
        heapq.heapify(queue)
        while queue:
            n, i, j = heapq.heappop(queue)
            free = [not in_a[i + x] and not in_b[j + x] for x in range(-n)]
            if all(free):
                tiles.append((i, j, -n))
                in_a[i : i - n] = in_b[j : j - n] = b"\x01" * -n
                continue
            at = 0
            for ok, run in groupby(free):
                size = len(list(run))
                if ok and size >= length:
                    heapq.heappush(queue, (-size, i + at, j + at))
                at += size
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


class _Index:
    """Seeds of a block of items: words, their numbers, and the items of each run of min_match words."""

    def __init__(self, ids: list[int | None], texts: list[str | None], min_match: int):
        tok = common.tokenize(pa.array(texts, pa.string()))
        self.words = tok.words
        self.ids = ids
        self.items = [(tok.ids[a:b].astype(np.int64) + 1) for a, b in zip(tok.starts[:-1], tok.starts[1:], strict=True)]
        seeds = [common.windows(x.astype(np.uint64), min_match) for x in self.items]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]


_TILES = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))
_HITS = "doc_id long, item_id long, item_words int, covered_words int, coverage double, tiles array<struct<item_start:int,doc_start:int,n_words:int>>"


def _search(index: _Index, min_match: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in common.rebatch(batches, ["text"], BATCH_BYTES):
            tok = common.tokenize(rb.column("text"))
            number = pc.fill_null(pc.index_in(tok.words, value_set=index.words.cast(tok.words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            words = number[tok.ids] if len(tok.ids) else np.empty(0, np.int64)
            # Only windows without a foreign word can be seeds.
            known = np.concatenate(([0], np.cumsum(words > 0)))
            at = np.flatnonzero(known[min_match:] - known[:-min_match] == min_match) if len(words) >= min_match else np.empty(0, np.int64)
            acc = np.full(len(at), min_match, np.uint64)
            for j in range(min_match):
                acc *= common._STEP
                acc += words[at + j].astype(np.uint64)
            hashes = common.mix(acc)
            lo, hi = np.searchsorted(index.seeds, hashes, "left"), np.searchsorted(index.seeds, hashes, "right")
            hit = np.flatnonzero(hi > lo)
            at, lo, hi = at[hit], lo[hit], hi[hit]
            doc = np.searchsorted(tok.starts, at, side="right") - 1
            inside = at + min_match <= tok.starts[doc + 1]
            pairs: dict[tuple[int, int], list[int]] = {}
            for d, p, x, y in zip(doc[inside].tolist(), at[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), strict=True):
                for item in set(index.owner[x:y].tolist()):
                    pairs.setdefault((d, item), []).append(p)
            rows = []
            for (d, item), seeds in sorted(pairs.items()):
                own = index.items[item].tolist()
                need = threshold * len(own)
                # No more words can be covered than lie under seeds.
                if len(seeds) * min_match < need:
                    continue
                # The words under seeds, with a foreign word between separate runs.
                text, places = [], []
                end = -1
                for p in seeds:
                    if p > end:
                        text.append(0)
                        places.append(-1)
                    for q in range(max(p, end), p + min_match):
                        text.append(int(words[q]))
                        places.append(q - int(tok.starts[d]))
                    end = p + min_match
                tiles = tile(own, text, min_match)
                covered = sum(n for _, _, n in tiles)
                if covered >= need:
                    rows.append((d, index.ids[item], len(own), covered, [{"item_start": i, "doc_start": places[j], "n_words": n} for i, j, n in sorted(tiles)]))
            if rows:
                docs = rb.column("doc_id").take(pa.array([r[0] for r in rows]))
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[3] / r[2] for r in rows]), pa.array([r[4] for r in rows], _TILES)],
                    names=["doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles"],
                )

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document and benchmark item it covers: doc_id, item_id, item_words, covered_words, coverage, tiles."""
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    _, size = common.text_bytes(items, "text")
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about block_bytes, as measured
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = _Index([r[0] for r in rows], [r[1] for r in rows], min_match)
        found = docs.mapInArrow(_search(index, min_match, threshold), _HITS)
        if blocks > 1:
            found = common.store(found, "hits", few=True)
        out = found if out is None else out.union(found)
    return out
