"""Language-model scores from a weighted backoff automaton of smoothed n-grams.

States are the sequences of up to `order - 1` words seen in training, a start state and the
empty state. A state h has an arc for each word seen after it, with the smoothed
probability, and a failure arc to the state without h's first word; the failure arcs form
a chain down to the empty state, whose arcs are the smoothed words. One traversal from left to
right carries the state, the longest known suffix of what was read, and adds log10
probabilities: of the arc, if there is one, else of the failure arc and what follows it.

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h, w) + mu * p(w | h without its first word)) / (c(h) + mu)

So the failure arc of h weighs log10(mu / (c(h) + mu)), and p(. | h) sums to one.

No count table is broadcast. Texts are cut into batches of bounded size, and batches are
gathered to chunks. A chunk sends the sorted hashes of its batches' distinct n-grams and their
training counts, packed, to the shards that own these hashes; a shard adds up the counts and
answers each chunk with what the others have, in the order asked. Each batch builds from the
answers the part of the automaton that its own texts can reach. A hot word is one entry of a
batch, whatever its count. Words have 63 bits of hash; longer n-grams as many as the input
needs for one n-gram in 2 ** SPARE_BITS to be taken for another one.

The texts are read twice, in the same order; a stored table gives that. Any other
plan is stored first. A checksum of each chunk's request guards it.

Defined results. Null or empty text: its end token only. Null doc_id: a training
document (crc32 of the empty text). Repeated rows count, and are scored, each. A text longer
than a batch is a batch of its own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of the longest n-gram.
ORDER = 4
#: Text of a batch. Its n-grams take some thirty times this in a Python worker.
BATCH_BYTES = 4 << 20
#: Least text for each shard; its requests take about as much.
SHARD_BYTES = 16 << 20
#: Text whose n-grams are enough for a packed request. Each chunk asks each shard, so both
#: grow with the root of the input above some 45 GB, to 200 MB of text at 100 TB; a task
#: holds eight bytes for each n-gram of a chunk, but unpacks one batch at a time.
ASK_BYTES = 384
#: Strength of the shorter context in the smoothed longer one, in counts.
MU = 4.0
WORD_BITS = 63
SPARE_BITS = 20
#: Neither can be a word, as both hold a space.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" start"))


def pack(values: np.ndarray) -> bytes:
    """Bytes of unsigned 64-bit values, plane by plane, compressed."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(parts: list[np.ndarray]) -> bytes:
    """Ascending values of each part, as differences."""
    return pack(np.concatenate([np.diff(x, prepend=np.uint64(0)) for x in parts]))


def unpack_sorted(blob: bytes, sizes: list[int]) -> np.ndarray:
    flat = unpack(blob)
    ends = np.cumsum(sizes)[:-1]
    return np.concatenate([np.cumsum(x, dtype=np.uint64) for x in np.split(flat, ends)])


class Grams:
    """N-grams of a batch of texts: keys[n - 1][i] is that of the n words up to place i.

    Each text is its words between a start and an end; `inside[n - 1]` says at which places n
    words of one text end, `train` which places are of training texts.
    """

    def __init__(self, texts: pa.Array, held: np.ndarray, order: int, bits: int):
        tok = common.tokenize(texts)
        n = len(tok)
        self.starts = tok.starts + 2 * np.arange(n + 1)
        seq = np.empty(self.starts[-1], np.uint64)
        doc = np.repeat(np.arange(n), np.diff(self.starts))
        place = np.arange(len(seq)) - self.starts[doc]
        last = self.starts[1:] - 1
        words = np.ones(len(seq), bool)
        words[self.starts[:-1]] = words[last] = False
        seq[words] = common.word_hashes(tok.words)[tok.ids] if len(tok.ids) else np.empty(0, np.uint64)
        seq[self.starts[:-1]], seq[last] = START, END
        self.train = ~held[doc]
        self.token = place > 0
        self.keys, self.inside = [seq >> np.uint64(64 - WORD_BITS)], [np.ones(len(seq), bool)]
        full = common.mix(seq)
        own = full
        for m in range(2, order + 1):
            full = np.concatenate((full[:1], common.mix(full[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:])))
            self.keys.append(full >> np.uint64(64 - bits))
            self.inside.append(place >= m - 1)

    def distinct(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of a level, ascending, and their training counts."""
        at = self.inside[level]
        marked = np.sort((self.keys[level][at] << np.uint64(1)) | self.train[at].astype(np.uint64))
        keys = marked >> np.uint64(1)
        first = _firsts(keys)
        return keys[first], np.add.reduceat(marked & np.uint64(1), first) if len(first) else np.empty(0, np.uint64)

    def spread(self, level: int, answers: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Total count at each place, 0 outside, from the shards' answers: checksums, and what others have of each distinct key."""
        at = np.flatnonzero(self.inside[level])
        keys = self.keys[level][at]
        order = np.argsort(keys)
        keys = keys[order]
        first = _firsts(keys)
        a, distinct = 0, keys[first]
        for crc, others in answers:
            if zipped(distinct[a : a + len(others)]) != crc:
                raise RuntimeError("the documents were read in another order the second time; store them first")
            a += len(others)
        if a != len(distinct):
            raise RuntimeError("the documents changed between two reads; store them first")
        out = np.zeros(len(self.train))
        if len(first):
            totals = np.add.reduceat(self.train[at[order]].astype(np.float64), first) + np.concatenate([x for _, x in answers])
            out[at[order]] = np.repeat(totals, np.diff(np.append(first, len(keys))))
        return out


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)


def _cuts(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Ends of the shards in ascending keys: equal ranges of the key space."""
    at = np.array([((s + 1) << bits) // n for s in range(n - 1)], np.uint64)
    return np.append(np.searchsorted(keys, at, side="left"), len(keys))


def sizes(total: int) -> tuple[int, int, int]:
    """Bytes of text of a chunk, the number of shards and the bits of a key, for an input of so many bytes."""
    least = int((ASK_BYTES * total) ** 0.5)
    bits = min(WORD_BITS, max(1, total // 4).bit_length() + SPARE_BITS)
    return max(BATCH_BYTES, least), max(1, -(-total // max(SHARD_BYTES, least))), bits


def _chunks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches of bounded text, gathered to chunks of about `size`."""
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    n = number = 0
    for rb in common.rebatch(batches, ["text"], BATCH_BYTES):
        held.append(rb)
        n += rb.column("text").nbytes
        if n >= size:
            yield (part << 32) | number, held
            held, n, number = [], 0, number + 1
    if held:
        yield (part << 32) | number, held


_ASK = "chunk long, level int, shard int, sizes array<int>, keys binary, counts binary"


def _ask(order: int, size: int, shards: int, bits: int):
    """For each chunk, level and shard: the keys that its batches need, and their own training counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, parts in _chunks(batches, size):
            found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
            for rb in parts:
                g = Grams(rb.column("text"), rb.column("held_out").to_numpy(zero_copy_only=False).astype(bool), order, bits)
                for level in range(order):
                    keys, counts = g.distinct(level)
                    found[level].append((keys, counts, _cuts(keys, shards, WORD_BITS if level == 0 else bits)))
                del g
            for level, own in enumerate(found):
                rows = []
                for s in range(shards):
                    span = [(int(cut[s - 1]) if s else 0, int(cut[s])) for _, _, cut in own]
                    if any(b > a for a, b in span):
                        cols = [[x[a:b] for x, (a, b) in zip(side, span, strict=True)] for side in ([k for k, _, _ in own], [c for _, c, _ in own])]
                        rows.append((chunk, level, s, [b - a for a, b in span], pack_sorted(cols[0]), pack(np.concatenate(cols[1]))))
                found[level] = []
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "level", "shard", "sizes", "keys", "counts"])
            common.trim()

    return run


_ANSWER = "chunk long, level int, shard int, sizes array<int>, crcs array<long>, others binary, types long, tokens long"


def _answer(table: pa.Table) -> pa.Table:
    """What a shard's other batches count of each key, for each chunk in the order it asked."""
    parts = [unpack_sorted(k, n) for k, n in zip(table.column("keys").to_pylist(), table.column("sizes").to_pylist(), strict=True)]
    crcs = [[zipped(x) for x in np.split(p, np.cumsum(n)[:-1])] for p, n in zip(parts, table.column("sizes").to_pylist(), strict=True)]
    counts = np.concatenate([unpack(c) for c in table.column("counts").to_pylist()])
    ends = np.cumsum([len(p) for p in parts])
    keys = np.concatenate(parts)
    del parts
    order = np.argsort(keys)
    keys = keys[order]
    first = _firsts(keys)
    totals = np.add.reduceat(counts[order], first)
    types = tokens = 0
    if table.column("level")[0].as_py() == 0:
        word = keys[first] != START >> np.uint64(64 - WORD_BITS)
        types, tokens = int((totals[word] > 0).sum()), int(totals[word].sum())
    others = np.empty(len(keys), np.uint64)
    others[order] = np.repeat(totals, np.diff(np.append(first, len(keys)))) - counts[order]
    blobs = [pack(x) for x in np.split(others, ends[:-1])]
    n = len(blobs)
    del keys, order, totals, others, counts
    common.trim()
    once = lambda x: pa.array([x] + [0] * (n - 1), pa.int64())  # noqa: E731  the shard's own figures stand in one of its rows
    return pa.table(
        {
            **{c: table.column(c) for c in ("chunk", "level", "shard", "sizes")},
            "crcs": pa.array(crcs, pa.list_(pa.int64())),
            "others": pa.array(blobs, pa.binary()),
            "types": once(types),
            "tokens": once(tokens),
        }
    )


def zipped(keys: np.ndarray) -> int:
    """Checksum of a request."""
    return xxhash.xxh32_intdigest(np.ascontiguousarray(keys).tobytes())


class Automaton:
    """What the texts of one batch can reach of the backoff automaton.

    counts[n - 1][i]: training count of the n words up to place i, 0 if they are unknown or not
    of one text. The state after place i is the longest known suffix there, of `order - 1` words
    at most: known[i] is its length. All its suffixes are known too, so the chain of failure
    arcs from it goes through every shorter length.
    """

    def __init__(self, counts: list[np.ndarray], n: int, v: int, mu: float):
        self.counts, self.mu = counts, mu
        self.order = len(counts)
        self.word = np.log10((counts[0] + 1.0) / (n + v + 1.0))
        self.known = sum(((c > 0).astype(np.int64) for c in counts[: self.order - 1]), np.zeros(len(counts[0]), np.int64))

    def _before(self, x: np.ndarray) -> np.ndarray:
        """x at the place before."""
        return np.concatenate((np.zeros(1, x.dtype), x[:-1]))

    def traverse(self) -> np.ndarray:
        """Weight of the step into each place: from the state carried there, by failure arcs, to an arc."""
        state = self._before(self.known)
        weight = self.word.copy()  # of the empty state's arc
        p = 10.0**weight
        for n in range(2, self.order + 1):
            there = state >= n - 1
            held = self._before(self.counts[n - 2])
            p = np.where(there, (self.counts[n - 1] + self.mu * p) / (held + self.mu), p)
            fail = np.log10(self.mu / (held + self.mu))
            weight = np.where(there, np.where(self.counts[n - 1] > 0, np.log10(p), fail + weight), weight)
        return weight


def _bodies(size: int):
    """Each chunk's rows, packed into one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for chunk, parts in _chunks(batches, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as w:
                for rb in parts:
                    w.write_batch(rb)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([z.compress(sink.getvalue().to_pybytes())], pa.binary())], names=["chunk", "body"])

    return run


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, bits: int, n: int, v: int, mu: float):
    def run(body: pa.Table, answers: pa.Table) -> pa.Table:
        blob = zstandard.ZstdDecompressor().decompress(body.column("body")[0].as_py())
        rows = answers.select(["level", "shard", "sizes", "crcs", "others"]).to_pylist()
        rows.sort(key=lambda r: (r["level"], r["shard"]))
        out = []
        for b, rb in enumerate(pa.ipc.open_stream(blob)):
            g = Grams(rb.column("text"), rb.column("held_out").to_numpy(zero_copy_only=False).astype(bool), order, bits)
            counts = []
            for level in range(order):
                own = [r for r in rows if r["level"] == level]
                counts.append(g.spread(level, [(r["crcs"][b], unpack(r["others"])[sum(r["sizes"][:b]) : sum(r["sizes"][: b + 1])]) for r in own]))
            auto = Automaton(counts, n, v, mu)
            token = g.token
            sums = lambda x: common.segment_sums(np.where(token, x, x.dtype.type(0)), g.starts)  # noqa: B023, E731
            out.append(
                pa.table(
                    {
                        "doc_id": rb.column("doc_id"),
                        "held_out": rb.column("held_out"),
                        "n_tokens": pa.array(np.diff(g.starts) - 1),
                        "n_known": pa.array(sums((counts[0] > 0).astype(np.int64))),
                        "train_tokens": pa.array(np.full(rb.num_rows, n, np.int64)),
                        "base_score": pa.array(sums(auto.word)),
                        "score": pa.array(sums(auto.traverse())),
                    }
                )
            )
            del g, counts, auto
            common.trim()
        return pa.concat_tables(out).combine_chunks()

    return run


def _is_scan(df: DataFrame) -> bool:
    """Whether the plan only reads files, row by row: read again, it gives the same rows in the same tasks."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (7, 2), mu: float = MU, order: int = ORDER) -> DataFrame:
    """Scores of all texts by a model of those whose crc32(id as text) mod fold[0] is not fold[1].

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score (the automaton's log10 probability, end token included).
    """
    common.prepare(docs.sparkSession)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % fold[0] == fold[1]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if not _is_scan(docs):
        docs = common.store(docs, "texts")
    size, shards, bits = sizes(common.text_bytes(docs, "text")[1])
    asked = docs.mapInArrow(_ask(order, size, shards, bits), _ASK)
    answers = common.store(asked.groupBy("level", "shard").applyInArrow(_answer, _ANSWER), "answers")
    n, v = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    bodies = docs.mapInArrow(_bodies(size), "chunk long, body binary")
    rows = answers.select("chunk", "level", "shard", "sizes", "crcs", "others")
    return bodies.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(_score(order, bits, int(n), int(v), mu), _SCORE)
