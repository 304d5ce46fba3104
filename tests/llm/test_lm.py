import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quadrel.llm import lm

from . import fixtures as fx


class Plain:
    """The automaton as dictionaries, walked word by word."""

    def __init__(self, texts, order, mu=lm.MU):
        self.order, self.mu = order, mu
        self.count = Counter()
        for x in texts:
            x = ["<s>", *x]
            for i in range(len(x)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        self.count[tuple(x[i - n + 1 : i + 1])] += 1
        words = {k: c for k, c in self.count.items() if len(k) == 1 and k != ("<s>",)}
        self.n, self.v = sum(words.values()), len(words)

    def p(self, state, w):
        if not state:
            return (self.count[w,] + 1) / (self.n + self.v + 1)
        return (self.count[*state, w] + self.mu * self.p(state[1:], w)) / (self.count[state] + self.mu)

    def walk(self, x):
        state, total = ("<s>",) if self.order > 1 and self.count["<s>",] else (), 0.0
        for w in x:
            at = state
            while at and not self.count[*at, w]:  # a failure arc
                total += math.log10(self.mu / (self.count[at] + self.mu))
                at = at[1:]
            total += math.log10(self.p(at, w))
            state = (*state, w)[-(self.order - 1) :] if self.order > 1 else ()
            while state and not self.count[state]:
                state = state[1:]
        return total


def brute(rows, order=lm.ORDER):
    texts = [[*fx.words(t), None] for _, t, *_ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows]
    m = Plain([x for x, h in zip(texts, held, strict=True) if not h], order)
    base = lambda x: sum(math.log10(m.p((), w)) for w in x)
    return [(i, h, len(x), sum(m.count[w,] > 0 for w in x), m.n, base(x), m.walk(x)) for (i, *_), x, h in zip(rows, texts, held, strict=True)]


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose(sorted(r[5] for r in got), sorted(r[5] for r in want)) and np.allclose(sorted(r[6] for r in got), sorted(r[6] for r in want))


@pytest.mark.parametrize(("order", "small"), [(lm.ORDER, False), (lm.ORDER, True), (5, True), (2, False), (1, False)])
def test_like_brute_force(spark, monkeypatch, order, small):
    if small:  # many batches, chunks and shards
        monkeypatch.setattr(lm, "SHARD_BYTES", 2000)
        monkeypatch.setattr(lm, "BATCH_BYTES", 1500)
        monkeypatch.setattr(lm, "ASK_BYTES", 400)
    rows = [*fx.documents(3), (None, "a null id", "en", "s", 1), (7, "a repeated id", "en", "s", 1)]
    same([tuple(r) for r in lm.score(fx.frame(spark, rows, extra=True), order=order).collect()], brute(rows, order))


def test_stored_table_in_many_chunks(spark, tmp_path, monkeypatch):
    rows = fx.documents(4)
    fx.frame(spark, rows).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert lm._is_scan(docs.select("doc_id")) and not lm._is_scan(docs.distinct())
    same([tuple(r) for r in lm.score(docs).collect()], brute(rows))


def test_sizes_grow_with_the_root_of_the_input():
    assert lm.sizes(0)[:2] == (lm.BATCH_BYTES, 1) and lm.sizes(10**9)[0] == lm.BATCH_BYTES
    size, shards, bits = lm.sizes(10**14)
    assert size < 2 * 10**8 and size * 0.15 / shards > 32  # n-grams of a request
    assert 10**14 / shards < 2.1 * 10**8 and bits == 63 and lm.sizes(10**9)[2] == 48


def test_model_sums_to_one():
    rows = fx.documents(5, 20)
    m = Plain([[*fx.words(r[1]), None] for r in rows], 3)
    vocab = [k[0] for k in m.count if len(k) == 1 and k != ("<s>",)]
    for state in [(), *[k for k in m.count if len(k) < 3 and k[-1] is not None][:40]]:
        assert math.isclose(sum(m.p(state, w) for w in vocab) + m.p(state, "unseen"), 1.0)


def test_long_text_and_pack(spark):
    x = np.array([0, 1, 2**63, 2**64 - 1, 77], np.uint64)
    assert (lm.unpack(lm.pack(x)) == x).all() and len(lm.unpack(lm.pack(x[:0]))) == 0
    parts = [x[:4], x[:0], x[4:]]
    assert (lm.unpack_sorted(lm.pack_sorted(parts), [4, 0, 1]) == x).all()
    rows = [(1, "word " * 60_000, "en", "s", 1), (2, "word", "en", "s", 1)]
    same([tuple(r) for r in lm.score(fx.frame(spark, rows)).collect()], brute(rows))


def test_empty(spark):
    assert lm.score(fx.frame(spark, [])).collect() == []
    same([tuple(r) for r in lm.score(fx.frame(spark, [(5, None, None, None, None)])).collect()], brute([(5, None)]))
