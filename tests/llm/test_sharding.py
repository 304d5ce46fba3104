import random
import zlib

import numpy as np
import pytest

from quadrel.llm import sharding

from . import fixtures as fx


def check(rows, out, shards):
    assert len(out) == len(rows)
    of, slots, loads = {}, {}, [0] * shards
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    for r in out:
        assert any(r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for t in texts[r.doc_id])
        assert of.setdefault(r.text_digest, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return loads


@pytest.mark.parametrize("small", [False, True])
def test_law(spark, monkeypatch, small):
    if small:  # several levels of buckets, several parts of a shard
        monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
        monkeypatch.setattr(sharding.assign_groups, "__defaults__", (6,))
    rows = [*fx.documents(1), (None, "null id", "en", "s", 1), (3, "again", "en", "s", 1)]
    loads = check(rows, sharding.balance_bytes(fx.frame(spark, rows, extra=True), 8).collect(), 8)
    assert max(loads) - min(loads) <= 0.25 * max(loads)


def test_large_group_stays_whole(spark):
    rows = [(i, "hot " * 50, "en", "s", 1) for i in range(100)] + [(200 + i, f"other {i} " * 60, "en", "s", 1) for i in range(40)]
    loads = check(rows, sharding.balance_bytes(fx.frame(spark, rows), 4).collect(), 4)
    assert max(loads) == 100 * 201 and max(sorted(loads)[:3]) - min(loads) < 1000


def test_empty(spark):
    assert sharding.balance_bytes(fx.frame(spark, []), 8).collect() == []
    assert [r.slot for r in sharding.balance_bytes(fx.frame(spark, [(1, None, None, None, None)]), 8).collect()] == [0]


def test_differencing():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 10**6) for _ in range(500)]
    v = np.zeros((500, 8), np.int64)
    v[:, -1] = sizes
    perm, sums = sharding.difference(v)
    loads = np.zeros(8, np.int64)
    for i in range(500):
        assert sorted(perm[i]) == list(range(8))
        loads[perm[i, -1]] += sizes[i]
    assert (loads == sums).all() and loads.max() - loads.min() < 0.0005 * loads.mean()
    # The textbook case for two sets: 8, 7, 6, 5, 4 leaves a difference of 2.
    v = np.array([[0, x] for x in (8, 7, 6, 5, 4)])
    assert sorted(sharding.difference(v)[1].tolist()) == [14, 16]


def plain(sizes, shards):
    """Differencing of all sizes in one list, as it is defined."""
    parts = [[0] * (shards - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p) - min(p))
        a, b = parts.pop(), parts.pop()
        parts.append([x + y for x, y in zip(sorted(a), sorted(b, reverse=True), strict=True)])
    return sorted(parts[0]) if parts else [0] * shards


def test_loads_like_plain_differencing(spark):
    rng = random.Random(4)
    rows = [(i, "x" * n, "en", "s", 1) for i, n in enumerate(rng.sample(range(1, 40_000), 120))]
    rows += [(500 + i, rows[i % 7][1], "en", "s", 1) for i in range(30)]
    loads = check(rows, sharding.balance_bytes(fx.frame(spark, rows), 8).collect(), 8)
    sizes = {}
    for _, t, *_ in rows:
        sizes[t] = sizes.get(t, 0) + len(t) + 1
    assert sorted(loads) == plain(list(sizes.values()), 8)


def test_long_text(spark):
    rows = [(1, "x" * 3_000_000, "en", "s", 1)] + [(2 + i, f"y{i}", "en", "s", 1) for i in range(14)]
    loads = check(rows, sharding.balance_bytes(fx.frame(spark, rows), 8).collect(), 8)
    assert sorted(loads)[-1] == 3_000_001 and max(sorted(loads)[:-1]) <= 9
