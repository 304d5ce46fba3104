import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.llm import embeddings as em

from . import fixtures as fx

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ok = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and v is not None and c is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.array(v, float).any()]
    n, edges = {}, []
    for x, (i, v, c) in enumerate(ok):
        n[i] = 0
        for y, (j, w, d) in enumerate(ok):
            if x != y and c == d and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                n[i] += 1
                edges.append((i, j))
    comp = fx.join(edges, [i for i, *_ in rows if i is not None])
    return sorted(((i, n.get(i, 0), comp.get(i), i is None or comp[i] == i) for i, *_ in rows), key=str)


def vectors(seed, n=300):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = rng.standard_normal(16)
        out.append(base)
        for _ in range(rng.integers(0, 3)):
            out.append(base + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3]) * np.linalg.norm(base) / 4)
        if rng.random() < 0.1:
            out.append(base)
    rows = [(i, [float(x) for x in np.float32(v)], int(i) % 2) for i, v in enumerate(out)]
    rows[5:5] = [(9000, rows[0][1], 0), (9001, rows[0][1], 0), (9002, rows[0][1], None)]
    bad = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [float("inf")] * 16, [1.0, 2.0]]
    return [*rows, *((9100 + i, v, 0) for i, v in enumerate([*bad, *bad])), (None, rows[0][1], 0)]


def run(spark, rows, **more):
    return sorted((tuple(r) for r in em.near_duplicates(fx.frame(spark, rows, SCHEMA, extra=True), **more).collect()), key=str)


@pytest.mark.parametrize("cell", [5, 10_000])
def test_like_brute_force(spark, cell):
    rows = vectors(cell)
    got, want = run(spark, rows, cell=cell), brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    true = sum(r[1] for r in want)
    assert true >= sum(r[1] for r in got) >= 0.98 * true and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_hot_cell_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(em, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in np.float32(base + rng.standard_normal(16) * 0.05)], 3) for i in range(150)]
    rows += [(200 + i, [float(x) for x in np.float32(rng.standard_normal(16))], 3) for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_each_length_is_compared(spark):
    """Also a rare length, and one component; an id with several vectors is one node."""
    rows = [(i, [float(x) for x in np.random.default_rng(i).standard_normal(16)], 1) for i in range(5)]
    rows += [(10, [1.0, 2.0], 1), (11, [1.0, 2.1], 1), (12, [-1.0, 2.0], 1), (20, [1.0], 1), (21, [2.0], 1), (22, [-3.0], 1), (23, [-3.0], 2)]
    assert run(spark, rows) == brute(rows)
    twice = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 1), (3, [0.1, 1.0], 1), (4, [-1.0, 0.0], 1)]
    assert run(spark, twice) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)], key=str)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [], 1)]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_visits_are_ordered_and_complete():
    rng = np.random.default_rng(2)
    index = em.MultiIndex(rng.standard_normal((400, 16)), 8, 0.93, 0.99)
    d1, d2 = rng.random(8), rng.random(8)
    index.reach = 0.4
    got = list(index.visits(d1, d2))
    far = [d1[i] + d2[j] - d1.min() - d2.min() for i, j in got]
    want = {(i, j) for i in range(8) for j in range(8) if d1[i] + d2[j] - d1.min() - d2.min() <= 0.4}
    assert far == sorted(far) and set(got) == want and len(got) == len(want)


def test_recall_on_the_test_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    near = table.where("vec_id % 20 = 0").select((F.col("vec_id") + 10**6).alias("vec_id"), F.transform("embedding", lambda x: x * 1.5 + 0.02).alias("embedding"), "label")
    rows = [tuple(r) for r in table.unionByName(near).collect()]
    got = {r.vec_id: r.n_links for r in em.near_duplicates(table.unionByName(near)).collect()}
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    want = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(1) - 1
    found = sum(min(got[r[0]], w) for r, w in zip(rows, want, strict=True))
    assert want.sum() > 0 and found >= 0.9 * want.sum() and all(got[r[0]] <= w for r, w in zip(rows, want, strict=True))


def test_pairs_at_the_threshold_seldom_miss_from_both_sides():
    missed = 0
    for seed in (11, 13):
        for codes in (16, 32):
            rng = np.random.default_rng(seed)
            x, turn = em.unit(rng.standard_normal((4000, 64))), rng.standard_normal((4000, 64))
            y = 0.93 * x + (1 - 0.93**2) ** 0.5 * em.unit(turn - (turn * x).sum(1, keepdims=True) * x)
            index = em.MultiIndex(x, codes, 0.93, em.RECALL)
            sides = [(d, index.homes(d)) for d in (index.distances(x), index.distances(y))]
            at = np.arange(len(x))
            far = [sum(di[at, j] - di[at, i] for di, i, j in zip(d, own, other, strict=True)) > index.reach for (d, own), (_, other) in zip(sides, sides[::-1], strict=True)]
            missed += int((far[0] & far[1]).sum())
    assert missed <= 5  # of 16,000
