import random

import numpy as np
import pyarrow as pa
import pytest

from quadrel.llm import hyperminhash as hm

from . import fixtures as fx


def brute(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = fx.words(t)
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(s)
    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss if s]
    edges = [(a, b) for x, (a, s) in enumerate(flat) for b, t in flat[:x] if 100 * len(s & t) >= percent * len(s | t)]
    comp = fx.join(edges, [i for i in sets if i is not None])
    return sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for i, ss in sets.items() for s in ss), key=str)


def run(spark, rows, k=4, percent=80, **more):
    return sorted((tuple(r) for r in hm.near_duplicates(fx.frame(spark, rows, **more), k=k, percent=percent).collect()), key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_like_brute_force(spark, k):
    rows = fx.documents(k)
    assert run(spark, rows, k, extra=True) == brute(rows, k, 80)


def test_hot_groups(spark):
    """Many exact copies, and near copies of which some only meet by others."""
    rng = random.Random(5)
    base = fx.prose(rng, 120).split()
    texts = [" ".join(base)] * 40
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [(1000 - i, t, "en", "src0", 1) for i, t in enumerate(texts)]
    assert run(spark, rows) == brute(rows, 4, 80)


def test_split_buckets(spark, monkeypatch):
    rng = random.Random(6)
    base = fx.prose(rng, 150).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(5):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "src0", 1))
    monkeypatch.setattr(hm, "BLOCK", 8)
    assert run(spark, rows) == brute(rows, 4, 80)


def test_near_copies_that_the_smallest_does_not_reach(spark, monkeypatch):
    """Chains of changes: neighbours are linked, the ends are not; two families share buckets but no link."""
    rng = random.Random(8)
    base = fx.prose(rng, 100).split()
    rows = []
    for family in range(2):
        w = list(base)
        for j in range(9):
            w[family * 40 + j * 4] = f"f{family}x{j}"
        for i in range(24):
            w = list(w)
            w[rng.randrange(100)] = f"z{family}y{i}"
            rows.append((1000 * family + rng.randrange(900), " ".join(w), "en", "src0", 1))
    rows = list({r[0]: r for r in rows}.values())
    monkeypatch.setattr(hm, "BLOCK", 6)
    assert run(spark, rows) == brute(rows, 4, 80)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (2, "other words that are not like it", "en", "s", 1), (3, None, "en", "s", 1)]
    assert run(spark, rows) == brute(rows, 4, 80)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None, None)]) == [(1, 0, 1, True)]


def test_registers_are_like_their_definition():
    rng = np.random.default_rng(1)
    u = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    got = hm.sketches(u, np.array([0, len(u)]))[0]
    shift = 64 - hm.K_BITS
    for b in range(hm.K):
        rest = [(int(x) << hm.K_BITS) & (2**64 - 1) for x in u if int(x) >> shift == b]
        if rest:
            bits = f"{min(rest):064b}"
            zeros = bits.index("1")
            mantissa = bits[zeros + 1 :].ljust(hm.MANTISSA, "0")[: hm.MANTISSA]
            assert got[b] == ((zeros + 1) << hm.MANTISSA) + int(mantissa, 2)


@pytest.mark.parametrize(("n", "share"), [(6, 0.8), (60, 0.8), (600, 0.5), (5000, 0.9)])
def test_estimate_is_close(n, share):
    rng = np.random.default_rng(n)
    errors = []
    for _ in range(30):
        u = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
        both = max(1, round(2 * n * share / (1 + share)))
        a, b = np.unique(u[:n]), np.unique(np.concatenate([u[:both], u[n : 2 * n - both]]))
        true = both / (2 * n - both)
        x, y = hm.sketches(a, np.array([0, len(a)])), hm.sketches(b, np.array([0, len(b)]))
        errors.append(hm.estimate(x, y, np.array([float(n)]), np.array([float(n)]))[0] - true)
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.08


def test_shingles_of_slices():
    texts = pa.array(["x y z", None, "", "A b  c d e", " q "] * 50, pa.string()).slice(3, 60)
    u, starts = hm.shingle_sets(texts, 4)
    want = [len(fx.words(t)) for t in texts.to_pylist()]
    assert [int(n) for n in np.diff(starts)] == [max(w - 3, min(w, 1)) for w in want]


def test_rounds_join_a_large_group_by_rows_of_its_size(spark, monkeypatch):
    """Each member is in one block a round."""
    rng = random.Random(11)
    base = fx.prose(rng, 100).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w), "en", "src0", 1))
    monkeypatch.setattr(hm, "BLOCK", 12)
    sent = []
    dealt = hm.NearDuplicates.dealt
    monkeypatch.setattr(hm.NearDuplicates, "dealt", lambda self, r, turn: sent.append((r.count(), (d := dealt(self, r, turn)).count())) or d)
    assert run(spark, rows) == brute(rows, 4, 80)
    assert sent and all(a == b for a, b in sent)


def test_rows_of_a_large_bucket_grow_with_its_size(spark, monkeypatch):
    """Texts that look similar and mostly are not linked: a member is dealt once a round, and its bucket has few blocks."""
    rng = random.Random(12)
    base = fx.prose(rng, 100).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(2, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w), "en", "src0", 1))
    monkeypatch.setattr(hm, "BLOCK", 4)
    dealt, met = [], []
    deal, blocks = hm.NearDuplicates.dealt, hm.NearDuplicates.blocks
    monkeypatch.setattr(hm.NearDuplicates, "dealt", lambda self, r, turn: dealt.append((r.count(), r.select("rep").distinct().count())) or deal(self, r, turn))
    monkeypatch.setattr(hm.NearDuplicates, "blocks", lambda self, r: met.append(((d := blocks(self, r)).groupBy("key", "rep").count().agg({"count": "max"}).first()[0], r.groupBy("key").count().agg({"count": "max"}).first()[0])) or d)
    assert run(spark, rows) == brute(rows, 4, 80)
    assert dealt and all(a == b for a, b in dealt)
    assert all(most <= 16 < members / 4 for most, members in met)


def test_a_bucket_that_fits_a_task_is_not_multiplied(spark, monkeypatch):
    """Buckets of 600 to 4,000 members, of which some are in a large component, give a row for each member; the rows are made once."""
    rows = spark.range(4000).selectExpr("0 as band", "id as rep", "explode(array(600L, 1400L, 4000L)) as key", "147L as size", "if(id % 4 = 0, id, 1L) as comp").where("rep < key").selectExpr("*", "key as n")
    got = {r[0]: r[1] for r in hm.NearDuplicates.blocks(None, rows).groupBy("key").count().collect()}
    assert got == {600: 600, 1400: 1400, 4000: 4000}
    plans = []
    sketched = hm.NearDuplicates.sketched
    monkeypatch.setattr(hm.NearDuplicates, "sketched", lambda self, r: plans.append(r._jdf.queryExecution().optimizedPlan().toString()) or sketched(self, r))
    rng = random.Random(13)
    base = fx.prose(rng, 100).split()
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(2, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        docs.append((1000 - i, " ".join(w), "en", "src0", 1))
    assert run(spark, docs) == brute(docs, 4, 80)
    assert plans and not any("explode(" in p for p in plans)


@pytest.mark.parametrize("block", [4096, 20])
def test_texts_of_a_bucket_are_cut_where_they_need_the_memory(spark, monkeypatch, block):
    """Each cut meets the others; no link is lost."""
    rng = random.Random(14)
    base = fx.prose(rng, 100).split()
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(2, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        docs.append((1000 - i, " ".join(w), "en", "src0", 1))
    monkeypatch.setattr(hm, "BLOCK", block)
    monkeypatch.setattr(hm, "BLOCK_SHINGLES", 500)
    met = []
    store = hm.common.store
    monkeypatch.setattr(hm.common, "store", lambda df, tag, few=False: (d := store(df, tag, few)) if tag != "met" else met.append(d := store(df, tag, few)) or d)
    assert run(spark, docs) == brute(docs, 4, 80)
    assert met and met[0].where("cut > 0").count()
