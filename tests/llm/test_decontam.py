import random

import pytest

from quadrel.llm import decontam as dc

from . import fixtures as fx

ITEMS = "item_id long, text string"


def tiles(item, doc, least):
    """Greedy string tiling without hashes."""
    in_a, in_b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not in_a[i + n] and not in_b[j + n]:
                    n += 1
                if n >= least:
                    best.append((-n, i, j))
        if not best:
            return out
        n, i, j = min(best)
        out.append((i, j, -n))
        for k in range(-n):
            in_a[i + k] = in_b[j + k] = True


def case(seed):
    rng = random.Random(seed)
    items = [fx.prose(rng, rng.randrange(10, 40), 3000) for _ in range(15)] + ["too short here", "", None, "The the the the the the the the"]
    items.append(items[0])
    docs = []
    for i in range(40):
        w = fx.prose(rng, rng.randrange(5, 120), 3000).split()
        if i % 3 == 0:
            a = items[i % 15].split()
            if i % 2:  # reordered
                k = len(a) // 2
                a = [*a[k:], "between", *a[:k]]
            if i % 5 == 0:
                a = [x.upper() for x in a[: len(a) // 3]]
            at = rng.randrange(len(w))
            w[at:at] = a
        docs.append(" ".join(w))
    docs += ["", None, "the the the the the the the", items[1], "  " + items[2].replace(" ", "\t\n")]
    return [(i, t, "en", "s", 1) for i, t in enumerate(docs)] + [(None, items[3], "en", "s", 1), (0, items[4], "en", "s", 1)], list(enumerate(items))


def brute(docs, items):
    out = []
    for d, t, *_ in docs:
        for i, u in items:
            a, b = fx.words(u), fx.words(t)
            covered = sum(x[2] for x in tiles(a, b, dc.MIN_MATCH)) if a and b else 0
            if covered and covered >= dc.THRESHOLD * len(a):
                out.append((d, i, len(a), covered))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 700])
def test_like_brute_force(spark, block):
    docs, items = case(1)
    out = dc.contaminated(fx.frame(spark, docs, extra=True), fx.frame(spark, items, ITEMS, extra=True), block_bytes=block)
    got = sorted(((r.doc_id, r.item_id, r.item_words, r.covered_words) for r in out.collect()), key=str)
    assert got == brute(docs, items) and len(got) > 10


def test_tiles_name_places(spark):
    docs, items = [(1, "x x a b c d e y f g h i j", "", "", 1)], [(7, "F g h i j a b c d e")]
    r = dc.contaminated(fx.frame(spark, docs), fx.frame(spark, items, ITEMS)).first()
    assert (r.coverage, [tuple(t) for t in r.tiles]) == (1.0, [(0, 8, 5), (5, 2, 5)])


@pytest.mark.parametrize("seed", range(120))
def test_tiling_like_its_definition(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(1, 3 + seed % 4) for _ in range(rng.randrange(5, 60))] for _ in range(2))
    got = dc.tile(a, b, 3)
    assert got == tiles(a, b, 3)
    used_a, used_b = [i + k for i, _, n in got for k in range(n)], [j + k for _, j, n in got for k in range(n)]
    assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b) and [a[i] for i in used_a] == [b[j] for j in used_b]


def test_empty(spark):
    docs, items = case(2)
    assert dc.contaminated(fx.frame(spark, []), fx.frame(spark, items, ITEMS)).collect() == []
    assert dc.contaminated(fx.frame(spark, docs), fx.frame(spark, [], ITEMS)).collect() == []


def test_long_text_of_one_word(spark):
    docs, items = [(1, "the " * 30_000, "", "", 1), (2, "the cat " * 9, "", "", 1)], [(7, "the the the the the the the the"), (8, "The cat the cat the cat")]
    out = dc.contaminated(fx.frame(spark, docs), fx.frame(spark, items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.covered_words) for r in out) == [(1, 7, 8), (2, 8, 6)]
