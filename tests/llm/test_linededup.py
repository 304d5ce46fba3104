import random

import pytest

from quadrel.llm import linededup as ld

from . import fixtures as fx


def corpus(seed):
    rng = random.Random(seed)
    block = [fx.prose(rng, 12) for _ in range(4)]
    notice = "All of this is a short notice."
    docs = []
    for i in range(30):
        lines = [fx.prose(rng, rng.randrange(5, 15)) for _ in range(rng.randrange(3, 9))]
        if i % 4 == 0:
            at = rng.randrange(len(lines))
            lines[at:at] = block
        if i % 3 == 0:
            lines.append(notice)
        if i % 7 == 3:
            lines = ["", *lines, "", "  " + lines[0] + " "]
        docs.append("\n".join(lines))
    docs += [docs[0], docs[0], docs[5], "", None, "\n\n", notice, notice]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(docs)]
    rng.shuffle(rows)
    return [*rows, (None, docs[0], "en", "s", 1), (3, docs[3] if docs[3] else "x", "en", "s", 1)], block


def brute(rows, min_words, rare):
    """The same pairs, aligned one by one."""
    firsts = {}
    for i, t, *_ in rows:
        if i is not None and t:
            firsts[t] = min(firsts.get(t, i), i)
    import hashlib

    order = sorted((i, hashlib.sha1(t.encode()).hexdigest()[:16], t) for t, i in firsts.items())
    hashes = {d: [ld.line_hash(x) for x in d[2].split("\n")] for d in order}
    holders = {}
    for d in order:
        for h in set(hashes[d]) - {0}:
            holders.setdefault(h, []).append(d)
    pairs = set()
    for h in holders.values():
        pairs |= {(d, h[0]) for d in h[1:]}
        if 3 <= len(h) <= rare:
            pairs |= set(zip(h[1:], h, strict=False))
    gone = {}
    for late, early in pairs:
        words = [len(x.split()) for x in late[2].split("\n")]
        found = ld.common_blocks(hashes[early], hashes[late], words, min_words)
        if found:
            lines, who = gone.setdefault(late[2], (set(), set()))
            lines |= set(found)
            who.add(early[0])
    out = []
    for i, t, *_ in rows:
        lines = t.split("\n") if t else []
        drop, who = gone.get(t, (set(), set())) if i is not None else (set(), set())
        if i is not None and t and i != firsts[t] and sum(len(x.split()) for x in lines) >= min_words:
            drop, who = set(range(len(lines))), {firsts[t]}
        out.append((i, len(lines), len(drop), tuple(sorted(who)), "\n".join(x for j, x in enumerate(lines) if j not in drop) if drop else t))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "rare"), [(1, 64), (2, 3), (3, 64)])
def test_like_brute_force(spark, seed, rare):
    rows, block = corpus(seed)
    out = ld.dedup_lines(fx.frame(spark, rows, extra=True), rare=rare).collect()
    got = sorted(((r.doc_id, r.n_lines, r.n_deleted, tuple(r.partners), r.kept_text) for r in out), key=str)
    assert got == brute(rows, ld.MIN_WORDS, rare)
    # The block stays in its first holder only, the short notice everywhere.
    assert sum(block[1] in (r.kept_text or "") for r in out if r.doc_id is not None) == 1
    assert sum("short notice" in (r.kept_text or "") for r in out if r.doc_id is not None and r.n_deleted < r.n_lines) >= 10


def all_earlier(rows, min_words=ld.MIN_WORDS):
    """Kept text and partners of each row (ids are unique), aligned with all earlier rows."""
    docs = [(i, t.split("\n")) for i, t in sorted(rows)]
    hashes = [[ld.line_hash(x) for x in lines] for _, lines in docs]
    out = {}
    for n, (i, lines) in enumerate(docs):
        words = [len(x.split()) for x in lines]
        found = {docs[m][0]: ld.common_blocks(hashes[m], hashes[n], words, min_words) for m in range(n)}
        drop = {j for f in found.values() for j in f}
        out[i] = ("\n".join(x for j, x in enumerate(lines) if j not in drop), {m for m, f in found.items() if f})
    return out


def like_all_earlier(spark, texts, rare=ld.RARE):
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in ld.dedup_lines(fx.frame(spark, [(i, t, "en", "s", 1) for i, t in rows]), rare=rare).collect()}
    for i, (kept, who) in all_earlier(rows).items():
        assert got[i].kept_text == kept
        assert set(got[i].partners) <= who and bool(got[i].partners) == bool(who)
    return got


def test_first_holders_of_lines_without_the_block(spark):
    """The first holders of a block's lines hold them apart, and the lines are not rare."""
    rng = random.Random(11)
    block = [fx.prose(rng, 12) for _ in range(4)]
    apart = "\n".join(x for line in block for x in (line, fx.prose(rng, 6)))
    texts = [apart, *("\n".join([fx.prose(rng, 8), *block, fx.prose(rng, 8)]) for _ in range(80))]
    got = like_all_earlier(spark, texts)
    assert [i for i, r in sorted(got.items()) if block[1] in r.kept_text] == [0, 1]
    assert all(got[i].n_deleted == 4 for i in range(2, 81))


@pytest.mark.parametrize(("seed", "rare"), [(1, 2), (2, 2), (3, 64)])
def test_like_brute_force_over_all_earlier(spark, seed, rare):
    """Moved, repeated and split blocks, blank lines between them, and lines that are blocks alone."""
    rng = random.Random(seed)
    pool = [fx.prose(rng, rng.choice((3, 7, 12, 12, 24))) for _ in range(14)]
    texts = []
    for _ in range(120):
        lines = [fx.prose(rng, 6)]
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(pool))
            for x in pool[at : at + rng.randrange(1, 5)]:
                lines += [x] if rng.random() < 0.8 else [x, ""]
            lines += [fx.prose(rng, 5)] if rng.random() < 0.6 else []
        texts.append("\n".join([*lines, fx.prose(rng, 6)]))
    like_all_earlier(spark, texts, rare)


def test_rounds_reach_every_holder(spark, monkeypatch):
    """A block that the first holders hold moved: an alignment takes the long other block instead."""
    monkeypatch.setattr(ld, "SMALL_PAIRS", 0)
    monkeypatch.setattr(ld, "ROUND", 2)
    rng = random.Random(5)
    block, other = [fx.prose(rng, 12) for _ in range(2)], [fx.prose(rng, 12) for _ in range(5)]
    moved = ["\n".join([*block, fx.prose(rng, 5), *other, fx.prose(rng, 5)]) for _ in range(9)]
    plain = ["\n".join([fx.prose(rng, 6), *block, fx.prose(rng, 6)])]
    late = ["\n".join([*([fx.prose(rng, 4)]), *other, fx.prose(rng, 7), *block, fx.prose(rng, 7)])]
    got = like_all_earlier(spark, [*moved, *plain, *late], rare=2)
    assert got[10].n_deleted == 7


@pytest.mark.parametrize("seed", range(10))
def test_runs_make_up_every_block(seed):
    rng = random.Random(seed)
    words = [rng.choice((0, 1, 4, 9, 25)) for _ in range(40)]
    hashes = [rng.randrange(1, 9) if w else 0 for w in words]
    spans = [(i, j) for i, j, _ in ld.runs(hashes, words, 20)]
    assert all(hashes[i] and hashes[j] and sum(words[i : j + 1]) >= 20 for i, j in spans)
    for p in range(40):
        for q in range(p, 40):
            if hashes[p] and hashes[q] and sum(words[p : q + 1]) >= 20:
                assert {x for i, j in spans if p <= i and j <= q for x in range(i, j + 1)} == set(range(p, q + 1))


@pytest.mark.parametrize("seed", range(10))
def test_alignment_is_one(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(1, 30) for _ in range(rng.randrange(40))] for _ in range(2))
    got = ld.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_patience_keeps_unique_lines_in_order():
    assert ld.patience([1, 2, 3, 4], [9, 1, 3, 8, 4]) == [(0, 1), (2, 2), (3, 4)]
    assert ld.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert ld.patience([], [1]) == []


def test_moved_blocks_stay_out_of_the_alignment():
    words = [30] * 4
    assert ld.common_blocks([1, 2, 3, 4], [1, 2, 3, 4], words, 20) == [0, 1, 2, 3]
    assert ld.common_blocks([1, 2, 9, 9], [5, 1, 2, 6], [1, 5, 5, 1], 20) == []


def test_empty(spark):
    assert ld.dedup_lines(fx.frame(spark, [])).collect() == []
    assert [tuple(r) for r in ld.dedup_lines(fx.frame(spark, [(1, None, None, None, None)])).collect()] == [(1, 0, 0, [], None)]
