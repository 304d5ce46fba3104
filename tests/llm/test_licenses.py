import random

import numpy as np
import pytest

from quadrel.llm import common
from quadrel.llm import licenses as li

from . import fixtures as fx

APACHE = "Licensed under the Apache License, Version 2.0."


def run(spark, docs, **more):
    out = li.scan(fx.frame(spark, docs, extra=True), **more).collect()
    return sorted(((r.doc_id, r.license, r.span_start, r.span_end, round(r.coverage, 3)) for r in out), key=str)


def row(i, t):
    return (i, t, "en", "s", 1)


def test_notices_and_texts(spark):
    mit = next(t[2] for t in li.TEMPLATES if t[1] == "text")
    n = len(mit.split())
    docs = [row(1, "Some words before. " + APACHE + " And after."), row(2, mit), row(3, "intro " + mit.upper().replace(",", " , ")), row(4, "no license at all here"), row(5, None), row(6, ""), row(7, "licensed"), row(8, APACHE + "\n" + APACHE), row(None, "This work is licensed under the GNU General Public License, version 3."), row(1, "All rights reserved")]
    got = run(spark, docs)
    assert (1, "Apache-2.0", 3, 10, 1.0) in got and (2, "MIT", 0, n, 1.0) in got and (1, "proprietary", 0, 3, 1.0) in got
    third = next(g for g in got if g[0] == 3)
    assert third[1] == "MIT" and third[2] == 1 and third[4] >= 0.99
    assert [g for g in got if g[0] == 8] == [(8, "Apache-2.0", 0, 7, 1.0), (8, "Apache-2.0", 7, 14, 1.0)]
    assert (None, "GPL-3.0", 0, 12, 1.0) in got and not [g for g in got if g[0] in (4, 5, 6, 7)]


def test_short_template_among_known_words(spark):
    rng = random.Random(5)
    vocab = " ".join(t[2] for t in li.TEMPLATES).split()
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(12)]
        w[6:6] = "All rights reserved.".split()
        docs.append(row(i, " ".join(w)))
    assert {g[0] for g in run(spark, docs) if g[1] == "proprietary"} == set(range(60))


def test_edited_text_is_found_with_its_coverage(spark):
    rng = random.Random(1)
    words = next(t[2] for t in li.TEMPLATES if t[1] == "text").split()
    for k in (3, 8):
        w = list(words)
        for i in rng.sample(range(len(w)), k):
            w[i] = "edited"
        w[20:20] = ["added", "words"]
        got = run(spark, [row(1, "before it " + " ".join(w) + " after it")])
        assert len(got) == 1 and got[0][1] == "MIT" and got[0][4] >= 1 - (k + 2) / len(words)


def test_unrelated_text_is_left_alone(spark):
    rng = random.Random(2)
    vocab = " ".join(t[2] for t in li.TEMPLATES).split()
    assert run(spark, [row(i, " ".join(rng.choice(vocab) for _ in range(200))) for i in range(30)]) == []


@pytest.mark.parametrize("seed", range(5))
def test_winnow_like_its_definition(seed):
    h = np.random.default_rng(seed).integers(0, 6, 40).astype(np.uint64)
    want = set()
    for i in range(len(h) - li.WINDOW + 1):
        view = h[i : i + li.WINDOW]
        want.add(i + max(j for j in range(li.WINDOW) if view[j] == view.min()))
    assert li.winnow(h).tolist() == sorted(want)
    assert li.winnow(h[:0]).tolist() == [] and len(li.winnow(h[:2])) == 1


def test_align_like_full_local_alignment():
    rng = random.Random(3)
    for _ in range(20):
        t = [rng.randrange(1, 9) for _ in range(12)]
        x = list(t)
        x[rng.randrange(12)] = 99
        x[5:5] = [77]
        text = [50] * 4 + x + [50] * 4
        n, a, b = li.align(t, text, 4)
        assert n >= 11 and a >= 4 and b <= 17


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [row(1, "a b c")], templates=[("x", "y", "a b c")]) == [(1, "x", 0, 3, 1.0)]
    assert run(spark, [row(1, "a b c")], templates=[("x", "y", "a b")]) == []
    assert len(common.windows(np.arange(2, dtype=np.uint64), 3)) == 0


def local(template, text):
    """Best local alignment over the whole table: score, matched words."""
    prev = [(0, 0)] * (len(text) + 1)
    best = (0, 0)
    for w in template:
        cur = [(0, 0)]
        for j, x in enumerate(text, 1):
            s, m = prev[j - 1]
            cell = max((s + 2, m + 1) if x == w else (s - 1, m), (prev[j][0] - 1, prev[j][1]), (cur[-1][0] - 1, cur[-1][1]))
            cur.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, cur[-1])
        prev = cur
    return best


def test_like_full_alignment_with_each_template(spark):
    """What is found, and how much of it, without fingerprints or a band."""
    rng = random.Random(12)
    other = [f"w{i}" for i in range(300)]
    docs, want = [], set()
    plain = [[p for w in t[2].lower().split() if (p := li._plain(w))] for t in li.TEMPLATES]
    for i in range(40):
        words = li.TEMPLATES[i % len(li.TEMPLATES)][2].split()
        for _ in range(rng.randrange(0, 1 + len(words) // 8)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["edited"], [words[at], "added"]])
        t = " ".join([*rng.choices(other, k=rng.randrange(0, 60)), *words, *rng.choices(other, k=rng.randrange(0, 60))])
        docs.append(row(i, t))
        text = [p for w in t.lower().split() if (p := li._plain(w))]
        full = [(local(p, text)[1], n) for n, p in enumerate(plain) if {w for w in p if li.decisive(w)} <= set(text)]
        ok = [(m / len(plain[n]), m, n) for m, n in full if m >= li.MIN_COVERAGE * len(plain[n]) and len(plain[n]) >= li.SHINGLE]
        if ok:
            want.add((i, max(ok, key=lambda x: (x[1], -x[2]))[1]))
    best = {}
    for r in li.scan(fx.frame(spark, docs)).collect():
        best[r.doc_id] = max(best.get(r.doc_id, 0), r.matched_words)
    assert len(want) > 25 and set(best.items()) == want


def test_neighbours_are_told_apart(spark):
    names = [t[0] for t in li.TEMPLATES]
    got = {r.doc_id: (r.license, r.coverage) for r in li.scan(fx.frame(spark, [row(i, "before " + t[2] + " after") for i, t in enumerate(li.TEMPLATES)])).collect()}
    assert got == {i: (n, 1.0) for i, n in enumerate(names)}
    none = [t[2].replace("version 3", "version 4").replace("Version 2.0", "Version 9").replace("4.0", "2.5") for t in li.TEMPLATES if t[0] in ("GPL-3.0", "Apache-2.0", "CC-BY-4.0", "CC-BY-NC-ND-4.0")]
    assert li.scan(fx.frame(spark, [row(i, t) for i, t in enumerate(none)])).collect() == []
    assert [li.decisive(w) for w in ("2.0", "v2", "http://x/license-2.0", "by", "by-nc", "lesser", "license")] == [True, True, False, False, True, True, False]


def test_bounded_templates():
    with pytest.raises(ValueError):
        li.Index([("x", "y", "word " * (li.MAX_TEMPLATE_BYTES // 5 + 1))])


def test_repeated_rows_and_long_text(spark):
    long = "word " * 50_000 + APACHE
    assert run(spark, [row(1, APACHE), row(1, APACHE), row(2, long)]) == sorted([(1, "Apache-2.0", 0, 7, 1.0)] * 2 + [(2, "Apache-2.0", 50_000, 50_007, 1.0)], key=str)
