import hashlib

import pytest
from pyspark.sql import functions as F

from quadrel.llm import mixing

from . import fixtures as fx


def fill(total, children):
    """Water filling by steps: children (weight, capacity)."""
    out = [0.0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = total
    while open_ and left > 1e-9:
        weight = sum(children[i][0] for i in open_)
        step = min(left, min((children[i][1] - out[i]) / children[i][0] for i in open_) * weight)
        for i in open_:
            out[i] += step * children[i][0] / weight
        left -= step
        open_ = [i for i in open_ if children[i][1] - out[i] > 1e-9]
    return out


def brute(rows, weights, share, epochs, seed, domain=lambda s: s[:4]):
    docs = [(i, domain(s if s is not None else ""), lang or "", s or "", len(fx.words(t))) for i, t, lang, s, _ in rows]
    leaves = {}
    for d in docs:
        leaves.setdefault(d[1:4], []).append(d)
    cap = {k: sum(d[4] for d in v) * epochs for k, v in leaves.items()}

    def deal(total, prefix, depth):
        kids = sorted({k[: depth + 1] for k in leaves if k[:depth] == prefix})
        parts = fill(total, [(weights.get(k, 1.0), sum(c for p, c in cap.items() if p[: depth + 1] == k)) for k in kids])
        out = {}
        for k, p in zip(kids, parts, strict=True):
            out |= {k: p} if depth == 2 else deal(p, k, depth + 1)
        return out

    budget = deal(share * sum(d[4] for d in docs), (), 0)
    out = []
    for k, v in leaves.items():
        tokens, b = sum(d[4] for d in v), round(budget[k], 6)
        full = int(b // tokens) if tokens else 0
        rest, before = b - full * tokens, 0

        def place(d, full=full):
            return int(hashlib.md5(f"{seed}|{full}|{'' if d[0] is None else d[0]}".encode()).hexdigest()[:12], 16)

        at = {}
        for d in v:
            at.setdefault(place(d), []).append(d)
        for p in sorted(at):
            out += [(d[0], d[4], round(b, 3), full + (before < rest)) for d in at[p]]
            before += sum(d[4] for d in at[p])
    return sorted(out, key=str)


def run(spark, rows, weights, share, epochs, seed, **more):
    path = {"domain": F.substring("source", 1, 4), "lang": F.col("lang"), "src": F.col("source")}
    out = mixing.mix(fx.frame(spark, rows, extra=True), path, weights, share, epochs, seed, **more)
    return sorted(((r.doc_id, r.n_tokens, round(r.leaf_budget, 3), r.copies) for r in out.collect()), key=str)


WEIGHTS = {("src0",): 0.7, ("src3",): 0.2, ("src0", "en"): 3.0, ("src0", ""): 0.0}


@pytest.mark.parametrize(("share", "epochs", "slices"), [(0.5, 1, 20_000), (0.5, 1, 4), (1.7, 3, 5), (9.0, 2, 3), (0.0, 1, 3)])
def test_like_brute_force(spark, share, epochs, slices):
    rows = [*fx.documents(2), (None, "null id and a few words", "fr", None, 1), (4, "a repeated id", "en", "src4", 1)]
    assert run(spark, rows, WEIGHTS, share, epochs, 5, slice_rows=slices) == brute(rows, WEIGHTS, share, epochs, 5)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "d string, l string, tokens long")
    out = {(r.d, r.l): r.budget for r in mixing.leaf_budgets(leaves, ["d", "l"], {}, F.lit(400.0), 1).collect()}
    assert out == {("a", "x"): 10.0, ("a", "y"): 190.0, ("b", "x"): 200.0}
    out = {(r.d, r.l): r.budget for r in mixing.leaf_budgets(leaves, ["d", "l"], {}, F.lit(2005.0), 1).collect()}
    assert out == pytest.approx({("a", "x"): 10.0, ("a", "y"): 995.0, ("b", "x"): 1000.0})


def test_empty(spark):
    assert run(spark, [], {}, 0.5, 1, 0) == []
    assert run(spark, [(1, None, None, None, None)], {}, 0.5, 1, 0) == [(1, 0, 0.0, 0)]
