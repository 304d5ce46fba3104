import random

import numpy as np
import pyarrow as pa
import pytest

from quadrel.llm import common

from . import fixtures as fx


@pytest.mark.parametrize("most", [10**6, 7])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "CONTRACT_EDGES", most)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 3000), (7, 3000)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    want = fx.join(edges, {x for e in edges for x in e})
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rebatch_keeps_rows_and_bounds():
    rng = random.Random(2)
    texts = [None if rng.random() < 0.1 else "x" * rng.randrange(0, 300) for _ in range(500)]
    batches = [pa.record_batch({"t": pa.array(texts[i : i + 64], pa.string())}) for i in range(0, 500, 64)]
    out = list(common.rebatch(iter(batches), ["t"], 1000))
    assert [t for b in out for t in b.column("t").to_pylist()] == texts
    sizes = [sum(len(t or "") for t in b.column("t").to_pylist()) for b in out]
    assert all(s <= 1000 or b.num_rows == 1 for s, b in zip(sizes, out, strict=True)) and len(out) < 120
    big = [pa.record_batch({"t": ["y" * 5000, "z", "y" * 5000]})]
    assert sum(b.num_rows for b in common.rebatch(iter(big), ["t"], 1000)) == 3 and list(common.rebatch(iter([]), ["t"], 9)) == []


def test_tokens_of_slices_and_blanks():
    texts = ["Ab  c", "", None, " x\x0by ", "É É", "\x1c a b"] * 40
    array = pa.array(texts, pa.string()).slice(7, 150)
    tok = common.tokenize(array)
    words = tok.words.to_pylist()
    got = [[words[i] for i in tok.ids[a:b]] for a, b in zip(tok.starts[:-1], tok.starts[1:], strict=True)]
    assert got == [fx.words(t) for t in texts[7:157]]
    assert len(common.tokenize(pa.array([], pa.string()))) == 0


def test_mix_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(common.mix(x))) == len(x)


def test_scratch_is_released(spark):
    with common.scope() as other:
        kept = common.store(spark.range(3).toDF("id"), "test", few=True)
    with common.scope() as made:
        df = common.store(spark.range(5).toDF("id"), "test", few=True)
    assert df.count() == 5 and len(made) == len(other) == 1
    common.release(spark, made)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(df.inputFiles()[0]).count()
    assert kept.count() == 3 and made == []


def test_broadcast_only_what_is_measured_to_be_small(spark):
    df = spark.range(1000).selectExpr("id", "repeat('x', 100) as s", "array(id, id) as a")
    plan = lambda most: common.small(df, most)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(1000 * 124).lower() and "broadcast" not in plan(1000 * 124 - 1).lower()
