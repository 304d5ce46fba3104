"""The pipeline's stages and run() against plain versions of their decisions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quadrel.llm import queries

from . import fixtures as fx
from .test_decontam import brute as brute_hits
from .test_hyperminhash import brute as brute_groups
from .test_langid import text
from .test_mixing import brute as brute_mix

SOURCES = ["src0", "src3", "src7", "src12", "src17"]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(9)
    items = [(i, text(rng, "en", 30)) for i in range(5)]
    rows = []
    for i in range(150):
        lang = ["en", "fr", "de", "en"][i % 4]
        t = text(rng, lang, rng.randrange(30, 90))
        if i % 11 == 0:
            t += " " + items[i % 5][1]
        rows.append((i, t, lang, rng.choice(SOURCES), len(t)))
    for i in range(0, 150, 10):
        rows.append((200 + i, rows[i][1], *rows[i][2:]))
        rows.append((201 + i, rows[i][1] + " more", *rows[i][2:]))
    rows += [(900, None, None, "src0", None), (901, "1234 !!", None, "src0", 7), (902, "", "en", "src0", 0)]
    fx.frame(spark, rows, extra=True).write.parquet(str(d / "documents.parquet"))
    fx.frame(spark, items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows, items


def test_stages(spark, world):
    d, rows, items = world
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    left = {r[0]: r for r in rows}
    out = cp.identify_languages(spark, docs, d)
    assert out.columns == columns
    kept = {r.doc_id for r in out.collect()}
    assert set(left) - kept == {900, 901}

    def ids(df):
        assert df.columns == columns
        got = [r.doc_id for r in df.select("doc_id").collect()]
        assert len(got) == len(set(got))
        return set(got)

    def only(df, keep):
        return df.where(F.col("doc_id").isin(list(keep)))

    docs = only(docs, kept)
    want = {r[0] for r in brute_groups([left[i] for i in kept], 5, 80) if r[3]}
    assert ids(cp.drop_near_duplicates(spark, docs, d)) == want
    docs = only(docs, want)
    want -= {h[0] for h in brute_hits([left[i] for i in want], items)}
    assert ids(cp.drop_contaminated(spark, docs, d)) == want
    docs = only(docs, want)
    got = ids(cp.mix_sources(spark, docs, d))
    domains = {"src0": "web", "src3": "web", "src7": "news", "src12": "books", "src17": "code"}
    plain = brute_mix([left[i] for i in want], queries.WEIGHTS, cp.BUDGET_SHARE, 1, queries.SEED, lambda s: domains.get(s, "other"))
    assert got == {r[0] for r in plain if r[3] > 0}
    docs = only(docs, got)
    out = cp.assign_shards(spark, docs, d).collect()
    assert {r.doc_id for r in out} == got


def test_run_is_its_stages(spark, world):
    d, rows, _ = world
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        df = stage(spark, docs, d)
        docs = spark.createDataFrame(df.collect(), df.schema)
    want = sorted((r.doc_id, r.shard, r.slot) for r in cp.STAGES[-1][1](spark, docs, d).collect())
    out = cp.run(spark, d)
    assert sorted((r.doc_id, r.shard, r.slot) for r in out.collect()) == want and len(want) > 50
    assert {"doc_id", "size", "text_crc32", "shard", "slot"} == set(out.columns)


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids are judged like others; an empty table stays empty; extra columns are kept."""
    rng = random.Random(3)
    item = text(rng, "en", 30)
    base = [text(rng, "en", 60) for _ in range(12)]
    rows = [(i, t, "en", "src0", 1) for i, t in enumerate(base)]
    rows += [(None, base[0], "en", "src0", 1), (None, base[0], "en", "src0", 1), (None, base[1] + " " + item, "en", "src0", 1), (2, base[2], "en", "src0", 1), (None, None, None, "src0", None)]
    fx.frame(spark, [(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = fx.frame(spark, rows, extra=True)
    kept = cp.identify_languages(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0 and kept.count() == len(rows) - 1
    kept = spark.createDataFrame(kept.collect(), docs.schema)  # a stage's result is written before the next one starts
    once = cp.drop_near_duplicates(spark, kept, str(tmp_path)).collect()
    assert sorted(r.text for r in once if item not in r.text) == sorted(base)  # the null copies and the repeated row went
    assert once[0].__fields__ == docs.columns
    clean = cp.drop_contaminated(spark, spark.createDataFrame(once, docs.schema), str(tmp_path)).collect()
    assert [r for r in clean if item in r.text] == [] and len(clean) == 12
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0


def test_registered(spark, sf_dir):
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and len(cp.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_test_tables(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
