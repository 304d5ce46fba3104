"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of docs; the last adds where a document is stored. A stage's
result is written before the next stage over the same input starts, which frees the scratch tables.

Defined results. A row with a null id is known, for the stage, by a hash of its text, so it is
judged like others. Rows of one id are judged together: they go if all of them are
rejected, if any of them is contaminated, and one of them stays in the near-duplicate
stage. Extra columns are kept as they are, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm import common, decontam, hyperminhash, langid, queries, sharding

#: Share of the tokens that the mixture keeps; without repeated epochs, so that rows stay unique.
BUDGET_SHARE = 0.8
#: A column name that no table has.
KEY = "quadrel_row_key"
#: Scratch tables of the last stage over an input; its result has been written when the next one starts.
_LEFT: dict[tuple[str, str], list[str]] = {}
_LOCK = Lock()


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        with _LOCK:
            before = _LEFT.pop(key, [])
        common.release(spark, before)
        with common.scope() as made:
            out = f(spark, docs, sf_dir)
        with _LOCK:
            _LEFT.setdefault(key, []).extend(made)
        return out

    return run_stage


def _key():
    """doc_id, or for null a number below -2**62 that follows the text."""
    none = F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 2) + F.lit(-(2**63))
    return F.coalesce(F.col("doc_id").cast("long"), none)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", _key())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of the keys in gone (doc_id)."""
    gone = common.store(gone.select(F.col("doc_id").alias(KEY)).distinct(), "gone", few=True)
    return docs.withColumn(KEY, _key()).join(common.small(gone), KEY, "left_anti").select(docs.columns)


@_stage
def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, from their text, the declared language and their source; others go."""
    model = langid.fit(docs)
    judged = langid.identify(langid.document_rows(_keyed(docs)), model)
    rejected = judged.groupBy(F.col("id").alias("doc_id")).agg(F.min("rejected").alias("rejected")).where("rejected")
    return _without(docs, rejected)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, once."""
    found = hyperminhash.near_duplicates(_keyed(docs), k=5, percent=80)
    left = _without(docs, found.where("not kept"))
    again = found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(KEY))
    again = common.store(again, "again", few=True)
    if not again.head(1):
        return left
    left = left.withColumn(KEY, _key())
    once = left.join(common.small(again), KEY, "left_semi").dropDuplicates([KEY])
    return left.join(common.small(again), KEY, "left_anti").unionByName(once).select(docs.columns)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return _without(docs, decontam.contaminated(_keyed(docs), queries.table(spark, sf_dir, "benchmark")))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budgets of the target mixture."""
    return _without(docs, queries.mixed(_keyed(docs), BUDGET_SHARE, 1).where("copies = 0"))


@_stage
def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document is stored: shards of near equal bytes."""
    rows = sharding.balance_bytes(docs, 8)
    return rows.select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language id", identify_languages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Near-duplicate groups and differencing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with common.scope() as made:
            docs = common.store(out, "stage")
        common.release(spark, last)
        last = made
    with _LOCK:
        left = _LEFT.pop((spark.sparkContext.applicationId, sf_dir), [])
    common.release(spark, left)
    return docs
