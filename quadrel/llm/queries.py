"""The ten operators with production parameters, as queries over (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, embeddings, hyperminhash, langid, licenses, linededup, lm, mixing, oracles, sharding, warc

#: Shares of the domains and, within each, of the languages; sources of a language share alike.
WEIGHTS: dict[tuple[str, ...], float] = {("web",): 0.4, ("news",): 0.3, ("books",): 0.2, ("code",): 0.1}
WEIGHTS |= {(d, lang): w for d in ("web", "news", "books", "code") for lang, w in (("en", 0.55), ("fr", 0.15), ("de", 0.15), ("es", 0.15))}
BUDGET_SHARE = 0.8
MAX_EPOCHS = 3
SEED = 7


def domain(source: Column) -> Column:
    """The domain of a source src<n>: five sources make a domain."""
    n = F.try_to_number(F.regexp_extract(source, r"^src(\d{1,9})$", 1), F.lit("999999999")).cast("long")
    return F.when(n < 5, "web").when(n < 10, "news").when(n < 15, "books").when(n >= 15, "code").otherwise("other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    rows = warc.resolve_revisits(warc.records(table(spark, sf_dir, "pages")))
    path = common.scratch_path(spark, "warc")
    warc.write_archives(rows, path)
    heads = common.store(warc.read_archives(spark, path), "heads")
    return warc.resolve_references(heads)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("kept_text"), F.lit(""))
    return rows.select("doc_id", "n_lines", "n_deleted", "partners", F.octet_length(kept).cast("long").alias("kept_bytes"), F.crc32(F.encode(kept, "UTF-8")).alias("kept_crc32"))


def mixed(docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    path = {"domain": domain(F.col("source").cast("string")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, path, WEIGHTS, budget_share, max_epochs, SEED)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles", F.lit(True).alias("contaminated"))


def op5_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.balance_bytes(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by markup, address and host, and all documents, by declared language and source."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    none = F.lit(None).cast("long")
    cols = ["declared", "host", "n_trigrams", "text_language", "language", "posterior", (~F.col("rejected")).alias("kept")]
    pages = langid.identify(langid.page_rows(table(spark, sf_dir, "pages")), model).select(none.alias("doc_id"), F.col("id").alias("page_id"), *cols)
    texts = langid.identify(langid.document_rows(docs), model).select(F.col("id").alias("doc_id"), none.alias("page_id"), *cols)
    return texts.unionByName(pages)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


#: SQL with the same rows; the other operators are held against brute force.
ORACLES: dict[str, str] = {
    "op1_warc_revisits": oracles.OP1,
    "op3_mix_sources": oracles.op3(WEIGHTS, BUDGET_SHARE, MAX_EPOCHS, SEED),
    "op8_embedding_dedup": oracles.OP8,
    "op10_hyperminhash": oracles.OP10,
}

QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_line_dedup, op3_mix_sources, op4_decontaminate, op5_shard_bytes, op6_language_id, op7_license_scan, op8_embedding_dedup, op9_lm_score, op10_hyperminhash)}
