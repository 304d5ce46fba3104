"""Language identification by Bayesian evidence fusion.

    log p(l | evidence) = text(l) + log p(declared | l) + log p(suffix | l) + log prior(l | host) + const

text(l): log likelihood of the letters' trigrams under a model of language l, tempered, as
trigrams overlap. The other terms come from grouped aggregates over all rows: the
text's own posterior is summed for each declared language, address suffix, domain
and host. A host's prior is smoothed by its domain's, and that by all rows'. Each row's
own share is taken out of the sums before they judge it. One more hypothesis, no known
language, has a flat trigram model and the prior `UNKNOWN`; a text for which it wins is rejected.

Only the trigram model is fitted on a sample: about `SAMPLE` labelled texts for each
language, taken by a hash of the id. Hosts are pre-aggregated, so a hot host is one row for each task.

Defined results. Null evidence is left out. A text without letters has no text term;
without any declared language it is rejected. `language` is the best language, null if
rejected; a row is rejected if its best posterior is below `min_posterior`, or
nothing in it is evidence. A long text is read whole; its trigrams count as `TEMPER`. Rows are judged each for itself, repeated or not.
An empty table gives an empty result; without a labelled text all rows are rejected.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled texts for each language, on average, that fit the trigram model.
SAMPLE = 2000
#: Symbols: blank, a-z, and the bytes of all other scripts in 37 classes.
SYMBOLS = 64
#: Trigrams that count in full; longer texts count as so many.
TEMPER = 40.0
#: Rows' worth of the level above in a smoothed prior.
PRIOR_STRENGTH = 10.0
MIN_POSTERIOR = 0.5
#: A text in no known language: trigrams of 27 symbols, all alike, and how often one is expected.
FLAT = -3 * float(np.log(27))
UNKNOWN = 1e-6
BATCH_BYTES = 1 << 20


def _symbols() -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[128:] = 27 + np.arange(128) % 37
    return table


_TABLE = _symbols()


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of the texts' lower-cased letters and the starts of the texts in them."""
    low = pc.utf8_lower(common.compact(texts))
    offsets = low.buffers()[1]
    ends = np.frombuffer(offsets, np.int64, len(low) + 1, low.offset * 8)
    data = low.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(low) else np.empty(0, np.uint8)
    ends = ends - ends[0] if len(ends) else np.zeros(1, np.int64)
    sym = _TABLE[raw]
    if len(sym) < 3:
        return np.empty(0, np.int32), np.zeros(len(low) + 1, np.int64)
    tri = (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]
    letters = sym > 0
    ok = letters[1:-1] & (letters[:-2] | letters[2:])  # at most one blank, at an end
    doc = np.repeat(np.arange(len(low), dtype=np.int32), np.diff(ends))
    ok &= doc[:-2] == doc[2:]
    starts = np.concatenate(([0], np.cumsum(np.bincount(doc[:-2][ok], minlength=len(low)))))
    return tri[ok], starts


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for rb in common.rebatch(batches, ["text"], BATCH_BYTES):
        tri, starts = trigrams(rb.column("text"))
        langs = np.array(rb.column("lang").to_pylist(), object)
        of = np.repeat(np.arange(rb.num_rows), np.diff(starts))
        for lang in set(langs.tolist()):
            n = np.bincount(tri[(langs == lang)[of]], minlength=SYMBOLS**3)
            sums[lang] = sums.get(lang, 0) + n
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "tri", "n"])


class Model:
    """Log probabilities (trigram, language) of add-half smoothed trigrams."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=0)).T.astype(np.float32))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit the trigram model on about `sample` texts of each language."""
    common.prepare(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lower(F.col(lang_col).cast("string")).alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return Model([], np.zeros((SYMBOLS**3, 0)))
    languages = sorted(sizes)
    share = F.element_at(F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))]), F.col("lang"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = rows.where(place < share).select("text", "lang").mapInArrow(_count, "lang string, tri int, n long").groupBy("lang", "tri").agg(F.sum("n").alias("n"))
    table = np.zeros((SYMBOLS**3, len(languages)))
    got = counts.toArrow()  # at most SYMBOLS ** 3 rows for each language
    cols = {lang: i for i, lang in enumerate(languages)}
    lang = np.array([cols[x] for x in got.column("lang").to_pylist()], np.int64)
    table[got.column("tri").to_numpy(), lang] = got.column("n").to_numpy()
    return Model(languages, table)


def softmax(x: np.ndarray) -> np.ndarray:
    """Posteriors of rows of log scores."""
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _flat(rows: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(rows.ravel()))


def _matrix(col: pa.Array, k: int) -> np.ndarray:
    """Rows of a list column; zeros for null."""
    out = np.zeros((len(col), k))
    full = col.is_valid().to_numpy(zero_copy_only=False)
    out[full] = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out


def _likelihood(model: Model):
    """Tempered log likelihoods ll (the last one: of no known language) and the text's own posteriors q."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in common.rebatch(batches, ["text"], BATCH_BYTES):
            tri, starts = trigrams(rb.column("text"))
            n = np.diff(starts)
            scale = TEMPER / np.maximum(n, TEMPER)
            sums = [common.segment_sums(t[tri].astype(np.float64), starts) * scale for t in model.table]
            ll = np.stack([*sums, n * scale * FLAT], axis=1)
            q = np.where((n > 0)[:, None], softmax(ll[:, :-1]), 0.0) if sums else np.zeros((len(n), 0))
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in ("id", *EVIDENCE)), pa.array(n), _flat(ll), _flat(q)], names=["id", *EVIDENCE, "n_trigrams", "ll", "q"])

    return run


EVIDENCE = ("host", "domain", "suffix", "declared")
_ROWS = "id long, host string, domain string, suffix string, declared string, n_trigrams long, ll array<double>, q array<double>"
_JUDGED = "id long, declared string, host string, n_trigrams long, text_language string, language string, posterior double, rejected boolean"


def _fuse(languages: list[str], mass: np.ndarray, min_posterior: float):
    """Judge rows by their likelihoods and the sums over all rows of the same host, domain, suffix and declared language."""
    k = len(languages)
    names = pa.array(languages, pa.string())
    total = mass.sum()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            some = rb.column("n_trigrams").to_numpy() > 0
            ll, q = _matrix(rb.column("ll"), k + 1), _matrix(rb.column("q"), k)
            there = {c: rb.column(c).is_valid().to_numpy(zero_copy_only=False)[:, None] for c in EVIDENCE}
            # The sums of the key's other rows.
            rest = {c: np.where(there[c], np.maximum(_matrix(rb.column(f"{c}_sums"), k) - q, 0.0), 0.0) for c in EVIDENCE}
            base = (mass + 1.0) / (total + k)
            domain = (rest["domain"] + PRIOR_STRENGTH * base) / (rest["domain"].sum(1, keepdims=True) + PRIOR_STRENGTH)
            host = (rest["host"] + PRIOR_STRENGTH * domain) / (rest["host"].sum(1, keepdims=True) + PRIOR_STRENGTH)
            # A declared language vouches for itself; others only by what the corpus shows.
            code = pc.fill_null(pc.index_in(rb.column("declared"), value_set=names), -1).to_numpy(zero_copy_only=False)
            vouch = np.where(code[:, None] == np.arange(k), 2.0, 0.5)
            declared = np.where(there["declared"], (rest["declared"] + vouch) / (mass + 2.0), 1.0)
            suffix = np.where(there["suffix"], (rest["suffix"] + 0.5) / (mass + 1.0), 1.0)
            score = np.where(some[:, None], ll[:, :k], 0.0) + np.log(host) + np.log(declared) + np.log(suffix)
            # No known language: its markup and address tell as much as those of the average row.
            odds = (host * declared * suffix).sum(1, keepdims=True)
            none = np.where(some[:, None], ll[:, k:] + np.log(odds * UNKNOWN), -np.inf)
            p = softmax(np.concatenate((score, none), axis=1))[:, :k]
            best = p.argmax(axis=1)
            posterior = p[np.arange(len(p)), best]
            rejected = (posterior < min_posterior) | (~some & ~there["declared"][:, 0])
            yield pa.RecordBatch.from_arrays(
                [
                    *(rb.column(c) for c in ("id", "declared", "host", "n_trigrams")),
                    names.take(pa.array(q.argmax(axis=1), mask=~some)),
                    names.take(pa.array(best, mask=rejected)),
                    pa.array(posterior),
                    pa.array(rejected),
                ],
                names=[x.split()[0] for x in _JUDGED.split(", ")],
            )

    return run


def identify(rows: DataFrame, model: Model, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Judge rows (id, text, declared, host, domain, suffix; all but id may be null).

    Returns id, declared, host, n_trigrams, text_language, language, posterior, rejected.
    """
    common.prepare(rows.sparkSession)
    cols = [F.col("id").cast("long").alias("id"), *(F.lower(F.col(c).cast("string")).alias(c) for c in EVIDENCE), F.col("text").cast("string").alias("text")]
    langs = model.languages
    rows = common.store(rows.select(*cols).mapInArrow(_likelihood(model), _ROWS), "likelihoods")
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select("id", "declared", "host", "n_trigrams", none.alias("text_language"), none.alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("rejected"))

    def summed(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(*(F.sum(F.get("q", F.lit(i))).alias(f"q{i}") for i in range(len(langs)))).select(*by, F.array(*(f"q{i}" for i in range(len(langs)))).alias("q"))

    # A row for each combination of evidence; the sums of its parts join it there, not at each row.
    seen = common.store(summed(rows, *EVIDENCE), "evidence", few=True)
    mass = np.array(summed(seen).first()["q"] or [0.0] * len(langs), float)
    known = seen.select(*EVIDENCE)
    for c in EVIDENCE:
        part = summed(seen.where(F.col(c).isNotNull()), c)
        known = known.join(part.withColumnRenamed("q", f"{c}_sums"), c, "left")
    known = common.store(known, "sums", few=True).select(*(F.col(c).alias(f"_{c}") for c in EVIDENCE), *(f"{c}_sums" for c in EVIDENCE))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in EVIDENCE]
    joined = rows.join(common.small(known), same, "left").drop(*(f"_{c}" for c in EVIDENCE))
    return joined.mapInArrow(_fuse(langs, mass, min_posterior), _JUDGED)


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows for `identify` from pages (page_id, url, html).

    The declared language is that of the first <html ...> tag with one, wherever the tag begins;
    tags in the strings of scripts are none.
    """
    html, url = F.col("html").cast("string"), F.lower(F.col("url").cast("string"))
    blank = lambda c: F.when(c != "", c)
    host = blank(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    marked = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    body = F.regexp_replace(marked, r"(?s)<[^>]*>", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("id"),
        F.regexp_replace(body, r"&[a-zA-Z#0-9]{1,10};", " ").alias("text"),
        blank(F.regexp_extract(marked, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1)).alias("declared"),
        host.alias("host"),
        blank(F.regexp_extract(host, r"([^.]+\.[^.]+)\.?$", 1)).alias("domain"),
        blank(F.regexp_extract(host, r"\.([a-z]{2,})\.?$", 1)).alias("suffix"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows for `identify` from documents (doc_id, text, lang, source): the source is the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"))
