"""WARC archives with revisit records.

`resolve_revisits` decides from headers alone: only digests, lengths and ids are shuffled, and
grouped (partial aggregates, so a hot payload costs one row for each task). The originals of
repeated payloads go to the records while they are measured to be small, so that payloads stay where
they are; else they are joined by digest, which moves the payloads once and which adaptive execution may split.
`write_archives` writes WARC/1.1 with fresh headers through Spark's own writer, so
any file system works, a lost task is retried, and only committed files are seen.
Payloads of revisits are not written. `read_archives` parses the files again.

Defined results. Null payload: empty. Payloads below `min_bytes`: always response.
All rows that bear the largest id of a payload are responses (a record does not
refer to itself), so repeated rows stay repeated. A null id is never the largest;
if all ids of a payload are null, all are responses. Null URL: no target header.
A long payload is one record, whole. An empty table gives no record. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CRLF = "\r\n"
#: Payloads below this stay responses: a revisit record would save nothing.
MIN_BYTES = 1000
#: Payload of an archive, on average, so that a file can be parsed in one task.
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest (lower-case hex SHA-1)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8")))


def resolve_revisits(rows: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds record_type and refers_to: the largest page_id of equal payloads is the response."""
    by = ["payload_digest", "payload_bytes"]
    heads = rows.where(F.col("payload_bytes") >= min_bytes).select(*by, "page_id")
    originals = heads.groupBy(*by).agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 and original is not null")
    originals = common.store(originals.drop("n"), "originals", few=True)
    joined = rows.join(common.small(originals), by, "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("original"))).drop("original")


def _record_id(page_id: Column, digest: Column) -> Column:
    """A name-based UUID, the same for each run."""
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-3"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4], F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one WARC record for each row of `resolve_revisits`, as gzipped archives."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
    )
    out = rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
    n, size = common.text_bytes(rows, "payload")
    records = max(1, FILE_BYTES * n // max(1, size))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _parse(f: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, f.read(int(head["content-length"]))


_HEADS = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, payload_bytes long, digest_ok boolean, payload string"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]


def _read(payloads: bool):
    names = [x.split()[0] for x in _HEADS.split(", ")]

    def rows(content: bytes) -> Iterator[tuple]:
        raw = io.BytesIO(content)
        for head, block in _parse(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw):
            response = head["warc-type"] == "response"
            body = block.partition(b"\r\n\r\n")[2]
            digest = head["warc-payload-digest"].partition(":")[2].lower()
            page = head.get("warc-page-id")
            yield (
                head["warc-record-id"],
                head["warc-type"],
                None if page is None else int(page),
                head.get("warc-target-uri"),
                digest,
                head.get("warc-refers-to"),
                len(body) if response else None,
                hashlib.sha1(body).hexdigest() == digest if response else None,
                body.decode("utf-8") if response and payloads else None,
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for content in rb.column("content"):
                held, size = [], 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += 200 + len(row[-1] or "")
                    if size > 8 << 20:
                        yield _table(held, names)
                        held, size = [], 0
                if held:
                    yield _table(held, names)

    return run


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives under path.

    payload_bytes and digest_ok (the payload has the digest in its header) are null for
    revisits; payload is null unless payloads are asked for.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(payloads), _HEADS)


def resolve_references(heads: DataFrame) -> DataFrame:
    """Join revisits to the responses they name: payload_bytes and refers_to (its page_id)."""
    heads = heads.drop("payload")
    responses = heads.where("record_type = 'response'")
    named = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("found"), F.min("digest_ok").alias("found_ok"))
    revisits = heads.where("record_type = 'revisit'").join(named, "refers_to_id", "left")
    cols = ["page_id", "url", "payload_digest", "record_type"]
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "digest_ok").unionByName(
        revisits.select(*[c for c in cols if c != "url"], F.col("found").alias("payload_bytes"), "refers_to", F.col("found_ok").alias("digest_ok"))
    )
