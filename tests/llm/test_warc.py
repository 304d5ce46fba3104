import gzip
import hashlib

import pytest

from quadrel.llm import common, warc

from . import fixtures as fx

SCHEMA = "page_id long, url string, html string"


def run(spark, rows):
    recs = warc.resolve_revisits(warc.records(fx.frame(spark, rows, SCHEMA, extra=True)))
    path = common.scratch_path(spark, "test")
    warc.write_archives(recs, path)
    return path, warc.read_archives(spark, path, payloads=True)


LONG, OTHER = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 80, "x" * 1000
ROWS = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/9\r\nX: y", LONG), (3, None, OTHER), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", OTHER), (None, "u", OTHER), (8, "u", OTHER)]


def test_round_trip(spark):
    path, heads = run(spark, ROWS)
    heads = common.store(heads, "heads")
    payloads = {}
    for r in heads.collect():
        if r.record_type == "response":
            assert r.digest_ok and len(r.payload.encode()) == r.payload_bytes
            payloads.setdefault(r.page_id, r.payload)
        else:
            assert r.payload is None
    texts = {9: LONG, 4: "x" * 999, 5: "x" * 999, 6: "", 7: "", 8: OTHER}
    assert payloads == texts
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve_references(heads).collect()), key=str)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        best = {LONG: 9, OTHER: 8}.get(h)
        revisit = best is not None and i != best
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    assert got == sorted(want, key=str)


def test_files_are_warc(spark):
    path, _ = run(spark, ROWS)
    data = b"".join(gzip.decompress(f.content) for f in spark.read.format("binaryFile").load(path).collect())
    records = list(warc._parse(__import__("io").BytesIO(data)))
    assert len(records) == len(ROWS)
    for head, block in records:
        assert len(block) == int(head["content-length"]) and block.startswith(b"HTTP/1.1 200 OK\r\n")
        assert "x" not in head and head["warc-record-id"].startswith("<urn:uuid:")
        if head["warc-type"] == "revisit":
            assert head["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc._parse(__import__("io").BytesIO(b"junk")))


def test_empty(spark):
    _, heads = run(spark, [])
    assert warc.resolve_references(common.store(heads, "heads")).collect() == []
