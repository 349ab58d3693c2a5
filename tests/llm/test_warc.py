"""Archives: an exact round trip, and segments that are missing, repeated or cut."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from velith.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = i is not None and len(body) >= 100 and first.get(body, i) < i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None, "ok"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 64, "file_bytes": 500}, {"min_revisit_bytes": 100, "segment_bytes": 200}])
def test_round_trip(spark, options):
    big, edge = "<p>ä€😀" * 30_000, "x" * 100
    rows = [(5, "http://a/ b?ü", big), (3, "http://b", big), (9, None, big), (1, "u", None), (2, "u", ""), (4, "u", edge), (6, "u", edge), (7, "u", edge[:99]), (8, "u", edge[:99]), (10, "u", "a\r\n\r\nb\r\n0\r\n\r\n"), (4, "u", edge), (None, "u", "null id"), (11, "u\r\nX-Injected: 1", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1)).withColumn("n", F.lit(1)).withColumn("first", F.lit(0))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["status"]) for r in warc.round_trip(df, **options).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


RECORDS = "page_id long, record_type string, refers_to long, origin string, segment int, total long, declared string, block binary"


def segments(parts, total, numbers=None):
    numbers = numbers or range(1, len(parts) + 1)
    return [(7 if k == 1 else None, "response" if k == 1 else "continuation", None, "r", k, total if k == len(parts) else None, None, p) for k, p in zip(numbers, parts, strict=True)]


@pytest.mark.parametrize(
    ("change", "status"),
    [
        (lambda s: s, "mismatch"),
        (lambda s: s[::-1], "mismatch"),
        (lambda s: [s[0], s[2]], "broken"),
        (lambda s: [*s, s[1]], "broken"),
        (lambda s: s[:2], "broken"),
        (lambda s: s[1:], "broken"),
        (lambda s: [s[0], (*s[1][:7], s[1][7][:-1]), s[2]], "broken"),
    ],
)
def test_segments(spark, change, status):
    block = warc.http_block(b"hello payload of some bytes", 27)
    rows = change(segments([block[:20], block[20:50], block[50:]], len(block)))
    found = spark.createDataFrame(rows, RECORDS)
    read = warc.reassemble(found).collect()
    assert [r["status"] for r in read] == [status]
    if status == "mismatch":
        assert (read[0]["page_id"], read[0]["payload_bytes"], read[0]["payload_digest"]) == (7, 27, hashlib.sha256(b"hello payload of some bytes").hexdigest())
    else:
        assert read[0]["payload_bytes"] is None and read[0]["payload_digest"] is None


def test_foreign_and_cut_archives(spark, tmp_path):
    import gzip

    good = list(warc.page_records(1, "u", b"payload one", None, hashlib.sha256(b"payload one").hexdigest(), 1 << 20))
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<x>")], b"software: other")
    odd = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<y>"), ("X-Page-Id", "seven")], b"HTTP/1.1 200 OK\r\n\r\nabc")
    bare = warc.record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\n\r\nabc")
    files = {
        "whole": [gzip.compress(x) for x in (info, *good, odd, bare)],
        "cut": [gzip.compress(good[0]), gzip.compress(good[0])[:-20]],
        "text": [b"this is no gzip file"],
        "other": [gzip.compress(b"HTTP/1.1 200 OK\r\n")],
    }
    uris = []
    for name, parts in files.items():
        (tmp_path / name).write_bytes(b"".join(parts))
        uris.append((f"file://{tmp_path}/{name}",))
    got = warc.read_pages(spark.createDataFrame(uris, "uri string")).collect()
    assert sorted((r["status"], r["page_id"]) for r in got if r["page_id"]) == [("ok", 1), ("ok", 1)]
    assert sorted(r["status"] for r in got if not r["page_id"]) == ["broken", "mismatch", "unreadable", "unreadable", "unreadable"]


def test_a_page_of_many_segments_takes_linear_time(spark):
    import time

    body = bytes(range(256)) * 65536  # 16 MB
    block = warc.http_block(body, len(body))
    size = 4096
    rows = [(7, "response", None, k + 1, len(block), hashlib.sha256(body).hexdigest(), block[k * size : (k + 1) * size]) for k in range(-(-len(block) // size))]
    began = time.perf_counter()
    assert warc.joined(rows)[3] == len(body)
    assert time.perf_counter() - began < 5


def test_chunked_framing():
    body = bytes(range(256)) * 100
    assert warc.unchunk(warc.chunked(body, 777)) == body and warc.unchunk(warc.chunked(b"")) == b""
    assert warc.unchunk(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunk(bad)
