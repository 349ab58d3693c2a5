"""WARC archives: segmented writing, and reading back by segment reassembly.

Writing: one HTTP response record per page, its body in chunked transfer framing, gzip member by member.  A block
longer than ``segment_bytes`` is cut into a first segment and continuation records that name its record id as origin;
the last one carries the total length.  Of pages with equal payloads of at least ``min_revisit_bytes``, the one with the
smallest page id is stored and the others become revisit records without a body.

Reading: every file is parsed once.  Whole records are decoded where they are and leave only their figures behind; segments
are set aside in a table, dealt by their origin identifier and sorted by segment number, so a task joins the segments of one
record at a time, in time proportional to its length, checks them against the total length, and only then decodes them.

Status of a page read back: ``ok``; ``mismatch`` (no digest is declared, or another one); ``broken`` (segments missing, repeated or
of the wrong total, a bad chunk frame or number: null payload figures).  A file that ends early, isn't gzip or holds no WARC
record at some place gives the records before that place and one row with nothing but the status ``unreadable``.  Records
of other types than response, revisit and continuation are passed over.

Defined cases: a null page has an empty payload; a null url becomes ``urn:page:<id>``; a null page id is written without
its header and read back as null; rows that share both the smallest page id and the payload are all responses; an
empty table gives no file and no row; a very long page is held once in a task; columns other than page_id, url and html are
not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velith.llm import blobs
from velith.llm.common import materialise, scratch_path, slices
from velith.operators.sizes import bounded

CRLF = b"\r\n"
WHEN = "2024-01-01T00:00:00Z"
PAGE = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, status string"
SEGMENT = "origin string, segment int, total long, declared string, block binary"
#: Digests of repeated payloads up to which they are sent to all executors; beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def chunked(body: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%b\r\n" % (len(part := body[k : k + size]), part) for k in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(framed: bytes) -> bytes:
    """The body inside chunked framing; chunk extensions and trailers are skipped, a cut frame raises ValueError."""
    at, parts = 0, []
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if at + size + 2 > len(framed) or framed[at + size : at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        parts.append(framed[at : at + size])
        at += size + 2


def http_block(payload: bytes | None, length: int) -> bytes:
    """An HTTP response; without payload only its head, which tells the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if payload is None:
        return head + b"Content-Length: %d\r\n\r\n" % length
    return head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)


def payload_of(block: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    """(payload, lower-cased HTTP headers) of a response block, with any chunked framing undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:]))
    return (unchunk(body) if headers.get(b"transfer-encoding", b"").lower() == b"chunked" else body), headers


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return b"WARC/1.1\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}"
    own = f"<urn:uuid:{uuid.uuid4()}>"
    shared = [("WARC-Target-URI", target), ("WARC-Date", WHEN)]
    named = [("X-Page-Id", str(page_id))] if page_id is not None else []
    about = [*named, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared, *about, ("WARC-Profile", profile), ("X-Refers-To-Page", str(refers_to))], http_block(None, len(payload)))
        return
    block = http_block(payload, len(payload))
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        if k == 1:
            cut = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, *about, *cut], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *shared, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), *last], part)


def revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """pages with payload, digest and refers_to (the smallest page id of equal payloads, null on a response)."""
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.length("payload") >= min_revisit_bytes
    groups = body.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    found = body.filter(large).join(bounded(materialise(groups, "repeated-payloads"), BROADCAST_ROWS), "digest", "left")
    revisit = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    small = body.filter(~large).withColumn("refers_to", F.lit(None).cast("long"))
    return found.withColumn("refers_to", revisit).select(*small.columns).union(small).select("page_id", "url", "payload", "digest", "refers_to")


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 100, segment_bytes: int = 16384, file_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write the archives; the manifest (uri, records, bytes) names the files that count."""

    def run(batches):
        out = uri = None
        at = n = 0
        done = []
        for batch in slices(batches, 128):
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    (uri, out), at, n = blobs.create(folder, ".warc.gz"), 0, 0
                for item in page_records(page_id, url, payload, refers_to, digest, segment_bytes):
                    packed = gzip.compress(item, level, mtime=0)
                    out.write(packed)
                    at, n = at + len(packed), n + 1
                if at >= file_bytes:
                    out.close()
                    done.append((uri, n, at))
                    out = None
        if out is not None:
            out.close()
            done.append((uri, n, at))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["uri", "records", "bytes"])

    return materialise(revisits(pages, min_revisit_bytes).mapInArrow(run, "uri string, records long, bytes long"), "warc-manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(CRLF)) != b"":
            key, _, value = line.partition(b":")
            headers[key.decode().strip().lower()] = value.decode().strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record ends early")
        yield headers, block


def decoded(page_id: int | None, kind: str, refers_to: int | None, declared: str | None, block: bytes) -> tuple:
    """A PAGE row of one whole block."""
    try:
        if kind == "revisit":
            _, headers = payload_of(block)
            return page_id, kind, refers_to, int(headers[b"content-length"]), declared, "ok"
        payload, _ = payload_of(block)
    except (ValueError, KeyError):
        return page_id, kind, refers_to, None, None, "broken"
    digest = hashlib.sha256(payload).hexdigest()
    return page_id, kind, None, len(payload), digest, "ok" if digest == declared else "mismatch"


def _number(headers: dict[str, str], name: str) -> int | None:
    return int(headers[name]) if name in headers else None


def file_rows(stream) -> Iterator[tuple]:
    """PAGE and SEGMENT columns of each record of an archive, those of the other kind null."""
    none = (None,) * 5
    try:
        with gzip.GzipFile(fileobj=stream) as plain:
            for h, block in parse(plain):
                kind = h.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                declared = h.get("warc-payload-digest")
                declared = declared and declared.removeprefix("sha256:")
                try:
                    page_id, refers_to, segment, total = (_number(h, n) for n in ("x-page-id", "x-refers-to-page", "warc-segment-number", "warc-segment-total-length"))
                except ValueError:
                    yield None, kind, None, None, None, "broken", *none
                    continue
                if segment is None and kind != "continuation":
                    yield *decoded(page_id, kind, refers_to, declared, block), *none
                else:
                    yield page_id, kind, refers_to, None, None, None, h.get("warc-segment-origin-id", h.get("warc-record-id")), segment or 0, total, declared, block
    except (ValueError, KeyError, EOFError, OSError, UnicodeDecodeError, zlib.error):
        yield None, None, None, None, None, "unreadable", *none


def read_records(manifest: DataFrame) -> DataFrame:
    """The rows of all files (see :func:`file_rows`), written: pages that were whole and segments that aren't."""
    names = [f.split()[0] for f in f"{PAGE}, {SEGMENT}".split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with blobs.open_stream(uri) as raw:
                    rows, size = [], 0
                    for row in file_rows(raw):
                        rows.append(row)
                        size += 200 + len(row[-1] or b"")
                        if size > 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                    if rows:
                        yield pack(rows)

    return materialise(manifest.select("uri").repartition(max(1, manifest.count()), "uri").mapInArrow(run, f"{PAGE}, {SEGMENT}"), "warc-records")


def joined(segments: list[tuple]) -> tuple:
    """A PAGE row of the segments (page_id, kind, refers_to, segment, total, declared, block) of one record, in order."""
    page_id, kind, refers_to, _, _, declared, _ = segments[0]
    numbers = [s[3] for s in segments]
    block = b"".join(s[6] for s in segments)
    if numbers != list(range(1, len(numbers) + 1)) or segments[-1][4] != len(block):
        first = segments[0] if numbers[0] == 1 else (None, None, None)
        return first[0], first[1], first[2], None, None, "broken"
    return decoded(page_id, kind, refers_to, declared, block)


def reassemble(segments: DataFrame) -> DataFrame:
    """A PAGE row of each record whose segments (page_id, record_type, refers_to and SEGMENT) are there."""
    names = [f.split()[0] for f in PAGE.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        held: list[tuple] = []
        last, out = None, []
        for batch in slices(batches, 64):
            for origin, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and origin != last:
                    out.append(joined(held))
                    held = []
                last = origin
                held.append(tuple(row))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
                out = []
        if held:
            out.append(joined(held))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    parts = segments.select("origin", "page_id", "record_type", "refers_to", "segment", "total", "declared", "block")
    return parts.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(run, PAGE)


def read_pages(manifest: DataFrame) -> DataFrame:
    """One row per page from the archives; see PAGE."""
    records = read_records(manifest)
    whole = records.filter("segment is null").select(*(f.split()[0] for f in PAGE.split(", ")))
    return whole.union(reassemble(records.filter("segment is not null")))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages into the shared folder and read every one back."""
    return read_pages(write_warc(pages, scratch_path(pages.sparkSession, "warc"), **options))
