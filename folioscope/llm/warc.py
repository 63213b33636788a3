"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

The writer makes one record for each page: a response, or for a payload that a
response with a smaller id already holds, a revisit that points to it. Each
record is a gzip member of its own; the archives are files of whole members in
the shared folder, of ARCHIVE bytes and one record more at most, written and
read by Spark alone. A record's last header is a digest of those before it.

The reader checks each member (its deflate data, CRC and length) and each
record (version line, headers and their digest, length, closing lines, block
and payload digests). It goes through an archive record by record and keeps
none of them. After a failed check it searches for the next valid member, or in
plain archives and in a member's inflated bytes for the next version line,
goes on from there, and logs the bytes between as a quarantined gap. Of a
member with broken deflate data the records before the fault are kept. What
follows such a fault in the same member depends on it and can't be inflated;
otherwise nothing is lost but the records that the damage touches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import fresh_path, stored, table

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 100
#: Stored bytes after which an archive is full.
ARCHIVE = 32 << 20
#: The byte that the plain writer's line separator gives back to an archive: the last one of a gzip member below 16 MB.
CLOSING = "\x00"
VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = b"2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"


def _safe(value: str | None) -> bytes:
    """A header value: control characters and blanks percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "").encode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    block = HTTP + payload if kind == "response" else HTTP
    own = "null" if page_id is None else str(page_id)
    head = [b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:page:{own}>".encode(), b"WARC-Target-URI: " + (_safe(url) or f"urn:page:{own}".encode()), b"WARC-Date: " + DATE,
            f"WARC-Payload-Digest: sha256:{digest}".encode(), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(), f"X-Payload-Length: {len(payload)}".encode()]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    head.append(b"X-Header-Digest: sha256:" + hashlib.sha256(b"\r\n".join(head)).hexdigest().encode())
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member that ends in a zero byte; a record of 16 MB or more is followed by an empty member, which does."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = deflate.compress(data) + deflate.flush()
    return out if out.endswith(b"\0") else out + member(b"")


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of pages (page_id, url, html) as files under path; a null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    slim = rows.where(F.col("n") >= LEAST_BYTES).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("uses")).where("uses > 1").drop("uses")
    # only pages that revisit come here, by their ids: the pages' own texts are joined on a key without repeats
    again = slim.join(first, "digest").where("page_id <> first or page_id is null").select(F.col("page_id").alias("again"), F.col("digest").alias("same"), "first").distinct()
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left").select("page_id", "url", "payload", "digest", "first")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for part in parts:
            for page, url, body, digest, to in part.itertuples(index=False):
                page = None if pd.isna(page) else int(page)
                kind = "response" if pd.isna(to) else "revisit"
                held.append(member(record(page, url, bytes(body), digest, kind, None if kind == "response" else int(to))))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield pd.DataFrame({"archive": [b"".join(held)[:-1]]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"archive": [b"".join(held)[:-1]]})

    made = marked.mapInPandas(write, T.StructType([T.StructField("archive", T.BinaryType())]))
    # one row is one file; the writer's line separator gives back its last byte
    made.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", CLOSING).option("maxRecordsPerFile", 1).text(path)


class Damaged(Exception):
    """A check failed."""


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place of a plain archive, checked, and the place after it."""
    if data[at : at + 5] != b"WARC/":
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers cut off")
    lines = data[at:end].split(b"\r\n")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if (want := head.get("x-header-digest", "")).startswith("sha256:"):
        own = [x for x in lines[1:] if not x.lower().startswith(b"x-header-digest:")]
        if hashlib.sha256(b"\r\n".join(own)).hexdigest() != want[7:].lower():
            raise Damaged("header digest")
    length = head.get("content-length", "")
    if not length.isdecimal():
        raise Damaged("no length")
    start = end + 4
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("wrong length")
    block = data[start:stop]
    if (want := head.get("warc-block-digest", "")).startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:].lower():
        raise Damaged("block digest")
    if head.get("warc-type") == "response" and (want := head.get("warc-payload-digest", "")).startswith("sha256:"):
        if hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() != want[7:].lower():
            raise Damaged("payload digest")
    return head, block, stop + 4


def _records_in(raw: bytes) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """Records (headers, block) of a member's inflated bytes and the gaps among them (start, end, reason), places in those bytes."""
    own: list[tuple[dict[str, str], bytes]] = []
    gaps: list[tuple[int, int, str]] = []
    place, bad = 0, None
    while place < len(raw):
        try:
            head, block, after = _record_at(raw, place)
        except Damaged as e:
            bad = bad or (place, str(e))
            place = raw.find(b"WARC/", place + 1)
            if place < 0:
                break
            continue
        if bad:
            gaps.append((bad[0], place, bad[1]))
            bad = None
        own.append((head, block))
        place = after
    if bad:
        gaps.append((bad[0], len(raw), bad[1]))
    return own, gaps


def salvage(data: bytes) -> tuple[list[tuple[int, dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """Records (place, headers, block) of an archive and its gaps (start, end, reason), places in the stored bytes."""
    found: list[tuple[int, dict[str, str], bytes]] = []
    gaps: list[tuple[int, int, str]] = []
    for what in events(data):
        (gaps if isinstance(what[2], str) else found).append(what)  # type: ignore[arg-type]
    return found, gaps


def events(data: bytes) -> Iterator[tuple]:
    """The records (place, headers, block) and gaps (start, end, reason) of an archive as they are met; of a record only its own bytes are held.

    Takes archives of gzip members, plain ones, and mixtures. An empty archive
    has neither records nor gaps. A gap within a member that inflates whole is
    logged with the member's place; its reason names the inflated bytes. What
    was inflated before a member's fault is searched for records in the same
    way, and the gap goes from the member's start to the next valid place.
    """
    at, size = 0, len(data)
    bad: tuple[int, str] | None = None
    view = memoryview(data)
    saved: list[tuple[dict[str, str], bytes]] = []  # from before a member's fault, which its stored bytes may show once more
    fault = 0
    while at < size:
        inner: list[tuple[int, int, str]] = []
        try:
            if data[at : at + 3] == MAGIC:
                raw, after, reason = _inflate(view, at)
                records, inner = _records_in(raw)
                if reason:
                    # a member of one record stands or falls with its own check; of several, those that pass theirs are kept
                    records = records if inner or len(records) > 1 else []
                    if records:
                        yield from ((at, *r) for r in records if r not in saved)
                        saved, fault = saved + records, max(fault, after)
                    raise Damaged(reason)
                own = [(at, *r) for r in records]
            else:
                head, block, after = _record_at(data, at)
                own = [(at, head, block)]
                if at < fault and (head, block) in saved:
                    own = []
        except Damaged as e:
            bad = bad or (at, str(e))
            nexts = [p for p in (data.find(MAGIC, at + 1), data.find(b"WARC/", at + 1)) if p > 0]
            at = min(nexts, default=size)
            continue
        if bad:
            yield bad[0], at, bad[1]
            bad = None
        if at >= fault:
            saved = []
        for start, stop, why in inner:
            yield at, after, f"{why} in inflated bytes {start} to {stop}"
        yield from own
        at = after
    if bad:
        yield bad[0], size, bad[1]


#: Bytes given to the inflater at a time, so that a member's end is found without copying the rest.
CHUNK = 1 << 16


def _inflate(view: memoryview, at: int) -> tuple[bytes, int, str]:
    """Inflated bytes of the member at a place, the place after it, and what is wrong with it, if anything.

    Of a broken member come the bytes before its fault and the fault's place.
    """
    inflate, out, place = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and place < len(view):
            out.append(inflate.decompress(view[place : place + CHUNK]))
            place += CHUNK
    except zlib.error as e:
        return *_before_fault(view, at, place), str(e)
    if not inflate.eof:
        return b"".join(out), len(view), "cut off"
    return b"".join(out), min(place, len(view)) - len(inflate.unused_data), ""


def _before_fault(view: memoryview, at: int, chunk: int) -> tuple[bytes, int]:
    """What inflates before the fault in the chunk at a place: that chunk goes in byte by byte."""
    inflate, out = zlib.decompressobj(31), []
    for place in range(at, chunk, CHUNK):
        out.append(inflate.decompress(view[place : place + CHUNK]))
    for place in range(chunk, min(chunk + CHUNK, len(view))):
        try:
            out.append(inflate.decompress(view[place : place + 1]))
        except zlib.error:
            break
    return b"".join(out), place


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, place long"


def _id(urn: str) -> int | None:
    text = urn.strip("<>").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdecimal() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record below path that passes its checks. Other record types than response and revisit come back too.

    Spark's reader of whole files takes archives of up to 2 GB.
    """
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                rows = []
                for place, head, block in events(bytes(data)):
                    if isinstance(block, str):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    told = head.get("x-payload-length", "")
                    revisit = head.get("warc-type") == "revisit"  # holds no payload: its length stands in the checked headers
                    rows.append((_id(head.get("warc-record-id", "")), int(told) if revisit and told.isdecimal() else len(payload), head.get("warc-payload-digest", "").removeprefix("sha256:").lower(),
                                 head.get("warc-type"), _id(head.get("warc-refers-to", "")), head.get("warc-target-uri"), name, place))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in _PAGE.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "place": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, _PAGE)


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """The log of quarantined bytes: archive, start, stop and reason of each gap."""
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(name, *g) for g in events(bytes(data)) if isinstance(g[2], str)], columns=["archive", "start", "stop", "reason"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "archive string, start long, stop long, reason string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages, written and read back.

    A row whose page_id is the smallest of its payload's is a response, and so
    is a repetition of that row. A null page_id gives a record without one; it
    revisits a payload that other pages hold. An empty table gives no rows.
    """
    path = fresh_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
