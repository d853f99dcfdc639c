"""WARC archives: writing segmented, chunk-framed records, and reassembling them.

Writing. A page becomes a response record, or a revisit record if an earlier page has the same payload. Both
state the payload's digest; a revisit also names the page and address of the response that it refers to.
A payload is framed in HTTP chunked transfer coding, and a record block longer than a segment is cut:
the first segment is the response with WARC-Segment-Number 1, the others are continuation records with
the origin's id, and the last states WARC-Segment-Total-Length. Spark's text writer stores the records
(as bytes, gzipped): its line separator is the blank lines that end a WARC record, so an archive
commits as any table does and can lie in any store.

Reading. Archives are read whole, one a task, and parsed by Content-Length. Continuation records are
grouped by origin id and ordered by segment number; numbers must run on from 1 and lengths must add up
to the stated total. Then the chunked framing is decoded and the payload held against the stated digest. Records
that need no reassembly are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import _to_arrow, cut, scratch, spread_join

LEAST = 100  # bytes from which equal payloads become revisits
SEGMENT = 32 * 1024  # bytes of a record block
CHUNK = 8 * 1024  # bytes of a transfer chunk
RECORDS = 5_000  # of an archive, at most; with SEGMENT the bound on what a reading task holds: 165 MB
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of object identifiers


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked transfer coding of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped, damage raises ValueError."""
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        size = int(data[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(data[at : at + size])
        at += size + 2


def _record(kind: str, block: bytes, fields: dict) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + block


def _one_line(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\r\n]+", " ", url)


def records(page: int | None, url: str | None, payload: bytes | None, digest: str, refers: tuple[int, str | None] | None, serial: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, each without the blank lines that end it. refers: the page and address of the
    response that a revisit refers to."""
    own = f"<urn:uuid:{uuid.uuid5(NAMES, serial)}>"
    common = {"WARC-Record-ID": own, "WARC-Target-URI": _one_line(url), "X-Page-ID": page, "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
        yield _record("revisit", block, common | {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": _one_line(refers[1]), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page": refers[0]})
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END + chunked(payload)
    common |= {"Content-Type": "application/http;msgtype=response"}
    if len(block) <= segment:
        yield _record("response", block, common)
        return
    cuts = range(0, len(block), segment)
    for number, at in enumerate(cuts, 1):
        part = block[at : at + segment]
        if number == 1:
            yield _record("response", part, common | {"WARC-Segment-Number": 1})
        else:
            more = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMES, f'{serial}/{number}')}>", "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": number}
            yield _record("continuation", part, more | ({"WARC-Segment-Total-Length": len(block)} if number == len(cuts) else {}))


def parsed(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(lower-case header fields, block) of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(END, at)
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]))
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != END:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield head, data[start:stop]
        at = stop + 4


def unzipped(data: bytes) -> bytes:
    """A gzip file of any number of members; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> str:
    """Write pages (page_id, url, html) as WARC archives under path, a URI, and return it.

    A null html is an empty payload, a very long one is cut into segments. Of equal payloads of `least` bytes or
    more, the row with the smallest page_id is a response; rows that repeat that page_id too are responses as well.
    A page_id that repeats with other payloads is a page of its own for each. A null page_id is never the
    smallest: such a row is a revisit if another row has the payload, else a response. An empty table makes no
    records. Other columns, whatever their names, are not read."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    named = F.when(F.col("page_id").isNotNull() & (F.length("payload") >= least), F.struct("page_id", "url"))
    copies = rows.groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n"))
    roles = spread_join(rows, copies, ["digest"], pages.count(), by="page_id", hashed=True)
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.lit(False))
    ready = roles.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.lower(F.hex("digest")).alias("digest"), revisit.alias("revisit"), F.col("first.page_id").alias("refers"), F.col("first.url").alias("where"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, task = _to_arrow("record binary"), uuid.uuid4().hex  # of this attempt: its file commits whole or not at all
        count = 0
        for b in batches:
            for r in b.to_pylist():
                count += 1
                made = list(records(r["page_id"], r["url"], r["payload"], r["digest"], (r["refers"], r["where"]) if r["revisit"] else None, f"{task}/{count}", segment))
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], schema=out)

    ready.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    return path


FIELDS = "page_id long, url string, kind string, refers long, digest string, id string, origin string, number int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path, segments unjoined. An archive must fit a task's memory; those
    written here hold RECORDS records of SEGMENT bytes at most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _to_arrow(FIELDS)
        number = lambda x: None if x is None else int(x)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for b in batches:
            for data in b.column("content").to_pylist():
                rows, size = [], 0
                for h, block in parsed(unzipped(data)):
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    rows.append((number(h.get("x-page-id")), h.get("warc-target-uri"), h["warc-type"], number(h.get("x-refers-to-page")), digest, h["warc-record-id"], h.get("warc-segment-origin-id"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, FIELDS)


def _join_segments(pdf: pd.DataFrame) -> pd.DataFrame:
    """One origin's segments -> its record, with the whole block."""
    pdf = pdf.sort_values("number")
    if pdf["number"].tolist() != list(range(1, len(pdf) + 1)):
        raise ValueError(f"segments of {pdf['id'].iloc[0]} are missing or repeated")
    block = b"".join(pdf["block"])
    if len(block) != pdf["total"].iloc[-1]:
        raise ValueError(f"segments of {pdf['id'].iloc[0]} do not add up to their total length")
    return pdf.iloc[:1].assign(block=[block])


def reassembled(records_: DataFrame) -> DataFrame:
    """Records whole: segments joined, lengths verified."""
    whole = records_.where("number IS NULL")
    parts = records_.where("number IS NOT NULL").withColumn("origin", F.coalesce("origin", "id"))
    return whole.unionByName(parts.groupBy("origin").applyInPandas(_join_segments, FIELDS))


PAYLOADS = "page_id long, url string, kind string, refers long, digest string, payload binary"


def payloads(records_: DataFrame) -> DataFrame:
    """(page_id, url, kind, refers, digest, payload): a record's HTTP body without its transfer framing, held
    against the record's digest; null for revisits, whose digest is that of the payload they refer to."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _to_arrow(PAYLOADS)
        for b in batches:
            body, found = [], []
            for kind, block, digest in zip(b.column("kind").to_pylist(), b.column("block").to_pylist(), b.column("digest").to_pylist(), strict=True):
                head, _, data = block.partition(END)
                if kind != "revisit":
                    data = unchunked(data) if b"transfer-encoding: chunked" in head.lower() else data
                    if (own := hashlib.sha256(data).hexdigest()) != (digest or own):
                        raise ValueError(f"a payload has digest {own}, its record says {digest}")
                    digest = own
                body.append(None if kind == "revisit" else data)
                found.append(digest)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "kind", "refers")), pa.array(found, pa.string()), pa.array(body, pa.binary())], schema=out)

    return records_.select("page_id", "url", "kind", "refers", "digest", "block").mapInArrow(decode, PAYLOADS)


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc")))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives under path.

    A revisit's payload is that of the response with the page and the digest it states."""
    got = payloads(reassembled(read_records(spark, path)))
    small = cut(got.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to")), "digests")
    whole, revisits = small.where("record_type = 'response'"), small.where("record_type = 'revisit'").drop("payload_bytes")
    asked = revisits.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    seen = whole.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").dropDuplicates(["refers_to", "payload_digest"])
    found = spread_join(revisits, asked.join(seen, ["refers_to", "payload_digest"]), ["refers_to", "payload_digest"], small.count(), by="page_id")
    return whole.unionByName(found)


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM d
"""
