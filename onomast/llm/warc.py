"""WARC archives (operator 9): writing with segmentation and revisits, reading with segment reassembly.

A payload is sent as an HTTP response in chunked transfer framing; a record whose block is longer than a segment
becomes an origin record and continuation records.  The reader groups segments by origin identifier, orders them by
segment number, verifies the numbers and the total length, and decodes the chunked framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.llm.base import join_values, local_path, prepare, staged

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Digests of repeated payloads that are broadcast at most (about 100 MB).
MOST_DIGESTS = 1_000_000
_VERSION = b"WARC/1.1"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields and payload of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return {}, block
    http = fields(head)
    return http, dechunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body


def record(kind: str, record_id: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), *more, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines).encode()
    return gzip.compress(b"".join([_VERSION, b"\r\n", head, b"\r\n", block, b"\r\n\r\n"]), 6, mtime=0)


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "about:blank")


def records_of(record_id: str, page_id, url, payload: bytes, digest: str, original, segment: int) -> Iterator[bytes]:
    """The records of one page: a revisit of ``original``, or a response in as many segments as it needs."""
    more = [("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        more.append(("X-Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http;msgtype=response")
    if original is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record("revisit", record_id, block, [*more, kind, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(original))])
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record("response", record_id, block, [*more, kind])
        return
    for k, at in enumerate(range(0, len(block), segment)):
        part = [("WARC-Segment-Number", str(k + 1))]
        if at + segment >= len(block):
            part.append(("WARC-Segment-Total-Length", str(len(block))))
        if not k:
            yield record("response", record_id, block[:segment], [*more, kind, *part])
        else:
            part.append(("WARC-Segment-Origin-ID", f"<{record_id}>"))
            yield record("continuation", str(uuid.uuid5(uuid.NAMESPACE_URL, f"{record_id}/{k}").urn), block[at : at + segment], [*more[:1], *part])


def write(pages: DataFrame, folder: str, least_bytes: int = 0, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in a folder that all executors mount; gives (archive, records).

    Of the pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is a response and
    the others revisit it; a null html is an empty payload.  Pages with a null page_id are always responses, and of
    several rows with the smallest page_id each is one.  Archives are written under a name of the task's own and renamed.
    """
    prepare(pages.sparkSession)
    to = local_path(folder)
    os.makedirs(to, exist_ok=True)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha = F.unhex(F.sha1(F.col("html").cast("binary")))
    long = F.octet_length("html") >= least_bytes
    p = p.withColumn("sha", F.when(long & F.col("page_id").isNotNull(), sha))
    # only digests that repeat; a digest that a third of all pages share is one row, summed before it moves
    twice = staged(p.where("sha is not null").groupBy("sha").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1"), "digests")
    if twice.count() <= MOST_DIGESTS:
        p = p.join(F.broadcast(twice.drop("n")), "sha", "left")
    else:
        p = join_values(p, twice, "sha", "n", "left")
    p = p.select("page_id", "url", "html", F.when(F.col("original") != F.col("page_id"), F.col("original")).alias("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        names, counts, out = [], [], None
        for batch in batches:
            for page_id, url, html, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or out.tell() >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    names.append(f"{part:06d}-{len(names):03d}.warc.gz")
                    counts.append(0)
                    out = open(f"{to}/.{own}-{names[-1]}", "wb")
                number += 1
                payload = html.encode()
                for data in records_of(uuid.uuid5(uuid.NAMESPACE_URL, f"{to}/{part}/{number}").urn, page_id, url, payload, digest_of(payload), original, segment):
                    out.write(data)
                    counts[-1] += 1
        if out:
            out.close()
        for n in names:
            os.replace(f"{to}/.{own}-{n}", f"{to}/{n}")
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return p.mapInArrow(run, "archive string, records long")


def members(path: str) -> Iterator[bytes]:
    """The records of an archive, one gzip member or one plain record each; one is held at a time."""
    with open(path, "rb") as f:
        if f.read(2) != b"\x1f\x8b":
            f.seek(0)
            while True:
                head = b""
                while (line := f.readline()) not in (b"\r\n", b""):
                    head += line
                if not head.strip():
                    if not line:
                        return
                    continue
                size = int(fields(head)["content-length"])
                yield head + b"\r\n" + f.read(size)
        f.seek(0)
        data, held = b"", []
        unzip = zlib.decompressobj(31)
        while data or (data := f.read(1 << 20)):
            held.append(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield b"".join(held)
                held, unzip = [], zlib.decompressobj(31)
        if any(held):
            raise ValueError(f"{path} is cut short")


_RECORDS = "record_id string, origin string, segment int, total long, kind string, page_id long, refers_to long, digest string, uri string, block binary"
_PAGES = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives of a folder, a row each; ``origin`` is set for segments."""
    prepare(spark)
    to = local_path(folder)
    names = sorted(x for x in os.listdir(to) if x.endswith((".warc", ".warc.gz")) and not x.startswith("."))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("uri", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for data in members(f"{to}/{name}"):
                    head, _, rest = data.partition(b"\r\n\r\n")
                    h = fields(head)
                    block = rest[: int(h["content-length"])]
                    if len(block) != int(h["content-length"]):
                        raise ValueError(f"a record of {name} is cut short")
                    number = lambda k, h=h: int(h[k]) if h.get(k) else None
                    rid = h["warc-record-id"].strip("<>")
                    segment = number("warc-segment-number")
                    origin = (h.get("warc-segment-origin-id") or rid).strip("<>") if segment else None
                    rows.append((rid, origin, segment, number("warc-segment-total-length"), h["warc-type"], number("x-page-id"), number("x-refers-to-page"), h.get("warc-payload-digest"), h.get("warc-target-uri"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.createDataFrame([(x,) for x in names], "name string")
    return files.repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, _RECORDS)


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The pages of a folder of archives: responses, whole or reassembled from segments, and revisits.

    Fails on a missing segment, a wrong total length, bad framing or a payload unlike its digest.  Only segments are
    shuffled, by their origin; a group is one record.  ``payload`` is null unless ``with_payload``.
    """
    r = records(spark, folder)
    group = F.array_sort(F.collect_list(F.struct("segment", "total", "kind", "page_id", "digest", "uri", "block")))
    parts = r.where("origin is not null").groupBy("origin").agg(group.alias("s"))
    parts = parts.select(
        F.expr("transform(s, x -> x.segment)").alias("numbers"), F.expr("element_at(s, -1).total").alias("total"), F.expr("s[0].kind").alias("kind"),
        F.expr("s[0].page_id").alias("page_id"), F.lit(None).cast("long").alias("refers_to"), F.expr("s[0].digest").alias("digest"), F.expr("s[0].uri").alias("uri"),
        F.expr("transform(s, x -> x.block)").alias("blocks"),
    )
    whole = r.where("origin is null and kind in ('response', 'revisit')").select(
        F.array(F.lit(1)).alias("numbers"), F.octet_length("block").cast("long").alias("total"), "kind", "page_id", "refers_to", "digest", "uri", F.array("block").alias("blocks")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _PAGES.split(", ")]
        for batch in batches:
            rows = []
            for numbers, total, kind, page_id, refers, digest, uri, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"".join(blocks)
                if numbers != list(range(1, len(numbers) + 1)) or total != len(block):
                    raise ValueError(f"segments {numbers} of {uri}: {len(block)} bytes of {total}")
                http, payload = payload_of(block)
                named = (digest or "").removeprefix("sha1:")
                if kind == "response":
                    size, found = len(payload), digest_of(payload)
                    if named and found != named:
                        raise ValueError(f"the payload of {uri} is not that of its digest")
                else:
                    size, found = int(http.get("content-length", 0)), named
                rows.append((page_id, uri, kind, refers, size, found, payload if with_payload and kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return whole.unionByName(parts).mapInArrow(run, _PAGES)
