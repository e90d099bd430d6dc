"""WARC archives compressed record by record with an embedded Zstandard dictionary.

A dictionary is trained on a bounded, hash-chosen sample of the records. Every archive starts with it
in a skippable frame (magic 0x184D2A5D); then each record is a Zstandard frame of its own, so one can
be read without the others. Equal payloads from ``LEAST_PAYLOAD`` bytes on are archived once: the page
with the smallest page_id is the response, the others are revisits that refer to it.

Archives are written by Spark's own file writer, so tasks may be repeated and any file system that
Spark knows will do: each row is a whole archive, and the line end that the text writer adds is the
one byte of a last skippable frame.

Cases: null html is an empty payload, null url a URN of the page; smaller payloads are all
responses; rows that repeat a page_id are records of their own, and all are responses if theirs is
the smallest page_id of the payload; pages without a page_id are never referred to unless all equal
ones lack it; an empty table makes no archive and reads back as an empty result; other columns are
ignored. A record is built whole, so a task holds a few times its longest page.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import new_path, table

LEAST_PAYLOAD = 100
#: Bytes of sampled records that the dictionary is trained on at most, of one sampled record, and of the dictionary.
SAMPLE_BYTES, SAMPLE_RECORD, DICTIONARY = 4 << 20, 1 << 19, 1 << 16
#: Sampled records at most.
SAMPLE_ROWS = 1 << 14
#: An archive is closed when it has this many bytes.
ARCHIVE = 16 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC, FILLER_MAGIC = 0x184D2A5D, 0x184D2A50
_NAMESPACE = uuid.UUID("6f1d4bb0-6d0e-4e53-9c5e-6f7d4a1f9e02")


def _record_id(page_id: int | None, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}{place}')}>"


def _line(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """One WARC/1.1 record; the block is an HTTP response, without its body in a revisit.

    A record's id comes from its page_id and digest, and from its place where an earlier record has both.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest, place)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url) if url else f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(stream: io.BufferedReader, first: bytes) -> dict[str, str]:
    if not first.startswith((b"WARC/", b"HTTP/")):
        raise ValueError(f"not a record: {first[:40]!r}")
    out = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(archive: bytes) -> Iterator[tuple[int | None, int, str, str, int | None, bytes]]:
    """(page_id, payload size, digest, type, refers to, payload) of each record; payloads are checked against their digest."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive starts with its dictionary")
    dictionary = archive[8 : 8 + size]
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    stream = io.BufferedReader(decoder.stream_reader(io.BytesIO(memoryview(archive)[8 + size :]), read_across_frames=True), 1 << 16)
    while first := stream.readline():
        head = _headers(stream, first)
        block = io.BytesIO(stream.read(int(head["content-length"])))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record has no end")
        http = _headers(block, block.readline())
        digest, payload = head["warc-payload-digest"].removeprefix("sha256:"), block.read()
        if head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload does not have its digest")
        number = lambda k: int(head[k]) if head.get(k, "None") != "None" else None
        yield number("page-id"), int(http["content-length"]), digest, head["warc-type"], number("refers-to-page-id"), payload


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit: what each page's record will be."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    full = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    light = full.where(F.length("payload") >= LEAST_PAYLOAD).select("page_id", "digest")
    # Only the groups' heads and the rows that revisit them move here; pages move once, by page_id.
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    revisits = light.join(firsts, "digest").where("not (page_id <=> refers_to)").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct()
    joined = full.join(revisits, full["page_id"].eqNullSafe(revisits["_page"]) & (full["digest"] == revisits["_digest"]), "left")
    return joined.select("page_id", "url", "payload", "digest", "refers_to", F.col("_digest").isNotNull().alias("revisit"))


def trained(pages: DataFrame) -> bytes:
    """A dictionary from a sample of different records, chosen by hash; empty if there is too little to learn from.

    At most ``SAMPLE_BYTES`` reach the driver, whatever the number of pages and however often they repeat.
    """
    usable = pages.select("page_id", "url", "html", F.length(F.col("html").cast("binary")).alias("size")).where(F.col("size").between(1, SAMPLE_RECORD))
    total = usable.agg(F.sum("size")).first()[0] or 0
    near = usable.withColumn("place", F.xxhash64("url", "html")).where(F.col("place") / F.lit(2.0**64) + 0.5 < 2 * SAMPLE_BYTES / max(1, total))
    once = near.groupBy("place").agg(F.min("page_id").alias("page_id"), F.min("url").alias("url"), F.min("html").alias("html"), F.min("size").alias("size"))
    few = once.orderBy("place").limit(SAMPLE_ROWS)
    so_far = F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = few.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).select("page_id", "url", "html").collect()
    samples = [record(r[0], r[1], r[2].encode(), hashlib.sha256(r[2].encode()).hexdigest(), None, False) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, path: str, dictionary: bytes) -> None:
    """Archives of all pages in the folder ``path``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known is not None:
            known.precompute_compress(level=LEVEL)
        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        frames: list[bytes] = []
        named: set[tuple] = set()
        held, task = 0, TaskContext.get().partitionId()

        def archive() -> pa.RecordBatch:
            start = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
            return pa.RecordBatch.from_arrays([pa.array([b"".join([start, *frames, struct.pack("<II", FILLER_MAGIC, 1)])], pa.binary())], ["archive"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                    name = (row[0], row[3])
                    place = f":{task}:{len(named)}:{len(frames)}" if name in named else ""
                    named.add(name)
                    frames.append(encoder.compress(record(*row, place)))
                    held += len(frames[-1])
                    if held >= ARCHIVE:
                        yield archive()
                        frames, held = [], 0
        if frames:
            yield archive()

    packed = planned(pages).select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(pack, "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in a folder of archives."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows = [r[:5] for r in records(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.mapInArrow(unpack, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back."""
    pages = table(spark, sf_dir, "pages")
    path = new_path(spark, "warc")
    write_archives(pages, path, trained(pages))
    return read_archives(spark, path)


OP9_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE octet_length(payload) >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(octet_length(p.payload) AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND octet_length(p.payload) >= 100
"""
