"""Media columns: what bytes really are, whatever their declared type says.

``store_samples`` keeps payloads losslessly as 8-bit PCM in a RIFF/WAVE container, ``sniff`` reads
stored bytes. One Aho-Corasick pass locates every magic number; a format's validator then walks its
structure to confirm it and find its length. The confirmed type at offset 0 corrects the declared
one, and confirmed media that begin later are carved out as (type, start, length).

Cases: null bytes count as empty; empty or unknown bytes are ``application/octet-stream`` with no
spans; a magic number whose structure does not hold is ignored; spans inside an already confirmed
embedded one are not reported again; rows that repeat give equal results; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, table

UNKNOWN = "application/octet-stream"
FRAME = 192
RATE = 8000

# --- validators: (bytes, start) -> length, or 0 if the structure does not hold ---------------------


def _riff(data: memoryview, at: int, form: bytes) -> int:
    if len(data) < at + 12 or data[at + 8 : at + 12] != form:
        return 0
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    end, pos, chunks = at + size, at + 12, 0
    if size < 20 or end > len(data):
        return 0
    while pos + 8 <= end:
        pos += 8 + (n := struct.unpack_from("<I", data, pos + 4)[0]) + (n & 1)
        chunks += 1
    return size if chunks and pos in (end, end + 1) else 0


def _wav(data: memoryview, at: int) -> int:
    n = _riff(data, at, b"WAVE")
    return n if n and data[at + 12 : at + 16] == b"fmt " else 0


def _webp(data: memoryview, at: int) -> int:
    n = _riff(data, at, b"WEBP")
    return n if n and data[at + 12 : at + 15] == b"VP8" else 0


def _png(data: memoryview, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, pos)
        if pos + 12 + n > len(data) or (first and kind != b"IHDR"):
            return 0
        if zlib.crc32(data[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", data, pos + 8 + n)[0]:
            return 0
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(data: memoryview, at: int) -> int:
    if len(data) < at + 13:
        return 0
    flags = data[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(pos: int) -> int:
        while pos < len(data) and data[pos]:
            pos += data[pos] + 1
        return pos + 1

    while pos < len(data):
        kind = data[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x21:
            pos = blocks(pos + 2)
        elif kind == 0x2C and pos + 10 <= len(data):
            local = data[pos + 9]
            pos = blocks(pos + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(data: memoryview, at: int) -> int:
    pos, scans = at + 2, 0
    while pos + 4 <= len(data):
        if data[pos] != 0xFF:
            return 0
        kind = data[pos + 1]
        if kind == 0xD9:
            return pos + 2 - at if scans else 0
        if kind == 0xFF or 0xD0 <= kind <= 0xD7 or kind == 0x01:
            pos += 1 if kind == 0xFF else 2
            continue
        n = struct.unpack_from(">H", data, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(data):
            return 0
        pos += 2 + n
        if kind == 0xDA:  # entropy-coded data runs to the next real marker
            scans += 1
            while pos + 1 < len(data) and not (data[pos] == 0xFF and data[pos + 1] not in (0, 0xFF) and not 0xD0 <= data[pos + 1] <= 0xD7):
                pos += 1
    return pos + 2 - at if scans and pos + 2 <= len(data) and data[pos : pos + 2] == b"\xff\xd9" else 0


def _bmp(data: memoryview, at: int) -> int:
    if len(data) < at + 54:
        return 0
    size, reserved, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    fits = 54 <= offset <= size <= len(data) - at
    plausible = reserved == 0 and header in (40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return size if fits and plausible and width > 0 and height and offset + (width * bits + 31) // 32 * 4 * abs(height) <= size else 0


def _table(bits: int, poly: int) -> list[int]:
    out = []
    for value in range(256):
        r = value << (bits - 8)
        for _ in range(8):
            r = (r << 1) ^ (poly if r >> (bits - 1) else 0)
            r &= (1 << bits) - 1
        out.append(r)
    return out


_CRC8, _CRC16 = _table(8, 0x07), _table(16, 0x8005)


def _flac_frame(data: memoryview, at: int, depth: int) -> int:
    """The length of the frame at ``at``, by its subframes' bits and both checksums, or 0; ``depth`` is the stream's bits a sample."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return 0
    block, rate, layout, sample = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    more = 0
    while data[at + 4] << more & 0x80:  # the frame's number has as many bytes as its first one has leading ones
        more += 1
    pos = at + 4 + max(1, more)
    size = [0, 192, 576, 1152, 2304, 4608, 0, 0, *(256 << i for i in range(8))][block]
    if block in (6, 7):
        size, pos = int.from_bytes(data[pos : pos + block - 5], "big") + 1, pos + block - 5
    pos += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    check = 0
    for byte in data[at:pos]:
        check = _CRC8[check ^ byte]
    depth = [depth, 8, 12, 0, 16, 20, 24, 32][sample]
    if not size or not depth or rate == 15 or layout > 10 or data[pos] != check:
        return 0
    widths = [depth + 1, depth] if layout == 9 else [depth, depth + 1] if layout > 7 else [depth] * (layout + 1)
    start, window = pos + 1, 1 << 14
    while True:
        view = data[start : start + window]
        try:
            used = _flac_subframes(format(int.from_bytes(view, "big"), f"0{8 * len(view)}b"), widths, size)
            break
        except (IndexError, ValueError):  # beyond the window, or beyond the bytes
            if start + window >= len(data):
                return 0
            window *= 4
    end = start + used
    check = 0
    for byte in data[at : end + 2]:
        check = (check << 8 & 0xFFFF) ^ _CRC16[check >> 8 ^ byte]
    return end + 2 - at if used and end + 2 <= len(data) and check == 0 else 0


def _flac_subframes(bits: str, widths: list[int], size: int) -> int:
    """Bytes of a frame's subframes, 0 if they are none; bits that are missing raise."""
    pos = 0
    for width in widths:
        kind, wasted, pos = int(bits[pos : pos + 7], 2), bits[pos + 7] == "1", pos + 8
        if wasted:
            width, pos = width - (bits.index("1", pos) + 1 - pos), bits.index("1", pos) + 1
        order = kind - 8 if 8 <= kind <= 12 else kind - 31 if 32 <= kind <= 63 else None
        if order is None:
            if kind > 1:
                return 0
            pos += width * (size if kind else 1)
            continue
        pos += order * width
        if kind >= 32:
            pos += 9 + order * (int(bits[pos : pos + 4], 2) + 1)
        method, parts, pos = int(bits[pos : pos + 2], 2), 1 << int(bits[pos + 2 : pos + 6], 2), pos + 6
        if method > 1 or size % parts or size // parts < order:
            return 0
        for part in range(parts):
            n = size // parts - (0 if part else order)
            rice, pos = int(bits[pos : pos + 4 + method], 2), pos + 4 + method
            if rice == (31 if method else 15):
                pos += 5 + n * int(bits[pos : pos + 5], 2)
            else:
                for _ in range(n):
                    pos = bits.index("1", pos) + 1 + rice
    if pos > len(bits):
        raise IndexError
    return -(-pos // 8)


def _flac(data: memoryview, at: int) -> int:
    """Metadata blocks, and the whole frames that follow them."""
    pos, first = at + 4, True
    while pos + 4 <= len(data):
        kind, n = data[pos] & 0x7F, int.from_bytes(data[pos + 1 : pos + 4], "big")
        if (first and (kind, n) != (0, 34)) or pos + 4 + n > len(data):
            return 0
        last, pos, first = data[pos] & 0x80, pos + 4 + n, False
        if last:
            depth = ((data[at + 20] & 1) << 4 | data[at + 21] >> 4) + 1
            try:
                while n := _flac_frame(data, pos, depth):
                    pos += n
            except IndexError:  # the bytes end within a frame's head
                pass
            return pos - at
    return 0


def _ogg(data: memoryview, at: int) -> int:
    pos = at
    while pos + 27 <= len(data) and data[pos : pos + 5] == b"OggS\0":
        n = data[pos + 26]
        if pos + 27 + n > len(data):
            return 0
        pos += 27 + n + sum(data[pos + 27 : pos + 27 + n])
    return pos - at if at < pos <= len(data) else 0


#: What may follow an end mark within a document: the next part or revision, or the end of the stream that holds an attached one.
_PDF_GOES_ON = re.compile(rb"(?:[\0\t\n\f\r ]+|%(?!PDF-)[^\r\n]*[\r\n])*(?:\d+[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj\b|xref\b|endstream\b)")


@lru_cache(maxsize=1)
def _pdf_ends(raw: bytes) -> list[int]:
    """Where the end marks of some bytes are; found once for all heads in them."""
    return [m.start() for m in re.finditer(b"%%EOF", raw)]


def _pdf(data: memoryview, at: int) -> int:
    """Up to the end mark of the last revision."""
    marks, end = _pdf_ends(data.obj), 0
    for i in range(bisect_left(marks, at + 9), len(marks)):
        end = marks[i] + 5
        if not _PDF_GOES_ON.match(data.obj, end):
            break
    return end - at if end else 0


@lru_cache(maxsize=1)
def _zip_archives(raw: bytes) -> dict[int, int]:
    """Start -> length of the archives in some bytes: an end record tells where its archive starts, the first one that fits counts."""
    out: dict[int, int] = {}
    for end in (m.start() for m in re.finditer(b"PK\5\6", raw)):
        if end + 22 > len(raw):
            continue
        entries, size, offset, note = struct.unpack_from("<HIIH", raw, end + 10)
        start, pos = end - size - offset, end - size
        if start < 0 or start in out or end + 22 + note > len(raw):
            continue
        while pos + 46 <= end and raw[pos : pos + 4] == b"PK\1\2":
            pos, entries = pos + 46 + sum(struct.unpack_from("<HHH", raw, pos + 28)), entries - 1
        if pos == end and entries == 0:
            out[start] = end + 22 + note - start
    return out


def _zip(data: memoryview, at: int) -> int:
    """Up to the first end record whose directory of entries lies just before it, counted from ``at``."""
    return _zip_archives(data.obj).get(at, 0)


#: (media type, magic bytes, validator)
FORMATS: list[tuple[str, bytes, Callable[[memoryview, int], int]]] = [
    ("audio/wav", b"RIFF", _wav),
    ("image/webp", b"RIFF", _webp),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("image/bmp", b"BM", _bmp),
    ("audio/flac", b"fLaC", _flac),
    ("audio/ogg", b"OggS", _ogg),
    ("application/pdf", b"%PDF-", _pdf),
    ("application/zip", b"PK\x03\x04", _zip),
]


def automaton() -> ahocorasick.Automaton:
    """All magic numbers; bytes are matched as Latin-1 characters."""
    out = ahocorasick.Automaton()
    for magic in {m for _, m, _ in FORMATS}:
        out.add_word(magic.decode("latin-1"), (len(magic), [(t, check) for t, m, check in FORMATS if m == magic]))
    out.make_automaton()
    return out


def identify(data: bytes, finder: ahocorasick.Automaton) -> tuple[str, list[tuple[str, int, int]]]:
    """(type of the whole, embedded spans) of some bytes."""
    view, kind, spans, done = memoryview(data), UNKNOWN, [], 0
    for last, (width, formats) in finder.iter(data.decode("latin-1")):
        start = last - width + 1
        if start < done:
            continue
        for name, check in formats:
            try:
                length = check(view, start)
            except (struct.error, IndexError):
                length = 0
            if length:
                if start == 0:
                    kind = name
                else:
                    spans.append((name, start, length))
                    done = start + length
                break
    _pdf_ends.cache_clear()  # they hold the bytes
    _zip_archives.cache_clear()
    return kind, spans


# --- 8-bit samples --------------------------------------------------------------------------------


def to_wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + (len(payload) & 1), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) & 1)


def wav_samples(data: bytes) -> tuple[int, int, int, bytes]:
    """(channels, rate, bits, sample bytes) of a confirmed WAVE file."""
    pos, channels, rate, bits = 12, 0, 0, 0
    while pos + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, pos)
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, pos + 8)
        elif kind == b"data":
            return channels, rate, bits, data[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    return channels, rate, bits, b""


def store_samples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media, declared_type: each text's bytes, padded with spaces to a positive multiple of 192, as a WAVE file."""
    chosen = docs.select(F.col(key), F.col(text).cast("binary").alias("bytes"))
    schema = T.StructType([chosen.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("declared_type", T.StringType())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [b or b"" for b in part.column(1).to_pylist()]
                media = [to_wav(b + b" " * (max(1, -(-len(b) // FRAME)) * FRAME - len(b))) for b in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([UNKNOWN] * len(media), pa.string())], [key, "n_bytes", "media", "declared_type"])

    return chosen.mapInArrow(store, schema)


def loudness(samples: bytes) -> tuple[int, int, int]:
    """(mean, mean square about 128, both rounded down, and how often the signal crosses 128) of unsigned 8-bit samples."""
    if not samples:
        return 0, 0, 0
    x = np.frombuffer(samples, np.uint8)
    centred = x.astype(np.int32) - 128
    above = x >= 128
    return int(x.sum(dtype=np.int64)) // len(x), int((centred * centred).sum(dtype=np.int64)) // len(x), int((above[1:] != above[:-1]).sum())


SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def sniff(media: DataFrame, key: str = "doc_id", column: str = "media", declared: str = "declared_type", carry: tuple[str, ...] = ()) -> DataFrame:
    """What each row's bytes are: true type, whether that corrects the declared one, embedded media, digests.

    Samples of 8-bit WAVE files are read back: payload_bytes, payload_sha256 and tail_crc32 (of the
    last 16) are theirs, and of the bytes themselves for any other type.
    """
    chosen = media.select(F.col(key), F.col(column).alias("media"), F.col(declared).alias("declared"), *carry)
    added = [("media_type", "string"), ("corrected", "boolean"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    schema = T.StructType([chosen.schema[c] for c in (key, *carry)] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in added] + [T.StructField("embedded", SPANS)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        spans_type = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(9)]
                for data, said in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = data or b""
                    kind, spans = identify(data, finder)
                    channels, rate, bits, payload = wav_samples(data) if kind == "audio/wav" else (0, 0, 0, data)
                    level = loudness(payload)
                    feature = f"{kind};channels={channels};rate={rate};bits={bits};frames={len(payload) // max(1, channels)};embedded={len(spans)};mean={level[0]};power={level[1]};crossings={level[2]}"
                    row = (kind, kind != said, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, [{"type": t, "start": s, "length": n} for t, s, n in spans])
                    for values, v in zip(out, row, strict=True):
                        values.append(v)
                kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans_type]
                kept = [part.column(0), *(part.column(3 + i) for i in range(len(carry)))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], schema.names)

    return chosen.mapInArrow(read, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as 8-bit samples, written, read back and identified."""
    path = new_path(spark, "media")
    stored = store_samples(table(spark, sf_dir, "documents"))
    stored.write.option("compression", "zstd").parquet(path)
    found = sniff(spark.read.schema(stored.schema).parquet(path), carry=("n_bytes",))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected")
