"""Operator 4, WARC: reader (and writer) of Zstandard archives with a leading dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself raw or
a Zstandard frame; each record is one frame compressed with it. The reader streams a file frame by
frame, finding a frame's end from its block headers, so memory is bounded by the largest record.
Each file is one task.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _sample

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Records that the dictionary is trained on at most, its size, the compression level.
DICTIONARY_ROWS, DICTIONARY_BYTES, LEVEL = 500, 64 << 10, 3
SEED = 42
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
RECORD = "path string, ordinal bigint, offset bigint, warc_type string, target_uri string, record_id string, date string, content_length bigint, headers map<string,string>, block binary, error string"


class Corrupt(ValueError):
    pass


class _Stream:
    """Reads exactly n bytes at a time and knows where it is."""

    def __init__(self, file):
        self.file, self.at = file, 0

    def take(self, n: int, may_end: bool = False) -> bytes:
        got = self.file.read(n)
        while len(got) < n and (more := self.file.read(n - len(got))):
            got += more
        self.at += len(got)
        if len(got) < n and not (may_end and not got):
            raise Corrupt("truncated frame")
        return got


def read_frame(stream: _Stream, magic: bytes) -> bytes:
    """The rest of the Zstandard frame that begins with magic, found by its block headers."""
    parts = [magic, stream.take(1)]
    flags = parts[1][0]
    single = flags >> 5 & 1
    parts.append(stream.take((not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]))
    while True:
        parts.append(head := stream.take(3))
        word = int.from_bytes(head, "little")
        kind, size = word >> 1 & 3, word >> 3
        if kind == 3:
            raise Corrupt("reserved block type")
        parts.append(stream.take(1 if kind == 1 else size))
        if word & 1:
            break
    if flags >> 2 & 1:
        parts.append(stream.take(4))
    return b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; raises Corrupt where it breaks the format.

    The values of a header given several times are joined by line breaks, which a value can't hold; the
    required ones may be given once only.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise Corrupt("no version line or no end of headers")
    headers: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            headers[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            raise Corrupt("header line without a name")
        last = name.strip().lower()
        if last in headers and last in _REQUIRED:
            raise Corrupt(f"header {last} given twice")
        headers[last] = f"{headers[last]}\n{value.strip()}" if last in headers else value.strip()
    if missing := [x for x in _REQUIRED if not headers.get(x)]:
        raise Corrupt("missing header " + ", ".join(missing))
    if not headers["content-length"].isdecimal():
        raise Corrupt("content-length isn't a number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Corrupt(f"content-length {length} doesn't fit the record")
    return headers, rest[:length]


def records(file) -> Iterator[tuple[int, dict[str, str] | None, bytes | None, str | None]]:
    """(offset, headers, block, error) of each record of an open archive. After a frame that can't be delimited the rest is unread."""
    stream = _Stream(file)
    decoder = zstandard.ZstdDecompressor()
    while True:
        offset = stream.at
        try:
            magic = stream.take(4, may_end=True)
            if not magic:
                return
            number = struct.unpack("<I", magic)[0]
            if number & 0xFFFFFFF0 == 0x184D2A50:
                payload = stream.take(struct.unpack("<I", stream.take(4))[0])
                if number == DICTIONARY_MAGIC and not offset:
                    if payload[:4] == struct.pack("<I", FRAME_MAGIC):
                        payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(payload))
                continue
            if number != FRAME_MAGIC:
                raise Corrupt("not a frame")
            frame = read_frame(stream, magic)
        except (Corrupt, zstandard.ZstdError) as e:
            yield offset, None, None, str(e)
            return
        try:
            headers, block = parse_record(decoder.decompressobj().decompress(frame))
            yield offset, headers, block, None
        except (Corrupt, zstandard.ZstdError) as e:
            yield offset, None, None, str(e)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at path (a file, folder or pattern), as RECORD has them.

    A record that breaks the format, or a file cut short, gives a row with error set and the record's
    fields null. Header names are in lower case; several values of one are joined by line breaks. Records without a target have target_uri null. No archives, no rows.
    """
    # only names are read here; contents are streamed by the tasks
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", True).load(path).select("path")
    names = [r.path for r in files.collect()]
    if not names:
        return spark.createDataFrame([], RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("error", pa.string())])
        for b in batches:
            for name in b.column(0).to_pylist():
                system, at = _open(name)
                rows, held = [], 0
                with system.open_input_stream(at, compression=None, buffer_size=1 << 20) as file:
                    for k, (offset, h, block, error) in enumerate(records(file)):
                        h = h or {}
                        rows.append({"path": name, "ordinal": k, "offset": offset, "warc_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "record_id": h.get("warc-record-id"), "date": h.get("warc-date"), "content_length": None if block is None else len(block), "headers": None if error else list(h.items()), "block": block, "error": error})
                        held += len(block or b"")
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    listed = spark.createDataFrame([(x,) for x in sorted(names)], "path string").repartitionByRange(len(names), "path")
    return listed.mapInArrow(run, RECORD)


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a resource record; what the format can't hold as it is (nulls, odd URLs) is marked in X- headers."""
    block = (html or "").encode()
    about = f"{page_id}\n{url}\n".encode() + hashlib.sha1(block).digest()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(about).digest())}>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html"]
    if url is not None:
        plain = url == url.strip() and url and url.isprintable() and "%" not in url
        head += [f"WARC-Target-URI: {url}"] if plain else [f"WARC-Target-URI: {quote(url, safe='/:?&=#')}", "X-Target-Quoted: 1"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if html is None:
        head.append("X-Null-Block: 1")
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; their own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def write(pages: DataFrame, path: str) -> int:
    """Writes the rows of pages as archives under path, one for each partition; gives their number. Null values survive a round trip."""
    # ids are chosen first: ordering whole pages would send the first of every task to the driver
    ids = _sample.least_hashes(pages.select(F.col("page_id").alias("doc_id")).where("doc_id is not null").distinct(), DICTIONARY_ROWS, SEED).select(F.col("doc_id").alias("page_id"))
    some = pages.select("page_id", "url", "html").join(F.broadcast(ids), "page_id", "left_semi").limit(DICTIONARY_ROWS).collect()
    dictionary = train_dictionary([record(*r) for r in some])
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    system, folder = _open(path)
    system.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(path)
        task = TaskContext.get()
        name, attempt = f"{at}/part-{task.partitionId():06d}.warc.zst", f"{at}/.attempt-{task.taskAttemptId()}"
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        n = 0
        # written aside and moved, so a lost or repeated attempt leaves no half file
        with system.open_output_stream(attempt, compression=None) as out:
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    out.write(compressor.compress(record(*row)))
                    n += 1
        system.move(attempt, name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "n bigint").agg(F.count("*")).first()[0]


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, url, html) of archives that `write` made; records with an error are left out."""
    h = F.col("headers")
    return found.where("error is null").select(
        h["x-page-id"].cast("bigint").alias("page_id"),
        F.when(h["x-target-quoted"].isNotNull(), F.url_decode("target_uri")).otherwise(F.col("target_uri")).alias("url"),
        F.when(h["x-null-block"].isNull(), F.col("block").cast("string")).alias("html"),
    )
