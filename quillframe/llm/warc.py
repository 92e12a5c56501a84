"""WARC archives whose records are compressed one by one with a Zstandard dictionary of their own."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import scratch_path, write_out

DICT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20  # of an archive's first records, from which its dictionary is built
LEAST_SAMPLES = 16
LEVEL = 3
BATCH_BYTES = 4 << 20
DICT_MAGIC, FILLER_MAGIC, FRAME_MAGIC = b"\x5d\x2a\x4d\x18", b"\x50\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
#: Every row of the archive ends with the head of a skippable frame of one byte, which is the line end the writer adds.
FILLER = FILLER_MAGIC + struct.pack("<I", 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = "page_id string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id: str | None) -> str:
    return "<urn:x-page:>" if page_id is None else f"<urn:x-page:{quote(page_id, safe='')}.>"


def id_of(name: str | None) -> str | None:
    """The page a record name stands for; the closing dot tells an empty id from none."""
    inner = "" if name is None else name[len("<urn:x-page:"):-1]
    return unquote(inner[:-1]) if inner else None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}",
        f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    block = HTTP % len(payload) + (b"" if revisit else payload)
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """The fields of RECORD. A response's digest and size are those of the payload as read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    kind, page = fields["WARC-Type"], id_of(fields["WARC-Record-ID"])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "revisit":
        return page, kind, id_of(fields["WARC-Refers-To"]), stated, None, None
    payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if digest(payload) != stated:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload it states")
    return page, kind, None, stated, len(payload), payload


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the records, or none where they are too few or too short to train one."""
    if len(records) < LEAST_SAMPLES:
        return None
    size = min(DICT_BYTES, sum(map(len, records)) // 10)
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8, f=18, accel=2)
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The rows of one archive: the dictionary in a leading skippable frame, then a frame for each record."""
    held, size = [], 0
    for item in records:
        held.append(item)
        size += len(item)
        if size >= SAMPLE_BYTES:
            break
    if not held:
        return
    trained = dictionary(held)
    if trained is not None:
        raw = trained.as_bytes()
        yield DICT_MAGIC + struct.pack("<I", len(raw)) + raw + FILLER
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    for part in (held, records):
        for item in part:
            yield packer.compress(item) + FILLER


def unframed(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each frame decompressed on its own."""
    at, step, trained = 0, 1 << 16, None
    view = memoryview(data)
    opener = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = bytes(view[at:at + 4])
        if magic == FRAME_MAGIC:
            frame, out = opener.decompressobj(), []
            while not frame.eof:
                if at >= len(data):
                    raise ValueError("the archive ends inside a record")
                out.append(frame.decompress(view[at:at + step]))
                at = min(at + step, len(data))
            at -= len(frame.unused_data)
            yield b"".join(out)
        elif magic[1:] == FILLER_MAGIC[1:] and magic[0] >> 4 == 5:
            size = struct.unpack("<I", view[at + 4:at + 8])[0]
            if magic == DICT_MAGIC and trained is None:
                trained = zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + size]))
                opener = zstandard.ZstdDecompressor(dict_data=trained)
            at += 8 + size
        else:
            raise ValueError("neither a Zstandard nor a skippable frame")


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) to one archive per partition under ``path``.

    The payload is the page in UTF-8; null counts as empty. Of equal payloads of at least ``least_bytes`` that
    of the smallest page_id (null last) is written as a response and the others as revisits of it. Rows that repeat
    a response, page_id included, are responses too. Spark's text writer commits the files, so
    a lost executor leaves no half-written archive and any file system will do; the line end it adds after a row is the
    content of a skippable frame. Empty tables give no records.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first"))
    shared = write_out(groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("sha1", "first"), "shared-payloads")
    rows = rows.join(shared, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.select(
        F.col("page_id").cast("string"), "url", "payload", F.col("first").cast("string").alias("first"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = (
            record(page.as_py(), url.as_py(), body.as_py(), first.as_py(), again.as_py())
            for batch in batches for page, url, body, first, again in zip(*batch.columns, strict=True))
        yield from _batched(((frame,) for frame in frames(items)), pa.schema([("frame", pa.binary())]), 0)

    archived = rows.mapInArrow(run, "frame binary")
    archived.select(F.col("frame").cast("string")).write.option("lineSep", "\n").text(path)


def _batched(rows: Iterator[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``BATCH_BYTES`` of column ``weigh``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[weigh] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: the columns of RECORD. Revisits have no payload of their own."""
    names = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (parsed(raw) for batch in batches for data in batch.column(0) for raw in unframed(data.as_py()))
        yield from _batched(rows, pa.schema(list(zip(names, types))), 5)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared scratch folder and describe every record as read back.

    page_id, payload_bytes, payload_digest (base32 SHA-1), record_type and refers_to; those of a
    revisit's payload come from the response it refers to.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, least_bytes)
    records = write_out(read(spark, path).drop("payload"), "warc-records")
    responses = records.filter(F.col("record_type") == "response").select(
        F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("whole")).groupBy("refers_to").agg(F.first("whole").alias("whole"))
    kind = pages.schema["page_id"].dataType
    return records.join(responses, "refers_to", "left").select(
        F.col("page_id").cast(kind), F.coalesce("payload_bytes", "whole").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("refers_to").cast(kind))
