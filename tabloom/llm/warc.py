"""WARC archives in Zstandard frames: a writer and a validating reader.

An archive begins with a skippable frame that holds the compression dictionary, then has one frame per record.
Archives are written by Spark's text writer, so they reach any store that Spark writes to: a row is the bytes of an
archive and the line separator after it is an empty skippable frame, which readers of Zstandard pass over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import lookup_join
from ..session import written

# Magic numbers of frames (RFC 8878): skippable frames have sixteen; the dictionary of an archive is in 0x5D.
_FRAME = 0xFD2FB528
_SKIP_LOW, _SKIP_HIGH = 0x184D2A50, 0x184D2A5F
_DICTIONARY = 0x184D2A5D
_DICTIONARY_MAGIC = 0xEC30A437
_EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"

# Payload bytes of an archive before compression; a longer record has an archive of its own.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
# The dictionary of an archive is trained on at most so many of its records.
DICTIONARY_RECORDS = 256
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def _key(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record_bytes(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has the digest and length of the payload, but not the payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(key)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="%/:?#[]@!$&'()*+,;=-._~")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on some records; the raw bytes of one where they are too few to train on."""
    step = max(1, len(records) // DICTIONARY_RECORDS)
    samples = [r[:DICTIONARY_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return samples[0][: DICTIONARY_BYTES // 4]


def archive_bytes(records: list[bytes]) -> bytes:
    raw = _dictionary(records)
    packer = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True
    )
    return b"".join([struct.pack("<II", _DICTIONARY, len(raw)), raw, *(packer.compress(r) for r in records)])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive_bytes(held)], pa.binary())], names=["archive"])

    for batch in batches:
        keys, urls, refers = (batch.column(c).to_pylist() for c in ("id", "url", "refers_to"))
        payloads = batch.column("payload")
        for i in range(batch.num_rows):
            held.append(record_bytes(keys[i], urls[i], payloads[i].as_py() or b"", refers[i]))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to`` to (id, url, payload): of records with equal payloads of at least ``min_bytes`` bytes all
    but the one with the smallest id refer to it."""
    digest = F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload"))
    groups = written(
        pages.select("id", digest.alias("digest")).filter("digest is not null").groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "digests",
    )
    found = lookup_join(pages.withColumn("digest", digest), groups, "digest")
    return found.withColumn("refers_to", F.when(F.col("id") != F.col("first"), F.col("first"))).drop("digest", "first")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write (id, url, payload) as archives under ``path``, one record per row; null payloads are empty.

    Each task packs the rows it reads, in archives of about ``ARCHIVE_BYTES``. Rows with a null id have an id
    without a number and refer to the smallest id with the same payload; rows that share the smallest id are all
    responses. No rows give no archives.
    """
    lean = pages.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    packed = revisits(lean, min_bytes).mapInArrow(_pack, "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", _EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def _frame_end(data: memoryview, at: int) -> int:
    """The end of the Zstandard frame at ``at``, from its header and the headers of its blocks."""
    head = zstandard.get_frame_parameters(data[at : at + 18])
    to = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if to + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[to : to + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("a block of reserved type")
        to += 3 + (1 if kind == 1 else size)
    to += 4 * head.has_checksum
    if to > len(data):
        raise ValueError("a frame is cut off")
    return to


def parse_record(record: bytes) -> dict:
    """Fields of a record; raises ValueError where the version, a mandatory field, the length or the digest is wrong."""
    head, found, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"a header line without a colon: {line[:50]!r}")
        fields[name.strip()] = value.strip()
    if missing := [m for m in _MANDATORY if m not in fields]:
        raise ValueError(f"no {', '.join(missing)}")
    if int(fields["Content-Length"]) + 4 != len(block) or not block.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length does not fit the record")
    payload = block[:-4]
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if digest and digest != base32_sha1(payload):
            raise ValueError("the payload has another digest")
        if int(fields.get("X-Payload-Length", len(payload))) != len(payload):
            raise ValueError("the payload has another length")
        digest = digest or base32_sha1(payload)
    length = fields.get("X-Payload-Length")
    return {
        "id": _key(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload,
        "payload_bytes": int(length) if length else len(payload), "payload_digest": digest or None,
        "record_type": fields["WARC-Type"], "refers_to": _key(fields.get("WARC-Refers-To")),
    }


def records_in(archive: bytes) -> Iterator[dict]:
    """Records of an archive in order; raises ValueError where a frame or record is malformed."""
    data = memoryview(archive)
    unpacker, at = None, 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if _SKIP_LOW <= magic <= _SKIP_HIGH:
            if at + 8 + size > len(data):
                raise ValueError("a frame is cut off")
            if magic == _DICTIONARY:
                if at:
                    raise ValueError("a dictionary that is not at the front")
                raw = bytes(data[8 : 8 + size])
                if raw[:4] == struct.pack("<I", _FRAME):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        elif magic == _FRAME:
            unpacker = unpacker or zstandard.ZstdDecompressor()
            end = _frame_end(data, at)
            try:
                record = unpacker.decompressobj().decompress(data[at:end])
            except zstandard.ZstdError as broken:
                raise ValueError(f"a frame that does not decompress: {broken}") from broken
            yield parse_record(record)
            at = end
        else:
            raise ValueError(f"no frame begins with {magic:#x}")


_RECORD = "id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_ARROW = {
    "id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(),
}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``: id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to.

    An archive is read whole by one task, so its size must fit an executor. Malformed archives fail the job. Without
    ``payloads`` they are validated but not handed on.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                rows, size = [], 0
                for record in records_in(archive.as_buffer().to_pybytes()):
                    if not payloads:
                        record["payload"] = None
                    rows.append(record)
                    size += record["payload_bytes"] if payloads else 0
                    if size > ARCHIVE_BYTES // 4:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(_ARROW))
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema(_ARROW))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, _RECORD)


def round_trip(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row under ``path``, read the archives back and report what they hold.

    Null html is an empty payload; see :func:`write_archives` for null and repeated ids; an empty table gives an
    empty result; other columns are not read.
    """
    lean = pages.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(url_column).alias("url"), F.col(html_column).cast("binary").alias("payload")
    )
    write_archives(lean, path, min_bytes)
    found = read_archives(pages.sparkSession, path, payloads=False)
    return found.select(F.col("id").alias(id_column), "payload_bytes", "payload_digest", "record_type", "refers_to")
