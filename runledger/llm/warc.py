"""WARC archives whose records are compressed one by one with a Zstandard dictionary of their own.

A file begins with a skippable frame that holds the dictionary, built from records of that file.  One frame per
record follows, so any record can be read alone from its offset.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import columns, read_bytes, write_bytes, written
from runledger.scale import scratch_dir

#: Magic number of the skippable frame that holds a dictionary, as the format for compressed archives fixes it.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of a file's first records that the dictionary is built from, and the size of the dictionary.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
FILE_BYTES = 32 << 20  # record bytes after which a task begins another file
LEVEL = 3

FILES = "path string, n_records long, n_bytes long"


def record_bytes(kind: str, record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no payload, but names the record it repeats."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _header(value: str) -> str:
    """A header is one line: other characters that would end it are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in value)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def build_dictionary(records: list[bytes]) -> bytes | None:
    """A dictionary from the given records; none if they are too few to learn from."""
    samples, size = [], 0
    for record in records:
        samples.append(record[: 64 << 10])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    if len(samples) < 16 or size < 4096:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # records too much alike or too short
        return None


def archive_chunks(records: list[bytes]) -> list[bytes]:
    """The bytes of one archive file: the dictionary's frame, then a frame for each record."""
    raw = build_dictionary(records)
    chunks = []
    if raw is None:
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    else:
        packed = zstandard.ZstdCompressor(level=19).compress(raw)
        chunks.append(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        compressor = zstandard.ZstdCompressor(
            level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(raw))
    return chunks + [compressor.compress(r) for r in records]


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive file, one after the other."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        frame = reader.decompressobj()
        yield frame.decompress(view[at:])
        at = len(data) - len(frame.unused_data)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        records: list[bytes] = []

        def store():
            chunks = archive_chunks(records)
            path = write_bytes(folder, f"part-{part:06d}-{number:04d}.warc.zst", chunks)
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([len(records)], pa.int64()), pa.array([sum(map(len, chunks))], pa.int64())],
                ["path", "n_records", "n_bytes"])

        for batch in batches:
            for page_id, url, html, digest, first in columns(batch, "page_id", "url", "html", "digest", "first"):
                kind = "response" if first is None or first == page_id else "revisit"
                records.append(record_bytes(
                    kind, _urn(page_id), url or "", (html or "").encode(), digest, None if kind == "response" else _urn(first)))
                held += len(records[-1])
                if held >= FILE_BYTES:
                    yield store()
                    records, held, number = [], 0, number + 1
        if records:
            yield store()

    return run


def _urn(page_id: int | None) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 100) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html); the table of files: path, n_records, n_bytes.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the smallest page_id is the
    response; all others are revisits that name it.  Null html is an empty payload, null url an empty one.  A row without
    a page_id is always a response and never named.  Rows that repeat a page_id and payload are all responses.  Empty
    tables make no file; further columns are ignored.

    Only payloads that occur twice take part in the join for revisits, in a form whose hot payload Spark can split.  A
    repeated task writes files of its own names; only those of the table count.
    """
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(html.cast("binary"), 256).alias("digest"))
    long = F.octet_length(html) >= min_revisit_bytes
    digests = pages.where(long & F.col("page_id").isNotNull()).select(
        "page_id", F.sha2(html.cast("binary"), 256).alias("digest"))
    firsts = written(digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").drop("n"), "first-pages")
    joined = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id").isNotNull(), F.col("first")).alias("first"))
    return written(joined.mapInArrow(_write(folder), FILES), "archives")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload", "payload_digest", "payload_bytes", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for (path,) in columns(batch, "path"):
            rows, held = [], 0
            for record in read_archive(read_bytes(path)):
                fields, payload = parse_record(record)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"damaged record in {path}")
                rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, payload, digest,
                             int(fields["X-Payload-Length"]), _page(fields.get("WARC-Refers-To"))))
                held += len(payload)
                if len(rows) == 1000 or held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(files: DataFrame) -> DataFrame:
    """Records of the files: page_id, url, record_type, payload, payload_digest, payload_bytes, refers_to.

    A revisit's payload is empty; ``payload_bytes`` and ``payload_digest`` are those of the full payload.  Payloads are
    checked against their digests.
    """
    spread = files.select("path").repartition(max(1, min(files.count(), 4096)), "path")
    return spread.mapInArrow(
        _read, "page_id long, url string, record_type string, payload binary, payload_digest string, payload_bytes long, "
               "refers_to long")
