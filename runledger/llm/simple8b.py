"""Token ids in Simple-8b words: a selector of 4 bits says how many ids of which width share the other 60 bits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import columns, read_bytes, write_bytes, written
from runledger.llm.tokens import encoder
from runledger.scale import scratch_dir

#: Ids per word and bits per id, by selector from 1 on.  Selector 0 escapes: the next word is one id of up to 64 bits.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
           (2, 30), (1, 60))
MAGIC = b"S8B1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 23  # ids after which a task begins another file


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Words of one block; the last word may have room left, the count of ids is kept beside the block."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    ids = ids.astype(np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    selector = np.zeros(n, np.uint8)
    for number, (count, bits) in reversed(list(enumerate(LAYOUTS, 1))):
        bad = np.zeros(len(padded) + 1, np.int32)
        np.cumsum(padded >> np.uint64(bits) != 0, out=bad[1:])
        selector[bad[count : count + n] == bad[:n]] = number
    step = np.array([1] + [count for count, _ in LAYOUTS])[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen = selector[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == 0)[:-1]])
    words = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    for number, (count, bits) in enumerate(LAYOUTS, 1):
        mine = chosen == number
        if mine.any():
            values = padded[starts[mine][:, None] + np.arange(count)]
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[place[mine]] = (values << shifts).sum(axis=1, dtype=np.uint64) | np.uint64(number << 60)
    escaped = chosen == 0
    words[place[escaped] + 1] = ids[starts[escaped]]
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    at = np.arange(len(words))
    if (selector == 0).any():  # words after an escape are ids, not words with selectors; an id may look like an escape
        raw, skip = [], -1
        for i in np.flatnonzero(selector == 0).tolist():
            if i != skip:
                skip = i + 1
                raw.append(skip)
        at = np.delete(at, raw)
    counts = np.array([1] + [count for count, _ in LAYOUTS])[selector[at]]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for number, (count, bits) in enumerate(LAYOUTS, 1):
        mine = selector[at] == number
        if mine.any():
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values = (words[at[mine]][:, None] >> shifts) & np.uint64((1 << bits) - 1)
            out[starts[mine][:, None] + np.arange(count)] = values
    escaped = selector[at] == 0
    out[starts[escaped]] = words[at[escaped] + 1]
    return out[:n]


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: counts, table of documents, block offsets in words, words."""
    blocks = [encode_block(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0] + [len(b) for b in blocks]).astype("<u8")
    head = np.array([len(doc_ids), len(ids), len(blocks), BLOCK_IDS], "<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), table.tobytes(), np.array(lengths, "<u8").tobytes(), offsets.tobytes(),
                     *(b.astype("<u8").tobytes() for b in blocks), known.tobytes()])


def open_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b token file")
    n_docs, n_ids, n_blocks, size = (int(x) for x in np.frombuffer(data, "<u8", 4, 4))
    at = 36
    table = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 16 * n_docs).astype(np.int64)
    at += 16 * n_docs + 8 * (n_blocks + 1)
    words = np.frombuffer(data, "<u8", int(offsets[-1]), at)
    known = np.frombuffer(data, np.uint8, n_docs, at + 8 * len(words))
    ids = np.empty(n_ids, np.uint32)
    for b in range(n_blocks):
        count = min(size, n_ids - b * size)
        ids[b * size : b * size + count] = decode_block(words[offsets[b] : offsets[b + 1]], count)
    return [int(d) if k else None for d, k in zip(table, known, strict=True)], lengths, ids


MANIFEST = "part int, file int, path string, n_docs long, n_ids long, n_bytes long"


def _write(path: str, end_id: int, folder: str, literal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, literal).ids
        end = np.array([end_id], "<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def store():
            ids = np.frombuffer(b"".join(parts), "<u4")
            data = file_bytes(doc_ids, [len(p) // 4 for p in parts], ids)
            name = write_bytes(folder, f"part-{part:06d}-{number:04d}.s8b", [data])
            row = [[part], [number], [name], [len(doc_ids)], [len(ids)], [len(data)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                                              ["part", "file", "path", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            for doc_id, text in columns(batch, "doc_id", "text"):
                doc_ids.append(doc_id)
                parts.append(encode(text) + end)
                held += len(parts[-1]) // 4
                if held >= FILE_IDS:
                    yield store()
                    doc_ids, parts, held, number = [], [], 0, number + 1
        if doc_ids:
            yield store()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None,
                      literal_specials: bool = False) -> DataFrame:
    """Write all documents in ascending doc_id order; the table of files, with ``first_id`` = ids before each.

    Null doc_ids come first; rows that repeat one stand side by side.  Null and empty texts are the end id alone.  An
    empty table makes no file; further columns are ignored.  Ranges of doc_ids are split by a row number too, so one
    doc_id on a third of all rows fills several files.  A repeated task writes files of its own names; only those
    of the table count.
    """
    folder = folder or scratch_dir(docs.sparkSession, "tokens")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    files = written(ordered.select("doc_id", "text").mapInArrow(_write(tokenizer, end_id, folder, literal_specials), MANIFEST), "files")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in columns(batch, "path", "first_id"):
            doc_ids, lengths, ids = open_file(read_bytes(path))
            ends = np.cumsum(lengths)
            for low in range(0, len(doc_ids), 4096):
                span = slice(low, low + 4096)
                pieces = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[span], lengths[span], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[span], pa.int64()), pa.array(first + ends[span] - lengths[span]),
                     pa.array(lengths[span]), pa.array(pieces, pa.binary()),
                     pa.array([zlib.crc32(p) for p in pieces], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document in the files, one task for each file or few."""
    files = files.select("path", "first_id")
    spread = files.repartition(max(1, min(files.count(), 4096)), "path")
    out = spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
    return out if with_ids else out.drop("ids")
