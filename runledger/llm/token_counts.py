"""Token counts of flat token files without an index: blocks are searched for end-of-document ids and stitched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import columns, filesystem, write_bytes, written
from runledger.llm.tokens import encoder
from runledger.scale import scratch_dir

BLOCK_BYTES = 4 << 20
FILE_BYTES = 64 << 20


def _write(path: str, end_id: int, kind: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, True).ids
        part, number, held = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        chunks: list[bytes] = []

        def store():
            name = write_bytes(folder, f"part-{part:06d}-{number:04d}.bin", chunks)
            n = len(doc_ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array([name] * n, pa.string()),
                 pa.array([held] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(doc_ids, pa.int64())],
                ["part", "file", "path", "n_bytes", "ordinal", "doc_id"])

        for batch in batches:
            for doc_id, text in columns(batch, "doc_id", "text"):
                ids = np.append(np.frombuffer(encode(text), "<u4"), np.uint32(end_id)).astype(kind)
                doc_ids.append(doc_id)
                chunks.append(ids.tobytes())
                held += len(chunks[-1])
                if held >= FILE_BYTES:
                    yield store()
                    doc_ids, chunks, held, number = [], [], 0, number + 1
        if doc_ids:
            yield store()

    return run


def write_flat_files(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "<u2", folder: str | None = None) -> DataFrame:
    """Flat token files of all documents, each followed by ``end_id``, and the table of who stands where.

    Names of special tokens in a text are ordinary text, so the end id occurs at ends only.
    """
    folder = folder or scratch_dir(docs.sparkSession, "flat")
    schema = "part int, file int, path string, n_bytes long, ordinal long, doc_id long"
    return written(docs.select("doc_id", "text").mapInArrow(_write(tokenizer, end_id, kind, folder), schema), "flat-rows")


def _search(end_id: int, kind: str, block_bytes: int):
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n_bytes, block in columns(batch, "path", "n_bytes", "block"):
                fs, base = filesystem(path)
                low = block * block_bytes
                with fs.open_input_file(base) as source:
                    source.seek(low)
                    ids = np.frombuffer(source.read(min(block_bytes, n_bytes - low)), kind)
                ends = np.flatnonzero(ids == end_id).astype(np.int64) + low // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64())),
                     pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64())],
                    ["path", "block", "ends", "n_ends", "last_end"])

    return run


def count_tokens(files: DataFrame, end_id: int, kind: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat token files (path, n_bytes): path, ordinal, file_start, n_tokens, ended.

    Every block is one vectorised comparison in a task of its own.  A prefix scan over the blocks of a file (a row each)
    gives the documents and the last end before a block; a document that spans blocks is stitched by it.
    ``n_tokens`` includes the end id.  Ids after the last end are a document with ``ended`` false.  Empty files and an
    empty table have no documents; further columns are ignored; a file listed twice is read twice.
    """
    if block_bytes % np.dtype(kind).itemsize:
        raise ValueError("a block must hold whole ids")
    listed = files.select("path", "n_bytes").where("n_bytes > 0")
    last = F.floor((F.col("n_bytes") - 1) / block_bytes).cast("long")
    blocks = listed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    spread = blocks.repartition(max(1, min(blocks.count(), 4096)), "path", "block")
    schema = "path string, block long, ends array<long>, n_ends long, last_end long"
    found = written(spread.mapInArrow(_search(end_id, kind, block_bytes), schema), "ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = found.select(
        "path", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("end_before"))
    at = found.select("path", "block", "ends").join(prefix, ["path", "block"]).select(
        "path", "docs_before", "end_before", "ends", F.posexplode("ends").alias("k", "end"))
    previous = F.when(F.col("k") == 0, F.col("end_before")).otherwise(F.get("ends", F.col("k") - 1))
    ended = at.select("path", (F.col("docs_before") + F.col("k")).alias("ordinal"), (previous + 1).alias("file_start"),
                      (F.col("end") - previous).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = found.groupBy("path").agg(F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("end"))
    n_ids = F.floor(F.col("n_bytes") / np.dtype(kind).itemsize)
    open_ = listed.join(whole, "path").where(n_ids > F.col("end") + 1).select(
        "path", "ordinal", (F.col("end") + 1).alias("file_start"), (n_ids - 1 - F.col("end")).alias("n_tokens"),
        F.lit(False).alias("ended"))
    return ended.unionByName(open_)


def document_tokens(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens) of all documents, counted in the flat files written for them.

    ``start`` counts the ids of all documents before it, in the order of the files; ``n_tokens`` includes the end id.
    Null and empty texts count 1.  Rows without a doc_id, and rows that repeat one, are counted each.
    """
    rows = write_flat_files(docs, tokenizer, end_id, kind)
    files = rows.groupBy("part", "file", "path").agg(F.max("n_bytes").alias("n_bytes"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    width = np.dtype(kind).itemsize
    files = written(files.withColumn("base", F.floor(F.coalesce(F.sum("n_bytes").over(before), F.lit(0)) / width)), "flat-files")
    counted = count_tokens(files, end_id, kind)
    named = rows.select("path", "ordinal", "doc_id").join(files.select("path", "base"), "path")
    return counted.join(named, ["path", "ordinal"]).select(
        "doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens")
