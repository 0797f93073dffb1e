"""Helpers that several operators share: tables, scratch tables, word hashes, byte files on shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.scale import scratch_dir

#: Code points U+0009 to U+000D and the space separate words.  ``bytes.split`` cuts at the same six.
SPACES = " \t\n\x0b\x0c\r"
SPACES_PATTERN = r"[\x20\x09-\x0D]+"

#: Words whose hashes a worker keeps; beyond it the table starts anew.
HASHED_WORDS = 250_000

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` in the shared scratch folder and read it back: one run, and nothing to recompute if an executor goes."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows stored with a key each, in a column whose name is new; and the name."""
    key = "_row"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def words_of(text: Column, pattern: str = SPACES_PATTERN) -> Column:
    """Array of the words between matches of ``pattern``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


class WordHashes(dict):
    """64-bit hash per word, kept because words come again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, from its words' hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = total * MIX_A + words[i : i + n]
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrow list array from one array per row."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch as tuples of the named columns."""
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path inside it, for local paths and URIs of any store that pyarrow can open."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def write_bytes(folder: str, name: str, chunks: list[bytes]) -> str:
    """Write a new file under a name of its own, so that a repeated task never touches another's file; its full path."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    stem, _, suffix = name.partition(".")
    name = f"{stem}-{uuid.uuid4().hex}.{suffix}"
    with fs.open_output_stream(f"{base}/{name}") as out:
        for chunk in chunks:
            out.write(chunk)
    return f"{folder}/{name}"


def read_bytes(path: str) -> bytes:
    fs, base = filesystem(path)
    with fs.open_input_stream(base) as source:
        return source.read()
