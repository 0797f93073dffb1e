"""Per-file fingerprints over file content."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 8 << 20
SHA2_BITS = {"sha512": 512, "sha256": 256}
#: Adler-32 counts modulo the largest prime below 2^16.
ADLER = 65521


def file_blocks(files: DataFrame, size: int = 1 << 20) -> DataFrame:
    """Rows of (path, offset, bytes) for files with content; an empty file has one empty block."""
    n = F.octet_length("content")
    at = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))).alias("offset")
    cut = files.filter(F.col("content").isNotNull()).select("path", "content", at)
    return cut.select("path", F.col("offset").cast("long").alias("offset"), F.expr(f"substring(content, offset + 1, {size})").alias("bytes"))


@F.pandas_udf(T.StructType([T.StructField("plain", T.LongType()), T.StructField("weighted", T.LongType())]))
def _block_sums(content: pd.Series) -> pd.DataFrame:
    """Sum of a block's bytes, and of its bytes times their distance from its end, both modulo ``ADLER``."""
    out = []
    for block in content:
        values = np.frombuffer(block, np.uint8).astype(np.int64)
        out.append((int(values.sum()) % ADLER, int((values * np.arange(len(values), 0, -1)).sum()) % ADLER))
    return pd.DataFrame(out, columns=["plain", "weighted"])


def adler32(blocks: DataFrame) -> DataFrame:
    """(path, fingerprint): Adler-32 as eight lower-case hex digits, from blocks (path, offset, bytes) in any order.

    A block is reduced to two numbers where it lies.  How often its bytes count in the second half follows from what comes
    after it, so a file of any size is spread over many tasks, and only sums are shuffled.  Blocks cover a file
    without gaps; one may hold up to 2^27 bytes.
    """
    sums = blocks.select("path", "offset", F.octet_length("bytes").cast("long").alias("n"), _block_sums("bytes").alias("s"))
    # a block's weight needs the file's length, so the parts with it are summed apart: length * plain, and end * plain
    end = F.col("offset") + F.col("n")
    per_file = sums.groupBy("path").agg(
        F.sum("n").alias("n"), F.sum("s.plain").alias("plain"), F.sum("s.weighted").alias("weighted"),
        F.sum(F.pmod(end, F.lit(ADLER)) * F.col("s.plain") % ADLER).alias("before"))
    low = (F.col("plain") + 1) % ADLER
    high = F.pmod(F.col("n") % ADLER + (F.col("n") % ADLER) * (F.col("plain") % ADLER) - F.col("before") + F.col("weighted"), F.lit(ADLER))
    value = F.shiftleft(high, 16).bitwiseOR(low)
    return per_file.select("path", F.lower(F.lpad(F.hex(value), 8, "0")).alias("fingerprint"))


def digest(content: Column, algo: str) -> Column:
    """Hex digest of binary content: crc32 (upper case, unpadded), sha512 or sha256."""
    if algo == "crc32":
        return F.hex(F.crc32(content))
    return F.sha2(content, SHA2_BITS[algo])


def fingerprint(files: DataFrame, algo: str) -> DataFrame:
    """Fingerprint table of files with content; null content has a null fingerprint."""
    if algo == "adler32":
        return files.select("path", "dir", "name").join(adler32(file_blocks(files)), "path", "left")
    return files.select("path", "dir", "name", digest(F.col("content"), algo).alias("fingerprint"))


def fingerprint_paths(paths: DataFrame, algo: str) -> DataFrame:
    """Fingerprints of files too large for one row, read in blocks from a shared mount.

    ``paths.path`` must be readable as a local path on every executor.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                adler, crc, sha = 1, 0, hashlib.new(algo) if algo in SHA2_BITS else None
                with open(path.removeprefix("file:"), "rb") as handle:
                    while block := handle.read(BLOCK):
                        if sha is not None:
                            sha.update(block)
                        elif algo == "adler32":
                            adler = zlib.adler32(block, adler)
                        else:
                            crc = zlib.crc32(block, crc)
                out.append(sha.hexdigest() if sha is not None
                           else f"{adler:08x}" if algo == "adler32" else f"{crc:X}")
            yield pd.DataFrame({"path": batch["path"], "fingerprint": out})

    return paths.select("path").mapInPandas(run, "path string, fingerprint string")


def empty_digest(algo: str = "sha512") -> Column:
    """Digest of an empty directory."""
    return F.sha2(F.lit("").cast("binary"), SHA2_BITS[algo])
