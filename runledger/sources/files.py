"""File inventories and text sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scale import broadcast_if_small

#: Characters that Spark writes as %XX in the names of folders, and the name of null and empty values there.
_ESCAPED = {c: f"%{ord(c):02X}" for c in "".join(map(chr, range(1, 32))) + "\"#%'*/:=?\\\x7f{[]^"}
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def file_inventory(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Recursive listing: path, dir, name, length, modificationTime (content only on request)."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    cols = ["path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"),
            F.substring_index("path", "/", -1).alias("name"), "length", "modificationTime"]
    return found.select(*cols, *(["content"] if content else []))


def write_files(rows: DataFrame, path: str, dir: Column, name: Column) -> None:
    """Text files below ``path``: one per ``dir=<dir>/name=<name>.txt``, with a line for each of its rows' ``line``.

    A task writes its files straight to their places, and a task that runs again writes the same ones, so there is nothing
    to rename afterwards.  A writer that makes a folder for each file spends most of its time on that, and so do listings.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(path)
        known, at, out = set(), None, None
        for batch in batches:
            for folder, file, line in zip(*(column.to_pylist() for column in batch.columns)):
                if (folder, file) != at:
                    if out is not None:
                        out.close()
                    if folder not in known:
                        store.create_dir(f"{root}/{folder}", recursive=True)
                        known.add(folder)
                    at, out = (folder, file), store.open_output_stream(f"{root}/{folder}/{file}")
                out.write((line or "").encode() + b"\n")
        if out is not None:
            out.close()
        yield from ()

    def escaped(value: Column) -> Column:
        text = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(_NO_VALUE))
        for character, code in sorted(_ESCAPED.items(), key=lambda c: c[0] != "%"):
            text = F.replace(text, F.lit(character), F.lit(code))
        return text

    files = rows.select(F.concat(F.lit("dir="), escaped(dir)).alias("folder"),
                        F.concat(F.lit("name="), escaped(name), F.lit(".txt")).alias("file"), "line")
    files.repartition("folder", "file").sortWithinPartitions("folder", "file").mapInArrow(write, "n long").write.format(
        "noop").mode("overwrite").save()


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with file and ordinal: (file, line_no, line).

    Files are read in splits, never as one row: a split's rows are numbered where they
    are read, and a table of one row per split, broadcast if it is small, carries the offsets of earlier splits.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    return lines.join(broadcast_if_small(splits), ["file", "block"]).select(
        "file", (F.col("_id") - F.col("_first") + F.col("_skip")).alias("line_no"), "line")


def read_run_list(spark: SparkSession, path: str) -> DataFrame:
    """Names or numbers from list files, separated by commas or newlines."""
    items = F.transform(F.split("value", ","), lambda x: F.regexp_replace(x, " ", ""))
    return spark.read.text(path).select(F.explode(items).alias("entry")).filter(F.col("entry") != "").distinct()


def restrict_to_list(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Runs listed by name or by number."""
    by_name = entries.select(F.col("entry").alias("name"), F.lit(True).alias("_by_name"))
    by_number = entries.select(F.col("entry").try_cast("bigint").alias("number"), F.lit(True).alias("_by_number"))
    by_number = by_number.dropna().distinct()
    return (runs.join(by_name, "name", "left").join(by_number, "number", "left")
            .filter(F.col("_by_name") | F.col("_by_number")).select(*runs.columns))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Job names of batch-queue snapshots: every token of a file but the first."""
    tokens = read_logs(spark, path).select("file", "line_no", F.posexplode(F.split("line", r"\s+")).alias("i", "job_name"))
    tokens = tokens.filter(F.col("job_name") != "")
    header = tokens.groupBy("file").agg(F.min(F.struct("line_no", "i")).alias("_h")).select("file", "_h.*")
    return tokens.join(header, ["file", "line_no", "i"], "left_anti").select("job_name")
