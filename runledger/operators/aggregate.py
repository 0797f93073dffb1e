"""Aggregations: good copies, completeness, sizes, digests, reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (DEFAULT_EVENTS_PER_FILE, ERROR, EXTRA_RAW_FILES, LISTING_MARK, NOT_AVAILABLE, PROCESSED, RAW,
                         TRANSFERRED)
from ..scale import join_few
from .joins import Masters, comparable, is_master, master_version


def good_copies(replicas: DataFrame, masters: Masters, catalogue: str, kind: str | None = None) -> DataFrame:
    """Verified copies per (run, type): n compared, good equal to their master.

    Equal checksums are counted before the master is known: the count beside the first
    master location's checksum is the number of good copies.  One scan and three combining
    aggregations; no join, and no step brings the replicas of a run together.
    """
    rows = replicas if kind is None else replicas.filter(F.col("type") == kind)
    compared, at_catalogue = comparable(), F.col("host") == catalogue
    candidate = (F.col("status") == TRANSFERRED) & is_master(masters)
    keys = ["run_number", "type", "_mv"]
    equal = rows.withColumn("_mv", master_version(masters)).filter(compared | candidate).groupBy(*keys, "checksum").agg(
        F.count_if(compared & ~at_catalogue).alias("_n"), F.count_if(compared & at_catalogue).alias("_listed"),
        F.min(F.when(candidate, F.col("pos"))).alias("_master"))
    unknown = F.sum(F.when(F.col("checksum").isNull(), F.col("_n")).otherwise(0))
    versions = equal.groupBy(*keys).agg(
        F.sum(F.col("_n") + F.col("_listed")).alias("n"), F.sum("_listed").alias("_listed"),
        F.coalesce(F.min_by("_n", "_master"), unknown).alias("_good"))
    return versions.groupBy("run_number", "type").agg(
        F.sum("n").alias("n"), F.sum(F.col("_good") + F.col("_listed")).alias("good")).filter(F.col("n") > 0)


def directory_totals(files: DataFrame) -> DataFrame:
    """Number and bytes of the entries of each directory."""
    return files.groupBy("dir").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("length").alias("bytes"))


def completeness(runs: DataFrame, replicas: DataFrame, files: DataFrame) -> DataFrame:
    """Raw transferred locations whose file count fits the events: 4 extra, and floor(e/n) or one more."""
    per_file = F.coalesce(F.col("reader.ini.events_per_file"), F.lit(DEFAULT_EVENTS_PER_FILE))
    events = F.col("trigger.events_built")
    built = runs.filter(events > 0).select(
        F.col("number").alias("run_number"), "raw_size_byte", F.floor(events / per_file).alias("expected"))
    raw = replicas.filter((F.col("type") == RAW) & (F.col("status") == TRANSFERRED)).select(
        "run_number", "pos", "host", "location")
    totals = directory_totals(files).withColumnRenamed("dir", "location")
    rows = raw.join(totals, "location").join(built, "run_number")
    n_files = F.col("n_entries") - EXTRA_RAW_FILES
    complete = (n_files == F.col("expected")) | (n_files == F.col("expected") + 1)
    return rows.select("run_number", "pos", "host", "location", n_files.alias("n_files"), "expected", "bytes",
                       "raw_size_byte", complete.alias("complete"))


def raw_size(runs: DataFrame, replicas: DataFrame, files: DataFrame) -> DataFrame:
    """Runs with ``raw_size_byte`` filled from their last complete location, where unset."""
    found = completeness(runs.filter(F.col("raw_size_byte").isNull()), replicas, files).filter("complete")
    sizes = found.groupBy(F.col("run_number").alias("number")).agg(F.max_by("bytes", "pos").alias("_bytes"))
    return join_few(runs, sizes, "number").withColumn("raw_size_byte", F.coalesce("raw_size_byte", "_bytes")).drop("_bytes")


def processed_size(replicas: DataFrame, files: DataFrame) -> DataFrame:
    """Fill the size of processed transferred locations from the listing, where unset."""
    listed = files.filter(~F.col("is_dir")).select(F.col("path").alias("location"), F.col("length").alias("_length"))
    fill = (F.col("type") == PROCESSED) & (F.col("status") == TRANSFERRED)
    return replicas.join(listed, "location", "left").withColumn(
        "size_bytes", F.when(fill, F.coalesce("size_bytes", "_length")).otherwise(F.col("size_bytes"))).drop("_length")


def size_per_event(runs: DataFrame) -> DataFrame:
    events = F.col("trigger.events_built")
    return runs.filter(F.col("raw_size_byte").isNotNull() & (events > 0)).select(
        "number", (F.col("raw_size_byte") / events).alias("bytes_per_event"), (F.col("raw_size_byte") * 1e-9).alias("gb"))


def directory_digest(fingerprints: DataFrame, algo: str = "sha512") -> DataFrame:
    """Digest per directory over its sorted per-file hex digests.

    Input: (dir, fingerprint) of the same algorithm.  Digests, not contents, are sorted by
    directory and hashed as a stream, so a directory of any size uses constant memory.
    """
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, n = None, None, 0
        for batch in batches:
            done = []
            for name, group in batch.groupby("dir", sort=False)["fingerprint"]:
                if name != current:
                    if state is not None:
                        done.append((current, state.hexdigest(), n))
                    current, state, n = name, hashlib.new(algo), 0
                state.update("".join(group).encode())
                n += len(group)
            if done:
                yield pd.DataFrame(done, columns=["dir", "digest", "n_files"])
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest(), n)], columns=["dir", "digest", "n_files"])

    rows = fingerprints.select("dir", "fingerprint").repartition("dir").sortWithinPartitions("dir", "fingerprint")
    return rows.mapInPandas(reduce, "dir string, digest string, n_files long")


def digest_nodes(files: DataFrame, levels: int = 3) -> DataFrame:
    """Nodes of a digest tree per directory: (dir, level, node, digest, n_files); ``node`` is a prefix of hex digits.

    Input: (dir, name, fingerprint).  A file is the SHA-256 of its name and fingerprint; files whose digests share
    ``levels`` digits form a leaf, and sixteen nodes a node of the level above, up to the root, level 0.  Names are
    spread evenly by their digests, so a directory of millions of files is summed by many tasks, and each level combines
    what many tasks made of the one below.  Digests travel as bytes, half the size of their digits and in the same order.
    """
    def sha256(parts: Column) -> Column:
        """Bytes of the digest of all ``parts`` as hex digits, one after the other."""
        return F.unhex(F.sha2(F.array_join(F.transform(parts, lambda p: F.lower(F.hex(p))), ""), 256))

    own = F.unhex(F.sha2(F.concat_ws("\n", F.coalesce("name", F.lit("")), F.coalesce("fingerprint", F.lit(""))), 256))
    rows = files.select("dir", own.alias("digest"))
    level = rows.groupBy("dir", F.substring(F.lower(F.hex("digest")), 1, levels).alias("node")).agg(
        sha256(F.array_sort(F.collect_list("digest"))).alias("digest"), F.count(F.lit(1)).alias("n_files"))
    nodes = level.withColumn("level", F.lit(levels))
    for up in range(levels - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        level = level.groupBy("dir", F.substring("node", 1, up).alias("_node")).agg(
            sha256(F.transform(children, lambda c: c["digest"])).alias("digest"),
            F.sum("n_files").alias("n_files")).withColumnRenamed("_node", "node")
        nodes = nodes.unionByName(level.withColumn("level", F.lit(up)))
    return nodes.select("dir", "level", "node", F.lower(F.hex("digest")).alias("digest"), "n_files")


def tree_digest(files: DataFrame, levels: int = 3) -> DataFrame:
    """Digest of each directory by the roots of its tree: (dir, digest, n_files)."""
    return digest_nodes(files, levels).filter("level = 0").select("dir", "digest", "n_files")


def differing_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaves (dir, node) of two sets of ``digest_nodes`` that differ, found without a look at the files."""
    leaf = before.agg(F.max("level")).first()[0]
    sides = [n.filter(F.col("level") == leaf).select("dir", "node", F.col("digest").alias(side)) for n, side in
             ((before, "_before"), (after, "_after"))]
    both = sides[0].join(sides[1], ["dir", "node"], "full")
    return both.filter(~F.col("_before").eqNullSafe(F.col("_after"))).select("dir", "node")


def duplicate_files(files: DataFrame) -> DataFrame:
    """Fingerprints that occur more than once in a directory."""
    return files.groupBy("dir", "fingerprint").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def directory_pretest(files: DataFrame) -> DataFrame:
    """A directory may be archived when it holds files and no subdirectories."""
    out = files.groupBy("dir").agg(F.count_if(~F.col("is_dir")).alias("n_files"), F.count_if("is_dir").alias("n_folders"))
    bad = (F.col("n_files") == 0) | (F.col("n_folders") > 0)
    return out.withColumn("status", F.when(bad, ERROR).otherwise("ok"))


def tape_locations(replicas: DataFrame, tape: str, mark: str = "tsm/") -> DataFrame:
    return replicas.filter((F.col("host") == tape) & (F.col("location") != NOT_AVAILABLE)
                           & F.col("location").contains(mark))


def tape_inventory(replicas: DataFrame, sizes: DataFrame, tape: str, mark: str = "tsm/") -> DataFrame:
    """Datasets on tape and their total size in MB."""
    rows = tape_locations(replicas, tape, mark).join(sizes.select("location", "mb"), "location", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_datasets"), F.coalesce(F.sum("mb"), F.lit(0.0)).alias("total_mb"))


def listing_size(lines: DataFrame, key: str = "file") -> DataFrame:
    """MB per tape listing: first token of every data line, thousands separators dropped."""
    first = F.regexp_extract("line", r"^ *([^ ]+)", 1)
    size = F.regexp_replace(first, ",", "").try_cast("double")
    return lines.filter(F.col("line").contains(LISTING_MARK)).groupBy(key).agg(
        F.sum(size / 1024 / 1024).alias("mb"))


def count_entries(replicas: DataFrame, host: str, status: str | None = None) -> DataFrame:
    """Entries of each run at a host, optionally of one status."""
    rows = replicas.filter(F.col("host") == host)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.groupBy("run_number").agg(F.count(F.lit(1)).alias("n"))


def double_entries(replicas: DataFrame, host: str) -> DataFrame:
    """Locations of runs entered more than once at a host, one row each, with the run's count."""
    many = count_entries(replicas, host).filter(F.col("n") > 1)
    return replicas.filter(F.col("host") == host).select("run_number", "pos", "location", "status").join(
        many, "run_number")


def log_totals(summaries: DataFrame) -> DataFrame:
    """Hours and TB of a log campaign; only logs with uploaded and inspected files count."""
    used = summaries.filter((F.col("nb_uploaded_files") > 0) & (F.col("nb_inspected_files") > 0))
    return used.agg(F.count(F.lit(1)).alias("n_logs"), (F.sum("total_time") / 3600).alias("hours"),
                    (F.sum("tr_amount_up") / 1024).alias("tb"))


def tape_status(replicas: DataFrame, tape: str, status: str) -> DataFrame:
    rows = replicas.filter((F.col("host") == tape) & (F.col("status") == status))
    return rows.select("run_number", "pos", "host", "status", "location",
                       F.when(F.col("checksum").isNotNull(), "YES").otherwise("NO").alias("checksum"))
