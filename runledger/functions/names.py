"""Names, times, identifiers and metadata as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..constants import PROCESSED, RAW, SCIENCE_CUTS, SCIENCE_LAST, TRANSFERRED, VETO
from ..scale import run_time


def science_run(start: Column, cuts: Sequence[tuple[str, str]] = SCIENCE_CUTS, last: str = SCIENCE_LAST) -> Column:
    """Science period of a time: the first cut not before it, else the last period."""
    period = F.lit(last)
    for cut, name in reversed(list(cuts)):
        period = F.when(start <= F.lit(cut).cast("timestamp_ntz"), name).otherwise(period)
    return period


def with_science_run(runs: DataFrame, cuts: Sequence[tuple[str, str]] = SCIENCE_CUTS) -> DataFrame:
    return runs.withColumn("science_run", science_run(F.col("start"), cuts))


def with_run_time(runs: DataFrame) -> DataFrame:
    return runs.withColumn("run_time", run_time(F.col("name")))


def run_name(start: Column) -> Column:
    return F.date_format(start, "yyMMdd_HHmm")


def with_run_name(runs: DataFrame) -> DataFrame:
    return runs.withColumn("run_name", run_name(F.col("start")))


def short_detector(detector: Column) -> Column:
    return F.when(detector == VETO, "mv").otherwise(detector)


def dataset_names(runs: DataFrame, phase: str, group: str = "data") -> DataFrame:
    """Scope and container of a run, and the container of its period."""
    period = science_run(F.col("start"))
    basic = F.concat_ws("_", F.lit(phase), period)
    scope = F.concat_ws("_", basic, run_name(F.col("start")), short_detector(F.col("detector")))
    return runs.select("number", basic.alias("basic_scope"), scope.alias("scope"), scope.alias("container"),
                       F.concat_ws("_", basic, F.lit(group)).alias("super_container"))


def metadata_tags(runs: DataFrame, replicas: DataFrame, host: str, kind: str, campaign: str) -> DataFrame:
    """Metadata record per run for one host and data type.

    The version is taken from the first location only, when that is a processed one there.
    """
    there = F.col("host").startswith(host) & F.col("status").startswith(TRANSFERRED)
    facts = replicas.groupBy(F.col("run_number").alias("number")).agg(
        F.bool_or(there & F.col("type").startswith(kind)).alias("_moved"),
        F.min_by(F.when(there & (F.col("type") == PROCESSED), F.col("version")), "pos").alias("_version"))
    step = F.when(F.col("_moved") & F.lit(kind in (RAW, PROCESSED)), kind).otherwise("undefined")
    return runs.join(facts, "number").select(
        "number", F.col("user").alias("phys_group"), short_detector(F.col("detector")).alias("provenance"),
        F.col("source.type").alias("datatype"), F.lit("SR" + campaign).alias("campaign"), step.alias("prod_step"),
        F.coalesce("_version", F.lit("None")).alias("version"))


def split_did(df: DataFrame, col: str) -> DataFrame:
    """``scope:name`` as two columns."""
    parts = F.split(F.col(col), ":")
    return df.withColumns({"scope": parts[0], "name": F.get(parts, F.lit(1))})


def path_parts(df: DataFrame, col: str) -> DataFrame:
    """Base name and directory of a path."""
    return df.withColumns({"basename": F.substring_index(col, "/", -1),
                           "dirname": F.regexp_extract(col, "^(.*)/[^/]*$", 1)})


def tape_names(files: DataFrame, dataset: str = "dataset", name: str = "name") -> DataFrame:
    """File names for tape (dataset added) and after a restore (12 characters dropped)."""
    return files.withColumns({"tape_name": F.concat_ws("_", dataset, name),
                              "restored_name": F.expr(f"substring({name}, 13)")})


def alert_record(df: DataFrame) -> DataFrame:
    """Rows as JSON text for alerts."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("record"))
