"""Endpoint sets of catalogue locations, and the rules behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _held(replicas: DataFrame, status: str | None) -> DataFrame:
    """Catalogue locations: those that carry an endpoint set."""
    rows = replicas.filter(F.col("rse").isNotNull())
    return rows if status is None else rows.filter(F.col("status") == status)


def _array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _holds(rses: Sequence[str]) -> Column:
    return F.size(F.array_except(_array(rses), F.col("rse"))) == 0


def _report(rows: DataFrame) -> DataFrame:
    return rows.select("run_number", "pos", "status", "location", F.concat_ws(", ", "rse").alias("rse"))


def rse_report(replicas: DataFrame, status: str | None = None, run: int | None = None) -> DataFrame:
    rows = _held(replicas, status)
    return _report(rows if run is None else rows.filter(F.col("run_number") == run))


def rse_copies(replicas: DataFrame, n: int, status: str | None = None) -> DataFrame:
    """Locations held at exactly ``n`` endpoints."""
    return _report(_held(replicas, status).filter(F.size("rse") == n))


def rse_single(replicas: DataFrame, rses: Sequence[str], status: str | None = None) -> DataFrame:
    """Locations whose only endpoint is the requested one."""
    return _report(_held(replicas, status).filter((F.size("rse") == 1) & _holds(rses)))


def rse_multiple(replicas: DataFrame, rses: Sequence[str], status: str | None = None) -> DataFrame:
    """Locations held at all requested endpoints, not at a single one."""
    return _report(_held(replicas, status).filter((F.size("rse") != 1) & _holds(rses)))


def rse_remaining(replicas: DataFrame, delete: Sequence[str]) -> DataFrame:
    """Endpoints left after a delete, which happens only if all requested ones are held."""
    rows = _held(replicas, None)
    left = F.filter("rse", lambda x: ~x.isin(list(delete)))
    return rows.withColumn("applied", _holds(delete)).withColumn(
        "remaining", F.when(F.col("applied"), left).otherwise(F.col("rse")))


def rse_refresh(rule_status: DataFrame, rses: Sequence[str]) -> DataFrame:
    """Endpoint set per dataset from its OK rules, in ``rses`` order, with ``rse:expiry`` texts.

    The latest listed rule of an endpoint counts; a set is at most ``len(rses)`` long.
    """
    last = rule_status.filter(F.col("rse").isin(list(rses))).groupBy("did", "rse").agg(
        F.max_by(F.struct("status", "expires"), "seq").alias("_r"))
    per = last.groupBy("did").agg(*[
        F.max(F.when((F.col("rse") == r) & (F.col("_r.status") == "OK"), F.col("_r.expires"))).alias(f"_e{i}")
        for i, r in enumerate(rses)])
    keep = lambda make: F.array_compact(F.array(*[
        F.when(F.col(f"_e{i}").isNotNull(), make(r, F.col(f"_e{i}"))) for i, r in enumerate(rses)]))
    return per.select("did", keep(lambda r, e: F.lit(r)).alias("rse"),
                      keep(lambda r, e: F.concat(F.lit(r + ":"), e)).alias("rule_info"))


def choose_rse(rules: DataFrame, seed: str, key: str = "rule_id") -> DataFrame:
    """Replace ``random:a,b`` endpoints by one listed element, fixed by (key, seed).

    The chosen endpoint takes over the lifetime given for the random entry.
    """
    def pick(entry):
        options = F.split(F.regexp_replace(F.split(entry, ":")[1], " ", ""), ",")
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
        slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.size(options)
        return F.when(entry.contains("random"), F.element_at(options, (slot + 1).cast("int"))).otherwise(entry)

    entries = F.map_entries("destination_livetime")
    return rules.withColumn("destination_livetime", F.map_from_entries(F.transform(
        entries, lambda e: F.struct(pick(e["key"]).alias("key"), e["value"].alias("value"))))).withColumn(
        "destination_rse", F.transform("destination_rse", pick))


def rules_by_did(dids: DataFrame, rules: DataFrame) -> DataFrame:
    """Datasets or files with their rules at each endpoint, one row per rule (none: null rule)."""
    return dids.join(rules.select("did", "rse", "rule_id", "expires"), "did", "left")


def replica_paths(files: DataFrame, rse: str) -> DataFrame:
    """``name|checksum|path`` of every file of a dataset at an endpoint."""
    return files.filter(F.col("rse") == rse).select(
        "dataset", "name", F.concat_ws("|", "name", "checksum", "path").alias("entry"))
