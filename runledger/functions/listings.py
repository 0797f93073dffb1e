"""Rule, replica, file and endpoint listings: one output row per listing line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ENDPOINT_MARK, NOT_AVAILABLE, VALID
from .logs import _last, after_colon, first_mark


def parse_rules(lines: DataFrame, location: str = "did") -> DataFrame:
    """Rule lines that name the listed location: id, account, status, endpoint, copies, expiry."""
    tokens = F.filter(F.split("line", " "), lambda t: t != "")
    rows = lines.filter(F.contains(F.col("line"), F.col(location))).withColumn("_t", tokens).filter(F.size("_t") >= 5)
    t = lambda i: F.get("_t", F.lit(i))
    return rows.select(
        location, "line_no", t(0).alias("rule_id"), t(1).alias("account"), t(3).alias("status"), t(4).alias("rse"),
        t(5).alias("copies"),
        F.when(F.size("_t") > 6, F.concat_ws("_", t(6), t(7))).otherwise(VALID).alias("expires"))


def rule_summary(rules: DataFrame, wanted: DataFrame, location: str = "did") -> DataFrame:
    """First rule per (location, endpoint) asked for; ``n/a`` fields where there is none."""
    first = rules.groupBy(location, "rse").agg(
        F.min_by(F.struct("rule_id", "account", "status", "copies", "expires"), "line_no").alias("_r"))
    out = wanted.join(first, [location, "rse"], "left")
    fields = [F.coalesce(F.col(f"_r.{c}"), F.lit(VALID if c == "expires" else NOT_AVAILABLE)).alias(c)
              for c in ("rule_id", "account", "status", "copies", "expires")]
    return out.select(location, "rse", *fields)


def _cell(i: int) -> Column:
    return F.translate(F.get("_c", F.lit(i)), " ", "")


def parse_replicas(lines: DataFrame) -> DataFrame:
    """Replica lines ``|scope|name|size|checksum|endpoint: path|``; borders and other lines are skipped."""
    rows = lines.filter(F.col("line").startswith("|")).withColumn("_c", F.split("line", r"\|"))
    where = F.split(F.get("_c", F.lit(5)), ":", 2)
    rows = rows.withColumn("_w", where).filter(F.size("_w") == 2)
    return rows.select(
        "file", _cell(1).alias("scope"), _cell(2).alias("name"), _cell(3).alias("size"), _cell(4).alias("checksum"),
        F.translate(F.col("_w")[0], " ", "").alias("rse"), F.translate(F.col("_w")[1], " ", "").alias("path"))


def parse_files(lines: DataFrame) -> DataFrame:
    """File lines ``|scope:name|guid|kind:checksum|size|events|``."""
    line = F.col("line")
    border = line.contains("-----------------------------") | line.contains("SCOPE:NAME") | ~line.contains("|")
    rows = lines.filter(~border).withColumn("_c", F.split(line, r"\|"))
    tail = lambda c: F.get(F.split(c, ":"), F.lit(1))
    return rows.select("file", tail(_cell(1)).alias("name"), _cell(2).alias("guid"), tail(_cell(3)).alias("checksum"),
                       _cell(4).alias("size"), _cell(5).alias("events"))


def parse_usage(lines: DataFrame) -> DataFrame:
    """Endpoint usage: used, rse, updated_at (``date_HHMMSS``), source; ``n/a`` where absent.

    A line saying that the endpoint does not exist ends the reading.
    """
    marks = ["[RSE does not exist", "used:", "rse:", "updated_at:", "source:"]
    names = ["_stop", "used", "rse", "updated_at", "source"]
    bare = lambda n: F.translate(after_colon(F.col("line"), n), " ", "")
    stamp = F.concat(bare(1), F.lit("_"), bare(2), bare(3), bare(4))
    rows = lines.select("file", "line_no", first_mark(F.col("line"), marks).alias("_m"), bare(1).alias("text"),
                        stamp.alias("stamp"))
    at = lambda i: F.when(F.col("_m") == i, F.col("line_no"))
    out = rows.groupBy("file").agg(F.min(at(0)).alias("_stop"), *[
        agg for i, k in enumerate(names) if i
        for agg in (F.max_by("stamp" if k == "updated_at" else "text", at(i)).alias(k), F.max(at(i)).alias(f"_at_{k}"))])
    known = lambda k: F.col("_stop").isNull() | (F.col(f"_at_{k}") < F.col("_stop"))
    return out.select("file", *[F.coalesce(F.when(known(k), F.col(k)), F.lit(NOT_AVAILABLE)).alias(k) for k in names[1:]])


def parse_rses(lines: DataFrame) -> DataFrame:
    """Registered endpoints of an endpoint listing."""
    return lines.filter(F.col("line").contains(ENDPOINT_MARK)).select("file", F.col("line").alias("rse"))


def parse_checksum(lines: DataFrame) -> DataFrame:
    """Checksum of a metadata listing: its last adler32 line, without the blank after the colon."""
    value = F.expr("substring(split(line, ':')[1], 2)")
    return lines.filter(F.col("line").contains("adler32")).groupBy("file").agg(
        _last(value, F.lit(True)).alias("checksum"))
