"""Structured Streaming jobs over run and replica-status events.

The aggregations are ordinary DataFrame functions: each works on a batch and on a stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..journal import create_entry, entry_names, read_entry, read_table, table_entry
from ..operators.mutate import Conflict
from ..scale import scratch_dir

ONCE = {"availableNow": True}
DAEMON = {"processingTime": "60 seconds"}


def new_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
              max_files: int | None = None) -> DataFrame:
    """Stream of the rows in files not seen before; ``path`` is a directory or a glob.

    ``max_files`` bounds a micro-batch, and with it what keyed state receives of one key.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def new_runs(runs: DataFrame, since: Column | None = None) -> DataFrame:
    """Incremental scan: only runs started after ``since`` (none: a full pass)."""
    return runs if since is None else runs.filter(F.col("start") > since)


@dataclass(frozen=True)
class Scan:
    """One pass of the daemon: its number, whether it was a full one, from when it looked, and the runs that it found."""

    number: int
    full: bool
    since: datetime | None
    runs: DataFrame


def scan(runs: DataFrame, folder: str, now: datetime, period: timedelta = timedelta(days=1)) -> Scan:
    """One pass over the catalogue: all runs if the last full pass is a ``period`` ago or more, else those begun since it.

    The runs are stored under ``folder`` first; then one entry commits them together with the mark, the time of the last
    full pass.  A pass that dies before that leaves the old mark, so the next one looks at the same runs again.  Of two
    passes at once one commits and the other one raises ``Conflict``.
    """
    spark = runs.sparkSession
    marks = f"{folder}/marks"
    done = entry_names(spark, marks)
    last = read_entry(spark, marks, done[-1])["full_at"] if done else None
    full_at = datetime.fromisoformat(last) if last else None
    full = full_at is None or now - full_at >= period
    found = new_runs(runs, None if full else F.lit(full_at).cast(runs.schema["start"].dataType))
    path = f"{folder}/runs/{uuid.uuid4().hex}"
    found.write.parquet(path)
    number = len(done) + 1
    entry = {"full": full, "full_at": (now if full else full_at).isoformat(), "at": now.isoformat(), "runs": table_entry(found, path)}
    if not create_entry(spark, marks, f"{number:012d}", entry):
        raise Conflict("another pass was committed first")
    return Scan(number, full, None if full else full_at, read_table(spark, entry["runs"]))


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream to Parquet, exactly once."""
    return (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ONCE)).start(path))


def upsert_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write the changed rows of an aggregation, one directory per batch; a replayed batch replaces its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part-{batch_id:09d}")

    return (stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ONCE)).start())


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key written by ``upsert_to``."""
    rows = spark.read.parquet(f"{path}/part-*")
    fields = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch_id").alias("_r")).select(*keys, "_r.*")


def drain(stream: DataFrame, start: Callable, label: str) -> str:
    """Run a stream over everything available, in a fresh scratch directory; returns the output path."""
    base = scratch_dir(stream.sparkSession, label)
    start(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out"


def current_state(events: DataFrame) -> DataFrame:
    """Latest status of every replica."""
    return events.groupBy("replica_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"),
        F.count(F.lit(1)).alias("n_events"))


def transfer_series(summaries: DataFrame, width: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Transfer volume, rate and time per tumbling window of the upload time."""
    rows = summaries if watermark is None else summaries.withWatermark("upload_time", watermark)
    return rows.groupBy(F.window("upload_time", width).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_transfers"), F.sum("tr_amount_up").alias("gb_up"),
        F.avg("tr_rate_up").alias("rate_up"), F.sum("total_time").alias("seconds"),
    ).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n_transfers", "gb_up",
             "rate_up", "seconds")
