"""A catalogue table that several writers change at once: a base in key ranges, changed rows beside it, merged when read.

A change stores the rows it touches and nothing else.  Each version is one entry that is created at most once, so of two
writers one comes first; the other one keeps its rows if they touch other runs, else derives them again from the new version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..journal import create_entry, entry_names, read_entry
from ..scale import BROADCAST_ROWS, broadcast_if_small, split_by_keys
from .mutate import KEY, Conflict, first_at, placed_locations, pulled_locations, set_location

PUT, DROP = "put", "drop"
COMPRESSION = "zstd"
#: From a snapshot to changed rows: those of ``put`` and ``drop``.
Change = Callable[[DataFrame], DataFrame]


def put(rows: DataFrame) -> DataFrame:
    """Rows that replace those of their key, or are new."""
    return rows.withColumn("_op", F.lit(PUT))


def drop(rows: DataFrame) -> DataFrame:
    """Keys whose rows go."""
    return rows.withColumn("_op", F.lit(DROP))


def push(new: DataFrame) -> Change:
    """M1 as a change; only the runs of ``new`` are looked at."""
    def change(table: DataFrame) -> DataFrame:
        theirs = table.join(broadcast_if_small(new.select("run_number").distinct()), "run_number", "left_semi")
        return put(placed_locations(theirs, new))

    return change


def set_fields(updates: Callable[[DataFrame], DataFrame], fields: Sequence[str], where: Column | None = None) -> Change:
    """M2 as a change; ``updates`` finds the keys and new values in the table.

    With ``where`` only rows that fulfil it can change, and no others are read.
    """
    def change(table: DataFrame) -> DataFrame:
        rows = table if where is None else table.filter(where)
        found = updates(rows)
        return put(set_location(rows.join(found.select(*KEY), list(KEY), "left_semi"), found, fields))

    return change


def pull(keys: Callable[[DataFrame], DataFrame]) -> Change:
    """M3 as a change."""
    return lambda table: drop(pulled_locations(table, keys(table)).select(*KEY))


def remove(host: str, paths: Callable[[DataFrame], DataFrame], status: str | None = None) -> Change:
    """M5 as a change."""
    return lambda table: drop(first_at(table, host, paths(table), status))


class ChangeLog:
    """The table at ``path``, with rows keyed by ``key``; two changes conflict where they touch the same first key column."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = KEY):
        self.spark, self.path, self.key = spark, path, list(key)

    # -- versions ---------------------------------------------------------------

    def version(self) -> int:
        names = entry_names(self.spark, f"{self.path}/versions")
        return int(names[-1]) if names else 0

    def state(self, version: int | None = None) -> dict:
        version = version or self.version()
        if not version:
            raise ValueError(f"no table at {self.path}")
        return read_entry(self.spark, f"{self.path}/versions", f"{version:012d}") | {"version": version}

    def _enter(self, version: int, state: dict) -> bool:
        entry = {k: v for k, v in state.items() if k != "version"}
        return create_entry(self.spark, f"{self.path}/versions", f"{version:012d}", entry)

    # -- base -------------------------------------------------------------------

    def create(self, rows: DataFrame, ranges: int = 64) -> None:
        """Store the first version, cut into ranges of the first key column of about equal size."""
        cuts = rows.approxQuantile(self.key[0], [i / ranges for i in range(1, ranges)], 0.001)
        state = {"schema": rows.schema.json(), "bounds": sorted(set(cuts)), "base": {}, "changes": [], "change": None}
        state["base"] = self._store(rows, state["bounds"])
        if not self._enter(1, state):
            raise Conflict(f"{self.path} has a table already")

    def _range(self, bounds: Sequence[float]) -> Column:
        """Number of a row's range; null keys are in the first one."""
        key = F.col(self.key[0])
        return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= key)) if bounds else F.lit(0)

    def _store(self, rows: DataFrame, bounds: Sequence[float], dealt: bool = False) -> dict[str, str]:
        """Write rows by range, a range with a hot key in several files; the folder of each range that has rows.

        ``dealt`` rows lie in few ranges a task already.
        """
        folder = f"{self.path}/base/{uuid.uuid4().hex}"
        dealt_rows = (rows if dealt else rows.repartitionByRange(*self.key)).withColumn("_range", self._range(bounds))
        dealt_rows.sortWithinPartitions("_range", *self.key).write.option("compression", COMPRESSION).partitionBy(
            "_range").parquet(folder)
        stored = self.spark.read.schema("_range int").parquet(folder)
        return {str(r[0]): f"{folder}/_range={r[0]}" for r in stored.distinct().collect()}  # at most one row per range

    # -- reading ----------------------------------------------------------------

    def _schema(self, state: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(state["schema"]))

    def _base(self, state: dict, ranges: Sequence[str] | None = None) -> DataFrame:
        folders = [f for n, f in state["base"].items() if ranges is None or n in ranges]
        reader = self.spark.read.schema(self._schema(state))
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self._schema(state))

    def _newest(self, state: dict) -> DataFrame:
        """The last change of each key."""
        schema = T.StructType([*self._schema(state).fields, T.StructField("_op", T.StringType())])
        order = F.create_map(*(F.lit(x) for n, c in enumerate(state["changes"]) for x in (c["folder"].rpartition("/")[2], n)))
        name = F.regexp_extract("_metadata.file_path", r"/changes/([0-9a-f]+)/", 1)
        rows = self.spark.read.schema(schema).parquet(*(c["folder"] for c in state["changes"]))
        fields = [F.col(f.name) for f in schema.fields if f.name not in self.key]
        return rows.withColumn("_seq", F.element_at(order, name)).groupBy(*self.key).agg(
            F.max_by(F.struct(*fields), "_seq").alias("_r")).select(*self.key, "_r.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the newest one by default."""
        return self._read(self.state(version))

    def _read(self, state: dict) -> DataFrame:
        return self._merged(state, self._base(state))

    def _merged(self, state: dict, base: DataFrame) -> DataFrame:
        if not state["changes"]:
            return base
        kept, doubtful = self._kept(state, base)
        put = self._newest(state).where(F.col("_op") == PUT).select(*base.columns)
        return (kept if doubtful is None else kept.unionByName(doubtful)).unionByName(put)

    def _kept(self, state: dict, base: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows of the base that no change touches: those that stay where they are, and those that were shuffled to be sure."""
        n = sum(c["rows"] for c in state["changes"])  # stored with each change, so no job is needed
        keys = self.spark.read.schema(self._schema(state)).parquet(*(c["folder"] for c in state["changes"])).select(*self.key)
        if n <= BROADCAST_ROWS:
            return base.join(F.broadcast(keys), self.key, "left_anti"), None
        clear, doubtful = split_by_keys(base, keys, self.key, n)
        return clear, doubtful.join(keys, self.key, "left_anti")

    def keys_since(self, version: int) -> DataFrame:
        """Keys that were changed after a version; only what those changes stored is read."""
        made = (self.state(v)["change"] for v in range(version + 1, self.version() + 1))
        folders = [c["folder"] for c in made if c]
        schema = T.StructType([f for f in self._schema(self.state()).fields if f.name in self.key])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders).select(*self.key).distinct()

    # -- writing ----------------------------------------------------------------

    def commit(self, change: Change, attempts: int = 8) -> int:
        """Apply a change to the newest version; returns the version made.  ``change`` runs again after a conflict."""
        for _ in range(attempts):
            state = self.state()
            own = self._write(state, change(self._read(state)))
            if own is None:
                return state["version"]
            seen = state["version"]
            while True:
                newest = self.state()
                if any(self._meet(own, self.state(v)["change"]) for v in range(seen + 1, newest["version"] + 1)):
                    break
                seen = newest["version"]
                if self._enter(seen + 1, newest | {"changes": [*newest["changes"], own], "change": own}):
                    return seen + 1
        raise Conflict(f"{attempts} changes of others touched the same rows")

    def _write(self, state: dict, rows: DataFrame) -> dict | None:
        """Store changed rows; None if there are none.  A key that occurs twice keeps one row, put before drop."""
        schema = self._schema(state)
        like = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_op", T.StringType())]))
        folder = f"{self.path}/changes/{uuid.uuid4().hex}"
        fields = [F.col(c) for c in like.columns if c not in self.key]
        once = like.unionByName(rows, allowMissingColumns=True).select(*like.columns).groupBy(*self.key).agg(
            F.max_by(F.struct(*fields), "_op").alias("_r")).select(*self.key, "_r.*").select(*like.columns)
        once.write.option("compression", COMPRESSION).parquet(folder)
        first = F.col(self.key[0])
        n, low, high = self.spark.read.schema(like.schema).parquet(folder).agg(F.count(F.lit(1)), F.min(first), F.max(first)).first()
        return {"folder": folder, "rows": n, "low": low, "high": high} if n else None

    def _meet(self, own: dict, other: dict | None) -> bool:
        """Do two changes touch the same first key?  Rows are read only where their ranges overlap."""
        if other is None or own["high"] < other["low"] or other["high"] < own["low"]:
            return False
        mine, theirs = (self.spark.read.parquet(c["folder"]).select(self.key[0]).distinct() for c in (own, other))
        return not mine.join(theirs, self.key[0], "left_semi").isEmpty()

    def compact(self) -> int:
        """Merge the changes into the ranges they touch; other ranges keep their files.  Returns the version made."""
        state = self.state()
        if not state["changes"]:
            return state["version"]
        touched = {str(r[0]) for r in self._newest(state).select(self._range(state["bounds"])).distinct().collect()}
        base = {n: f for n, f in state["base"].items() if n not in touched}
        kept, doubtful = self._kept(state, self._base(state, touched))
        moved = self._newest(state).where(F.col("_op") == PUT).select(*kept.columns)
        moved = (moved if doubtful is None else moved.unionByName(doubtful)).repartitionByRange(*self.key)
        base |= self._store(kept.unionByName(moved), state["bounds"], True)  # rows of the base lie in their ranges
        while True:
            newest = self.state()
            if newest["base"] != state["base"]:
                raise Conflict("another compaction came first")
            later = newest["changes"][len(state["changes"]):]
            if self._enter(newest["version"] + 1, newest | {"base": base, "changes": later, "change": None}):
                return newest["version"] + 1
