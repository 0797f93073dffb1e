"""Order-dependent checks on replica status: stall alarms and illegal transitions.

Each check has a batch form and a stream form.  Both split a replica's history by time
buckets: rows are ordered inside a bucket, and one row per bucket meets its neighbour.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import (ERROR, FAILED, STALL_ALERT_HOURS, STALL_PURGE_HOURS, TRANSFERRED, TRANSFERRING, VERIFYING)
from ..operators.changes import ChangeLog, put
from ..scale import broadcast_if_small, previous_in_key

# States that may follow a state; repeating a state is not a transition.
LEGAL = {
    TRANSFERRING: (VERIFYING, ERROR),
    VERIFYING: (TRANSFERRED, ERROR, FAILED),
    TRANSFERRED: (TRANSFERRING,),
    ERROR: (TRANSFERRING,),
    FAILED: (TRANSFERRING,),
}
FINISHED = (TRANSFERRED, VERIFYING)
HOUR_MS = 3_600_000
LEVELS = (("alert", STALL_ALERT_HOURS * HOUR_MS), ("purge", STALL_PURGE_HOURS * HOUR_MS))
BUCKET_SECONDS = 86_400
STREAM_BUCKET_SECONDS = 7 * 86_400
#: Into how many shards streams deal replicas, unless told; and how many events a key (shard, bucket) should have.
SHARDS, KEY_EVENTS = 4096, 500
#: Events in a row of state at most.
HELD_ROWS = 10_000

EVENT = {"event_id": "long", "ms": "long", "status": "string"}
#: Summary of a bucket: its first and last event, and neighbours (before, after) of interest inside it.
SUMMARY_SCHEMA = ", ".join(
    ["replica_id long", "bucket long", "seen long"]
    + [f"{side}_{name} {kind}" for side in ("first", "last") for name, kind in EVENT.items()]
    + [f"{side}_{name} array<{kind}>" for side in ("before", "after") for name, kind in EVENT.items()])

HELD_SCHEMA = "replica_id array<long>, ms array<long>, event_id array<long>, status array<string>"


def _millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


# -- batch ------------------------------------------------------------------

def legal(before: Column, after: Column) -> Column:
    ok = before == after
    for state, following in LEGAL.items():
        ok = ok | ((before == state) & after.isin(*following))
    return ok


def bad_transitions(events: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Status changes that the vocabulary does not allow."""
    bucket = F.floor(_millis("ts") / (bucket_seconds * 1000))
    rows = previous_in_key(events, "replica_id", ["ts", "event_id"], bucket, ["status"])
    bad = F.col("prev_status").isNotNull() & ~legal(F.col("prev_status"), F.col("status"))
    return rows.filter(bad).select("replica_id", "event_id", "prev_status", "status")


def stall_alarms(events: DataFrame, now_ms: Column, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Unfinished states without another event for 2 h (alert) or 24 h (purge), as of ``now_ms``."""
    back = events.select("replica_id", "event_id", "status", _millis("ts").alias("since_ms"),
                         (-_millis("ts")).alias("_t"), (-F.col("event_id")).alias("_e"))
    rows = previous_in_key(back, "replica_id", ["_t", "_e"], F.floor(F.col("_t") / (bucket_seconds * 1000)), ["since_ms"])
    return _alarms(rows, F.coalesce("prev_since_ms", now_ms) - F.col("since_ms"))


def _alarms(rows: DataFrame, idle: Column) -> DataFrame:
    open_ = rows.filter(~F.col("status").isin(*FINISHED)).withColumn("_idle", idle)
    level = F.array_compact(F.array(*[F.when(F.col("_idle") > limit, name) for name, limit in LEVELS]))
    return open_.select("replica_id", "event_id", "since_ms", "status", F.explode(level).alias("level"))


# -- stream -----------------------------------------------------------------

Event = tuple[int, int, str]  # ms, event_id, status


def _may_stall(before: Event, after: Event) -> bool:
    return before[2] not in FINISHED and after[0] - before[0] > LEVELS[0][1]


def _may_be_illegal(before: Event, after: Event) -> bool:
    return before[2] != after[2] and after[2] not in LEGAL.get(before[2], ())


class _BucketProcessor(StatefulProcessor):
    """Events of the replicas of one shard in one time bucket; a change emits new summaries of the replicas that it touches.

    A call for a key costs as much as a hundred events, so a key has many replicas.  State is a row of arrays per batch, not
    a row per event.  ``seen`` counts the events, so the summary with the largest count is the newest.
    """

    def __init__(self, of_interest: Callable[[Event, Event], bool], bucket_ms: int, closes: bool):
        self.of_interest, self.bucket_ms, self.closes = of_interest, bucket_ms, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", HELD_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int | None, list[Event]] = defaultdict(list)
        for _, _, replica, ms, event_id, status, *_ in rows:  # by position: names are looked up row by row
            new[replica].append((ms, event_id, status))
        held: dict[int | None, list[Event]] = defaultdict(list)
        first = True
        for stored in self.events.get():
            first = False
            for replica, *event in zip(*stored):
                if replica in new:
                    held[replica].append(tuple(event))
        if self.closes and first:
            self.handle.registerTimer((int(key[1]) + 1) * self.bucket_ms)
        for events in new.values():
            events.sort()
        fresh = [(replica, *e) for replica, events in new.items() for e in events]
        self.events.appendList([tuple(map(list, zip(*fresh[i:i + HELD_ROWS]))) for i in range(0, len(fresh), HELD_ROWS)])
        for replica, events in new.items():
            yield self._summary(replica, key[1], sorted([*held[replica], *events], key=lambda e: e[:2]))

    def _summary(self, replica: int | None, bucket: int, events: list[Event]) -> Row:
        pairs = [p for p in zip(events, events[1:]) if self.of_interest(*p)]
        row = {"replica_id": replica, "bucket": bucket, "seen": len(events)}
        for side, (ms, event_id, status) in (("first", events[0]), ("last", events[-1])):
            row |= {f"{side}_event_id": event_id, f"{side}_ms": ms, f"{side}_status": status}
        for n, side in enumerate(("before", "after")):
            row |= {f"{side}_event_id": [p[n][1] for p in pairs], f"{side}_ms": [p[n][0] for p in pairs],
                    f"{side}_status": [p[n][2] for p in pairs]}
        return Row(**row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.events.clear()
        return iter(())

    def close(self) -> None:
        pass


def shards_for(events: DataFrame, bucket_seconds: int = STREAM_BUCKET_SECONDS) -> int:
    """How many shards give keys of the fullest bucket about ``KEY_EVENTS`` of ``events``, all that a stream will hold."""
    bucket = F.floor(_millis("ts") / (bucket_seconds * 1000))
    fullest = events.filter(F.col("ts").isNotNull()).groupBy(bucket).count().agg(F.max("count")).first()[0]
    return max(1, -(-(fullest or 0) // KEY_EVENTS))


def _summaries(events: DataFrame, of_interest: Callable, bucket_seconds: int, retention: str | None,
               shards: int) -> DataFrame:
    """Stream of bucket summaries, in any order of arrival; a row without a time is left out.

    Without ``retention`` no row is ever late, and state holds the whole history.  With it, rows that lag behind the
    newest by more are dropped, and the state of buckets that end before that is freed.  A batch reads again what the
    shards that it touches hold in its buckets.  ``shards`` cannot change under a checkpoint.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts").isNotNull())
    if retention is not None:
        rows = rows.withWatermark("ts", retention)
    ms, shard = F.unix_millis("ts"), F.pmod(F.xxhash64("replica_id"), F.lit(shards))
    keyed = rows.select(shard.alias("shard"), F.floor(ms / (bucket_seconds * 1000)).alias("bucket"), "replica_id",
                        ms.alias("ms"), "event_id", "status", *(["ts"] if retention is not None else []))
    return keyed.groupBy("shard", "bucket").transformWithState(
        _BucketProcessor(of_interest, bucket_seconds * 1000, retention is not None), SUMMARY_SCHEMA, "Append",
        "None" if retention is None else "EventTime")


def stall_summaries(events: DataFrame, bucket_seconds: int = STREAM_BUCKET_SECONDS, retention: str | None = None,
                    shards: int = SHARDS) -> DataFrame:
    """Stream that ``stalled`` reads.  Needs a state store with column families (RocksDB)."""
    return _summaries(events, _may_stall, bucket_seconds, retention, shards)


def transition_summaries(events: DataFrame, bucket_seconds: int = STREAM_BUCKET_SECONDS, retention: str | None = None,
                         shards: int = SHARDS) -> DataFrame:
    """Stream that ``illegal`` reads.  Needs a state store with column families (RocksDB)."""
    return _summaries(events, _may_be_illegal, bucket_seconds, retention, shards)


Pending = tuple[int, int, str, int]  # ms, event_id, status, levels decided
ALARM_SCHEMA = "replica_id long, event_id long, since_ms long, status string, level string"


class _TimerProcessor(StatefulProcessor):
    """Events of one replica for as long as an alarm about them, or about the one before, is open.

    A replica has one timer, for the first of its events that is due.  When that goes off, all events that are due by then
    are decided and the timer is set again, so a batch costs a replica a timer and not an event one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "ms long, event_id long, status string, decided int")

    def _idle(self, events: list[Pending], i: int) -> float:
        """Time from an event to the next one; without end if there is none yet."""
        return events[i + 1][0] - events[i][0] if i + 1 < len(events) else float("inf")

    def _due(self, events: list[Pending]) -> int | None:
        """When the next level of an event can be decided."""
        return min((ms + LEVELS[decided][1] + 1 for ms, _, _, decided in events), default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(e) for e in self.events.get()]
        known = {e[:2] for e in held}
        new = {(r.ms, r.event_id, r.status, 0) for r in rows if (r.ms, r.event_id) not in known}
        if not new:
            return iter(())
        events = sorted([*held, *new])
        self.events.put(events)
        before, due = self._due(held), self._due(events)
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        events = [tuple(e) for e in self.events.get()]
        alarms, left = [], []
        for i, (ms, event_id, status, decided) in enumerate(events):
            while decided < len(LEVELS) and ms + LEVELS[decided][1] < now:
                level, limit = LEVELS[decided]
                if status not in FINISHED and self._idle(events, i) > limit:
                    alarms.append(Row(replica_id=key[0], event_id=event_id, since_ms=ms, status=status, level=level))
                decided += 1
            if decided < len(LEVELS):
                left.append((ms, event_id, status, decided))
        if left:
            self.events.put(left)
            self.handle.registerTimer(self._due(left))
        else:
            self.events.clear()
        return iter(alarms)

    def close(self) -> None:
        pass


def timed_alarms(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream of stall alarms, raised by timers as soon as event time has passed 2 h or 24 h without another event.

    Event time is the newest event's less ``delay``.  Events that lag behind by less may come in any order and cancel
    alarms that are not due yet; later ones are dropped, as are rows without a time.  State holds a replica's events of
    the last 24 h of event time.  Needs a state store with column families (RocksDB).
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts").isNotNull()).withWatermark("ts", delay)
    keyed = rows.select("replica_id", "event_id", "ts", F.unix_millis("ts").alias("ms"), "status")
    return keyed.groupBy("replica_id").transformWithState(_TimerProcessor(), ALARM_SCHEMA, "Append", "EventTime")


def _neighbours(summaries: DataFrame) -> DataFrame:
    """(replica_id, before, after) of interest inside buckets and all across them; the last event has no ``after``."""
    key = ("replica_id", "bucket")
    fields = F.struct(*[c for c in summaries.columns if c not in key])
    newest = summaries.groupBy(*key).agg(F.max_by(fields, "seen").alias("_s")).select(*key, "_s.*")

    following = F.lead(_side("first")).over(Window.partitionBy("replica_id").orderBy("bucket"))
    return _pairs(newest, newest.withColumn("_next", following), ("replica_id",))


def _side(name: str, row: str = "") -> Column:
    return F.struct(*[F.col(f"{row}{name}_{f}").alias(f) for f in EVENT])


def _pairs(inside: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, before, after): the pairs of interest in summaries, and each summary's last event with the ``_next`` one."""
    both = F.arrays_zip(*[f"{s}_{f}" for s in ("before", "after") for f in EVENT])
    within = inside.select(*key, F.explode(both).alias("_p")).select(
        *key, _side("before", "_p.").alias("before"), _side("after", "_p.").alias("after"))
    return within.unionByName(edges.select(*key, _side("last").alias("before"), F.col("_next").alias("after")))


# -- summaries folded into a table ------------------------------------------

BUCKET_KEY = ("replica_id", "bucket")


def summary_log(spark: SparkSession, path: str) -> ChangeLog:
    """The newest summary of each bucket at ``path``; the table is made if there is none."""
    log = ChangeLog(spark, path, BUCKET_KEY)
    if not log.version():
        log.create(spark.createDataFrame([], SUMMARY_SCHEMA))
    return log


def fold(log: ChangeLog, summaries: DataFrame) -> int:
    """Put summaries that are newer than the stored ones of their buckets; returns the version.

    The size of a change is that of ``summaries``, and summaries that were folded before change nothing.
    """
    fields = F.struct(*[c for c in summaries.columns if c not in BUCKET_KEY])
    newest = summaries.groupBy(*BUCKET_KEY).agg(F.max_by(fields, "seen").alias("_s")).select(*BUCKET_KEY, "_s.*")

    def change(table: DataFrame) -> DataFrame:
        stored = table.select(*BUCKET_KEY, F.col("seen").alias("_seen"))
        rows = newest.join(stored, list(BUCKET_KEY), "left")
        return put(rows.filter(F.col("_seen").isNull() | (F.col("seen") > F.col("_seen"))).drop("_seen"))

    return log.commit(change)


def fold_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact_every: int = 20):
    """Fold a stream of summaries into ``summary_log``; a replayed batch changes nothing."""
    log = summary_log(stream.sparkSession, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        fold(log, batch)
        if batch_id % compact_every == compact_every - 1:
            log.compact()

    return (stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def changed_neighbours(log: ChangeLog, since: int) -> DataFrame:
    """The rows of ``_neighbours``, with ``bucket``, that may have changed after a version of the log.

    These are the pairs inside touched buckets, and the pairs across between a touched bucket and the ones beside it.
    Only replicas with touched buckets are looked at; a replica has one row per bucket there.
    """
    touched = log.keys_since(since).withColumn("_touched", F.lit(True))
    rows = log.read().join(broadcast_if_small(touched.select("replica_id").distinct()), "replica_id", "left_semi")
    rows = rows.join(touched, list(BUCKET_KEY), "left")
    order = Window.partitionBy("replica_id").orderBy("bucket")
    rows = rows.withColumns({"_next": F.lead(_side("first")).over(order), "_next_touched": F.lead("_touched").over(order)})
    return _pairs(rows.filter("_touched"), rows.filter("_touched OR _next_touched"), ("replica_id", "bucket"))


def stalled(summaries: DataFrame, now_ms: Column) -> DataFrame:
    """Alarms as of ``now_ms`` from stored ``stall_summaries``: the rows of ``stall_alarms`` over the same events."""
    rows = _neighbours(summaries).select(
        "replica_id", "before.event_id", F.col("before.ms").alias("since_ms"), "before.status", "after.ms")
    return _alarms(rows, F.coalesce("ms", now_ms) - F.col("since_ms"))


def illegal(summaries: DataFrame) -> DataFrame:
    """Illegal changes from stored ``transition_summaries``: the rows of ``bad_transitions`` over the same events."""
    rows = _neighbours(summaries).select(
        "replica_id", "after.event_id", F.col("before.status").alias("prev_status"), "after.status")
    return rows.filter(F.col("prev_status").isNotNull() & ~legal(F.col("prev_status"), F.col("status")))
