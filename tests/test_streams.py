import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from runledger import hooks
from runledger.streaming import jobs, state

SCHEMA = "event_id long, ts timestamp_ntz, replica_id long, status string"
T0 = dt.datetime(2024, 1, 1)


def event(i, minutes, replica, status):
    return (i, T0 + dt.timedelta(minutes=minutes), replica, status)


EVENTS = [
    event(1, 0, 1, "transferring"), event(2, 120, 1, "verifying"), event(3, 500, 1, "transferred"),
    event(4, 0, 2, "transferring"), event(5, 121, 2, "error"), event(6, 121 + 1441, 2, "transferring"),
    event(7, 1700, 3, "transferring"), event(8, 1800, 4, "verifying"), event(9, 1800, 5, "transferred"),
    event(10, 1810, 5, "verifying"), event(11, 4000, 6, "transferring"), event(12, 1600, 2, "transferring"),
]


@pytest.fixture
def source(spark, tmp_path):
    """Events in three files, in time order."""
    path = str(tmp_path / "events")
    for lo, hi in ((0, 600), (600, 1900), (1900, 9999)):
        part = [e for e in EVENTS if lo <= (e[1] - T0).total_seconds() / 60 < hi]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, source):
    return jobs.new_files(spark, source, SCHEMA, max_files=1)


@pytest.fixture
def shuffled(spark, tmp_path):
    """Events in four files whose times overlap, the newest ones first."""
    path = str(tmp_path / "shuffled")
    for n in range(4):
        spark.createDataFrame(EVENTS[::-1][n::4], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def summaries(spark, source, stream_of, max_files, **options):
    events = jobs.new_files(spark, source, SCHEMA, max_files=max_files)
    out = jobs.drain(stream_of(events, **options), jobs.append_to, "summaries")
    return spark.read.schema(state.SUMMARY_SCHEMA).parquet(out)


@pytest.mark.parametrize("max_files", [1, 3, None])
def test_stalls_do_not_depend_on_batches(spark, shuffled, rows, max_files):
    now = F.lit(int((T0 + dt.timedelta(minutes=4000)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    got = rows(state.stalled(summaries(spark, shuffled, state.stall_summaries, max_files, bucket_seconds=3600), now),
               "replica_id", "event_id", "level")
    batch = state.stall_alarms(spark.createDataFrame(EVENTS, SCHEMA), now, bucket_seconds=3600)
    assert got == rows(batch, "replica_id", "event_id", "level")
    assert got == [(2, 12, "alert"), (2, 12, "purge"), (2, 4, "alert"), (2, 5, "alert"), (2, 5, "purge"),
                   (3, 7, "alert"), (3, 7, "purge")]


@pytest.mark.parametrize("max_files", [1, None])
def test_transitions_do_not_depend_on_batches(spark, shuffled, rows, max_files):
    got = rows(state.illegal(summaries(spark, shuffled, state.transition_summaries, max_files)))
    assert got == rows(state.bad_transitions(spark.createDataFrame(EVENTS, SCHEMA), bucket_seconds=600))
    assert got == [(5, 10, "transferred", "verifying")]


def test_late_event_between_two_takes_an_alarm_back(spark, tmp_path, rows):
    """A status that arrives late, but lies between two others, ends the wait that they seemed to span."""
    path = str(tmp_path / "late")
    for e in (event(1, 0, 1, "transferring"), event(2, 125, 1, "verifying"), event(3, 118, 1, "error")):
        spark.createDataFrame([e], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    now = F.lit(0)
    assert rows(state.stalled(summaries(spark, path, state.stall_summaries, 1), now)) == []
    got = rows(state.illegal(summaries(spark, path, state.transition_summaries, 1)), "event_id", "prev_status")
    assert got == [(2, "error")]


def alarms_by_hand(events, delay_minutes):
    """Alarms about whatever waited long enough before the newest event less the delay."""
    out = []
    now = max(e[1] for e in events) - dt.timedelta(minutes=delay_minutes)
    for _, at, replica, status in events:
        event_id = next(e[0] for e in events if e[1:] == (at, replica, status))
        later = sorted((e[1], e[0]) for e in events if e[2] == replica and (e[1], e[0]) > (at, event_id))
        for level, hours in (("alert", 2), ("purge", 24)):
            due = at + dt.timedelta(hours=hours)
            if status not in ("transferred", "verifying") and due < now and (not later or later[0][0] > due):
                out.append((replica, event_id, level))
    return sorted(set(out), key=repr)


def drained(spark, source, max_files, delay, base):
    query = jobs.append_to(state.timed_alarms(jobs.new_files(spark, source, SCHEMA, max_files=max_files), delay),
                           str(base / "out"), str(base / "checkpoint"))
    query.awaitTermination()
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.read.schema(state.ALARM_SCHEMA).parquet(str(base / "out")), held


@pytest.mark.parametrize("max_files", [1, 2, None])
def test_timers_do_not_depend_on_batches(spark, source, rows, tmp_path, max_files):
    got, _ = drained(spark, source, max_files, "30 minutes", tmp_path)
    expected = alarms_by_hand(EVENTS, 30)
    assert rows(got, "replica_id", "event_id", "level") == expected
    assert (2, 12, "alert") in expected and (2, 5, "purge") in expected and not [r for r in expected if r[0] in (1, 6)]


def test_a_late_event_cancels_an_alarm_that_is_not_due(spark, rows, tmp_path):
    path = str(tmp_path / "events")
    files = [[event(1, 0, 1, "transferring"), event(2, 0, 2, "transferring")], [event(3, 180, 9, "verifying")],
             [event(4, 60, 1, "verifying")], [event(4, 60, 1, "verifying"), event(5, 3000, 9, "verifying")]]
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got, held = drained(spark, path, 1, "2 hours", tmp_path)
    assert rows(got, "replica_id", "event_id", "level") == [(2, 2, "alert"), (2, 2, "purge")]
    assert held <= 4  # of the replica with the newest event alone: its list, and its timer


def test_an_alarm_comes_when_time_passes_without_events(spark, rows, tmp_path):
    """No event of the replica follows: the timer alone raises the alarm, once per level, and not before its time."""
    path = str(tmp_path / "events")
    spark.createDataFrame([event(1, 0, 1, "transferring")], SCHEMA).coalesce(1).write.parquet(path)
    for minutes, expected in ((100, []), (120, []), (121, [(1, "alert")]), (700, [(1, "alert")]), (1500, [(1, "alert"), (1, "purge")])):
        spark.createDataFrame([event(minutes, minutes, 2, "verifying")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got, _ = drained(spark, path, 1, "0 seconds", tmp_path)
        assert rows(got, "event_id", "level") == expected


def test_three_days_of_passes(spark, rows, tmp_path):
    """The second pass finds what is new since the full one, the third one everything again."""
    runs = spark.createDataFrame([(n, T0 + dt.timedelta(hours=20 * n)) for n in range(4)], "number long, start timestamp_ntz")
    folder, day = str(tmp_path / "scans"), dt.timedelta(days=1)

    def at(hours):
        now = T0 + dt.timedelta(hours=hours)
        return jobs.scan(runs.filter(F.col("start") <= F.lit(now)), folder, now, day)

    first, second, third, fourth = at(10), at(33), at(34), at(50)
    assert [s.full for s in (first, second, third, fourth)] == [True, False, True, False]
    assert [rows(s.runs, "number") for s in (first, second, third, fourth)] == [[(0,)], [(1,)], [(0,), (1,)], [(2,)]]
    assert second.since == T0 + dt.timedelta(hours=10) and fourth.since == T0 + dt.timedelta(hours=34)


def test_a_pass_that_dies_leaves_the_mark(spark, rows, tmp_path, monkeypatch):
    runs = spark.createDataFrame([(1, T0)], "number long, start timestamp_ntz")
    folder = str(tmp_path / "scans")

    def dies(*args):
        raise RuntimeError

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "create_entry", dies)
        with pytest.raises(RuntimeError):
            jobs.scan(runs, folder, T0)
    again = jobs.scan(runs, folder, T0 + dt.timedelta(minutes=1))
    assert (again.number, again.full, rows(again.runs, "number")) == (1, True, [(1,)])
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "entry_names", lambda *a: [])
        with pytest.raises(jobs.Conflict):
            jobs.scan(runs, folder, T0)


def test_folded_summaries(spark, shuffled, rows, tmp_path):
    """A fold stores what is new, a second one of the same rows nothing, and only touched buckets are derived again."""
    now = F.lit(0)
    found = summaries(spark, shuffled, state.transition_summaries, 1, bucket_seconds=3600)
    log = state.summary_log(spark, str(tmp_path / "log"))
    assert state.fold(log, found.filter("replica_id < 3")) == 2
    assert rows(log.keys_since(2)) == [] and log.keys_since(1).filter("replica_id > 2").isEmpty()
    assert state.fold(log, found) == 3 and state.fold(log, found) == 3
    assert log.keys_since(2).filter("replica_id < 3").isEmpty()
    assert log.state()["change"]["rows"] == found.filter("replica_id > 2").select("replica_id", "bucket").distinct().count()
    again = state.changed_neighbours(log, 2)
    assert again.filter("replica_id < 3").isEmpty()
    assert rows(state.illegal(log.read())) == rows(state.illegal(found)) == [(5, 10, "transferred", "verifying")]
    assert rows(state.stalled(log.read(), now)) == rows(state.stalled(found, now))
    log.compact()
    assert rows(state.illegal(log.read())) == rows(state.illegal(found))
    whole = state.changed_neighbours(log, 1).drop("bucket")
    assert rows(whole) == rows(state._neighbours(found))


def test_stream_folds_each_batch(spark, shuffled, rows, tmp_path):
    events = jobs.new_files(spark, shuffled, SCHEMA, max_files=2)
    state.fold_to(state.stall_summaries(events, bucket_seconds=3600), str(tmp_path / "log"), str(tmp_path / "mark"),
                  compact_every=2).awaitTermination()
    log = state.summary_log(spark, str(tmp_path / "log"))
    now = F.lit(int((T0 + dt.timedelta(minutes=4000)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    batch = state.stall_alarms(spark.createDataFrame(EVENTS, SCHEMA), now, bucket_seconds=3600)
    assert rows(state.stalled(log.read(), now), "replica_id", "event_id", "level") == rows(batch, "replica_id", "event_id", "level")
    assert log.state()["changes"] == []


def test_retention_frees_old_buckets_and_keeps_their_results(spark, source, rows):
    kept = summaries(spark, source, state.transition_summaries, 1, bucket_seconds=3600, retention="10 minutes")
    assert rows(state.illegal(kept)) == [(5, 10, "transferred", "verifying")]


def test_state_and_series_over_several_batches(spark, source, rows):
    out = jobs.drain(jobs.current_state(stream(spark, source)), jobs.upsert_to, "state")
    latest = jobs.latest_rows(spark, out, ["replica_id"])
    assert rows(latest) == rows(jobs.current_state(spark.createDataFrame(EVENTS, SCHEMA)))
    logs = stream(spark, source).select(
        F.col("ts").cast("timestamp").alias("upload_time"), F.lit(1.5).alias("tr_amount_up"), F.lit(2.0).alias("tr_rate_up"),
        F.lit(3).alias("total_time"))
    out = jobs.drain(jobs.transfer_series(logs, "1 hour", "1 day"), jobs.upsert_to, "series")
    series = jobs.latest_rows(spark, out, ["window_start", "window_end"])
    assert series.agg(F.sum("n_transfers"), F.sum("gb_up")).first() == (12, 18.0)


def test_checkpoint_resumes(spark, source, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    rows_of = lambda: jobs.new_files(spark, source, SCHEMA).withColumnRenamed("ts", "start")
    since = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    for _ in range(2):
        jobs.append_to(jobs.new_runs(rows_of(), since), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == sum(e[1] > T0 + dt.timedelta(hours=1) for e in EVENTS)
    spark.createDataFrame([event(99, 9000, 9, "error")], SCHEMA).write.mode("append").parquet(source)
    jobs.append_to(jobs.new_runs(rows_of(), since), out, mark).awaitTermination()
    assert spark.read.parquet(out).filter("event_id = 99").count() == 1


def test_hooks(spark, rows):
    runs = spark.sql("SELECT id AS number, array(struct('h' AS host), struct('g' AS host)) AS data FROM range(3)")
    count = lambda b: pd.DataFrame({"n": b["data"].map(len)})
    assert rows(hooks.per_run(runs, count, "n long")) == [(2,)] * 3
    total = hooks.per_run(runs, count, "n long", lambda out: out.agg(F.sum("n").alias("n")))
    assert rows(total) == [(6,)]
    assert hooks.per_location(runs, lambda df: df.filter("number = 1")).count() == 1


def test_pass_order_and_subset(spark):
    add = lambda n: lambda t: {"x": t["x"].withColumn(n, F.lit(len(t["x"].columns)))}
    both = hooks.Pass([("a", add("a")), ("b", add("b"))], durable=["x"])
    start = {"x": spark.range(1)}
    assert both.run(start)["x"].first().asDict() == {"id": 0, "a": 1, "b": 2}
    assert both.run(start, only=["b"])["x"].columns == ["id", "b"]
    assert start["x"].columns == ["id"]
    with pytest.raises(KeyError):
        both.run(start, only=["c"])


def test_scratch_follows_the_checkpoint_folder(spark, monkeypatch):
    from runledger.scale import scratch_dir

    class Conf:
        def get(self, key, default):
            return "/shared/folder" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert scratch_dir(Session(), "x").startswith("/shared/folder/x-")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_a_replica_has_one_timer(spark):
    """Not one per event and level: a call for each timer is what a batch of a busy replica costs."""
    class Held(list):
        get = list.__iter__

        def put(self, events):
            self[:] = events

    class Handle:
        timers, events = [], Held()

        def getListState(self, *_):
            return self.events

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    processor, handle = state._TimerProcessor(), Handle()
    processor.init(handle)
    hours = [Row(ms=3 * n * state.HOUR_MS, event_id=n, status="transferring") for n in range(1, 9)]
    for batch in (hours[4:], hours[:4]):  # the older events come last
        list(processor.handleInputRows((7,), iter(batch), At(0)))
        assert len(handle.timers) == 1
    now = 28 * state.HOUR_MS
    fired = list(processor.handleExpiredTimer((7,), At(now), At(handle.timers.pop())))
    assert [(a.event_id, a.level) for a in fired] == [(n, "alert") for n in range(1, 9)]
    assert len(handle.timers) == 1 and handle.timers[0] > now


def test_a_key_of_state_holds_many_replicas(spark, rows, tmp_path):
    """Not a key per replica and a row per event: calls for each key are what a batch of many replicas costs."""
    path, n = str(tmp_path / "events"), 200
    events = [event(2 * k + i, 10 * (i + k % 3), k or None, status)
              for k in range(n) for i, status in enumerate(("transferring", "error" if k % 2 else "transferred"))]
    events += events[10:20]  # rows that come twice, the second time in a later batch
    for part in (events[::2], events[1::2]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    expected = rows(state.bad_transitions(spark.createDataFrame(events, SCHEMA)))
    assert len(expected) == n // 2
    for shards in (1, 4):
        stream = state.transition_summaries(jobs.new_files(spark, path, SCHEMA, max_files=1), shards=shards)
        out = str(tmp_path / f"out{shards}")
        query = jobs.append_to(stream, out, str(tmp_path / f"mark{shards}"))
        query.awaitTermination()
        found = spark.read.schema(state.SUMMARY_SCHEMA).parquet(out)
        assert rows(state.illegal(found)) == expected
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * shards
        assert found.groupBy("replica_id").agg(F.max("seen").alias("n")).agg(F.sum("n")).first()[0] == len(events)


def test_a_large_batch_is_held_in_several_rows(monkeypatch):
    class Held(list):
        get, appendList = list.__iter__, list.extend

    class Handle:
        def __init__(self):
            self.events = Held()

        def getListState(self, *_):
            return self.events

    monkeypatch.setattr(state, "HELD_ROWS", 3)
    processor, handle = state._BucketProcessor(state._may_be_illegal, 1000, False), Handle()
    processor.init(handle)
    events = [(0, 0, replica, 10 * i, i, "error") for i in range(4) for replica in (1, 2, None) if replica or i < 2]
    for batch in (events[::2], events[1::2]):
        made = {r.replica_id: r for r in processor.handleInputRows((0, 0), iter(batch), None)}
    assert [len(stored[0]) for stored in handle.events] == [3, 2, 3, 2]
    assert {r: (s.seen, s.first_ms, s.last_ms) for r, s in made.items()} == {1: (4, 0, 30), 2: (4, 0, 30), None: (2, 0, 10)}


def test_shards_follow_the_fullest_bucket(spark):
    at = "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, if(id < 2000, 0, id))"
    events = spark.range(2010).selectExpr("id AS event_id", f"{at} AS ts")  # ten rows are weeks away
    assert state.shards_for(events) == 4 and state.shards_for(events.unionAll(events)) == 8
    assert state.shards_for(events.filter("false")) == 1
    assert state.shards_for(events.selectExpr("event_id", "CAST(null AS timestamp_ntz) AS ts")) == 1
