"""The change log: merging, conflicts between writers, compaction."""

import threading

import pytest
from pyspark.sql import functions as F
from test_joins import replicas

from runledger import scale
from runledger.operators import changes, mutate

COLUMNS = ("run_number", "pos", "host", "status")


@pytest.fixture
def reps(spark):
    return replicas(spark, *((run, pos, "hs"[pos % 2], "raw", None, "verifying" if pos == 1 else "transferred", f"c{pos}", True)
                             for run in range(1, 9) for pos in range(3)))


def log_of(spark, tmp_path, rows, **limits):
    log = changes.ChangeLog(spark, str(tmp_path / "log"))
    log.create(rows, **limits)
    return log


def files(tmp_path):
    return {str(p) for p in (tmp_path / "log" / "base").rglob("*.parquet")}


def new(spark, *runs):
    return spark.createDataFrame([(r, 0, "new", f"/new/{r}") for r in runs], "run_number long, ordinal long, host string, location string")


def verified(table):
    return mutate.first_match(table, F.col("status") == "verifying").withColumn("status", F.lit("transferred"))


def test_changes_equal_operators(spark, reps, rows, tmp_path):
    log = log_of(spark, tmp_path, reps, ranges=3)
    keys = reps.filter("host = 's' AND run_number < 4").select("run_number", "host")
    paths = reps.filter("run_number = 6").select("location")
    expected = mutate.push_locations(reps, new(spark, 2, 5, 77))
    expected = mutate.set_location(expected, verified(expected), ["status"])
    expected = mutate.pull_locations(expected, keys)
    expected = mutate.remove_location(expected, "h", paths)
    steps = [changes.push(new(spark, 2, 5, 77)), changes.set_fields(verified, ["status"]), changes.pull(lambda t: keys),
             changes.remove("h", lambda t: paths)]
    assert [log.commit(c) for c in steps] == [2, 3, 4, 5]
    assert rows(log.read(), *COLUMNS) == rows(expected, *COLUMNS)
    assert log.read().columns == reps.columns
    assert rows(log.read(1)) == rows(reps)  # old versions stay
    assert log.compact() == 6 and not log.state()["changes"]
    assert rows(log.read(), *COLUMNS) == rows(expected, *COLUMNS)


def test_a_change_stores_what_it_touches(spark, reps, rows, tmp_path):
    log = log_of(spark, tmp_path, reps)
    before = files(tmp_path)
    log.commit(changes.push(new(spark, 3)))
    own = log.state()["change"]
    assert (own["rows"], own["low"], own["high"]) == (1, 3, 3) and files(tmp_path) == before
    assert log.commit(lambda t: changes.drop(t.limit(0).select("run_number", "pos"))) == 2  # nothing to do


def test_compaction_leaves_other_ranges(spark, reps, rows, tmp_path):
    log = log_of(spark, tmp_path, reps, ranges=4)
    before = log.state()["base"]
    log.commit(lambda t: changes.drop(t.filter("run_number = 1").select("run_number", "pos")))
    log.commit(changes.push(new(spark, 1)))
    log.compact()
    after = log.state()["base"]
    assert sum(before[n] != after.get(n) for n in before) == 1
    assert rows(log.read().filter("run_number = 1"), "pos", "host") == [(0, "new")]
    log.commit(lambda t: changes.drop(t.select("run_number", "pos")))
    log.compact()
    assert log.state()["base"] == {} and log.read().count() == 0
    log.commit(changes.push(new(spark, 4)))
    assert rows(log.read(), "run_number", "pos") == [(4, 0)]
    assert log.compact() and log.read().count() == 1


def test_writers_of_other_runs_both_stay(spark, reps, rows, tmp_path):
    log = log_of(spark, tmp_path, reps)
    calls = []

    def slow(table):
        calls.append(1)
        if len(calls) == 1:
            log.commit(changes.push(new(spark, 8)))
        return changes.push(new(spark, 1))(table)

    assert log.commit(slow) == 3 and len(calls) == 1
    assert rows(log.read().filter("host = 'new'"), "run_number", "pos") == [(1, 3), (8, 3)]


def test_writers_of_one_run_come_one_after_the_other(spark, reps, rows, tmp_path):
    log = log_of(spark, tmp_path, reps)
    calls = []

    def slow(table):
        calls.append(1)
        if len(calls) == 1:
            log.commit(changes.push(new(spark, 5)))
        return changes.push(new(spark, 5))(table)

    assert log.commit(slow) == 3 and len(calls) == 2  # derived again, so both records stay
    assert rows(log.read().filter("host = 'new'"), "run_number", "pos") == [(5, 3), (5, 4)]

    def unlucky(table):
        log.commit(changes.push(new(spark, 5)))
        return changes.push(new(spark, 5))(table)

    with pytest.raises(mutate.Conflict):
        log.commit(unlucky, attempts=2)


def test_commit_during_compaction_stays(spark, reps, rows, tmp_path, monkeypatch):
    log = log_of(spark, tmp_path, reps)
    log.commit(changes.push(new(spark, 2)))
    store, met = log._store, []

    def slow(*args):
        if not met:
            met.append(log.commit(changes.push(new(spark, 2, 3))))
        return store(*args)

    monkeypatch.setattr(log, "_store", slow)
    assert log.compact() == 4 and len(log.state()["changes"]) == 1
    assert rows(log.read().filter("host = 'new'"), "run_number", "pos") == [(2, 3), (2, 4), (3, 3)]


def test_writers_in_threads(spark, reps, rows, tmp_path):
    log = log_of(spark, tmp_path, reps)
    failed = []

    def write(run):
        try:
            for _ in range(2):
                log.commit(changes.push(new(spark, run, 1)), attempts=30)
        except Exception as error:  # shown by the assertion below
            failed.append(error)

    threads = [threading.Thread(target=write, args=(run,)) for run in (2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert rows(log.read().filter("host = 'new'"), "run_number", "pos") == sorted(
        [(r, p) for r in (2, 3, 4) for p in (3, 4)] + [(1, p) for p in range(3, 9)], key=repr)


def test_empty_table_and_null_keys(spark, reps, rows, tmp_path):
    log = log_of(spark, tmp_path, reps.limit(0))
    assert log.read().count() == 0
    log.commit(changes.push(new(spark, 1)))
    nameless = reps.limit(1).withColumn("run_number", F.lit(None).cast("long"))
    other = changes.ChangeLog(spark, str(tmp_path / "nulls"))
    other.create(nameless.unionByName(reps))
    assert other.read().count() == 25 and log.read().count() == 1
    with pytest.raises(mutate.Conflict):
        other.create(reps)


def test_versions_by_two_writers(spark, reps, rows, tmp_path):
    path = str(tmp_path / "catalogue")
    assert mutate.write_version(reps, path) == 1
    first = reps.filter("run_number = 1")
    other = reps.filter("run_number = 2")
    assert mutate.write_version(first, path, expected=1) == 2
    with pytest.raises(mutate.Conflict):
        mutate.write_version(other, path, expected=1)
    assert rows(mutate.read_version(spark, path)) == rows(first)  # the late writer changed nothing
    made = []
    threads = [threading.Thread(target=lambda df=df: made.append(mutate.write_version(df, path))) for df in (first, other, reps)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [3, 4, 5]
    assert sorted(mutate.read_version(spark, path, v).count() for v in made) == [3, 3, 24]
    with pytest.raises(ValueError):
        mutate.read_version(spark, str(tmp_path / "none"))


def test_rows_that_no_key_can_equal_are_not_shuffled(spark, rows, monkeypatch):
    left = spark.range(4000).selectExpr("CASE WHEN id % 50 > 0 THEN id END AS run_number", "id % 3 AS pos", "repeat('x', 300) AS text")
    left = left.union(left.limit(500))
    keys = left.selectExpr("run_number", "CAST(pos AS INT) AS pos").filter("run_number % 10 = 3 OR run_number IS NULL")
    monkeypatch.setattr(scale, "is_small", lambda df: False)
    found = scale.without_keys(left, keys, ["run_number", "pos"])
    assert rows(found) == rows(left.join(keys, ["run_number", "pos"], "left_anti")) and found.count() > 3000
    clear, doubtful = scale.split_by_keys(left, keys, ["run_number", "pos"], keys.count())
    assert 450 < doubtful.count() < 1600 and clear.count() + doubtful.count() == 4500
    assert rows(scale.without_keys(left, keys.limit(0), ["run_number", "pos"])) == rows(left)


def test_many_changes_leave_most_rows_in_place(spark, reps, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "BROADCAST_ROWS", 0)
    log = log_of(spark, tmp_path, reps, ranges=3)
    gone = lambda t: changes.drop(t.filter("run_number IN (2, 7)").select("run_number", "pos"))
    seen = []
    log.commit(gone)
    log.commit(changes.set_fields(lambda t: seen.append(t.count()) or verified(t), ["status"], F.col("status") == "verifying"))
    expected = [r for r in rows(reps, *COLUMNS) if r[0] not in (2, 7)]
    expected = [(*r[:3], "transferred") for r in expected]
    assert seen == [6] and rows(log.read(), *COLUMNS) == expected
    plan = log.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan
    log.compact()
    assert not log.state()["changes"] and rows(log.read(), *COLUMNS) == expected
