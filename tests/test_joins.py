import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runledger import scale
from runledger.operators import aggregate, joins

REPLICA = ("run_number long, pos long, host string, type string, version string, status string, checksum string, "
           "has_checksum boolean, location string")
MASTERS = (("raw", "P", False), ("raw", "T", False), ("processed", "Q", True))


def replicas(spark, *specs):
    """Specs: (run, pos, host, type, version, status, checksum, has_checksum)."""
    return spark.createDataFrame([(*s, f"/{s[2]}/{s[0]}/{s[1]}") for s in specs], REPLICA)


def test_first_master_wins(spark, rows):
    reps = replicas(spark, (1, 0, "T", "raw", None, "transferred", "t", True),
                    (1, 1, "P", "raw", None, "transferred", "p", True),
                    (2, 0, "P", "raw", "v1", "transferred", "p", True),
                    (3, 0, "P", "raw", None, "verifying", "p", True),
                    (4, 0, "Q", "processed", "v1", "transferred", "q1", True),
                    (4, 1, "Q", "processed", "v2", "transferred", "q2", True))
    assert rows(joins.master_checksum(reps, MASTERS)) == [
        (1, "raw", None, "t"), (4, "processed", "v1", "q1"), (4, "processed", "v2", "q2")]


def test_null_equals_missing_master(spark, rows):
    reps = replicas(spark, (1, 0, "X", "raw", None, "transferred", None, True),
                    (1, 1, "X", "raw", None, "transferred", "a", True),
                    (1, 2, "X", "raw", None, "transferred", None, False),
                    (1, 3, "C", "raw", None, "transferred", "zzz", True),
                    (1, 4, "X", "untriggered", None, "transferred", None, True))
    out = joins.compare_checksums(reps, MASTERS, "C")
    assert rows(out, "pos", "good", "no_master") == [(0, True, True), (1, False, True), (3, True, True)]
    assert rows(aggregate.good_copies(reps, MASTERS, "C")) == [(1, "raw", 3, 2)]


def test_here_there_last_wins(spark, rows):
    reps = replicas(spark, (1, 0, "H", "raw", None, "transferred", None, True),
                    (1, 1, "H", "raw", None, "transferred", None, True),
                    (1, 2, "H", "raw", None, "error", None, True),
                    (1, 3, "R", "raw", None, "RSEreupload", None, True),
                    (2, 0, "R", "raw", None, "error", None, True))
    up = joins.here_there(reps, "H", ["R", "S"], "raw", "upload")
    assert rows(up, "run_number", "remote", "here.pos", "there.pos") == [
        (1, "R", 1, 3), (1, "S", 1, None), (2, "R", None, 0), (2, "S", None, None)]
    down = joins.here_there(reps, "H", ["R"], "raw", "download")
    assert rows(down, "run_number", "here.pos", "there.pos") == [(1, 2, None), (2, None, None)]


def test_processed_pairs_only_of_the_version(spark, rows):
    reps = replicas(spark, (1, 0, "H", "processed", "v0", "transferred", None, True),
                    (1, 1, "R", "processed", "v1", "transferred", None, True))
    out = joins.here_there(reps, "H", ["R"], "processed", "upload", "v1")
    assert rows(out, "here.pos", "there.pos") == [(None, 1)]


RANGES = [(0, 10, 20, "a"), (1, 15, 40, "b"), (2, 0, 1000, "c"), (3, 500, 500, "never"), (4, 2000, 2001, "d")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_range_lookup(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(joins, "is_small", lambda df: broadcast)
    runs = spark.createDataFrame([(n,) for n in (9, 10, 19, 20, 39, 40, 500, 1000, 2000, 2001)], "number long")
    ranges = spark.createDataFrame(RANGES, "pos long, min long, max long, value string")
    named = joins.range_lookup(runs.select(F.lit("x").alias("name"), "number"), ranges)
    assert named.dtypes == [("name", "string"), ("number", "bigint"), ("value", "string")]
    assert rows(joins.range_lookup(runs, ranges)) == sorted([
        (9, "c"), (10, "a"), (19, "a"), (20, "b"), (39, "b"), (40, "c"), (500, "c"), (1000, None), (2000, "d"),
        (2001, None)], key=repr)


def test_pieces_cover_exactly(spark):
    rng = random.Random(7)
    data = [(i, lo, lo + rng.choice([0, 1, 7, 8, 9, 63, 500, 4096])) for i in range(60) for lo in [rng.randrange(5000)]]
    levels = scale.levels_for(4096)
    df = spark.createDataFrame(data, "id long, lo long, hi long").select(
        "id", F.explode(scale.range_pieces(F.col("lo"), F.col("hi"), levels)).alias("p")).select("id", "p.*")
    seen = {}
    for r in df.collect():
        width = 8 ** r.level
        seen.setdefault(r.id, []).extend(range(r.node * width, (r.node + 1) * width))
    for i, lo, hi in data:
        assert sorted(seen.get(i, [])) == list(range(lo, hi))


def test_interval_mean_bounds_are_closed(spark, rows):
    runs = spark.sql("""SELECT * FROM VALUES (1L, timestamp_ntz'2017-01-01 00:00:00', timestamp_ntz'2017-01-01 01:00:00'),
        (2L, timestamp_ntz'2017-01-01 05:00:00', timestamp_ntz'2017-01-01 06:00:00'),
        (3L, timestamp_ntz'2017-01-01 00:00:00', NULL) AS t(number, start, end)""")
    readings = spark.sql("""SELECT * FROM VALUES (timestamp_ntz'2017-01-01 00:00:00', 'v', 1.0D),
        (timestamp_ntz'2017-01-01 01:00:00', 'v', 2.0D), (timestamp_ntz'2017-01-01 01:00:00.000001', 'v', 100.0D),
        (timestamp_ntz'2017-01-01 00:30:00', 'w', 50.0D) AS t(ts, sensor, value)""")
    assert rows(joins.interval_mean(runs, readings, "v"), "number", "mean_value") == [(1, 1.5), (2, None), (3, None)]


def test_interval_mean_against_all_readings(spark, rows):
    """Intervals inside a second, over days, back to back and turned round; dense seconds, equal times, missing values."""
    draw = random.Random(8)
    zero = dt.datetime(2016, 12, 30, 23, 0)

    def time():
        day = draw.choice([0, 0, 1, 2, 5, 9])
        return zero + dt.timedelta(days=day, seconds=draw.choice([0, 1, 59, 3599, 3600, draw.randrange(86_400)]),
                                   microseconds=draw.choice([0, 0, 1, 999_999, draw.randrange(10**6)]))

    hot = [(zero + dt.timedelta(microseconds=draw.randrange(50)), "v", draw.random()) for _ in range(400)]
    readings = hot + [(time(), draw.choice("vw"), draw.choice([None, 100 * draw.random(), draw.random()])) for _ in range(900)]
    spans = [(n, time(), time()) for n in range(300)] + [(300 + n, t, t) for n, (t, _, _) in enumerate(readings[::9])]
    spans += [(900, zero, None), (901, None, zero), (902, zero - dt.timedelta(days=30), zero + dt.timedelta(days=30))]
    runs = spark.createDataFrame(spans, "number long, start timestamp_ntz, end timestamp_ntz")
    df = spark.createDataFrame(readings, "ts timestamp_ntz, sensor string, value double").repartition(5)
    got = {r.number: r.mean_value for r in joins.interval_mean(runs, df, "v").collect()}
    assert len(got) == len(spans)
    for number, start, end in spans:
        inside = [v for t, s, v in readings if s == "v" and v is not None and start and end and start <= t <= end]
        assert got[number] == (pytest.approx(sum(inside) / len(inside), rel=1e-9) if inside else None)
    assert joins.interval_mean(runs.limit(0), df, "v").count() == 0
    assert rows(joins.interval_mean(runs.filter("number = 902"), df.limit(0), "v"), "mean_value") == [(None,)]


def test_strays(spark, rows):
    files = spark.createDataFrame(
        [("/d/known", "f1", False), ("/d", "known", True), ("/d/other", "f2", False), ("/base", "sub", True),
         ("/d/other", "sub", True), ("/d", "file", False)], "dir string, name string, is_dir boolean")
    files = files.withColumn("path", F.concat_ws("/", "dir", "name"))
    reps = replicas(spark, (1, 0, "h", "raw", None, "transferred", None, True)).withColumn("location", F.lit("/d/known"))
    reps = reps.unionByName(reps.withColumn("location", F.lit("/d/file")))
    assert rows(joins.find_strays(files, reps, "h", "/base"), "path") == [("/d/other/f2",), ("/d/other/sub",)]


def test_verify_upload_by_name(spark, rows):
    local = spark.createDataFrame([("d", "a", "1"), ("d", "b", "2"), ("e", "a", "1")],
                                  "dataset string, file string, fingerprint string")
    cat = spark.createDataFrame([("d", "a", "x", None), ("d", "b", "x", "2"), ("e", "a", "y", "1")],
                                "dataset string, file string, rse string, checksum string")
    assert rows(joins.verify_upload(local, cat, "x")) == [("d", 2, 2, "transferred"), ("e", 1, 0, "RSEreupload")]
    assert rows(joins.matched_uploads(local, cat, "x")) == [("d", "a", None, True), ("d", "b", "2", True), ("e", "a", None, False)]
    assert rows(joins.verify_upload(local, cat, "x", check=True)) == [
        ("d", 2, 1, "RSEreupload"), ("e", 1, 0, "RSEreupload")]


def test_uploads_are_sorted_once_by_hash(spark, rows):
    local = spark.createDataFrame([("d", "a", "1"), ("d", "a", "1"), (None, "a", None), ("e", None, "3"), ("dd", "a", "4")],
                                  "dataset string, file string, fingerprint string")
    cat = spark.createDataFrame([("d", "a", "x", "1"), ("d", "a", "x", "0"), (None, "a", "x", "2"), ("e", None, "y", "3")],
                                "dataset string, file string, rse string, checksum string")
    found = joins.matched_uploads(local, cat, "x")
    assert rows(found) == sorted([("d", "a", "1", True), (None, "a", "2", True), ("e", None, None, False), ("dd", "a", None, False)], key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") == 1 and "xxhash64" in plan
    checked = joins.matched_uploads(local, cat, "x", check=True)
    assert [r.found for r in checked.orderBy("dataset", "file").collect()] == [False, True, False, False]


def test_ranges_are_dealt_before_they_are_cut(spark, rows, monkeypatch):
    ranges = spark.createDataFrame([(p, 40 * p, 40 * p + p % 70, f"v{p}") for p in range(300)], "pos long, min long, max long, value string")
    runs = spark.createDataFrame([(n,) for n in range(0, 12100, 7)] + [(None,), (40,), (40,)], "number long")
    small = rows(joins.range_lookup(runs, ranges.repartition(1)))
    monkeypatch.setattr(joins, "is_small", lambda df: False)
    monkeypatch.setattr(joins, "TASK_RANGES", 20)
    found = joins.range_lookup(runs, ranges.repartition(1))
    assert rows(found) == small and (40, "v1") in small and (None, None) in small
    assert joins._first_per_node(ranges.coalesce(1), F.col("min"), F.col("max"), 3)._jdf.queryExecution().optimizedPlan().toString().count(
        "RepartitionByExpression") == 1
    assert "bitmap_construct_agg" in found._jdf.queryExecution().optimizedPlan().toString()
