import pytest
from pyspark.sql import functions as F
from test_joins import replicas

from runledger.operators import mutate


@pytest.fixture
def reps(spark):
    return replicas(spark, (1, 0, "h", "raw", None, "verifying", None, False),
                    (1, 1, "h", "raw", None, "verifying", None, False),
                    (1, 2, "t", "raw", None, "transferred", None, True),
                    (2, 0, "h", "raw", None, "transferred", "x", True))


def test_push_then_pull_is_identity(spark, reps, rows):
    new = spark.createDataFrame([(1, 0, "n", "/n/0"), (1, 1, "n", "/n/1"), (9, 0, "n", "/n/2")],
                                "run_number long, ordinal long, host string, location string")
    pushed = mutate.push_locations(reps, new)
    assert rows(pushed.filter("host = 'n'"), "run_number", "pos", "location") == [
        (1, 3, "/n/0"), (1, 4, "/n/1"), (9, 0, "/n/2")]
    pulled = mutate.pull_locations(pushed, pushed.filter("host = 'n'"))
    assert rows(pulled) == rows(reps)


def test_set_writes_nulls_and_only_the_first_match(spark, reps, rows):
    first = mutate.first_match(reps, F.col("status") == "verifying")
    out = mutate.set_location(reps, first.withColumns({"status": F.lit("error"), "location": F.lit(None).cast("string")}),
                              ["status", "location"])
    assert rows(out, "run_number", "pos", "status", "location")[:2] == [(1, 0, "error", None),
                                                                         (1, 1, "verifying", "/h/1/1")]


def test_rename_and_remove_take_the_first(spark, reps, rows):
    same = reps.withColumn("location", F.when(F.col("host") == "h", "/same").otherwise(F.col("location")))
    moves = spark.createDataFrame([("/same", "/new")], "src string, dst string")
    assert rows(mutate.rename_location(same, "h", moves), "run_number", "pos", "location") == [
        (1, 0, "/new"), (1, 1, "/same"), (1, 2, "/t/1/2"), (2, 0, "/new")]
    paths = spark.createDataFrame([("/same",)], "location string")
    assert rows(mutate.remove_location(same, "h", paths), "run_number", "pos") == [(1, 1), (1, 2)]
    assert rows(mutate.remove_location(same, "h", paths, "transferred"), "run_number", "pos") == [(1, 0), (1, 1), (1, 2)]


@pytest.mark.parametrize("status", ["transferred", "verifying", "error"])
def test_checksum_is_added_only_while_verifying(spark, rows, status):
    one = replicas(spark, (1, 0, "h", "raw", None, status, None, False))
    digests = spark.createDataFrame([("/h/1/0", "sum")], "location string, digest string")
    expected = ("transferred", "sum", True) if status == "verifying" else (status, None, False)
    assert rows(mutate.add_checksum(one, digests, "h"), "status", "checksum", "has_checksum") == [expected]
    assert rows(mutate.add_checksum(one, digests, "elsewhere"), "status") == [(status,)]


def test_missing_file_is_an_error(spark, reps, rows):
    digests = spark.createDataFrame([("/h/1/0", "sum"), ("/h/2/0", "other")], "location string, digest string")
    out = mutate.add_checksum(reps, digests, "h")
    assert rows(out, "run_number", "pos", "status", "checksum") == [
        (1, 0, "transferred", "sum"), (1, 1, "error", None), (1, 2, "transferred", None), (2, 0, "transferred", "x")]
    again = mutate.add_checksum(reps, digests, "h", recheck=True)
    assert rows(again, "run_number", "pos", "checksumproblem") == [(1, 0, None), (1, 1, None), (1, 2, None), (2, 0, True)]


def test_backfill(spark, rows):
    reps = replicas(spark, (1, 0, "P", "raw", None, "transferred", "a", True),
                    (1, 1, "T", "raw", None, "transferred", None, False),
                    (2, 0, "P", "raw", None, "transferred", "b", True),
                    (2, 1, "T", "raw", None, "transferred", None, False))
    digests = spark.createDataFrame([("/T/1/1", "a"), ("/T/2/1", "a")], "location string, digest string")
    assert rows(mutate.backfill_checksum(reps, digests, "P", "T").filter("host = 'T'"), "checksum") == [("a",), ("a",)]
    strict = mutate.backfill_checksum(reps, digests, "P", "T", require_match=True).filter("host = 'T'")
    assert rows(strict, "run_number", "checksum") == [(1, "a"), (2, None)]


def test_versions(spark, reps, rows, tmp_path):
    path = str(tmp_path / "catalogue")
    assert mutate.current_version(spark, path) is None
    assert mutate.write_version(reps, path, dry_run=True) == 1
    assert mutate.current_version(spark, path) is None
    assert mutate.write_version(reps, path) == 1
    assert mutate.write_version(mutate.read_version(spark, path).filter("run_number = 2"), path) == 2
    assert mutate.read_version(spark, path).count() == 1
    assert rows(mutate.read_version(spark, path, 1)) == rows(reps)


def test_only_rows_to_verify_meet_their_digests(spark, rows, monkeypatch):
    reps = replicas(spark, *((run, 0, "hgt"[run % 3], "raw", None, ["verifying", "transferred", None][run % 2 + (run % 7 == 0)], None, run % 4 > 0)
                             for run in range(30)), (50, 0, None, "raw", None, "verifying", None, None))
    reps = reps.unionByName(reps.filter("run_number < 6")).withColumn("location", F.when(F.col("run_number") != 9, F.col("location")))
    once = reps.select("location", F.md5("location").alias("digest")).distinct()
    twice = reps.filter("run_number % 5 < 3").select("location", F.md5("location").alias("digest"))  # some several times

    def by_join(digests):
        monkeypatch.setattr(mutate, "_with_digests", lambda replicas, found, todo: replicas.join(found, "location", "left"))
        expected = rows(mutate.add_checksum(reps, digests, "h", ["g"]))
        monkeypatch.undo()
        return expected

    for digests in (once, twice, once.limit(0)):
        assert rows(mutate.add_checksum(reps, digests, "h", ["g"])) == by_join(digests)
    monkeypatch.setattr(mutate, "is_small", lambda df: False)  # many locations are found several times
    assert rows(mutate.add_checksum(reps, twice, "h", ["g"])) == by_join(twice)
    monkeypatch.undo()
    plan = mutate.add_checksum(reps, once, "h")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
