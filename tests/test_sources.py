import json

from pyspark.sql import functions as F

from runledger.scale import tasks_for
from runledger.sources import catalogue, files


def test_runs_keep_missing_and_null_apart(spark, tmp_path, rows):
    docs = [{"number": 1, "name": "a", "start": "2017-01-01T00:00:00", "trigger": {"events_built": 5},
             "data": [{"host": "h", "creation_time": "2017-01-01 10:00:00", "checksum": None, "rule_info": "no_rule"},
                      {"host": "g", "creation_time": ["2017-01-01 11:00:00"], "rse": ["r1", "r2"], "rule_info": ["r1:x"],
                       "size": 7, "pax_version": "v1"},
                      {"host": "f", "checksum": "c"}]},
            {"number": 2, "name": "b"}]
    path = tmp_path / "runs.json"
    path.write_text("\n".join(map(json.dumps, docs)) + "\n{broken")
    runs = catalogue.read_runs(spark, str(path), "json")
    assert [r._corrupt_record for r in runs.collect() if r._corrupt_record] == ["{broken"]
    flat = catalogue.explode_locations(runs)
    assert rows(flat, "run_number", "pos", "host", "checksum", "has_checksum") == [
        (1, 0, "h", None, True), (1, 1, "g", None, False), (1, 2, "f", "c", True)]
    assert [str(r[0]) for r in flat.select("creation_time").collect()] == [
        "2017-01-01 10:00:00", "2017-01-01 11:00:00", "None"]
    assert rows(flat.filter("pos < 2"), "pos", "rse", "rule_info", "size_bytes", "version") == [
        (0, None, ["no_rule"], None, None), (1, ["r1", "r2"], ["r1:x"], 7, "v1")]


def test_nested_processor_settings(spark, tmp_path):
    doc = {"number": 1, "processor": {"DEFAULT": {"gains": [1.0, 2.5], "drift_velocity_liquid": 1.4e5},
                                      "correction_versions": {"Drift": "1.0"}},
           "reader": {"self_trigger": True, "ini": {"write_mode": 2, "trigger_config_override":
                                                     {"Zip": {"events_per_file": 250}}}}}
    path = tmp_path / "runs.json"
    path.write_text(json.dumps(doc))
    run = catalogue.read_runs(spark, str(path), "json").first()
    assert run.gains == [1.0, 2.5] and run.params["drift_velocity_liquid"] == 1.4e5 and "gains" in run.params
    assert run.correction_versions == {"Drift": "1.0"}
    assert (run.reader.self_trigger, run.reader.ini.write_mode, run.reader.ini.events_per_file) == (True, 2, 250)


def test_parquet_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs")
    json_path = tmp_path / "r.json"
    json_path.write_text(json.dumps({"number": 3, "name": "x"}))
    catalogue.read_runs(spark, str(json_path), "json").drop("_corrupt_record").write.parquet(path)
    assert catalogue.read_runs(spark, path).first().number == 3


def test_first_site_wins(spark, tmp_path, rows):
    path = tmp_path / "sites.json"
    path.write_text(json.dumps([{"name": "a", "method": "scp", "upload_options": ["b"], "purge": 2},
                                {"name": "b", "method": "rsync"}, {"name": "a", "method": "late"}], indent=1))
    assert rows(catalogue.read_sites(spark, str(path)), "name", "method", "upload_options", "purge") == [
        ("a", "scp", ["b"], 2), ("b", "rsync", None, None)]


def test_only_the_first_rule_counts(spark, tmp_path, rows):
    path = tmp_path / "rule.json"
    path.write_text(json.dumps([{"run_nb": "5-8, 10", "destination_livetime": {"A": "-1"}, "verification_only": False},
                                {"run_nb": "99"}], indent=1))
    rules = catalogue.read_rules(spark, str(path))
    assert rules.first().rule_id is not None
    assert rows(catalogue.rule_numbers(rules), "number") == [(10,), (5,), (6,), (7,)]
    assert rules.first().destination_livetime == {"A": "-1"}


def test_line_numbers_across_splits(spark, tmp_path):
    for name, n in (("a.log", 5000), ("b.log", 1), ("c.log", 300)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.read_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5301
    assert all(r.line == f"{r.file.rsplit('/', 1)[1]} {r.line_no}" for r in got)


def test_lines_are_not_moved_to_be_numbered(spark, tmp_path):
    """A row per split meets the lines where they are, whatever Spark guesses of its size."""
    (tmp_path / "a.log").write_text("x\n" * 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = files.read_logs(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tasks_follow_rows(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 0) == tasks_for(spark, 5) == few
    assert tasks_for(spark, 1001, task_rows=10) == 101 and tasks_for(spark, 10 ** 9) == 1000


def test_run_list(spark, tmp_path, rows):
    (tmp_path / "list.txt").write_text("a, 3\n\n 4 ,,b\n")
    entries = files.read_run_list(spark, str(tmp_path / "list.txt"))
    assert rows(entries) == [("3",), ("4",), ("a",), ("b",)]
    runs = spark.createDataFrame([(1, "a"), (3, "c"), (5, "d"), (4, "b")], "number long, name string")
    assert rows(files.restrict_to_list(runs, entries), "number") == [(1,), (3,), (4,)]


def test_queue_drops_each_header(spark, tmp_path, rows):
    (tmp_path / "q1").write_text("\n NAME  \njob_1\n  job_2 job_3\n")
    (tmp_path / "q2").write_text("NAME\n")
    assert rows(files.read_queue(spark, str(tmp_path))) == [("job_1",), ("job_2",), ("job_3",)]


def test_inventory(spark, tmp_path, rows):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "f1").write_text("12345")
    (tmp_path / "d" / "e" / "f2").write_text("1")
    found = files.file_inventory(spark, str(tmp_path))
    assert "content" not in found.columns
    assert rows(found.select(F.substring_index("dir", "/", -1).alias("d"), "name", "length")) == [("d", "f1", 5), ("e", "f2", 1)]
    assert files.file_inventory(spark, str(tmp_path), content=True).filter("name = 'f2'").first().content == b"1"


def test_nesting_reverses_exploding(spark):
    from runledger import fixtures as fx

    runs = fx.nested_runs(spark, "/root/testdata/sf0.001").select("number", "data").filter("number < 200")
    back = catalogue.nest_locations(runs, catalogue.explode_locations(runs))
    assert sorted(back.collect()) == sorted(runs.collect())
    emptied = catalogue.nest_locations(runs, catalogue.explode_locations(runs).limit(0))
    assert emptied.filter("size(data) = 0").count() == runs.filter("data IS NOT NULL").count()
    assert emptied.filter("data IS NULL").count() == runs.filter("data IS NULL").count() > 0


def test_files_are_written_in_place(spark, tmp_path):
    """A file of each (dir, name) holds a line per row; no folder of its own, whatever the names hold."""
    made = [("a", 1, "x"), ("a", 1, "yy"), ("a", 2, None), ("b=%/c", 3, "é\nz"), (None, 4, ""), ("", 4, "q")]
    df = spark.createDataFrame(made, "d string, n long, line string").repartition(3)
    path = f"file://{tmp_path}/inventory"
    files.write_files(df, path, F.col("d"), F.col("n"))
    found = files.file_inventory(spark, path)
    got = sorted((r.dir.rpartition("/")[2], r.name, r.length) for r in found.collect())
    assert got == [("dir=__HIVE_DEFAULT_PARTITION__", "name=4.txt", 3), ("dir=a", "name=1.txt", 5), ("dir=a", "name=2.txt", 1),
                   ("dir=b%3D%25%2Fc", "name=3.txt", 5)]
    assert len([p for p in (tmp_path / "inventory").rglob("*") if p.is_dir()]) == 3
