"""Readers, each over files that Spark writes from the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..scale import scratch_dir, tasks_for
from ..sources import catalogue, files
from .registry import query


def _json(df, label):
    path = scratch_dir(df.sparkSession, label)
    df.write.json(path)
    return path


def _text(df, label):
    path = scratch_dir(df.sparkSession, label)
    df.write.text(path)
    return path


LOCATION_COLUMNS = ("run_number", "pos", "host", "type", "status", "location", "checksum", "has_checksum", "version",
                    "size_bytes", "creation_time")
LOCATION_SQL = """
SELECT number AS run_number, pos, host, type, status, location, checksum, has_checksum, version, size_bytes, creation_time
FROM nested_locations"""


@query("s1_read_runs", LOCATION_SQL, "nested_locations")
def s1(spark, sf):
    runs = catalogue.read_runs(spark, _json(fx.nested_runs(spark, sf), "runs"), "json")
    return catalogue.explode_locations(runs).select(*LOCATION_COLUMNS)


@query("s2_read_sites", "SELECT name, method, dir_raw, dir_processed, purge, nstreams FROM sites", "sites")
def s2(spark, sf):
    rows = fx.sites(spark, sf).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("docs"))
    path = _text(rows.select(F.to_json("docs")), "sites")
    return catalogue.read_sites(spark, path).select("name", "method", "dir_raw", "dir_processed", "purge", "nstreams")


@query("s3_read_rules", "SELECT rule_id, number FROM rule_sets", "rule_sets")
def s3(spark, sf):
    rules = fx.rules(spark, sf)
    path = _text(rules.select(F.to_json(F.array(F.struct("*")))), "rules")
    return catalogue.rule_numbers(catalogue.read_rules(spark, path, per_line=True))


@query("s4_file_inventory", """
SELECT source AS dir, doc_id, strlen(text) + 1 AS length, true AS has_time FROM documents""")
def s4(spark, sf):
    """A file per document, found with its directory and length."""
    path = scratch_dir(spark, "inventory")
    files.write_files(fx.table(spark, sf, "documents").select("source", "doc_id", F.col("text").alias("line")), path,
                      F.col("source"), F.col("doc_id"))
    found = files.file_inventory(spark, path)
    return found.select(F.regexp_extract("dir", "dir=([^/]*)$", 1).alias("dir"),
                        F.regexp_extract("name", r"^name=(\d+)\.txt$", 1).cast("long").alias("doc_id"), "length",
                        F.col("modificationTime").isNotNull().alias("has_time"))


@query("s5_read_logs", """
SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS ordinal, line FROM log_lines""", "log_lines")
def s5(spark, sf):
    """Logs written in order, several to a file; the numbers of lines must give the order back.

    Files, and the tasks that sort, are as many as the lines ask for; a key of the last join has the lines of one file at most.
    """
    path = scratch_dir(spark, "logs")
    logs = fx.log_lines(spark, sf)
    tasks = tasks_for(spark, logs.count())
    logs.repartitionByRange(tasks, "file", "line_no").sortWithinPartitions("file", "line_no").select(
        F.concat_ws("|", "file", "line")).write.text(path)
    lines = files.read_logs(spark, path).select(
        F.col("file").alias("_file"), "line_no", F.substring_index("line", "|", 1).cast("long").alias("file"),
        F.regexp_extract("line", r"^\d+\|(.*)$", 1).alias("line"))
    spread = lines.repartition(tasks, "file", "_file")
    first = spread.groupBy("file", "_file").agg(F.min("line_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.repartition(tasks, "file")
    before = Window.partitionBy("file").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return spread.join(first, ["file", "_file"]).select(
        "file", (F.col("line_no") - F.col("_first") + F.col("_skip")).alias("ordinal"), "line")


@query("s6_read_run_list", """
SELECT number, name FROM runs WHERE name IN (SELECT name FROM runs WHERE number % 5 = 0)
  OR number IN (SELECT number + 1 FROM runs WHERE number % 5 = 0)""", "runs")
def s6(spark, sf):
    runs = fx.runs(spark, sf)
    listed = runs.filter(F.col("number") % 5 == 0).select(
        F.concat("name", F.lit(" , "), (F.col("number") + 1).cast("string"), F.lit(",")))
    return files.restrict_to_list(runs.select("number", "name"), files.read_run_list(spark, _text(listed, "list")))


@query("s7_read_corrections", "SELECT kind, calculation_time, version, function FROM corrections", "corrections")
def s7(spark, sf):
    path = _json(fx.corrections(spark, sf).drop("c0", "c1"), "corrections")
    return catalogue.read_corrections(spark, path).select("kind", "calculation_time", "version", "function")


@query("s8_explode_locations", LOCATION_SQL, "nested_locations")
def s8(spark, sf):
    return catalogue.explode_locations(fx.nested_runs(spark, sf)).select(*LOCATION_COLUMNS)


@query("s9_read_queue", "SELECT job_name FROM queue", "queue")
def s9(spark, sf):
    path = scratch_dir(spark, "queue")
    fx.queue(spark, sf).write.csv(path, header=True)
    return files.read_queue(spark, path)
