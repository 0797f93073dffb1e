from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.fingerprints import fingerprint
from ..functions.logs import log_summary
from ..operators import aggregate as op
from .registry import query

COMPLETE_SQL = """
, totals AS (SELECT dir, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM listing GROUP BY dir),
complete AS (SELECT l.run_number, l.pos, l.host, l.location, t.n - 4 AS n_files,
    CAST(floor(r.events_built / coalesce(r.events_per_file, 1000)) AS BIGINT) AS expected, t.bytes, r.raw_size_byte,
    t.n - 4 = floor(r.events_built / coalesce(r.events_per_file, 1000))
      OR t.n - 4 = floor(r.events_built / coalesce(r.events_per_file, 1000)) + 1 AS complete
  FROM raw_locations l JOIN totals t ON l.location = t.dir JOIN runs r ON r.number = l.run_number
  WHERE l.status = 'transferred' AND r.events_built > 0)
"""
COMPLETE_VIEWS = ("listing", "raw_locations", "runs")


@query("a1_good_copies", "SELECT run_number, type, n, good FROM good_copies", "good_copies")
def a1(spark, sf):
    return op.good_copies(fx.replicas(spark, sf), fx.MASTERS, fx.CATALOGUE)


@query("a2_completeness", COMPLETE_SQL + "SELECT * FROM complete", *COMPLETE_VIEWS)
def a2(spark, sf):
    return op.completeness(fx.runs(spark, sf), fx.raw_locations(spark, sf), fx.listing(spark, sf))


@query("a3_raw_size", COMPLETE_SQL + """
SELECT r.number, coalesce(r.raw_size_byte, c.bytes) AS raw_size_byte
FROM runs r LEFT JOIN complete c ON c.run_number = r.number AND c.complete""", *COMPLETE_VIEWS)
def a3(spark, sf):
    rows = op.raw_size(fx.runs(spark, sf), fx.raw_locations(spark, sf), fx.listing(spark, sf))
    return rows.select("number", "raw_size_byte")


@query("a4_processed_size", """
SELECT run_number, pos, CASE WHEN type = 'processed' AND status = 'transferred'
  THEN coalesce(CASE WHEN pos % 3 <> 0 THEN size_bytes END, size_bytes + 1)
  ELSE CASE WHEN pos % 3 <> 0 THEN size_bytes END END AS size_bytes FROM replicas""", "replicas")
def a4(spark, sf):
    rows = fx.replicas(spark, sf)
    found = rows.select(F.col("location").alias("path"), (F.col("size_bytes") + 1).alias("length"),
                        F.lit(False).alias("is_dir"))
    unset = rows.withColumn("size_bytes", F.when(F.col("pos") % 3 != 0, F.col("size_bytes")))
    return op.processed_size(unset, found).select("run_number", "pos", "size_bytes")


@query("a5_size_per_event", """
SELECT number, round(raw_size_byte / events_built, 6) AS bytes_per_event, round(raw_size_byte * 1e-9, 9) AS gb
FROM runs WHERE raw_size_byte IS NOT NULL AND events_built > 0""", "runs")
def a5(spark, sf):
    return op.size_per_event(fx.runs(spark, sf)).select(
        "number", F.round("bytes_per_event", 6).alias("bytes_per_event"), F.round("gb", 9).alias("gb"))


@query("a6_directory_digest", """
SELECT dir, sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n_files
FROM (SELECT dir, sha256(text) AS h FROM files) x GROUP BY dir""", "files")
def a6(spark, sf):
    return op.directory_digest(fingerprint(fx.files(spark, sf), "sha256"), "sha256")


TREE_SQL = """
, leaf AS (SELECT dir, substr(h, 1, 3) AS node, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n
  FROM (SELECT dir, sha256(name || chr(10) || fingerprint) AS h FROM listing) x GROUP BY 1, 2),
two AS (SELECT dir, substr(node, 1, 2) AS node, sha256(string_agg(d, '' ORDER BY leaf.node)) AS d, CAST(sum(n) AS BIGINT) AS n
  FROM leaf GROUP BY dir, substr(leaf.node, 1, 2)),
one AS (SELECT dir, substr(node, 1, 1) AS node, sha256(string_agg(d, '' ORDER BY two.node)) AS d, CAST(sum(n) AS BIGINT) AS n
  FROM two GROUP BY dir, substr(two.node, 1, 1))
SELECT dir, sha256(string_agg(d, '' ORDER BY node)) AS digest, CAST(sum(n) AS BIGINT) AS n_files FROM one GROUP BY dir"""


@query("a15_tree_digest", TREE_SQL, "listing")
def a15(spark, sf):
    return op.tree_digest(fx.listing(spark, sf))


@query("a7_duplicate_files", """
SELECT dir, fingerprint, count(*) AS n FROM listing GROUP BY 1, 2 HAVING count(*) > 1""", "listing")
def a7(spark, sf):
    return op.duplicate_files(fx.listing(spark, sf))


@query("a8_directory_pretest", """
SELECT dir, count(*) FILTER (WHERE NOT is_dir) AS n_files, count(*) FILTER (WHERE is_dir) AS n_folders,
  CASE WHEN count(*) FILTER (WHERE NOT is_dir) = 0 OR count(*) FILTER (WHERE is_dir) > 0 THEN 'error' ELSE 'ok' END AS status
FROM listing GROUP BY dir""", "listing")
def a8(spark, sf):
    return op.directory_pretest(fx.listing(spark, sf))


@query("a9_tape_inventory", """
SELECT count(*) AS n_datasets, CAST(round(sum(size_bytes) / 1000000, 0) AS BIGINT) AS total_mb
FROM replicas WHERE host = 'site1' AND location LIKE '%site1/raw%'""", "replicas")
def a9(spark, sf):
    rows = fx.replicas(spark, sf)
    sizes = rows.select("location", (F.col("size_bytes") / 1e6).alias("mb"))
    return op.tape_inventory(rows, sizes, fx.TAPE, "site1/raw").select(
        "n_datasets", F.round("total_mb").cast("long").alias("total_mb"))


@query("a10_listing_size", """
SELECT run_number AS file, round(sum(size_bytes / 1048576.0), 6) AS mb FROM replicas WHERE pos % 5 <> 0 GROUP BY 1""",
       "replicas")
def a10(spark, sf):
    mark = F.when(F.col("pos") % 5 != 0, " DEFAULT A ").otherwise(" OTHER A ")
    line = F.concat(F.lit("   "), F.format_number("size_bytes", 0), F.lit(" B "), mark, F.col("location"))
    lines = fx.replicas(spark, sf).select(F.col("run_number").alias("file"), line.alias("line"))
    return op.listing_size(lines).select("file", F.round("mb", 6).alias("mb"))


@query("a11_double_entries", """
SELECT run_number, pos, location, status, count(*) OVER (PARTITION BY run_number) AS n
FROM replicas WHERE host = 'site5' QUALIFY n > 1""", "replicas")
def a11(spark, sf):
    return op.double_entries(fx.replicas(spark, sf), fx.CATALOGUE)


@query("a12_count_entries", """
SELECT run_number, count(*) AS n FROM replicas WHERE host = 'site1' AND status = 'transferred' GROUP BY 1""", "replicas")
def a12(spark, sf):
    return op.count_entries(fx.replicas(spark, sf), fx.TAPE, "transferred")


@query("a13_log_totals", """
SELECT count(*) AS n_logs, round(sum(total_time) / 3600, 6) AS hours, round(sum(tr_amount_up) / 1024, 6) AS tb
FROM log_summary WHERE nb_uploaded_files > 0 AND nb_inspected_files > 0""", "log_summary")
def a13(spark, sf):
    rows = op.log_totals(log_summary(fx.log_lines(spark, sf)))
    return rows.select("n_logs", F.round("hours", 6).alias("hours"), F.round("tb", 6).alias("tb"))


@query("a14_tape_status", """
SELECT run_number, pos, host, status, location, CASE WHEN checksum IS NOT NULL THEN 'YES' ELSE 'NO' END AS checksum
FROM replicas WHERE host = 'site1' AND status = 'transferred'""", "replicas")
def a14(spark, sf):
    return op.tape_status(fx.replicas(spark, sf), fx.TAPE, "transferred")
