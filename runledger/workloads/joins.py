from pyspark.sql import functions as F

from .. import fixtures as fx
from ..constants import DERIVED_PRODUCTS
from ..operators import joins as op
from .registry import query

REMOTES = ["site4", "site1", "site5"]


def as_files(listing):
    return listing.select(F.col("dir").alias("dataset"), F.col("name").alias("file"), "fingerprint", "length")


def job_name(column="number"):
    return F.concat(F.lit("job_"), F.col(column).cast("string"))


@query("j1_master_checksum",
       "SELECT run_number, type, version, checksum AS master_checksum FROM masters", "masters")
def j1(spark, sf):
    return op.master_checksum(fx.replicas(spark, sf), fx.MASTERS)


@query("j2_compare_checksums", """
SELECT run_number, pos, host, type, version, checksum, master_checksum, good, master_checksum IS NULL AS no_master
FROM compared""", "compared")
def j2(spark, sf):
    return op.compare_checksums(fx.replicas(spark, sf), fx.MASTERS, fx.CATALOGUE).select(
        "run_number", "pos", "host", "type", "version", "checksum", "master_checksum", "good", "no_master")


HERE_THERE_SQL = """
, eligible AS (SELECT * FROM replicas WHERE {where}),
here AS (SELECT run_number, pos FROM (SELECT *, row_number() OVER (PARTITION BY run_number ORDER BY pos DESC) rn
  FROM eligible WHERE host = 'site0' {here_ok}) x WHERE rn = 1),
remotes AS (SELECT * FROM (VALUES (0, 'site4'), (1, 'site1'), (2, 'site5')) v(option, remote)),
there AS (SELECT run_number, host, pos, status FROM (
  SELECT *, row_number() OVER (PARTITION BY run_number, host ORDER BY pos DESC) rn
  FROM eligible WHERE host IN ('site4', 'site1', 'site5') {there_ok}) x WHERE rn = 1),
runs_seen AS (SELECT DISTINCT run_number FROM eligible WHERE host IN ('site0', 'site4', 'site1', 'site5'))
SELECT s.run_number, m.option, m.remote, h.pos AS here_pos, t.pos AS there_pos
FROM runs_seen s CROSS JOIN remotes m LEFT JOIN here h ON h.run_number = s.run_number
LEFT JOIN there t ON t.run_number = s.run_number AND t.host = m.remote"""


@query("j3_here_there", HERE_THERE_SQL.format(
    where="type = 'raw'", here_ok="AND status = 'transferred'", there_ok=""), "replicas")
def j3(spark, sf):
    rows = op.here_there(fx.replicas(spark, sf), "site0", REMOTES, "raw", "upload")
    return rows.select("run_number", "option", "remote", F.col("here.pos").alias("here_pos"),
                       F.col("there.pos").alias("there_pos"))


@query("j4_range_lookup", """
SELECT number, (SELECT arg_min(g.value, g.pos) FROM ranges g WHERE r.number >= g.min_no AND r.number < g.max_no) AS value
FROM runs r""", "runs", "ranges")
def j4(spark, sf):
    return op.range_lookup(fx.runs(spark, sf).select("number"), fx.ranges(spark, sf))


@query("j5_interval_mean", """
SELECT i.number, round((SELECT avg(value) FROM readings r WHERE r.sensor = 'click'
   AND r.ts BETWEEN i.start_ts AND i.end_ts), 9) AS mean_value FROM intervals i""", "readings", "intervals")
def j5(spark, sf):
    rows = op.interval_mean(fx.intervals(spark, sf), fx.readings(spark, sf), "click")
    return rows.select("number", F.round("mean_value", 9).alias("mean_value"))


@query("j6_find_strays", """
SELECT path, dir FROM listing l WHERE NOT (is_dir AND dir = '/raw/1')
  AND dir NOT IN (SELECT location FROM raw_locations WHERE host = 'site0' AND run_number % 3 <> 0)
  AND path NOT IN (SELECT location FROM raw_locations WHERE host = 'site0' AND run_number % 3 <> 0)""",
       "listing", "raw_locations")
def j6(spark, sf):
    known = fx.raw_locations(spark, sf).filter(F.col("run_number") % 3 != 0)
    return op.find_strays(fx.listing(spark, sf), known, "site0", "/raw/1").select("path", "dir")


@query("j7_find_missing", """
SELECT run_number, location FROM raw_locations WHERE location NOT IN (SELECT dir FROM listing)""",
       "listing", "raw_locations")
def j7(spark, sf):
    listed = fx.listing(spark, sf).select(F.col("dir").alias("path"))
    return op.find_missing(fx.raw_locations(spark, sf), listed, "site0").select("run_number", "location")


@query("j8_verify_download", """
SELECT dataset, CAST(sum(nc) AS BIGINT) AS n_catalogue, CAST(sum(nd) AS BIGINT) AS n_downloaded,
  CAST(sum(CASE WHEN d = c THEN 1 ELSE 0 END) AS BIGINT) AS n_matched,
  sum(CASE WHEN d = c THEN 1 ELSE 0 END) = sum(nc) AND sum(CASE WHEN d = c THEN 1 ELSE 0 END) = sum(nd) AS verified
FROM (SELECT dataset, file, max(CASE WHEN side = 'c' THEN fp END) AS c, max(CASE WHEN side = 'd' THEN fp END) AS d,
        max(CASE WHEN side = 'c' THEN 1 ELSE 0 END) AS nc, max(CASE WHEN side = 'd' THEN 1 ELSE 0 END) AS nd
  FROM (SELECT 'c' AS side, dir AS dataset, name AS file, fingerprint AS fp FROM listing
        UNION ALL SELECT 'd', dir, name, CASE WHEN length % 29 = 0 THEN 'x' ELSE fingerprint END FROM listing
        WHERE length % 23 <> 0) u GROUP BY dataset, file) f GROUP BY dataset""", "listing")
def j8(spark, sf):
    files = as_files(fx.listing(spark, sf))
    broken = F.when(F.col("length") % 29 == 0, "x").otherwise(F.col("fingerprint"))
    downloaded = files.filter(F.col("length") % 23 != 0).withColumn("fingerprint", broken)
    return op.verify_download(downloaded, files)


UPLOADED_SQL = """
, local AS (SELECT DISTINCT dir AS dataset, name AS file FROM listing),
there AS (SELECT dir AS dataset, name AS file, max(fingerprint) AS checksum FROM listing WHERE length % 31 <> 0
  GROUP BY 1, 2)
"""


def _uploads(spark, sf):
    files = as_files(fx.listing(spark, sf))
    rse = F.when(F.col("length") % 31 != 0, "entrance").otherwise("other")
    return files.select("dataset", "file"), files.withColumn("rse", rse).withColumnRenamed("fingerprint", "checksum")


@query("j9_verify_upload", UPLOADED_SQL + """
SELECT l.dataset, count(*) AS n_files, count(t.file) AS n_found,
  CASE WHEN count(t.file) = count(*) THEN 'transferred' ELSE 'RSEreupload' END AS status
FROM local l LEFT JOIN there t ON l.dataset = t.dataset AND l.file = t.file GROUP BY l.dataset""", "listing")
def j9(spark, sf):
    return op.verify_upload(*_uploads(spark, sf), "entrance")


@query("j9_matched_uploads", UPLOADED_SQL + """
SELECT l.dataset, l.file, t.checksum, t.file IS NOT NULL AS found
FROM local l LEFT JOIN there t ON l.dataset = t.dataset AND l.file = t.file""", "listing")
def j9_rows(spark, sf):
    return op.matched_uploads(*_uploads(spark, sf), "entrance")


@query("j10_match_rules", "SELECT number, rule_id FROM matches", "matches")
def j10(spark, sf):
    return op.match_rules(fx.runs(spark, sf), fx.rules(spark, sf))


@query("j11_not_queued", """
SELECT number, name FROM runs WHERE concat('job_', CAST(number AS VARCHAR)) NOT IN (SELECT job_name FROM queue)""",
       "runs", "queue")
def j11(spark, sf):
    return op.not_queued(fx.runs(spark, sf), fx.queue(spark, sf), job_name()).select("number", "name")


@query("j12_not_processed", """
SELECT number, name FROM runs WHERE number NOT IN (
  SELECT run_number FROM replicas WHERE host = 'site2' AND type = 'processed' AND version = 'v1')""", "runs", "replicas")
def j12(spark, sf):
    return op.not_processed(fx.runs(spark, sf), fx.replicas(spark, sf), "site2", "v1").select("number", "name")


PRODUCT_VALUES = ", ".join(f"('{p}')" for p in DERIVED_PRODUCTS)


def products_done(spark, sf):
    """Products already made: one per line item."""
    names = F.array(*[F.lit(p) for p in DERIVED_PRODUCTS])
    index = (F.col("l_partkey") % len(DERIVED_PRODUCTS) + 1).cast("int")
    return fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("number"), F.element_at(names, index).alias("product"))


@query("j13_product_backlog", f"""
SELECT r.number, r.name, p.product FROM runs r CROSS JOIN (VALUES {PRODUCT_VALUES}) p(product)
WHERE (r.number, p.product) NOT IN (SELECT (l_orderkey, ([{PRODUCT_VALUES.replace('(', '').replace(')', '')}])
  [CAST(l_partkey % {len(DERIVED_PRODUCTS)} AS INTEGER) + 1]) FROM lineitem)""", "runs")
def j13(spark, sf):
    return op.product_backlog(fx.runs(spark, sf), DERIVED_PRODUCTS, products_done(spark, sf))
