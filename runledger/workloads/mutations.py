from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import changes
from ..operators import mutate as op
from ..scale import scratch_dir
from ..sources.catalogue import explode_locations, nest_locations
from .registry import query

STATE = ("run_number", "pos", "host", "status", "location", "checksum")


def base(spark, sf):
    return fx.replicas(spark, sf).drop("rse")


@query("m1_push_locations", """
SELECT run_number, pos, host, status, location, checksum FROM replicas
UNION ALL
SELECT r.number, coalesce(m.pos, -1) + 1 + o.ordinal, 'site4', 'transferring', '/new/' || CAST(r.number AS VARCHAR), NULL
FROM runs r CROSS JOIN (VALUES (0), (1)) o(ordinal)
LEFT JOIN (SELECT run_number, max(pos) AS pos FROM replicas GROUP BY 1) m ON m.run_number = r.number
WHERE r.number % 4 = 0""", "replicas", "runs")
def m1(spark, sf):
    new = fx.runs(spark, sf).filter(F.col("number") % 4 == 0).select(
        F.col("number").alias("run_number"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"),
        F.lit("site4").alias("host"), F.lit("raw").alias("type"), F.lit("transferring").alias("status"),
        F.concat(F.lit("/new/"), F.col("number").cast("string")).alias("location"))
    return op.push_locations(base(spark, sf), new).select(*STATE)


@query("m2_set_location", """
, first AS (SELECT run_number, min(pos) AS pos FROM replicas WHERE status = 'verifying' GROUP BY 1)
SELECT r.run_number, r.pos, host, CASE WHEN f.pos IS NOT NULL THEN 'transferred' ELSE status END AS status, location,
  CASE WHEN f.pos IS NOT NULL THEN 'sum' || CAST(r.run_number AS VARCHAR) ELSE checksum END AS checksum
FROM replicas r LEFT JOIN first f ON f.run_number = r.run_number AND f.pos = r.pos""", "replicas")
def m2(spark, sf):
    rows = base(spark, sf)
    updates = op.first_match(rows, F.col("status") == "verifying").select(
        "*", F.lit("transferred").alias("status"),
        F.concat(F.lit("sum"), F.col("run_number").cast("string")).alias("checksum"))
    return op.set_location(rows, updates, ["status", "checksum"]).select(*STATE)


@query("m3_pull_locations", """
SELECT run_number, pos, host, status, location, checksum FROM replicas r WHERE NOT EXISTS (
  SELECT 1 FROM replicas k WHERE k.size_bytes % 10 = 3 AND k.run_number = r.run_number AND k.host = r.host
  AND k.status = r.status AND k.checksum IS NOT DISTINCT FROM r.checksum)""", "replicas")
def m3(spark, sf):
    rows = base(spark, sf)
    keys = rows.filter(F.col("size_bytes") % 10 == 3).select("run_number", "host", "status", "checksum")
    return op.pull_locations(rows, keys).select(*STATE)


@query("m4_rename_location", """
SELECT run_number, pos, host, status, CASE WHEN host = 'site0' AND size_bytes % 4 = 0 THEN '/moved' || location
  ELSE location END AS location, checksum FROM replicas""", "replicas")
def m4(spark, sf):
    rows = base(spark, sf)
    moves = rows.filter(F.col("size_bytes") % 4 == 0).select(
        F.col("location").alias("src"), F.concat(F.lit("/moved"), "location").alias("dst"))
    return op.rename_location(rows, "site0", moves).select(*STATE)


@query("m5_remove_location", """
SELECT run_number, pos, host, status, location, checksum FROM replicas
WHERE NOT (host = 'site1' AND status = 'transferred' AND size_bytes % 3 = 0)""", "replicas")
def m5(spark, sf):
    rows = base(spark, sf)
    paths = rows.filter(F.col("size_bytes") % 3 == 0).select("location")
    return op.remove_location(rows, "site1", paths, "transferred").select(*STATE)


@query("m6_set_run_field", """
SELECT number, CASE WHEN number % 6 = 0 THEN CAST(events_built AS DOUBLE) WHEN has_params THEN 2.0 END AS drift,
  CASE WHEN number % 6 = 0 THEN '9.9' ELSE drift_version END AS version FROM runs""", "runs")
def m6(spark, sf):
    runs = fx.runs(spark, sf)
    values = runs.filter(F.col("number") % 6 == 0).select(
        "number", F.col("trigger.events_built").cast("double").alias("value"), F.lit("9.9").alias("version"))
    out = op.set_run_field(runs, values, "drift_velocity_liquid", "drift")
    return out.select("number", F.element_at("params", "drift_velocity_liquid").alias("drift"),
                      F.element_at("correction_versions", "drift").alias("version"))


@query("m7_write_version", "SELECT run_number, pos, host, status, location, checksum FROM replicas WHERE pos % 2 = 0",
       "replicas")
def m7(spark, sf):
    path = scratch_dir(spark, "catalogue")
    op.write_version(base(spark, sf), path)
    op.write_version(op.read_version(spark, path).filter(F.col("pos") % 2 == 0), path)
    op.write_version(op.read_version(spark, path).limit(0), path, dry_run=True)
    return op.read_version(spark, path).select(*STATE)


# M1, M2, M3 and M5 in turn; ``s0`` has the rows before.
CHANGES_SQL = """
, s1 AS (SELECT run_number, pos, host, status, location, checksum, size_bytes FROM {base}
  UNION ALL SELECT r.number, coalesce(m.pos, -1) + 1 + o.ordinal, 'site4', 'transferring', '/new/' || CAST(r.number AS VARCHAR), NULL, NULL
  FROM runs r CROSS JOIN (VALUES (0), (1)) o(ordinal)
  LEFT JOIN (SELECT run_number, max(pos) AS pos FROM {base} GROUP BY 1) m ON m.run_number = r.number WHERE r.number % 4 = 0),
s2 AS (SELECT s.run_number, s.pos, host, CASE WHEN f.pos IS NOT NULL THEN 'transferred' ELSE status END AS status, location,
    CASE WHEN f.pos IS NOT NULL THEN 'sum' || CAST(s.run_number AS VARCHAR) ELSE checksum END AS checksum, size_bytes
  FROM s1 s LEFT JOIN (SELECT run_number, min(pos) AS pos FROM s1 WHERE status = 'verifying' GROUP BY 1) f
    ON f.run_number = s.run_number AND f.pos = s.pos),
s3 AS (SELECT * FROM s2 r WHERE NOT EXISTS (SELECT 1 FROM s2 k WHERE k.size_bytes % 10 = 3 AND k.run_number = r.run_number
    AND k.host = r.host AND k.status = r.status AND k.checksum IS NOT DISTINCT FROM r.checksum)),
s4 AS (SELECT * FROM s3 WHERE NOT (host = 'site1' AND status = 'transferred' AND size_bytes % 3 = 0))
"""


def _added(spark, sf):
    return fx.runs(spark, sf).filter(F.col("number") % 4 == 0).select(
        F.col("number").alias("run_number"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"),
        F.lit("site4").alias("host"), F.lit("raw").alias("type"), F.lit("transferring").alias("status"),
        F.concat(F.lit("/new/"), F.col("number").cast("string")).alias("location"))


def _verified(table):
    return op.first_match(table, F.col("status") == "verifying").select(
        "*", F.lit("transferred").alias("status"),
        F.concat(F.lit("sum"), F.col("run_number").cast("string")).alias("checksum"))


def _changes(spark, sf):
    """The changes of ``CHANGES_SQL``."""
    return [
        changes.push(_added(spark, sf)),
        changes.set_fields(_verified, ["status", "checksum"], F.col("status") == "verifying"),
        changes.pull(lambda t: t.filter(F.col("size_bytes") % 10 == 3).select("run_number", "host", "status", "checksum")),
        changes.remove("site1", lambda t: t.filter(F.col("size_bytes") % 3 == 0).select("location"), "transferred"),
    ]


@query("m11_change_log", CHANGES_SQL.format(base="replicas") + """
SELECT run_number, pos, host, status, location, checksum FROM s4""", "replicas", "runs")
def m11(spark, sf):
    log = changes.ChangeLog(spark, scratch_dir(spark, "change-log"))
    log.create(base(spark, sf))
    for number, change in enumerate(_changes(spark, sf)):
        log.commit(change)
        if number == 1:
            log.compact()
    return log.read().select(*STATE)


@query("m12_interleaved_writers", """
, s0 AS (SELECT * FROM replicas WHERE NOT (host = 'site3' AND status = 'error'))
""" + CHANGES_SQL.format(base="s0") + """
SELECT run_number, pos, host, status, location, checksum FROM s2""", "replicas", "runs")
def m12(spark, sf):
    """Another site drops its failed copies after this one has read the table, and this one starts again."""
    log = changes.ChangeLog(spark, scratch_dir(spark, "two-writers"))
    log.create(base(spark, sf))
    pushing, verifying, *_ = _changes(spark, sf)
    met = []

    def late(table):
        if not met:
            met.append(log.commit(lambda t: changes.drop(t.filter("host = 'site3' AND status = 'error'").select("run_number", "pos"))))
        return pushing(table)

    log.commit(late)
    log.commit(verifying)
    return log.read().select(*STATE)


@query("m8_add_checksum", """
SELECT run_number, pos, host,
  CASE WHEN todo THEN CASE WHEN size_bytes % 2 = 0 THEN 'transferred' ELSE 'error' END ELSE status END AS status, location,
  CASE WHEN todo THEN CASE WHEN size_bytes % 2 = 0 THEN sha256(location) END ELSE checksum END AS checksum
FROM (SELECT *, host IN ('site2', 'site3') AND status = 'verifying' AS todo FROM replicas) r""", "replicas")
def m8(spark, sf):
    rows = base(spark, sf)
    digests = rows.filter(F.col("size_bytes") % 2 == 0).select("location", F.sha2("location", 256).alias("digest"))
    return op.add_checksum(rows, digests, "site2", ["site3"]).select(*STATE)


@query("m9_backfill_checksum", """
SELECT run_number, pos, host, status, location, CASE WHEN host = 'site1' AND status = 'transferred'
  THEN coalesce(checksum, CASE WHEN size_bytes % 2 = 0 THEN sha256(location) END) ELSE checksum END AS checksum
FROM replicas""", "replicas")
def m9(spark, sf):
    rows = base(spark, sf)
    digests = rows.filter(F.col("size_bytes") % 2 == 0).select("location", F.sha2("location", 256).alias("digest"))
    return op.backfill_checksum(rows, digests, "site0", "site1").select(*STATE)


@query("m10_nest_locations", """
, pushed AS (SELECT number, pos, host, status, location FROM nested_locations
  UNION ALL SELECT number, 9, 'site9', 'transferring', '/new' FROM runs WHERE number % 5 = 0),
first AS (SELECT number, min(pos) AS pos FROM pushed WHERE status = 'verifying' GROUP BY 1),
changed AS (SELECT p.number, count(*) AS n, string_agg(concat(host, ':', CASE WHEN f.pos IS NOT NULL THEN 'transferred'
    ELSE status END, ':', location), ';' ORDER BY p.pos) AS l
  FROM pushed p LEFT JOIN first f ON f.number = p.number AND f.pos = p.pos WHERE host <> 'site1' GROUP BY 1)
SELECT r.number, CASE WHEN r.number % 17 <> 0 OR r.number % 5 = 0 THEN coalesce(n, 0) END AS n_locations,
  CASE WHEN r.number % 17 <> 0 OR r.number % 5 = 0 THEN coalesce(l, '') END AS locations
FROM runs r LEFT JOIN changed c ON c.number = r.number""", "runs", "nested_locations")
def m10(spark, sf):
    runs = fx.nested_runs(spark, sf)
    new = runs.filter(F.col("number") % 5 == 0).select(
        F.col("number").alias("run_number"), F.lit(0).alias("ordinal"), F.lit("site9").alias("host"),
        F.lit("transferring").alias("status"), F.lit("/new").alias("location"))
    rows = op.push_locations(explode_locations(runs), new)
    done = op.first_match(rows, F.col("status") == "verifying").withColumn("status", F.lit("transferred"))
    rows = op.set_location(rows, done, ["status"]).filter(F.col("host") != "site1")
    words = F.transform("data", lambda d: F.concat_ws(":", d["host"], d["status"], d["location"]))
    return nest_locations(runs, rows).select(
        "number", F.when(F.col("data").isNotNull(), F.size("data")).cast("long").alias("n_locations"),
        F.array_join(words, ";").alias("locations"))
