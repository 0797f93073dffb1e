from pyspark.sql import functions as F

from .. import fixtures as fx
from ..constants import DERIVED_PRODUCTS
from ..operators.select import transfer_options
from ..plans import processing, purge, rules, transfer
from .joins import HERE_THERE_SQL, PRODUCT_VALUES, job_name, products_done
from .registry import query
from .selections import sites

NOW = fx.NOW
UPLOAD = (("site4", "rsync"), ("site1", "tape"), ("site5", "catalogue"))


def now():
    return fx.ntz(NOW)


@query("p1_stalled_transfers", f"""
, touched AS (SELECT location, CASE WHEN size_bytes % 3 = 0 THEN creation_time + INTERVAL 90 MINUTE
    ELSE creation_time END AS mtime FROM replicas WHERE size_bytes % 4 <> 0),
aged AS (SELECT r.*, epoch(TIMESTAMP '{NOW}') - epoch(greatest(coalesce(t.mtime, TIMESTAMP '1970-01-01'), creation_time)) AS age
  FROM replicas r LEFT JOIN touched t ON t.location = r.location
  WHERE r.host = 'site2' AND r.status NOT IN ('transferred', 'verifying'))
SELECT run_number, pos, type, status, location, age AS age_seconds, age > 7200 AS alert,
  CASE WHEN age > 86400 THEN 'timeout' WHEN status = 'error' THEN 'error' END AS reason,
  age > 86400 OR status = 'error' AS purge,
  (age > 86400 OR status = 'error') AND type = 'processed' AND coalesce(version = 'v1', false) AS delete_bytes
FROM aged""", "replicas")
def p1(spark, sf):
    rows = fx.replicas(spark, sf)
    late = F.when(F.col("size_bytes") % 3 == 0, F.col("creation_time") + F.expr("INTERVAL 90 MINUTE")).otherwise(
        F.col("creation_time"))
    touched = rows.filter(F.col("size_bytes") % 4 != 0).select(
        F.col("location").alias("path"), late.alias("modificationTime"))
    return purge.stalled_transfers(rows, touched, now(), "site2", "site0", "v1")


@query("p2_bad_checksum", """
SELECT r.run_number, r.pos, r.type, r.version, r.location, coalesce(g.good, 0) AS good,
  r.type = 'processed' OR coalesce(g.good, 0) > 1 AS purge
FROM replicas r JOIN masters m ON r.run_number = m.run_number AND r.type = m.type
  AND r.version IS NOT DISTINCT FROM m.version
LEFT JOIN good_copies g ON g.run_number = r.run_number AND g.type = r.type
WHERE r.host = 'site2' AND r.status = 'transferred' AND m.checksum IS NOT NULL
  AND r.checksum IS DISTINCT FROM m.checksum""", "good_copies")
def p2(spark, sf):
    return purge.bad_checksum_plan(fx.replicas(spark, sf), fx.MASTERS, "site2", fx.CATALOGUE)


@query("p3_buffer_purge", f"""
SELECT r.run_number, r.pos, r.type, r.location, g.good FROM replicas r
JOIN good_copies g ON g.run_number = r.run_number AND g.type = r.type
JOIN runs x ON x.number = r.run_number JOIN sites s ON s.name = r.host
WHERE r.host = 'site0' AND r.type <> 'processed' AND r.status = 'transferred' AND g.good >= 3 AND s.purge IS NOT NULL
  AND epoch(TIMESTAMP '{NOW}') - epoch(x.start_ts) > s.purge * 86400""", "good_copies", "runs", "sites")
def p3(spark, sf):
    return purge.buffer_purge_plan(fx.runs(spark, sf), fx.replicas(spark, sf), sites(spark, sf), fx.MASTERS, now(),
                                   "site0", fx.CATALOGUE)


@query("p4_processed_purge", """
SELECT run_number, pos, type, version, location FROM replicas
WHERE host = 'site2' AND type <> 'raw' AND version = 'v1'""", "replicas")
def p4(spark, sf):
    return purge.processed_purge_plan(fx.replicas(spark, sf), "site2", "v1")


@query("p5_catalogue_purge", """
, x AS (SELECT run_number, bool_or(host = 'site0' AND status = 'transferred') AS on_primary,
    bool_or(host = 'site1' AND status = 'transferred') AS on_tape,
    bool_or(host = 'site5' AND mask > 0) AS in_catalogue,
    count(*) FILTER (WHERE host = 'site0' AND status = 'transferred') AS n_primary FROM replicas
  WHERE host IN ('site0', 'site1', 'site5') GROUP BY 1),
p AS (SELECT run_number, checksum FROM replicas WHERE host = 'site0' AND status = 'transferred'
  QUALIFY row_number() OVER (PARTITION BY run_number ORDER BY pos DESC) = 1),
t AS (SELECT run_number, checksum FROM replicas WHERE host = 'site1' AND status = 'transferred'
  QUALIFY row_number() OVER (PARTITION BY run_number ORDER BY pos DESC) = 1)
SELECT x.run_number, on_primary, on_tape, coalesce(p.checksum = t.checksum, false) AS checksums_agree, in_catalogue,
  n_primary, on_primary AND on_tape AND in_catalogue AND coalesce(p.checksum = t.checksum, false) AS purge
FROM x LEFT JOIN p ON p.run_number = x.run_number LEFT JOIN t ON t.run_number = x.run_number""", "replicas")
def p5(spark, sf):
    return purge.catalogue_purge_plan(fx.replicas(spark, sf), fx.PRIMARY, fx.TAPE, fx.CATALOGUE)


def _upload_plan(spark, sf):
    return transfer.transfer_plan(fx.runs(spark, sf), fx.replicas(spark, sf), "site0", UPLOAD, "upload",
                                  ["raw"], "v1", now())


UPLOAD_SQL = HERE_THERE_SQL.format(where="type = 'raw'", here_ok="AND status = 'transferred'", there_ok="") + """
"""
PLAN_SQL = """
, pairs AS (""" + UPLOAD_SQL[UPLOAD_SQL.index("SELECT s.run_number"):] + """),
plan AS (SELECT p.*, r.location FROM pairs p JOIN replicas r ON r.run_number = p.run_number AND r.pos = p.here_pos
  WHERE p.there_pos IS NULL QUALIFY row_number() OVER (PARTITION BY p.run_number ORDER BY option) = 1)
"""
PLAN_SQL = UPLOAD_SQL[:UPLOAD_SQL.index("SELECT s.run_number")].rstrip() + PLAN_SQL


@query("p6_transfer_plan", PLAN_SQL + """
SELECT run_number, 'raw' AS type, remote, ['rsync', 'tape', 'catalogue'][option + 1] AS method, remote AS destination,
  here_pos AS source_pos, location AS source_location FROM plan""", "replicas")
def p6(spark, sf):
    return _upload_plan(spark, sf).select("run_number", "type", "remote", "method", "destination", "source_pos",
                                          "source_location")


@query("p7_destination_record", PLAN_SQL + f"""
SELECT run_number, 'raw' AS type, remote AS host, 'transferring' AS status,
  CASE WHEN remote = 'site5' THEN 'n/a' ELSE coalesce(s.dir_raw, 'none') || '/' || CAST(here_pos AS VARCHAR) END AS location,
  TIMESTAMP '{NOW}' AS creation_time
FROM plan LEFT JOIN sites s ON s.name = plan.remote""", "replicas", "sites")
def p7(spark, sf):
    rows = transfer.destination_record(_upload_plan(spark, sf), sites(spark, sf), now())
    return rows.select("run_number", "type", "host", "status", "location", "creation_time")


@query("p8_upload_candidates", """
, c AS (SELECT run_number, status FROM replicas WHERE host = 'site5'
  QUALIFY row_number() OVER (PARTITION BY run_number ORDER BY pos DESC) = 1),
h AS (SELECT run_number FROM replicas WHERE host = 'site0' GROUP BY 1
  HAVING bool_or(status = 'transferred') AND NOT bool_or(status = 'error'))
SELECT h.run_number, c.status AS catalogue_status FROM h LEFT JOIN c ON c.run_number = h.run_number
WHERE coalesce(c.status, '') NOT IN ('transferring', 'error', 'transferred')""", "replicas")
def p8(spark, sf):
    return transfer.upload_candidates(fx.replicas(spark, sf), "site0", fx.CATALOGUE)


@query("p9_tape_candidates", """
SELECT run_number, true AS here, false AS on_tape FROM replicas GROUP BY 1
HAVING bool_or(host = 'site0' AND status = 'transferred')
  AND NOT bool_or(host = 'site1' AND status IN ('transferred', 'transferring'))""", "replicas")
def p9(spark, sf):
    return transfer.tape_candidates(fx.replicas(spark, sf), "site0", fx.TAPE, "upload")


@query("p10_processing_plan", """
SELECT r.number, r.name, h.location AS in_location,
  '/out/pax_v1/' || r.name || CASE WHEN detector = 'muon_veto' THEN '_MV' ELSE '' END || '.root' AS out_location,
  CASE WHEN events_built < 1000 THEN 1 ELSE 7 END AS ncpus,
  CASE WHEN detector = 'muon_veto' THEN 'veto' WHEN self_trigger THEN 'self_trigger' ELSE 'led' END AS profile,
  CASE WHEN detector = 'muon_veto' THEN 'BSON.DecodeZBSON' ELSE 'Pickle.DecodeZPickle' END AS decoder
FROM runs r JOIN (SELECT run_number, location FROM replicas WHERE host = 'site2' AND type = 'raw' AND status = 'transferred'
  QUALIFY row_number() OVER (PARTITION BY run_number ORDER BY pos DESC) = 1) h ON h.run_number = r.number
WHERE NOT skip AND has_params AND write_mode = 2 AND events_built <> 0
  AND concat('job_', CAST(number AS VARCHAR)) NOT IN (SELECT job_name FROM queue)
  AND number NOT IN (SELECT run_number FROM replicas WHERE host = 'site2' AND type = 'processed' AND version = 'v1')""",
       "runs", "replicas", "queue")
def p10(spark, sf):
    return processing.processing_plan(fx.runs(spark, sf), fx.replicas(spark, sf), fx.queue(spark, sf), job_name(),
                                      "site2", "v1", 8, "/out")


@query("p11_product_plan", f"""
SELECT r.number, r.name, p.product, '/site2/processed/' || CAST(r.number AS VARCHAR) AS in_location,
  '/mini/pax_v1/' || r.name || '_' || p.product || '.root' AS out_location
FROM runs r CROSS JOIN (VALUES {PRODUCT_VALUES}) p(product)
WHERE r.number IN (SELECT run_number FROM replicas WHERE host = 'site2' AND type = 'processed' AND version = 'v1'
    AND status = 'transferred')
  AND concat('job_', CAST(r.number AS VARCHAR)) NOT IN (SELECT job_name FROM queue)
  AND (r.number, p.product) NOT IN (SELECT (l_orderkey, ([{PRODUCT_VALUES.replace('(', '').replace(')', '')}])
    [CAST(l_partkey % {len(DERIVED_PRODUCTS)} AS INTEGER) + 1]) FROM lineitem)""", "runs", "replicas", "queue")
def p11(spark, sf):
    return processing.product_plan(fx.runs(spark, sf), fx.replicas(spark, sf), fx.queue(spark, sf), job_name(),
                                   products_done(spark, sf), "site2", "v1", "/mini")


TARGET_SQL = """
, targets AS (
  SELECT m.number, m.rule_id, e.rse, CASE WHEN d.verification_only THEN '-2'
      WHEN e.rse = 'rse0' THEN d.live0 ELSE '-1' END AS lifetime,
    CASE WHEN d.removes AND NOT d.verification_only THEN 'rse1' ELSE '' END AS remove
  FROM matches m JOIN rule_defs d ON d.rule_id = m.rule_id
  JOIN (VALUES ('rse0'), ('rse1'), ('rse2'), ('rse3')) e(rse)
    ON d.verification_only OR e.rse = 'rse0' OR e.rse = concat('rse', CAST(d.s % 3 + 1 AS VARCHAR))
  UNION ALL
  SELECT r.number, NULL, e.rse, '-2', '' FROM runs r CROSS JOIN (VALUES ('rse0'), ('rse1'), ('rse2'), ('rse3')) e(rse)
  WHERE r.number NOT IN (SELECT number FROM matches))
"""


def _targets(spark, sf, per_run=None, per_target=None):
    return rules.rule_targets(fx.runs(spark, sf), fx.rules(spark, sf), fx.RSES, per_run, per_target)


@query("p12_rule_targets", TARGET_SQL + "SELECT number, rule_id, rse, lifetime, remove FROM targets",
       "matches", "rule_defs")
def p12(spark, sf):
    return _targets(spark, sf).withColumn("remove", F.concat_ws(",", "remove"))


ONE_RULE = ("SELECT did, rse, arg_max(rule_id, (seq, rule_id)) AS rule_id, arg_max(status, (seq, rule_id)) AS status "
            "FROM rule_listing GROUP BY 1, 2")


def _one_rule(spark, sf):
    """Existing rule per (did, endpoint): the last listed one."""
    order = F.struct("seq", "rule_id")
    listed = fx.rule_listing(spark, sf).select("did", "rse", "rule_id", "status", "seq").repartition("did")
    return listed.groupBy(F.xxhash64("did").alias("_hash"), "did", "rse").agg(
        F.max_by("rule_id", order).alias("rule_id"), F.max_by("status", order).alias("status")).drop("_hash")


@query("p13_rule_actions", TARGET_SQL + f"""
, known AS ({ONE_RULE})
SELECT t.number, t.rule_id AS rule, t.rse, t.lifetime, k.status AS rule_status,
  CASE WHEN t.remove <> '' OR t.number % 6 = 0 THEN 'skip'
    WHEN k.rule_id IS NOT NULL THEN CASE WHEN k.status = 'OK' THEN CASE WHEN t.lifetime = '3600' THEN 'update' ELSE 'keep' END
      ELSE 'wait' END
    WHEN t.lifetime = '-2' THEN 'verify' WHEN t.lifetime = '-1' THEN 'add_permanent' ELSE 'add_lifetime' END AS action
FROM targets t LEFT JOIN known k ON k.did = concat('scope:', CAST(t.number AS VARCHAR)) AND k.rse = t.rse""",
       "matches", "rule_defs", "rule_listing")
def p13(spark, sf):
    def known(members):
        named = members.withColumn("did", F.concat(F.lit("scope:"), F.col("number").cast("string")))
        return rules.with_known(named, _one_rule(spark, sf)).drop("did")

    def actions(targets):
        status = F.when(F.col("number") % 6 == 0, "error").otherwise("transferred")
        return rules.rule_actions(targets.withColumn("status", status)).drop("rule_id")

    out = _targets(spark, sf, known, actions)
    return out.select("number", F.col("rule_id").alias("rule"), "rse", "lifetime", "rule_status", "action")


@query("p14_roundtrip_verdict", """
, a AS (SELECT path AS dataset, sha256(text) AS before, CASE WHEN length % 5 = 0 THEN 'broken' ELSE sha256(text) END AS after,
    length FROM files)
SELECT dataset, before, CASE WHEN length % 7 <> 0 THEN after END AS after,
  CASE WHEN length % 7 <> 0 AND before = after AND before <> sha256('') THEN 'transferred' ELSE 'error' END AS status
FROM a""", "files")
def p14(spark, sf):
    files = fx.files(spark, sf)
    before = files.select(F.col("path").alias("dataset"), F.sha2("content", 256).alias("digest"))
    after = files.filter(F.col("length") % 7 != 0).select(
        F.col("path").alias("dataset"),
        F.when(F.col("length") % 5 == 0, "broken").otherwise(F.sha2("content", 256)).alias("digest"))
    return purge.roundtrip_verdict(before, after, F.sha2(F.lit("").cast("binary"), 256))


@query("p15_restore_plan", """
SELECT r.run_number, r.pos, r.location, '/raw/' || x.name || CASE WHEN x.detector = 'muon_veto' THEN '_MV' ELSE '' END AS target,
  CASE WHEN r.mask & 4 <> 0 THEN 'rse2' END AS rse,
  CASE WHEN '/raw/' || x.name || CASE WHEN x.detector = 'muon_veto' THEN '_MV' ELSE '' END IN
    (SELECT '/raw/' || name FROM runs WHERE number % 3 = 0) THEN 'overwrite_request' ELSE 'download' END AS status
FROM replicas r JOIN runs x ON x.number = r.run_number
WHERE r.host = 'site5' AND r.type = 'raw'
  AND r.run_number NOT IN (SELECT run_number FROM replicas WHERE host = 'site2' AND type = 'raw')""", "replicas", "runs")
def p15(spark, sf):
    runs = fx.runs(spark, sf)
    present = runs.filter(F.col("number") % 3 == 0).select(F.concat(F.lit("/raw/"), "name").alias("path"))
    return transfer.restore_plan(runs, fx.replicas(spark, sf), present, "site2", fx.CATALOGUE, "/raw", "raw", "rse2")


@query("p16_single_file_rules", """
SELECT l.dir AS dataset, l.path AS did, 'rse0' AS rse, l.fingerprint AS rule_id, 10 AS lifetime,
  coalesce(c.copies, 0) AS copies
FROM listing l LEFT JOIN (SELECT replace(did, 'scope:', '/raw/') AS dataset,
  count(*) FILTER (WHERE length(rule_id) = 32) AS copies FROM rule_listing GROUP BY 1) c ON c.dataset = l.dir""",
       "listing", "rule_listing")
def p16(spark, sf):
    file_rules = fx.listing(spark, sf).select(
        F.col("dir").alias("dataset"), F.col("path").alias("did"), F.lit("rse0").alias("rse"),
        F.col("fingerprint").alias("rule_id"))
    dataset_rules = fx.rule_listing(spark, sf).withColumn("did", F.regexp_replace("did", "scope:", "/raw/"))
    return rules.single_file_rule_plan(file_rules, dataset_rules)


def configured_upload(spark, sf, host="site2"):
    """Remotes of a site as its configuration lists them."""
    return transfer.configured_remotes(transfer_options(sites(spark, sf), host, "upload"))
