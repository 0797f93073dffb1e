from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import endpoints as op
from .registry import query

COLUMNS = "SELECT run_number, pos, status, location, rse_text AS rse FROM replicas WHERE host = 'site5'"


@query("r1_rse_copies", COLUMNS + " AND bit_count(mask) = 2 AND status = 'transferred'", "replicas")
def r1(spark, sf):
    return op.rse_copies(fx.replicas(spark, sf), 2, "transferred")


@query("r2_rse_single", COLUMNS + " AND mask = 2", "replicas")
def r2(spark, sf):
    return op.rse_single(fx.replicas(spark, sf), ["rse1"])


@query("r3_rse_multiple", COLUMNS + " AND mask & 6 = 6 AND bit_count(mask) <> 1", "replicas")
def r3(spark, sf):
    return op.rse_multiple(fx.replicas(spark, sf), ["rse1", "rse2"])


@query("r4_rse_report", COLUMNS + " AND status = 'verifying'", "replicas")
def r4(spark, sf):
    return op.rse_report(fx.replicas(spark, sf), "verifying")


@query("r5_rse_remaining", """
SELECT run_number, pos, mask & 5 = 5 AS applied, concat_ws(',',
  CASE WHEN mask & 1 <> 0 AND mask & 5 <> 5 THEN 'rse0' END, CASE WHEN mask & 2 <> 0 THEN 'rse1' END,
  CASE WHEN mask & 4 <> 0 AND mask & 5 <> 5 THEN 'rse2' END, CASE WHEN mask & 8 <> 0 THEN 'rse3' END) AS remaining
FROM replicas WHERE host = 'site5'""", "replicas")
def r5(spark, sf):
    rows = op.rse_remaining(fx.replicas(spark, sf), ["rse0", "rse2"])
    return rows.select("run_number", "pos", "applied", F.concat_ws(",", "remaining").alias("remaining"))


@query("r6_rse_refresh", """
, last AS (SELECT did, rse, arg_max(status, (seq, rule_id)) AS status, arg_max(expires, (seq, rule_id)) AS expires
  FROM rule_listing GROUP BY did, rse)
SELECT did, coalesce(string_agg(rse, ',' ORDER BY rse) FILTER (WHERE status = 'OK'), '') AS rse,
  coalesce(string_agg(rse || ':' || expires, ',' ORDER BY rse) FILTER (WHERE status = 'OK'), '') AS rule_info
FROM last GROUP BY did""", "rule_listing")
def r6(spark, sf):
    listing = fx.rule_listing(spark, sf).withColumn("seq", F.struct("seq", "rule_id"))
    return op.rse_refresh(listing, fx.RSES).select(
        "did", F.concat_ws(",", "rse").alias("rse"), F.concat_ws(",", "rule_info").alias("rule_info"))


@query("r7_choose_rse", """
SELECT c_custkey AS rule_id, 'rse0,' || ['a', 'b', 'c'][
  ('0x' || substr(md5('seed:' || CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 3 + 1] AS destination_rse,
  '-1' AS lifetime FROM customer""")
def r7(spark, sf):
    random = F.lit("random: a, b, c")
    rules = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("rule_id"), F.array(F.lit("rse0"), random).alias("destination_rse"),
        F.create_map(F.lit("rse0"), F.lit("0"), random, F.lit("-1")).alias("destination_livetime"))
    chosen = op.choose_rse(rules, "seed")
    picked = F.col("destination_rse")[1]
    return chosen.select("rule_id", F.concat_ws(",", "destination_rse").alias("destination_rse"),
                         F.col("destination_livetime")[picked].alias("lifetime"))


@query("r8_rules_by_did", """
, dids AS (SELECT concat('scope:', CAST(o_orderkey AS VARCHAR)) AS did FROM orders)
SELECT d.did, r.rse, r.rule_id, r.expires FROM dids d LEFT JOIN rule_listing r ON r.did = d.did""", "rule_listing")
def r8(spark, sf):
    dids = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("scope:"), F.col("o_orderkey").cast("string")).alias("did"))
    return op.rules_by_did(dids, fx.rule_listing(spark, sf))


@query("r9_replica_paths", """
SELECT dir AS dataset, name, name || '|' || fingerprint || '|' || path AS entry FROM listing WHERE length % 2 = 0""",
       "listing")
def r9(spark, sf):
    rse = F.when(F.col("length") % 2 == 0, "rse0").otherwise("rse1")
    files = fx.listing(spark, sf).select(F.col("dir").alias("dataset"), "name", F.col("fingerprint").alias("checksum"),
                                         "path", rse.alias("rse"))
    return op.replica_paths(files, "rse0")
