from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import fingerprints, names
from .registry import query


@query("e1_adler32", """
, hexes AS (SELECT path, length AS n, regexp_extract_all(hex(encode(text)), '..') AS l FROM files WHERE length > 0),
bytes AS (SELECT path, n, generate_subscripts(l, 1) - 1 AS i, ('0x' || unnest(l))::BIGINT AS b FROM hexes),
sums AS (SELECT path, any_value(n) AS n, sum(b) AS s, sum((n - i) * b) AS w FROM bytes GROUP BY path)
SELECT path, lower(lpad(to_hex(CAST(((n + w) % 65521) * 65536 + (1 + s) % 65521 AS BIGINT)), 8, '0')) AS fingerprint
FROM sums UNION ALL SELECT path, '00000001' FROM files WHERE length = 0""", "files")
def e1(spark, sf):
    return fingerprints.fingerprint(fx.files(spark, sf), "adler32").select("path", "fingerprint")


@query("e2_crc32", """
, steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT path, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM files)
SELECT path, to_hex(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])))::BIGINT) AS fingerprint FROM bytes, steps""", "files")
def e2(spark, sf):
    return fingerprints.fingerprint(fx.files(spark, sf), "crc32").select("path", "fingerprint")


@query("e3_sha", "SELECT path, sha256(text) AS fingerprint FROM files", "files")
def e3(spark, sf):
    return fingerprints.fingerprint(fx.files(spark, sf), "sha256").select("path", "fingerprint")


@query("e4_science_run", """
SELECT number, CASE WHEN start_ts <= TIMESTAMP '1996-06-01 00:00:00' THEN 'SR000'
  WHEN start_ts <= TIMESTAMP '1997-06-01 00:00:00' THEN 'SR00X' ELSE 'SR001' END AS science_run FROM runs""", "runs")
def e4(spark, sf):
    cuts = (("1996-06-01 00:00:00", "SR000"), ("1997-06-01 00:00:00", "SR00X"))
    return names.with_science_run(fx.runs(spark, sf), cuts).select("number", "science_run")


@query("e5_run_name_time", """
SELECT number, strptime(name, '%y%m%d_%H%M') AS run_time, strftime(start_ts, '%y%m%d_%H%M') AS run_name FROM runs""",
       "runs")
def e5(spark, sf):
    return names.with_run_name(names.with_run_time(fx.runs(spark, sf))).select("number", "run_time", "run_name")


@query("e6_dataset_names", """
SELECT number, 'x1_SR000' AS basic_scope, 'x1_SR000_' || strftime(start_ts, '%y%m%d_%H%M') || '_' ||
  CASE WHEN detector = 'muon_veto' THEN 'mv' ELSE detector END AS scope, 'x1_SR000_data' AS super_container
FROM runs""", "runs")
def e6(spark, sf):
    return names.dataset_names(fx.runs(spark, sf), "x1").select("number", "basic_scope", "scope", "super_container")


@query("e7_metadata_tags", """
, f AS (SELECT run_number, bool_or(starts_with(host, 'site2') AND starts_with(status, 'transferred')
    AND starts_with(type, 'processed')) AS moved FROM replicas GROUP BY 1),
v AS (SELECT run_number, CASE WHEN starts_with(host, 'site2') AND starts_with(status, 'transferred') AND type = 'processed'
    THEN version END AS version FROM replicas QUALIFY row_number() OVER (PARTITION BY run_number ORDER BY pos) = 1)
SELECT r.number, r.owner AS phys_group, CASE WHEN detector = 'muon_veto' THEN 'mv' ELSE detector END AS provenance,
  source_type AS datatype, 'SR001' AS campaign, CASE WHEN f.moved THEN 'processed' ELSE 'undefined' END AS prod_step,
  coalesce(v.version, 'None') AS version
FROM runs r JOIN f ON f.run_number = r.number JOIN v ON v.run_number = r.number""", "runs", "replicas")
def e7(spark, sf):
    return names.metadata_tags(fx.runs(spark, sf), fx.replicas(spark, sf), "site2", "processed", "001")


@query("e8_identifiers", """
SELECT did, 'scope' AS scope, split_part(did, ':', 2) AS name, location,
  regexp_extract(location, '[^/]*$') AS basename, regexp_extract(location, '^(.*)/[^/]*$', 1) AS dirname
FROM (SELECT concat('scope:', CAST(run_number AS VARCHAR)) AS did, location FROM replicas) x""", "replicas")
def e8(spark, sf):
    rows = fx.replicas(spark, sf).select(
        F.concat(F.lit("scope:"), F.col("run_number").cast("string")).alias("did"), "location")
    return names.path_parts(names.split_did(rows, "did"), "location")


@query("e9_tape_names", """
SELECT path, dir || '_' || name AS tape_name, substr(name, 13) AS restored_name FROM listing""", "listing")
def e9(spark, sf):
    return names.tape_names(fx.listing(spark, sf), "dir").select("path", "tape_name", "restored_name")


@query("e18_alert_record", """
SELECT CAST(json_object('detector', detector, 'name', name, 'number', number) AS VARCHAR) AS record FROM runs""", "runs")
def e18(spark, sf):
    return names.alert_record(fx.runs(spark, sf).select("number", "name", "detector"))
