"""Catalogue-shaped views over the test tables, as DataFrames and as SQL for the oracle.

All views are row-wise projections (``rse_sets`` is the one aggregate).  ``pos`` is a
sparse ordinal, total within a run, so no view sorts or collects a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIMARY, TAPE, PROC_A, PROC_B, REMOTE, CATALOGUE = (f"site{i}" for i in range(6))
MASTERS = (("raw", PRIMARY, False), ("raw", TAPE, False), ("processed", PROC_A, True), ("processed", PROC_B, True))
NOW = "1998-12-01 00:00:00"
RSES = ("rse0", "rse1", "rse2", "rse3")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue runs with the declared nested columns, without ``data``."""
    key = F.col("o_orderkey")
    name = _text(F.date_format("o_orderdate", "yyMMdd"), "_", F.lpad((key % 24).cast("string"), 2, "0"),
                 F.lpad((key % 60).cast("string"), 2, "0"))
    skip = F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.lit("donotprocess").alias("name")))
    keep = F.array(F.struct(F.col("o_orderpriority").alias("name")))
    params = F.map_from_arrays(
        F.array(F.lit("gains"), F.lit("drift_velocity_liquid"), F.lit("electron_lifetime_liquid")),
        F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return table(spark, sf, "orders").select(
        key.alias("number"), name.alias("name"),
        F.when(key % 10 == 0, "muon_veto").otherwise("tpc").alias("detector"),
        F.col("o_orderdate").alias("start"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("end"),
        _text("user", (F.col("o_custkey") % 10).cast("string")).alias("user"),
        F.struct(F.when(key % 3 == 0, "AmBe").otherwise("Rn220").alias("type")).alias("source"),
        F.when(key % 50 == 0, skip).otherwise(keep).alias("tags"),
        F.struct((F.col("o_custkey") * 10).alias("events_built")).alias("trigger"),
        F.struct((key % 4 != 0).alias("self_trigger"),
                 F.struct(F.when(key % 9 == 0, 1).otherwise(2).alias("write_mode"),
                          F.when(key % 3 == 0, 500).alias("events_per_file")).alias("ini")).alias("reader"),
        F.when(key % 5 == 0, key * 1000).alias("raw_size_byte"),
        F.when(key % 8 != 0, params).alias("params"),
        F.lit(None).cast("array<double>").alias("gains"),
        F.when(key % 3 == 0, F.create_map(F.lit("drift"), _text("Brand#", (F.col("o_custkey") % 25).cast("string"))))
        .alias("correction_versions"),
    )


def nested_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with an embedded array of up to four locations; every 17th has none."""
    key = F.col("number")

    def location(i):
        host = (key + i) % 6
        return F.struct(
            _text("site", host.cast("string")).alias("host"),
            F.when(i % 2 == 0, "raw").otherwise("processed").alias("type"),
            F.when((key + i) % 3 == 0, "verifying").otherwise("transferred").alias("status"),
            _text("/site", host.cast("string"), "/", key.cast("string"), "/", i.cast("string")).alias("location"),
            F.when((key + i) % 4 != 0, _text("ok", key.cast("string"))).alias("checksum"),
            ((key + i) % 7 != 0).alias("has_checksum"),
            F.col("start").alias("creation_time"), F.lit(None).cast("string").alias("creation_place"),
            F.when(i % 2 == 1, "v1").alias("pax_version"), F.lit(None).cast("string").alias("pax_hash"),
            F.when(i % 2 == 1, key * 10 + i).alias("size"), F.lit(None).cast("boolean").alias("checksumproblem"),
            F.lit(None).cast("array<string>").alias("rse"), F.lit(None).cast("array<string>").alias("rule_info"))

    data = F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), location)
    return runs(spark, sf).withColumn("data", F.when(key % 17 != 0, data))


def replicas(spark: SparkSession, sf: str) -> DataFrame:
    """Flat replica table: one row per (run_number, pos)."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    q = F.col("l_quantity").cast("int")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    pos = (line.cast("long") * F.lit(10 ** 18) + (part % 10 ** 8) * F.lit(10 ** 10)
           + (cents % 10 ** 8) * F.lit(100) + q.cast("long"))
    processed = F.col("l_returnflag") == "R"
    kind = F.when(processed, "processed").otherwise("raw")
    status = (F.when(line == 5, "verifying").when(line == 6, "transferring").when(line == 7, "error")
              .otherwise("transferred"))
    host = _text("site", (supp % 6).cast("string"))
    run = F.col("l_orderkey")
    checksum = F.when(status.isin("transferred", "verifying") & (q % 11 != 0),
                      F.when(q % 5 == 0, _text("bad", part.cast("string")))
                      .otherwise(_text("ok", run.cast("string"))))
    held = F.array_compact(F.array(*[F.when(part.bitwiseAND(1 << i) != 0, r) for i, r in enumerate(RSES)]))
    return table(spark, sf, "lineitem").select(
        run.alias("run_number"), pos.alias("pos"), host.alias("host"), kind.alias("type"),
        F.when(processed, _text("v", (part % 3).cast("string"))).alias("version"), status.alias("status"),
        F.col("l_shipdate").alias("creation_time"), cents.alias("size_bytes"), checksum.alias("checksum"),
        (q % 13 != 0).alias("has_checksum"),
        _text("/", host, "/", kind, "/", run.cast("string"), "/", pos.cast("string")).alias("location"),
        F.when(supp % 6 == 5, held).alias("rse"),
    )


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Files found on disk: every line item is one file of its run's raw directory."""
    return table(spark, sf, "lineitem").select(
        _text("/raw/", _s("l_orderkey")).alias("dir"),
        _text("f", _s("l_partkey"), "_", _s("l_suppkey"), "_", _s("l_linenumber")).alias("name"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("length"),
        F.col("l_shipdate").alias("modificationTime"),
        F.lower(F.hex((F.col("l_partkey") % 50))).alias("fingerprint"),
        (F.col("l_quantity").cast("int") == 50).alias("is_dir"),
    ).withColumn("path", F.concat_ws("/", "dir", "name"))


def raw_locations(spark: SparkSession, sf: str) -> DataFrame:
    """One raw location per run, in the directory that ``listing`` fills."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("run_number"), F.lit(0).cast("long").alias("pos"), F.lit(PRIMARY).alias("host"),
        F.lit("raw").alias("type"), F.lit(None).cast("string").alias("version"),
        F.when(key % 7 == 0, "verifying").otherwise("transferred").alias("status"),
        F.col("o_orderdate").alias("creation_time"), F.lit(None).cast("long").alias("size_bytes"),
        F.lit(None).cast("string").alias("checksum"), F.lit(False).alias("has_checksum"),
        _text("/raw/", key.cast("string")).alias("location"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files with content, one directory per source."""
    return table(spark, sf, "documents").select(
        _text(F.col("source"), "/doc", _s("doc_id")).alias("path"), F.col("source").alias("dir"),
        _text("doc", _s("doc_id")).alias("name"), F.octet_length("text").cast("long").alias("length"),
        F.encode("text", "UTF-8").alias("content"))


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Half-open number ranges, some overlapping: the lowest pos wins."""
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        p.alias("pos"), (p * 10).alias("min"), (p * 10 + F.col("p_size")).alias("max"), F.col("p_name").alias("value"))


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_type").alias("kind"),
        (ntz("2017-01-01 00:00:00") + F.make_dt_interval(secs=p.cast("decimal(18,6)"))).alias("calculation_time"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("version"),
        _text(F.col("p_size").cast("string"), " * v + 0.5").alias("function"),
        F.col("p_retailprice").alias("c0"), F.col("p_size").cast("double").alias("c1"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("ts", F.col("event_type").alias("sensor"), "value")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Run-like intervals of one hour."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("number"), F.col("ts").alias("start"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end"))


def status_of(event_type: Column) -> Column:
    return (F.when(event_type == "click", "transferring").when(event_type == "view", "verifying")
            .when(event_type == "purchase", "transferred").when(event_type == "error", "error").otherwise("failed"))


def status_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("replica_id"), status_of(F.col("event_type")).alias("status"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Transfer logs, one file per run; the kind of line follows from the ordinal."""
    size, kind = F.col("size_bytes"), F.col("pos") % 8
    unit = F.when(size % 3 == 0, "KB").when(size % 3 == 1, "MB").otherwise("GB")
    line = (F.when(kind == 0, _text("Transferred amount of data: ", size.cast("string"), " ", unit))
            .when(kind == 1, _text("Number of uploaded files: ", (size % 97).cast("string")))
            .when(kind == 2, "ERROR [There is not enough quota left to fulfil the operation.")
            .when(kind == 3, "Upload to tape: [succcessful]")
            .when(kind == 4, _text("Number of inspected files: ", (size % 89).cast("string")))
            .when(kind == 5, _text("Network transfer rate: ", (size % 5000).cast("string"), ".50 kB/sec"))
            .when(kind == 6, _text("run [INFO] tsm upload dataset 160824_0125 took ", (size % 600).cast("string"),
                                   " seconds"))
            .otherwise("ERROR [('Connection aborted.', BadStatusLine('',))]"))
    return replicas(spark, sf).select(F.col("run_number").alias("file"), F.col("pos").alias("line_no"),
                                      line.alias("line"))


def rse_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoints per run; at most four distinct values, so the set stays bounded."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_number")).agg(
        F.array_sort(F.collect_set(_text("rse", (F.col("l_partkey") % 4).cast("string")))).alias("rse"))


def queue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter(F.col("o_orderkey") % 7 == 0).select(
        _text("job_", _s("o_orderkey")).alias("job_name"))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Site configuration derived from nations; names repeat, so the first entry counts."""
    n = F.col("n_nationkey")
    site = (n % 6).cast("string")
    options = F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")),
                          lambda i: _text("site", ((n + i) % 6).cast("string")))
    return table(spark, sf, "nation").select(
        n.cast("long").alias("pos"), _text("site", site).alias("name"),
        F.when(n % 6 == 1, "tape").when(n % 6 == 5, "catalogue").otherwise("rsync").alias("method"),
        _text("host-", F.col("n_name")).alias("hostname"),
        _text("/data/", site, "/raw").alias("dir_raw"),
        F.when(n % 6 != 0, _text("/data/", site, "/processed")).alias("dir_processed"),
        F.when(n % 6 < 4, _text("/data/", site, "/minitrees")).alias("dir_minitrees"),
        F.when(n % 6 != 3, options).alias("upload_options"),
        F.when(n % 6 != 1, F.array(F.lit(PRIMARY), F.lit(TAPE))).alias("download_options"),
        F.when(n % 2 == 0, (n % 6 + 2).cast("int")).alias("purge"),
        F.when(n % 6 == 2, "v1").alias("pax_version_purge"),
        F.when(n % 6 == 0, 2).alias("nstreams"))


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """Transfer rules derived from suppliers."""
    s = F.col("s_suppkey")
    low = s * 150
    numbers = (F.when(s % 4 == 0, _text(low.cast("string"), "-", (low + 40).cast("string"), ", ",
                                        (low + 90).cast("string")))
               .when(s % 4 == 1, low.cast("string"))
               .when(s % 4 == 2, (low + 7).cast("string"))
               .when(s != 3, _text(low.cast("string"), " - ", (low + 60).cast("string"))))
    day = F.date_add(F.lit("1996-01-01").cast("date"), (s % 700).cast("int"))
    names = (F.when(s % 4 == 2, _text(F.date_format(day, "yyMMdd"), "_0000-",
                                                F.date_format(F.date_add(day, 2), "yyMMdd"), "_2359"))
             .when(s % 4 == 1, _text(F.date_format(day, "yyMMdd"), "_0101, 970101_0505")))
    live = F.when(s % 3 == 0, "-1").when(s % 3 == 1, "3600").otherwise("0")
    return table(spark, sf, "supplier").select(
        s.alias("rule_id"), (s % 7 == 6).alias("verification_only"), numbers.alias("run_nb"),
        F.lit(None).cast("string").alias("run_nb_exclude"), names.alias("run_name"),
        F.lit(None).cast("string").alias("run_name_exclude"),
        F.array(F.lit("rse0"), _text("rse", (s % 3 + 1).cast("string"))).alias("destination_rse"),
        F.map_from_arrays(F.array(F.lit("rse0"), _text("rse", (s % 3 + 1).cast("string"))),
                          F.array(live, F.lit("-1"))).alias("destination_livetime"),
        F.when(s % 9 == 8, F.array(F.lit("rse1"))).alias("remove_rse"))


def rule_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Existing rules at endpoints, one per line item."""
    part = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        _text("scope:", _s("l_orderkey")).alias("did"),
        F.when(part % 5 == 0, F.md5(_s("l_partkey"))).otherwise(_text("r", _s("l_partkey"))).alias("rule_id"),
        _text("rse", (part % 4).cast("string")).alias("rse"),
        F.when(part % 3 == 0, "OK").when(part % 3 == 1, "REPLICATING").otherwise("STUCK").alias("status"),
        F.when(part % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd_HH:mm:ss")).otherwise("valid")
        .alias("expires"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("seq"))


# ---------------------------------------------------------------------------
# The same views as SQL.

_SQL = {
    "runs": """
SELECT o_orderkey AS number,
  concat(strftime(o_orderdate,'%y%m%d'), '_', lpad(CAST(o_orderkey % 24 AS VARCHAR),2,'0'),
         lpad(CAST(o_orderkey % 60 AS VARCHAR),2,'0')) AS name,
  CASE WHEN o_orderkey % 10 = 0 THEN 'muon_veto' ELSE 'tpc' END AS detector,
  o_orderdate AS start_ts,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 HOUR END AS end_ts,
  concat('user', CAST(o_custkey % 10 AS VARCHAR)) AS owner,
  CASE WHEN o_orderkey % 3 = 0 THEN 'AmBe' ELSE 'Rn220' END AS source_type,
  o_orderpriority AS tag, o_orderkey % 50 = 0 AS skip, o_custkey * 10 AS events_built,
  o_orderkey % 4 <> 0 AS self_trigger, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 2 END AS write_mode,
  CASE WHEN o_orderkey % 3 = 0 THEN 500 END AS events_per_file,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 1000 END AS raw_size_byte,
  o_orderkey % 8 <> 0 AS has_params,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('Brand#', CAST(o_custkey % 25 AS VARCHAR)) END AS drift_version
FROM orders""",
    "nested_locations": """
SELECT number, i AS pos, concat('site', CAST((number+i) % 6 AS VARCHAR)) AS host,
  CASE WHEN i % 2 = 0 THEN 'raw' ELSE 'processed' END AS type,
  CASE WHEN (number+i) % 3 = 0 THEN 'verifying' ELSE 'transferred' END AS status,
  concat('/site', CAST((number+i) % 6 AS VARCHAR), '/', CAST(number AS VARCHAR), '/', CAST(i AS VARCHAR)) AS location,
  CASE WHEN (number+i) % 4 <> 0 THEN concat('ok', CAST(number AS VARCHAR)) END AS checksum,
  (number+i) % 7 <> 0 AS has_checksum, CASE WHEN i % 2 = 1 THEN 'v1' END AS version,
  CASE WHEN i % 2 = 1 THEN number * 10 + i END AS size_bytes, start_ts AS creation_time
FROM (SELECT number, start_ts, unnest(range(0, number % 4 + 1)) AS i FROM runs WHERE number % 17 <> 0) x""",
    "replicas": """
SELECT run_number, pos, host, type, version, status, creation_time, size_bytes,
  CASE WHEN status IN ('transferred','verifying') AND q % 11 <> 0
       THEN CASE WHEN q % 5 = 0 THEN concat('bad', CAST(l_partkey AS VARCHAR))
                 ELSE concat('ok', CAST(run_number AS VARCHAR)) END END AS checksum,
  q % 13 <> 0 AS has_checksum,
  concat('/', host, '/', type, '/', CAST(run_number AS VARCHAR), '/', CAST(pos AS VARCHAR)) AS location,
  l_partkey % 16 AS mask,
  concat_ws(', ', CASE WHEN l_partkey & 1 <> 0 THEN 'rse0' END, CASE WHEN l_partkey & 2 <> 0 THEN 'rse1' END,
            CASE WHEN l_partkey & 4 <> 0 THEN 'rse2' END, CASE WHEN l_partkey & 8 <> 0 THEN 'rse3' END) AS rse_text
FROM (SELECT l_orderkey AS run_number,
    CAST(l_linenumber AS BIGINT) * 1000000000000000000 + (l_partkey % 100000000) * 10000000000
      + (CAST(round(l_extendedprice * 100) AS BIGINT) % 100000000) * 100 + CAST(l_quantity AS INT) AS pos,
    concat('site', CAST(l_suppkey % 6 AS VARCHAR)) AS host,
    CASE WHEN l_returnflag = 'R' THEN 'processed' ELSE 'raw' END AS type,
    CASE WHEN l_returnflag = 'R' THEN concat('v', CAST(l_partkey % 3 AS VARCHAR)) END AS version,
    CASE WHEN l_linenumber = 5 THEN 'verifying' WHEN l_linenumber = 6 THEN 'transferring'
         WHEN l_linenumber = 7 THEN 'error' ELSE 'transferred' END AS status,
    l_shipdate AS creation_time, CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes,
    l_partkey, CAST(l_quantity AS INT) AS q
  FROM lineitem) t""",
    "masters": """
SELECT run_number, type, version, checksum FROM (
  SELECT *, row_number() OVER (PARTITION BY run_number, type, version ORDER BY pos) rn FROM replicas
  WHERE status = 'transferred' AND ((type = 'raw' AND version IS NULL AND host IN ('site0','site1'))
     OR (type = 'processed' AND host IN ('site2','site3')))) x WHERE rn = 1""",
    "compared": """
SELECT r.*, m.checksum AS master_checksum,
  r.host = 'site5' OR r.checksum IS NOT DISTINCT FROM m.checksum AS good
FROM replicas r LEFT JOIN masters m ON r.run_number = m.run_number AND r.type = m.type
  AND r.version IS NOT DISTINCT FROM m.version
WHERE r.status = 'transferred' AND r.has_checksum AND r.type <> 'untriggered'""",
    "good_copies": """
SELECT run_number, type, count(*) AS n, CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) AS BIGINT) AS good
FROM compared GROUP BY 1, 2""",
    "listing": """
SELECT concat('/raw/', CAST(l_orderkey AS VARCHAR)) AS dir,
  concat('f', CAST(l_partkey AS VARCHAR), '_', CAST(l_suppkey AS VARCHAR), '_', CAST(l_linenumber AS VARCHAR)) AS name,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS length, l_shipdate AS mtime,
  lower(to_hex(l_partkey % 50)) AS fingerprint, CAST(l_quantity AS INT) = 50 AS is_dir,
  concat('/raw/', CAST(l_orderkey AS VARCHAR), '/f', CAST(l_partkey AS VARCHAR), '_', CAST(l_suppkey AS VARCHAR), '_',
         CAST(l_linenumber AS VARCHAR)) AS path
FROM lineitem""",
    "raw_locations": """
SELECT o_orderkey AS run_number, CAST(0 AS BIGINT) AS pos, 'site0' AS host, 'raw' AS type,
  CASE WHEN o_orderkey % 7 = 0 THEN 'verifying' ELSE 'transferred' END AS status, o_orderdate AS creation_time,
  concat('/raw/', CAST(o_orderkey AS VARCHAR)) AS location
FROM orders""",
    "files": """
SELECT source AS dir, concat('doc', CAST(doc_id AS VARCHAR)) AS name,
  concat(source, '/doc', CAST(doc_id AS VARCHAR)) AS path, text, strlen(text) AS length FROM documents""",
    "ranges": """
SELECT p_partkey AS pos, p_partkey * 10 AS min_no, p_partkey * 10 + p_size AS max_no, p_name AS value
FROM part""",
    "corrections": """
SELECT p_type AS kind, TIMESTAMP '2017-01-01 00:00:00' + to_seconds(p_partkey) AS calculation_time,
  CASE WHEN p_size % 3 <> 0 THEN p_brand END AS version, concat(CAST(p_size AS VARCHAR), ' * v + 0.5') AS function,
  p_size, p_retailprice AS c0, CAST(p_size AS DOUBLE) AS c1
FROM part""",
    "latest": """
SELECT kind, calculation_time, function, p_size,
  coalesce(version, strftime(calculation_time, '%Y-%m-%d %H:%M:%S')) AS version
FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY calculation_time DESC) AS rn FROM corrections) x
WHERE rn = 1""",
    "readings": "SELECT ts, event_type AS sensor, value FROM events",
    "intervals": """
SELECT event_id AS number, ts AS start_ts, ts + INTERVAL 1 HOUR AS end_ts FROM events""",
    "status_events": """
SELECT event_id, ts, user_id AS replica_id,
  CASE event_type WHEN 'click' THEN 'transferring' WHEN 'view' THEN 'verifying' WHEN 'purchase' THEN 'transferred'
       WHEN 'error' THEN 'error' ELSE 'failed' END AS status
FROM events""",
    "log_lines": """
SELECT run_number AS file, pos AS line_no, size_bytes,
  CASE pos % 8 WHEN 0 THEN concat('Transferred amount of data: ', CAST(size_bytes AS VARCHAR), ' ',
                                  CASE size_bytes % 3 WHEN 0 THEN 'KB' WHEN 1 THEN 'MB' ELSE 'GB' END)
    WHEN 1 THEN concat('Number of uploaded files: ', CAST(size_bytes % 97 AS VARCHAR))
    WHEN 2 THEN 'ERROR [There is not enough quota left to fulfil the operation.'
    WHEN 3 THEN 'Upload to tape: [succcessful]'
    WHEN 4 THEN concat('Number of inspected files: ', CAST(size_bytes % 89 AS VARCHAR))
    WHEN 5 THEN concat('Network transfer rate: ', CAST(size_bytes % 5000 AS VARCHAR), '.50 kB/sec')
    WHEN 6 THEN concat('run [INFO] tsm upload dataset 160824_0125 took ', CAST(size_bytes % 600 AS VARCHAR), ' seconds')
    ELSE 'ERROR [(''Connection aborted.'', BadStatusLine('''',))]' END AS line
FROM replicas""",
    "log_summary": """
SELECT file,
  coalesce(arg_max(CAST(nullif(regexp_extract(line, 'uploaded files: (\\d+)', 1), '') AS BIGINT), line_no)
           FILTER (WHERE line LIKE 'Number of uploaded files:%'), 0) AS nb_uploaded_files,
  coalesce(arg_max(CAST(nullif(regexp_extract(line, 'inspected files: (\\d+)', 1), '') AS BIGINT), line_no)
           FILTER (WHERE line LIKE 'Number of inspected files:%'), 0) AS nb_inspected_files,
  coalesce(arg_min(gb, line_no) FILTER (WHERE gb IS NOT NULL), 0) AS tr_amount_up,
  coalesce(arg_max(gb, line_no) FILTER (WHERE gb IS NOT NULL), 0) AS tr_amount_dw,
  coalesce(arg_min(rate, line_no) FILTER (WHERE rate IS NOT NULL), 0) AS tr_rate_up,
  coalesce(arg_max(rate, line_no) FILTER (WHERE rate IS NOT NULL AND line_no > first_amount), 0) AS tr_rate_dw,
  coalesce(arg_max(took, line_no) FILTER (WHERE took IS NOT NULL), 0) AS total_time
FROM (SELECT *, min(CASE WHEN gb IS NOT NULL THEN line_no END) OVER (PARTITION BY file) AS first_amount FROM (
  SELECT file, line_no, line,
  CASE WHEN line_no % 8 = 0 THEN size_bytes / CASE size_bytes % 3 WHEN 0 THEN 1048576.0 WHEN 1 THEN 1024.0 ELSE 1.0 END END AS gb,
  CASE WHEN line_no % 8 = 5 THEN CAST(size_bytes % 5000 AS DOUBLE) + 0.5 END AS rate,
  CASE WHEN line_no % 8 = 6 THEN CAST(size_bytes % 600 AS DOUBLE) END AS took
  FROM log_lines) a) b
GROUP BY file HAVING count(*) FILTER (WHERE line_no % 8 = 3) > 0""",
    "queue": "SELECT concat('job_', CAST(o_orderkey AS VARCHAR)) AS job_name FROM orders WHERE o_orderkey % 7 = 0",
    "site_rows": """
SELECT CAST(n_nationkey AS BIGINT) AS pos, concat('site', CAST(n_nationkey % 6 AS VARCHAR)) AS name,
  CASE n_nationkey % 6 WHEN 1 THEN 'tape' WHEN 5 THEN 'catalogue' ELSE 'rsync' END AS method,
  concat('host-', n_name) AS hostname, concat('/data/', CAST(n_nationkey % 6 AS VARCHAR), '/raw') AS dir_raw,
  CASE WHEN n_nationkey % 6 <> 0 THEN concat('/data/', CAST(n_nationkey % 6 AS VARCHAR), '/processed') END AS dir_processed,
  CASE WHEN n_nationkey % 6 < 4 THEN concat('/data/', CAST(n_nationkey % 6 AS VARCHAR), '/minitrees') END AS dir_minitrees,
  CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 6 + 2 END AS purge,
  CASE WHEN n_nationkey % 6 = 2 THEN 'v1' END AS purge_version,
  CASE WHEN n_nationkey % 6 = 0 THEN 2 END AS nstreams, n_nationkey AS n
FROM nation""",
    "sites": "SELECT * FROM site_rows s WHERE pos = (SELECT min(pos) FROM site_rows t WHERE t.name = s.name)",
    "rule_sets": """
SELECT s_suppkey AS rule_id, unnest(CASE
    WHEN s_suppkey % 4 = 0 THEN list_append(range(s_suppkey * 150, s_suppkey * 150 + 40), s_suppkey * 150 + 90)
    WHEN s_suppkey % 4 = 1 THEN [s_suppkey * 150] WHEN s_suppkey % 4 = 2 THEN [s_suppkey * 150 + 7]
    WHEN s_suppkey <> 3 THEN range(s_suppkey * 150, s_suppkey * 150 + 60) ELSE CAST([] AS BIGINT[]) END) AS number
FROM supplier""",
    "rule_defs": """
SELECT s_suppkey AS rule_id, s_suppkey % 7 = 6 AS verification_only, s_suppkey % 9 = 8 AS removes,
  s_suppkey = 3 AS all_numbers, TRUE AS dated,
  TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(s_suppkey % 700 AS INTEGER)) AS day, s_suppkey % 4 AS k,
  s_suppkey AS s, CASE s_suppkey % 3 WHEN 0 THEN '-1' WHEN 1 THEN '3600' ELSE '0' END AS live0
FROM supplier""",
    "run_times": "SELECT number, name, strptime(name, '%y%m%d_%H%M') AS t FROM runs",
    "matches": """
SELECT DISTINCT r.number, d.rule_id FROM run_times r JOIN rule_defs d ON d.all_numbers
  OR (d.dated AND d.k = 2 AND r.t BETWEEN d.day AND d.day + INTERVAL '2 days 23 hours 59 minutes')
  OR (d.dated AND d.k = 1 AND (r.t = d.day + INTERVAL '1 hour 1 minute' OR r.name = '970101_0505'))
UNION SELECT r.number, s.rule_id FROM run_times r JOIN rule_sets s ON s.number = r.number""",
    "rule_listing": """
SELECT concat('scope:', CAST(l_orderkey AS VARCHAR)) AS did,
  CASE WHEN l_partkey % 5 = 0 THEN md5(CAST(l_partkey AS VARCHAR)) ELSE concat('r', CAST(l_partkey AS VARCHAR)) END AS rule_id,
  concat('rse', CAST(l_partkey % 4 AS VARCHAR)) AS rse,
  CASE l_partkey % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'REPLICATING' ELSE 'STUCK' END AS status,
  CASE WHEN l_partkey % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d_%H:%M:%S') ELSE 'valid' END AS expires,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS seq
FROM lineitem""",
}
_NEEDS = {
    "nested_locations": ["runs"], "masters": ["replicas"], "compared": ["replicas", "masters"],
    "good_copies": ["compared"], "latest": ["corrections"], "log_lines": ["replicas"],
    "log_summary": ["log_lines"], "sites": ["site_rows"], "run_times": ["runs"],
    "matches": ["run_times", "rule_sets", "rule_defs"],
}


def oracle(sql: str, *views: str) -> str:
    """``sql`` with the named views (and what they need) as leading CTEs; a leading comma adds further CTEs."""
    order: list[str] = []

    def add(name):
        for dep in _NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{v} AS ({_SQL[v].strip()})" for v in order) + "\n" + sql.strip()
