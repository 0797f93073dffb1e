"""Log and listing parsers over lines written from the line items."""

from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as fx
from ..functions import listings, logs
from ..scale import scratch_dir
from .registry import query


def _lines(spark, sf, line, key="run_number"):
    """(file, line_no, line) with one line per replica."""
    return fx.replicas(spark, sf).select(F.col(key).alias("file"), F.col("pos").alias("line_no"), line.alias("line"))


def _stored(lines):
    """Lines written out and read back, as tool output is: parsing filters then see text, not the fixture's recipe."""
    path = scratch_dir(lines.sparkSession, "lines")
    lines.write.option("compression", "zstd").parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])



def _size():
    return F.col("size_bytes")


UPLOAD_KINDS = (0, 1, 2, 9, 10, 12, 17)  # counters used by the query
UPLOAD_NAMES = [K.UPLOAD_COUNTERS[i][0] for i in UPLOAD_KINDS]


def _upload_line():
    line = F.lit("no counter")
    for n, i in enumerate(UPLOAD_KINDS):
        name, mark, integer = K.UPLOAD_COUNTERS[i]
        value = F.format_number("size_bytes", 0) if integer else _cat(_size().cast("string"), " kB")
        if name == "elapsed_processing_time":
            value = _cat("00:", (_size() % 60).cast("string"), ":07")
        line = F.when(F.col("pos") % 8 == n, _cat(mark, "   ", value)).otherwise(line)
    return line


def _upload_sql():
    picks = []
    for n, i in enumerate(UPLOAD_KINDS):
        name, _, integer = K.UPLOAD_COUNTERS[i]
        value = "size_bytes" if integer else "concat(CAST(size_bytes AS VARCHAR), 'kB')"
        if name == "elapsed_processing_time":
            value = "concat('00:', CAST(size_bytes % 60 AS VARCHAR), ':07')"
        pick = f"arg_max({value}, pos) FILTER (WHERE pos % 8 = {n})"
        default = "NULL" if name == "backedup" else "-1" if integer else "'-1'"
        picks.append(f"coalesce({pick}, {default}) AS {name}")
    return f"SELECT run_number AS file, {', '.join(picks)} FROM replicas GROUP BY 1"


@query("e10_parse_upload_log", _upload_sql(), "replicas")
def e10(spark, sf):
    return logs.parse_upload_log(_lines(spark, sf, _upload_line())).select("file", *UPLOAD_NAMES)


@query("e11_parse_restore_log", """
SELECT run_number AS file,
  coalesce(arg_max(CAST(size_bytes AS VARCHAR), pos) FILTER (WHERE pos % 4 = 0), '-1') AS restored_objects,
  coalesce(arg_max(CAST(size_bytes AS VARCHAR) || 'GB', pos) FILTER (WHERE pos % 4 = 1), '-1') AS restored_bytes,
  '-1' AS failed_objects FROM replicas GROUP BY 1""", "replicas")
def e11(spark, sf):
    kind = F.col("pos") % 4
    line = (F.when(kind == 0, _cat("Total number of objects restored:  ", _size().cast("string")))
            .when(kind == 1, _cat("Total number of bytes transferred: ", _size().cast("string"), " GB")).otherwise("other"))
    return logs.parse_restore_log(_lines(spark, sf, line)).select(
        "file", "restored_objects", "restored_bytes", "failed_objects")


@query("e11_restored_files", """
SELECT run_number AS file, CAST(size_bytes AS VARCHAR) AS name, CAST(any_value(size_bytes) AS VARCHAR) AS file_size,
  '[Done]' AS file_status FROM replicas WHERE pos % 2 = 0 GROUP BY run_number, size_bytes""", "replicas")
def e11b(spark, sf):
    text = _size().cast("string")
    line = _cat("Restoring   ", text, "  /tape/", text, " --> /disk/", text, " [Done]")
    line = F.when(F.col("pos") % 2 == 0, line).otherwise("other")
    return logs.restored_files(_stored(_lines(spark, sf, line))).select("file", "name", "file_size", "file_status")


@query("e12_log_summary", """
SELECT file, nb_uploaded_files, nb_inspected_files, round(tr_amount_up, 6) AS tr_amount_up,
  round(tr_amount_dw, 6) AS tr_amount_dw, tr_rate_up, tr_rate_dw, total_time FROM log_summary""", "log_summary")
def e12(spark, sf):
    rows = logs.log_summary(fx.log_lines(spark, sf))
    return rows.select("file", "nb_uploaded_files", "nb_inspected_files", F.round("tr_amount_up", 6).alias("tr_amount_up"),
                       F.round("tr_amount_dw", 6).alias("tr_amount_dw"), "tr_rate_up", "tr_rate_dw", "total_time")


@query("e13_classify_errors", """
SELECT file, CASE arg_min(line_no % 8, line_no) WHEN 2 THEN 'RSEquota' ELSE 'RSEreupload' END AS status,
  min(line_no) AS line_no FROM log_lines WHERE line_no % 8 IN (2, 7) GROUP BY file""", "log_lines")
def e13(spark, sf):
    return logs.classify_errors(fx.log_lines(spark, sf))


@query("e14_parse_rules", """
SELECT did, rule_id, 'account' AS account, status, rse, '1' AS copies,
  CASE WHEN expires = 'valid' THEN 'valid' ELSE expires END AS expires FROM rule_listing""", "rule_listing")
def e14(spark, sf):
    rows = fx.rule_listing(spark, sf)
    expiry = F.when(F.col("expires") == "valid", "").otherwise(F.regexp_replace("expires", "_", "  "))
    line = F.concat_ws("  ", "rule_id", F.lit("account"), "did", "status", "rse", F.lit("1"), expiry)
    parsed = listings.parse_rules(_stored(rows.select("did", F.col("seq").alias("line_no"), line.alias("line"))))
    return parsed.drop("line_no")


@query("e15_parse_replicas", """
SELECT run_number AS file, 'scope' AS scope, 'f' || CAST(pos AS VARCHAR) AS name, CAST(size_bytes AS VARCHAR) AS size,
  checksum, host AS rse, 'srm://' || host || ':80' || location AS path FROM replicas WHERE checksum IS NOT NULL""",
       "replicas")
def e15(spark, sf):
    row = F.concat_ws(" | ", F.lit(""), F.lit("scope"), _cat("f", F.col("pos").cast("string")), _size().cast("string"),
                      F.col("checksum"), _cat(F.col("host"), ": srm://", F.col("host"), ":80", F.col("location")),
                      F.lit(""))
    line = F.when(F.col("checksum").isNotNull(), F.ltrim(row)).otherwise("+-------+")
    return listings.parse_replicas(_stored(_lines(spark, sf, line)))


@query("e15_parse_files", """
SELECT run_number AS file, 'f' || CAST(pos AS VARCHAR) AS name, md5(location) AS guid, checksum,
  CAST(size_bytes AS VARCHAR) AS size, '' AS events FROM replicas WHERE checksum IS NOT NULL""", "replicas")
def e15b(spark, sf):
    row = F.concat_ws("|", F.lit(""), _cat(" scope:f", F.col("pos").cast("string"), " "), F.md5("location"),
                      _cat(" ad:", F.col("checksum")), _cat(" ", _size().cast("string")), F.lit(" "), F.lit(""))
    line = F.when(F.col("checksum").isNotNull(), row).otherwise("|-----------------------------+----|")
    return listings.parse_files(_stored(_lines(spark, sf, line)))


@query("e16_parse_downloads", """
SELECT file, CAST(n AS VARCHAR) AS total_files, CASE WHEN n = ok THEN 'successful' ELSE 'file number error' END AS status,
  ok AS n_messages FROM (SELECT run_number AS file, count(*) AS n, count(*) FILTER (WHERE size_bytes % 20 <> 0) AS ok
  FROM replicas GROUP BY 1) x""", "replicas")
def e16(spark, sf):
    size = _size().cast("string")
    line = F.when(_size() % 20 != 0, _cat("0 1 2 3 4 5 successfully scope:f", size, " successfully downloaded from x]"))
    messages = _lines(spark, sf, line.otherwise("failed"))
    totals = fx.replicas(spark, sf).groupBy(F.col("run_number").alias("file")).agg(
        F.max("pos").alias("_last"), F.count(F.lit(1)).alias("_n"))
    tail = totals.select("file", F.posexplode(F.array(
        F.lit("Download summary"), _cat("Total files : ", F.col("_n").cast("string")))).alias("i", "line"), "_last")
    tail = tail.select("file", (F.col("_last") + 1 + F.col("i")).alias("line_no"), "line")
    return logs.parse_downloads(messages.unionByName(tail)).select("file", "total_files", "status", "n_messages")


@query("e16_downloaded_files", """
SELECT run_number AS file, 'f' || CAST(pos AS VARCHAR) AS dw_file, CAST(size_bytes AS VARCHAR) AS dw_size,
  '12' AS dw_time, host AS dw_rse FROM replicas""", "replicas")
def e16b(spark, sf):
    pos, size = F.col("pos").cast("string"), _size().cast("string")
    one = _cat("0 1 2 3 4 5 6 scope:f", pos, " successfully downloaded ", size, " bytes downloaded in about 12 s")
    two = _cat("0 1 2 3 4 5 6 scope:f", pos, " successfully downloaded from ", F.col("host"), "]")
    rows = fx.replicas(spark, sf).select(
        F.col("run_number").alias("file"), F.col("pos").alias("line_no"), F.explode(F.array(one, two)).alias("line"))
    return logs.downloaded_files(_stored(rows))


@query("e17_parse_usage", """
SELECT run_number AS file, coalesce(arg_max(CAST(size_bytes AS VARCHAR), pos) FILTER (WHERE pos % 4 = 0), 'n/a') AS used,
  coalesce(arg_max(host, pos) FILTER (WHERE pos % 4 = 1), 'n/a') AS rse,
  coalesce(arg_max('2017-01-01_01' || lpad(CAST(size_bytes % 60 AS VARCHAR), 2, '0') || '05', pos)
    FILTER (WHERE pos % 4 = 2), 'n/a') AS updated_at, 'n/a' AS source FROM replicas GROUP BY 1""", "replicas")
def e17(spark, sf):
    kind = F.col("pos") % 4
    line = (F.when(kind == 0, _cat("used: ", _size().cast("string"))).when(kind == 1, _cat("  rse: ", F.col("host")))
            .when(kind == 2, _cat("updated_at: 2017-01-01: 01:", F.lpad((_size() % 60).cast("string"), 2, "0"), ":05"))
            .otherwise("files: 3"))
    return listings.parse_usage(_lines(spark, sf, line))


@query("e17_parse_rses", """
SELECT run_number AS file, upper(host) || '_USERDISK' AS rse FROM replicas WHERE pos % 2 = 0""", "replicas")
def e17b(spark, sf):
    line = F.when(F.col("pos") % 2 == 0, _cat(F.upper("host"), "_USERDISK")).otherwise(F.col("host"))
    return listings.parse_rses(_lines(spark, sf, line))
