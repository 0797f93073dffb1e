"""Tool and transfer logs: lines (file, line_no, line) reduced to records per file.

Each parser is one aggregation: ordered picks combine map-side, so a long log is never
brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def after_colon(line: Column, n: int = 1) -> Column:
    """The n-th colon-separated field."""
    return F.get(F.split(line, ":"), F.lit(n))


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("line_no")))


def first_mark(line: Column, marks: Sequence[str]) -> Column:
    """Index of the first mark, in the given order, that the line contains."""
    out = F.lit(None).cast("int")
    for i, mark in reversed(list(enumerate(marks))):
        out = F.when(line.contains(mark), i).otherwise(out)
    return out


def _bare(n: int = 1) -> Column:
    """The n-th colon-separated field without blanks."""
    return F.translate(after_colon(F.col("line"), n), " ", "")


def parse_upload_log(lines: DataFrame) -> DataFrame:
    """Counters of an upload, last line per counter; absent ones are -1 (objects backed up: null)."""
    mark = first_mark(F.col("line"), [m for _, m, _ in K.UPLOAD_COUNTERS])
    kinds = ["number" if integer else "clock" if name == "elapsed_processing_time" else "text" for name, _, integer in K.UPLOAD_COUNTERS]
    # a line is split once, and only into the value of its counter
    rows = lines.select("file", "line_no", mark.alias("_m"), F.split("line", ":").alias("_f"))
    bare = lambda n: F.replace(F.get("_f", F.lit(n)), F.lit(" "), F.lit(""))
    of_kind = lambda kind, value: F.when(
        F.col("_m").isin([i for i, k in enumerate(kinds) if k == kind]), value).alias(kind)
    rows = rows.select(
        "file", "line_no", "_m", of_kind("text", bare(1)),
        of_kind("number", F.replace(bare(1), F.lit(","), F.lit("")).try_cast("bigint")),
        of_kind("clock", F.concat_ws(":", bare(1), bare(2), bare(3))))
    aggs = []
    for i, (name, _, integer) in enumerate(K.UPLOAD_COUNTERS):
        picked = _last(F.col(kinds[i]), F.col("_m") == i)
        if name != "backedup":
            picked = F.coalesce(picked, F.lit(-1) if integer else F.lit("-1"))
        aggs.append(picked.alias(name))
    return rows.groupBy("file").agg(*aggs)


def restored_files(lines: DataFrame) -> DataFrame:
    """Files named by restore lines; the last line of a local name counts."""
    tokens = F.filter(F.split("line", " "), lambda t: t != "")
    rows = lines.filter(F.col("line").contains(K.RESTORE_FILE_MARK)).withColumn("_t", tokens).filter(F.size("_t") >= 6)
    entry = F.struct(F.col("_t")[1].alias("file_size"), F.col("_t")[2].alias("file_path_tsm"),
                     F.col("_t")[4].alias("file_path_local"), F.col("_t")[5].alias("file_status"))
    return rows.groupBy("file", F.substring_index(F.col("_t")[4], "/", -1).alias("name")).agg(
        F.max_by(entry, "line_no").alias("_e")).select("file", "name", "_e.*")


def parse_restore_log(lines: DataFrame) -> DataFrame:
    """Totals of a restore, last line per counter; absent ones are -1."""
    rows = lines.select("file", "line_no", _bare().alias("text"), *[
        F.col("line").contains(mark).alias(f"_{name}") for name, mark in K.RESTORE_COUNTERS])
    return rows.groupBy("file").agg(*[
        F.coalesce(_last(F.col("text"), F.col(f"_{name}")), F.lit("-1")).alias(name) for name, _ in K.RESTORE_COUNTERS])


def log_summary(lines: DataFrame) -> DataFrame:
    """Transfer summary of logs that hold the success phrase.

    Amount (GB) and rate: the first line is the upload, the last one the download; a
    download rate counts only after the first amount.
    """
    line = F.col("line")
    grab = lambda mark, pattern: F.regexp_extract(line, mark + pattern, 1)
    whole = lambda mark: F.when(line.contains(mark), grab(mark, r"\s*(\d+)").try_cast("bigint"))
    number = grab(K.LOG_AMOUNT, r"\s*([0-9.]+)").try_cast("double")
    unit = F.regexp_extract(line, K.LOG_AMOUNT + r"\s*[0-9.]+\s*([A-Za-z]+)", 1)
    amount = F.when(line.contains(K.LOG_AMOUNT), F.when(unit == "MB", number / 1024)
                    .when(unit == "KB", number / 1024 / 1024).otherwise(number))
    rate = F.when(line.contains(K.LOG_RATE),
                  F.regexp_replace(grab(K.LOG_RATE, r"\s*([0-9.,]+)"), ",", "").try_cast("double"))
    took = F.when(line.contains(K.LOG_DATASET), F.regexp_extract(line, r"took\s*([0-9.]+)", 1).try_cast("double"))
    dataset = F.when(line.contains(K.LOG_DATASET), F.regexp_extract(line, r"\[INFO\][^_]*?(.{6}_.{4})", 1))
    rows = lines.select("file", "line_no", whole(K.LOG_UPLOADED).alias("up"), whole(K.LOG_INSPECTED).alias("seen"),
                        amount.alias("amount"), rate.alias("rate"), took.alias("took"), dataset.alias("dataset"),
                        line.contains(K.SUCCESS_PHRASE).alias("ok"))
    pick = lambda how, c: how(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    at = lambda how, c: how(F.when(F.col(c).isNotNull(), F.col("line_no")))
    out = rows.groupBy("file").agg(
        F.bool_or("ok").alias("_ok"), pick(F.max_by, "up").alias("up"), pick(F.max_by, "seen").alias("seen"),
        pick(F.min_by, "amount").alias("a_first"), pick(F.max_by, "amount").alias("a_last"),
        pick(F.min_by, "rate").alias("r_first"), pick(F.max_by, "rate").alias("r_last"),
        pick(F.max_by, "took").alias("took"), pick(F.max_by, "dataset").alias("dataset"),
        at(F.min, "amount").alias("_a_no"), at(F.max, "rate").alias("_r_no")).filter("_ok")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "file", F.coalesce("dataset", F.lit("")).alias("dataset"),
        F.to_timestamp(F.nullif(F.regexp_extract(F.col("file").cast("string"), r"(\d{8}_\d{6})\.[^/]*$", 1), F.lit("")),
                       "yyyyMMdd_HHmmss").cast("timestamp_ntz").alias("upload_time"),
        zero(F.col("up")).alias("nb_uploaded_files"), zero(F.col("seen")).alias("nb_inspected_files"),
        zero(F.col("a_first")).alias("tr_amount_up"), zero(F.col("a_last")).alias("tr_amount_dw"),
        zero(F.col("r_first")).alias("tr_rate_up"),
        zero(F.when(F.col("_r_no") > F.col("_a_no"), F.col("r_last"))).alias("tr_rate_dw"),
        zero(F.col("took")).alias("total_time"))


def classify_errors(lines: DataFrame, patterns: Sequence[tuple[str, str]] = K.UPLOAD_ERRORS) -> DataFrame:
    """State per file from its first line that matches a pattern; patterns are tested in order."""
    rows = lines.select("file", "line_no", first_mark(F.col("line"), [p for p, _ in patterns]).alias("_m"))
    hit = F.when(F.col("_m").isNotNull(), F.col("line_no"))
    first = rows.groupBy("file").agg(F.min_by("_m", hit).alias("_m"), F.min(hit).alias("line_no"))
    status = F.element_at(F.array(*[F.lit(s) for _, s in patterns]), F.col("_m") + 1)
    return first.filter(F.col("line_no").isNotNull()).select("file", status.alias("status"), "line_no")


def downloaded_files(lines: DataFrame) -> DataFrame:
    """Files named by success messages: size and time from byte lines, endpoint from source lines."""
    line = F.col("line")
    rows = lines.filter(line.contains(K.DOWNLOAD_OK)).withColumn("_t", F.split(line, " "))
    name = F.regexp_extract(line, "(?:^| )[^ :]+:([^ :]+)(?= |$)", 1)
    sized, sourced = line.contains(K.DOWNLOAD_BYTES), line.contains(K.DOWNLOAD_FROM)
    # values, not lines and their words, are sorted and shuffled
    rows = rows.select("file", "line_no", name.alias("dw_file"), sized.alias("_sized"), sourced.alias("_sourced"),
                       F.when(sized, F.get("_t", F.lit(10))).alias("size"), F.when(sized, F.get("_t", F.lit(15))).alias("time"),
                       F.when(sourced, F.split(F.element_at("_t", -1), "]")[0]).alias("rse"))
    out = rows.groupBy("file", "dw_file").agg(
        F.bool_or("_sourced").alias("_known"),
        _last(F.col("size"), F.col("_sized")).alias("dw_size"), _last(F.col("time"), F.col("_sized")).alias("dw_time"),
        _last(F.col("rse"), F.col("_sourced")).alias("dw_rse"))
    gap = lambda c: F.coalesce(c, F.lit("-1")).alias(c)
    return out.filter("_known").select("file", "dw_file", gap("dw_size"), gap("dw_time"), gap("dw_rse"))


def parse_downloads(lines: DataFrame) -> DataFrame:
    """Download totals per file of output; successful when every file has its success message."""
    line = F.col("line")
    marks = {"total_files": "Total files", "dw_files": "Downloaded files",
             "alreadylocal_files": "Files already found locally", "dwfail_files": "Files that cannot be downloaded"}
    rows = lines.select(
        "file", "line_no", line.contains("Download summary").alias("_s"), line.contains(K.DOWNLOAD_OK).alias("_ok"),
        F.when(line.startswith("DID"), F.expr("substring(line, 5)")).alias("did"),
        *[F.when(line.contains(mark), _bare()).alias(name) for name, mark in marks.items()])
    fields = ["did", *marks]
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    out = rows.groupBy("file").agg(
        F.min(F.when(F.col("_s"), F.col("line_no"))).alias("_begin"), F.count_if("_ok").alias("n_messages"),
        *[F.max_by(c, known(c)).alias(c) for c in fields], *[F.max(known(c)).alias(f"_at_{c}") for c in fields])
    value = lambda c: F.when(F.col(f"_at_{c}") >= F.col("_begin"), F.col(c))
    return out.select("file", *[value(c).alias(c) for c in fields], "n_messages",
                      F.when(F.col("n_messages") == value("total_files").try_cast("bigint"), "successful")
                      .otherwise("file number error").alias("status"))
