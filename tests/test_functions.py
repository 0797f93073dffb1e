import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions import fingerprints, listings, logs, names

TEXT = b"Hi there, run catalogue!"


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text.strip("\n").split("\n"))],
                                 "file string, line_no long, line string")


@pytest.mark.parametrize("content", [TEXT, b"", b"\x00\xff" * 5000])
def test_fingerprints(spark, tmp_path, content):
    files = spark.createDataFrame([("d/n", "d", "n", bytearray(content))], "path string, dir string, name string, content binary")
    path = tmp_path / "file"
    path.write_bytes(content)
    paths = spark.createDataFrame([(f"file:{path}",)], "path string")
    for algo, want in {"adler32": f"{zlib.adler32(content):08x}", "crc32": f"{zlib.crc32(content):X}",
                       "sha512": hashlib.sha512(content).hexdigest(), "sha256": hashlib.sha256(content).hexdigest()}.items():
        assert fingerprints.fingerprint(files, algo).first().fingerprint == want
        assert fingerprints.fingerprint_paths(paths, algo).first().fingerprint == want


def test_adler32_of_blocks(spark, rows):
    """Blocks of any size and order give the checksum of the whole; empty, missing and long contents."""
    draw = random.Random(3)
    contents = [b"", b"a", b"\xff" * 70_000, bytes(draw.randrange(256) for _ in range(10_001)), b"\x00" * 300, None]
    files = spark.createDataFrame([(f"p{n}", "d", "n", c) for n, c in enumerate(contents)], "path string, dir string, name string, content binary")
    want = [(f"p{n}", None if c is None else f"{zlib.adler32(c):08x}") for n, c in enumerate(contents)]
    assert rows(fingerprints.fingerprint(files, "adler32"), "path", "fingerprint") == sorted(want, key=repr)
    for size in (1, 7, 4096, 70_000):
        few = files.filter("path <> 'p2'") if size == 1 else files
        blocks = fingerprints.file_blocks(few, size).repartition(5)
        assert set(rows(fingerprints.adler32(blocks))) == {w for w in want if w[1] and (size > 1 or w[0] != "p2")}


def test_empty_directory_digest(spark):
    assert spark.range(1).select(fingerprints.empty_digest()).first()[0] == hashlib.sha512(b"").hexdigest()


def test_names(spark, rows):
    runs = spark.sql("""SELECT number, name, detector, CAST(start AS timestamp_ntz) AS start FROM VALUES
        (1, '170202_1740', 'tpc', '2017-02-02 17:40:00'), (2, '170202_1740', 'muon_veto', '2017-02-02 17:40:01'),
        (3, '990101_0000', 'tpc', '1999-01-01 00:00:00') AS t(number, name, detector, start)""")
    assert rows(names.dataset_names(runs, "p"), "number", "scope", "super_container") == [
        (1, "p_SR000_170202_1740_tpc", "p_SR000_data"), (2, "p_SR001_170202_1740_mv", "p_SR001_data"),
        (3, "p_SR000_990101_0000_tpc", "p_SR000_data")]
    times = names.with_run_name(names.with_run_time(runs))
    assert [str(r.run_time) for r in times.orderBy("number").collect()] == [
        "2017-02-02 17:40:00", "2017-02-02 17:40:00", "1999-01-01 00:00:00"]
    assert times.filter("name <> run_name").count() == 0


def test_identifiers(spark):
    df = spark.createDataFrame([("s:n", "/a/b/run", "ds", "0123456789abXYZ")], "did string, path string, dataset string, name string")
    row = names.path_parts(names.split_did(df.drop("name"), "did"), "path").first()
    assert (row.scope, row.name, row.basename, row.dirname) == ("s", "n", "run", "/a/b")
    row = names.tape_names(df).first()
    assert (row.tape_name, row.restored_name) == ("ds_0123456789abXYZ", "XYZ")


def test_metadata_version_comes_from_the_first_location_only(spark, rows):
    runs = spark.sql("SELECT 1L AS number, 'u' AS user, 'muon_veto' AS detector, struct('AmBe' AS type) AS source")
    reps = spark.createDataFrame([(1, 0, "h1", "raw", None, "transferred"), (1, 1, "h1", "processed", "v2", "transferred")],
                                 "run_number long, pos long, host string, type string, version string, status string")
    assert rows(names.metadata_tags(runs, reps, "h", "processed", "001")) == [
        (1, "u", "mv", "AmBe", "SR001", "processed", "None")]
    assert rows(names.metadata_tags(runs, reps.filter("pos = 1"), "h", "raw", "001")) == [
        (1, "u", "mv", "AmBe", "SR001", "undefined", "v2")]


def test_upload_log(spark):
    row = logs.parse_upload_log(lines(spark, """
Total number of objects inspected:    1,234
Total number of objects inspected:    1,235
Total number of bytes transferred:     3.21 GB
Elapsed processing time:           00:12:59
""")).first()
    assert (row.inspected, row.backedup, row.failed, row.bytes_transferred) == (1235, None, -1, "3.21GB")
    assert (row.elapsed_processing_time, row.object_compressed) == ("00:12:59", "-1")
    assert len(row) == 1 + len(K.UPLOAD_COUNTERS)


def test_restore_log(spark, rows):
    text = lines(spark, """
Restoring    2,048,000 /tape/a/f1 --> /disk/f1 [Done]
Restoring        1,024 /tape/a/f2 --> /disk/f2 [Done]
Total number of objects restored:    2
Total number of bytes transferred:    1.95 MB
""")
    assert rows(logs.restored_files(text), "name", "file_size", "file_path_tsm", "file_status") == [
        ("f1", "2,048,000", "/tape/a/f1", "[Done]"), ("f2", "1,024", "/tape/a/f2", "[Done]")]
    row = logs.parse_restore_log(text).first()
    assert (row.restored_objects, row.restored_bytes, row.failed_objects) == ("2", "1.95MB", "-1")


def test_log_summary(spark):
    text = """
2016 [INFO] File/Folder for backup: 160824_0125
2016 [INFO] Network transfer rate: 1,000.5 kB/s
2016 [INFO] Transferred amount of data: 512 MB
2016 [INFO] Number of uploaded files: 7
2016 [INFO] Number of inspected files: 9
2016 [INFO] Network transfer rate: 2,000.5 kB/s
2016 [INFO] Transferred amount of data: 3 GB
2016 [INFO] tsm upload dataset 160824_0125 took 12 seconds
2016 [INFO] Upload to tape: [succcessful]
"""
    name = "/log/tsm_20160824_012530.log"
    row = logs.log_summary(lines(spark, text, name).unionByName(lines(spark, "Upload to tape: [failed]", "g"))).collect()
    assert len(row) == 1
    row = row[0]
    assert (row.file, row.dataset, str(row.upload_time)) == (name, "160824_0125", "2016-08-24 01:25:30")
    assert (row.tr_amount_up, row.tr_amount_dw, row.tr_rate_up, row.tr_rate_dw) == (0.5, 3.0, 1000.5, 2000.5)
    assert (row.nb_uploaded_files, row.nb_inspected_files, row.total_time) == (7, 9, 12.0)
    one_rate = text.replace("2,000.5 kB/s", "?").replace("512 MB", "1048576 KB")
    row = logs.log_summary(lines(spark, one_rate)).first()
    assert (row.tr_rate_up, row.tr_rate_dw, row.tr_amount_up) == (1000.5, 0.0, 1.0)


def test_first_matching_line_decides(spark):
    text = "fine\nx " + K.UPLOAD_ERRORS[1][0] + " y\n" + K.UPLOAD_ERRORS[0][0]
    row = logs.classify_errors(lines(spark, text)).first()
    assert (row.status, row.line_no) == ("RSEquota", 1)
    assert logs.classify_errors(lines(spark, "fine")).count() == 0
    both = lines(spark, K.RULE_ERRORS[1][0] + K.RULE_ERRORS[0][0])
    assert logs.classify_errors(both, K.RULE_ERRORS).first().status == "n/a"
    assert logs.classify_errors(lines(spark, K.DOWNLOAD_ERRORS[3][0]), K.DOWNLOAD_ERRORS).first().status == "too_many_connections"


DOWNLOAD = """
[32;1m2017-01-01 10:11:12,123 INFO [Thread 1/3 : File s:f1 successfully downloaded from A_DISK]
a b c d e f g s:f1 successfully downloaded 10 bytes downloaded in about 15 seconds
a b c d e f g s:f2 successfully downloaded 12 bytes downloaded in about 16 seconds
Download summary
DID s:raw
Total files : {n}
Downloaded files : 1
Files already found locally : 0
Files that cannot be downloaded : 0
"""


def test_downloads(spark, rows):
    text = lines(spark, DOWNLOAD.format(n=3))
    row = logs.parse_downloads(text).first()
    assert (row.did, row.total_files, row.dw_files, row.status) == ("s:raw", "3", "1", "successful")
    assert logs.parse_downloads(lines(spark, DOWNLOAD.format(n=4))).first().status == "file number error"
    assert rows(logs.downloaded_files(text)) == [("f", "f1", "10", "15", "A_DISK")]


def test_rule_listing(spark, rows):
    text = """
ID       ACCOUNT  SCOPE:NAME  STATE  RSE  COPIES  EXPIRES
abc      user     s:raw       OK[1/0/0]  A   1
def      user     s:raw       STUCK[0]   B   1   2017-01-01 10:00:00
ghi      user     s:other     OK   C   1
"""
    rules = listings.parse_rules(lines(spark, text).withColumn("did", F.lit("s:raw")))
    assert rows(rules, "rule_id", "status", "rse", "copies", "expires") == [
        ("abc", "OK[1/0/0]", "A", "1", "valid"), ("def", "STUCK[0]", "B", "1", "2017-01-01_10:00:00")]
    wanted = spark.createDataFrame([("s:raw", "A"), ("s:raw", "Z")], "did string, rse string")
    assert rows(listings.rule_summary(rules, wanted), "rse", "rule_id", "expires") == [("A", "abc", "valid"), ("Z", "n/a", "valid")]


def test_listings(spark, rows):
    replicas = lines(spark, """
+---------+------+
| SCOPE   | NAME | SIZE | ADLER32 | RSE |
| s       | f1   | 10 B | aa      | A_DISK: srm://x:80/f1 |
noise
""")
    assert rows(listings.parse_replicas(replicas)) == [("f", "s", "f1", "10B", "aa", "A_DISK", "srm://x:80/f1")]
    files = lines(spark, """
+-----------------------------+------+
| SCOPE:NAME | GUID | ADLER32 | SIZE | EVENTS |
|-----------------------------+------|
| s:f1 | g1 | ad:aa | 10 |  |
Total files : 1
""")
    assert rows(listings.parse_files(files)) == [("f", "f1", "g1", "aa", "10", "")]
    usage = "used: 5 TB\nrse: A\nupdated_at: 2017-01-01: 10:11:12\nsource: srm"
    assert rows(listings.parse_usage(lines(spark, usage))) == [("f", "5TB", "A", "2017-01-01_101112", "srm")]
    cut = "used: 5\n[RSE does not exist]\nrse: A"
    assert rows(listings.parse_usage(lines(spark, cut))) == [("f", "5", "n/a", "n/a", "n/a")]
    assert rows(listings.parse_rses(lines(spark, "A_USERDISK\nother")), "rse") == [("A_USERDISK",)]
    assert rows(listings.parse_checksum(lines(spark, "md5: 1\nadler32: aa")), "checksum") == [("aa",)]


def test_alert_record(spark):
    assert names.alert_record(spark.sql("SELECT 2 AS b, 'x' AS a")).first().record == '{"a":"x","b":2}'


def test_downloaded_files_sort_values_not_lines(spark):
    """Lines and their words end before rows are grouped; the last line of each kind counts, also one cut short."""
    from runledger.functions import logs as downloads

    sized = "0 1 2 3 4 5 6 s:a successfully downloaded 7 bytes downloaded in about 12 s"
    lines = spark.createDataFrame([(1, 1, sized), (1, 2, "0 s:a successfully downloaded from site1]"),
                                   (1, 3, "s:a successfully downloaded bytes downloaded"), (1, 4, "s:b successfully downloaded from x]"),
                                   (1, 5, "0 s:a successfully downloaded from site2]")], "file long, line_no long, line string")
    out = downloads.downloaded_files(lines)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "-1", "-1", "site2"), (1, "b", "-1", "-1", "x")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(row for row in plan.splitlines() if "Aggregate [" in row)
    assert "split(" not in aggregate and "line#" not in aggregate


def test_upload_lines_are_split_once(spark, rows):
    """Each counter is read as its own kind only, and a line without one still makes its file a row."""
    lines = spark.createDataFrame(
        [("f", 1, "Total number of objects inspected:  1,234"), ("f", 2, "Total number of bytes inspected:  1,5 GB"),
         ("f", 3, "Elapsed processing time:  00:01:07"), ("f", 4, "Total number of objects failed:  many"),
         ("g", 1, "no counter: 3"), (None, 1, None)], "file string, line_no long, line string")
    out = logs.parse_upload_log(lines)
    got = rows(out, "file", "inspected", "backedup", "failed", "bytes_inspected", "elapsed_processing_time", "object_compressed")
    assert got == sorted([("f", 1234, None, -1, "1,5GB", "00:01:07", "-1"), ("g", -1, None, -1, "-1", "-1", "-1"),
                          (None, -1, None, -1, "-1", "-1", "-1")], key=repr)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
