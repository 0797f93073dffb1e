"""One registered query per operator, with its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import (decontaminate, divergence, html, neardup, packing, periodic, pieces, quality, secrets, simple8b,
                           substrings, token_counts, warc)
from runledger.llm.common import table, words_of

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_OF_TEXT = 50256


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, sf_dir, "documents"), TOKENIZER, END_OF_TEXT)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), number("novel"))


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER)
    return simple8b.read_token_files(files, with_ids=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, sf_dir, "documents"))
    kept = F.when(F.col("kept_text").isNull(), F.lower(F.hex("digest"))).otherwise(F.sha2("kept_text", 256))
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where a tenth of the documents, by the checksum of their id, repeat some of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
        part = F.slice(w, a + 1, p)
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(F.array_repeat(part, times)), F.lit(1), n - a)), " ")

    words = words_of(F.col("text"))  # bound by a lambda, so that they are computed once
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                                 (-r["period"]).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"),
                        F.sha2(F.replace(F.array_join(listed, ""), F.lit(",\n"), F.lit("\n")), 256).alias("runs_sha256"),
                        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), PIECES), PIECES)
    return read.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_html_extraction, op3_warc, op4_near_duplicates, op5_packing, op6_token_counts,
    op7_secret_scans, op8_simple8b, op9_decontamination, op10_substring_dedup,
    op11_source_divergence, op12_periodic_runs, op13_sentencepiece)}

WARC_SQL = """
WITH rec AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d,
                    strlen(coalesce(html, '')) AS n FROM pages),
firsts AS (SELECT d, min(page_id) AS first FROM rec WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM rec LEFT JOIN firsts USING (d)"""

NEAR_SQL = r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\x0C\r]+') AS w
    FROM documents),
shingle AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
meet AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM meet JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM doc UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN size USING (doc_id)"""

SUBSTRING_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\x0C\r]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + d AS p FROM win JOIN first USING (k), range(0, 50) AS r(d) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM doc),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

RUNS_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, w, len(w) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: list_prepend((256 + ascii(c))::BIGINT, list_transform(range(8), lambda z: 0::BIGINT))))),
      lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END),
      4294967295) AS h
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\x0C\r]+') AS w FROM documents)),
spot AS (SELECT rid, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p
    FROM (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM doc)))),
same AS (SELECT s.rid, t.i - s.i AS q, s.i FROM spot s JOIN spot t ON s.rid = t.rid AND s.x = t.x AND s.i < t.i),
island AS (SELECT rid, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM same) GROUP BY rid, q, g
  HAVING count(*) + q >= greatest(12, 2 * q)),
run AS (SELECT rid, start, length, min(q) AS period FROM island GROUP BY rid, start, length),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM run),
best AS (SELECT rid, start, length, period FROM run
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l
  FROM run GROUP BY rid),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM spot ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM doc LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""

ORACLES = {
    "op1_quality_rules": quality.BASE_SQL, "op3_warc": WARC_SQL, "op4_near_duplicates": NEAR_SQL,
    "op9_decontamination": decontaminate.REPORT_SQL, "op10_substring_dedup": SUBSTRING_SQL,
    "op11_source_divergence": divergence.DIVERGENCE_SQL, "op12_periodic_runs": RUNS_SQL,
}
