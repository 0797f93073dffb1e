"""Benchmark decontamination with a broadcast set of hashed test n-grams, in built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import with_row_keys, words_of, written
from runledger.scale import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words stand all ASCII characters but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows in one broadcast set (key, length and ten words each); more are taken in several passes.
BLOCK_WINDOWS = 100_000


def normal_words(text: Column) -> Column:
    return words_of(F.translate(text, UPPER, LOWER), BETWEEN)


def _key(words: Column, start: Column, length: int) -> Column:
    """Hash of four words spread over a window; equal windows have equal keys, a hit is verified on all words."""
    at = sorted({0, length // 3, 2 * length // 3, length - 1})
    return F.xxhash64(F.lit(length), *(F.get(words, start + i) for i in at))


def _starts(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(item_id, length, words) for every window of every item; an item with fewer words is one window."""
    short = F.size("words") < window
    full = items.select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return full.select(
        "item_id",
        F.explode(F.when(short, F.array("words")).otherwise(
            F.transform(_starts(F.size("words"), window), lambda i: F.slice("words", i + 1, window)))).alias("words"),
    ).withColumn("length", F.size("words")).distinct()


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10,
                       block_windows: int = BLOCK_WINDOWS, key: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, spans, n_hit, items.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  ``spans`` are the sorted [start, end)
    word ranges of occurring windows, ``n_hit`` counts the words inside any of them, ``items`` has the ids of the items
    that own one, sorted as strings.

    Null and empty texts have no words, hence no hits, in documents and items alike.  Rows are judged one by one, also
    such as repeat a doc_id or have none.  An item without an id marks words but is not listed.  Empty tables are fine;
    further columns are ignored.  The set of windows is broadcast in blocks of at most ``block_windows``, so its size is
    bounded whatever the benchmark holds; each block reads the documents once.  ``key`` names a column of stored row keys
    (longs), which then comes last in the result.
    """
    owned = written(benchmark_windows(items, window), "windows")
    distinct = owned.select("length", "words").distinct().withColumn("wid", F.xxhash64(F.lit(1), "words"))
    total = distinct.count()
    lengths = sorted(r[0] for r in distinct.select("length").distinct().collect())  # at most `window` values
    blocks = max(1, -(-total // block_windows))
    keyed = distinct.withColumn("key", reduce(
        lambda other, n: F.when(F.col("length") == n, _key(F.col("words"), F.lit(0), n)).otherwise(other),
        lengths, F.lit(None).cast("long")))
    rows = docs.withColumn("rid", F.col(key) if key else F.monotonically_increasing_id())
    hits = [_scan(rows, keyed.where(F.pmod("wid", F.lit(blocks)) == b) if blocks > 1 else keyed, lengths, b == 0)
            for b in range(blocks)]
    by_row = written(
        reduce(DataFrame.unionByName, hits).groupBy("rid").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            F.collect_set(F.when(F.col("wid").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
            .alias("found"),
            F.collect_set("wid").alias("wids")),
        "hits")
    spans = by_row.select("rid", "doc_id", "n_words", F.array_sort("found").alias("spans"))
    named = owned.where("item_id IS NOT NULL").select(
        F.xxhash64(F.lit(1), "words").alias("wid"), F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = by_row.select("rid", F.explode("wids").alias("wid")).join(broadcast_if_small(named), "wid").groupBy("rid").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    return spans.join(listed, "rid", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "spans", _covered(F.col("spans")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), *([F.col("rid").alias(key)] if key else []))


def _scan(docs: DataFrame, windows: DataFrame, lengths: list[int], first: bool) -> DataFrame:
    """Occurrences of a block of windows, plus in the first block one row for each row of ``docs``.

    Every position of a text becomes a key that the broadcast join looks up; a last key stands for the row itself.
    """
    n = F.size("words")
    own = F.lit(0).cast("long")
    keys, before, offsets = [], F.lit(0), F.lit(0)

    def keys_of(length: int) -> Column:
        return F.transform(_starts(n, length), lambda i: _key(F.col("words"), i, length))

    for length in lengths:
        keys.append(keys_of(length))
        offsets = F.when(F.col("w.length") == length, before).otherwise(offsets)
        before = before + F.greatest(F.col("n_words") - length + 1, F.lit(0))
    keys.append(F.array(own))
    rows = docs.select("rid", "doc_id", normal_words(F.col("text")).alias("words"))
    keyed = rows.withColumns({"keys": F.concat(*keys), "n_words": n})
    # the outer form: the plain one adds a filter on the size of ``keys`` below, which splits the text again per key
    points = keyed.select("rid", "doc_id", "words", "n_words", F.posexplode_outer("keys").alias("pos", "key")).alias("d")
    spark = docs.sparkSession
    small = windows.select("key", "length", F.col("words").alias("gram"), "wid")
    if first:
        itself = spark.range(1).select(own.alias("key"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("gram"),
                                       F.lit(None).cast("long").alias("wid"))
        small = small.unionByName(itself)
    start = F.col("d.pos") - offsets
    same = F.slice("d.words", F.greatest(start, F.lit(0)) + 1, F.col("w.length")) == F.col("w.gram")
    is_row = (F.col("w.length") == 0) & (F.col("d.pos") == before)
    met = (F.col("d.key") == F.col("w.key")) & (is_row | ((F.col("w.length") > 0) & (start >= 0) & same))
    # the block is bounded by its number of windows
    return points.join(F.broadcast(small).alias("w"), met).select(
        "d.rid", "d.doc_id", "d.n_words", "w.wid", start.alias("start"), F.col("w.length").alias("length"))


def _covered(spans: Column) -> Column:
    """Words inside sorted ranges: what each adds beyond the furthest end so far."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("n"),
        F.greatest(a["reach"], s["end"]).alias("reach")), lambda a: a["n"])


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns.

    Each row goes or stays for its own text, also if it shares a doc_id or has none.
    """
    rows, key = with_row_keys(docs)
    found = written(find_contamination(rows, items, window, key=key).where("n_hit > 0").select(key), "contaminated")
    return rows.join(broadcast_if_small(found), key, "left_anti").select(*docs.columns)


REPORT_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
needle AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item)),
spot AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM doc WHERE len(w) > 0),
hay AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM spot, (SELECT DISTINCT n FROM needle) WHERE i + n - 1 <= len(w)),
hit AS (SELECT rid, i, h.n, item_id FROM hay h JOIN needle USING (n, k)),
cover AS (SELECT rid, count(DISTINCT i + d) AS n_hit FROM hit, range(0, 10) AS r(d) WHERE d < n GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid)"""
