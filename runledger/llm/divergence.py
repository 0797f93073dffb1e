"""How the sources of a language differ in their words: run-length columns of counts, intersected pair by pair."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import columns, written
from runledger.scale import broadcast_if_small

#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: Different words that a task counts before it hands them on, and bytes of a text that are split at once.
HELD_WORDS, SLICE = 200_000, 1 << 20
#: Classes of words in one block of run-length columns, and sources of one task's pairs.
BLOCK, TILE = 2048, 64

#: A-Z becomes lower case; all other ASCII characters but a-z stand between words.
LETTERS = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, about ``SLICE`` bytes at once; a word is never cut."""
    raw = text.translate(LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    known: set[tuple[str, str]] = set()
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            yield _counted([lang] * len(terms), [source] * len(terms), pa.array(terms, pa.binary()).cast(pa.string()),
                           list(n.values()), [docs[t] for t in terms])
        found.clear()

    for batch in batches:
        for lang, source, text in columns(batch, "lang", "source", "text"):
            known.add((lang, source))
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            own: set[bytes] = set()
            for words in _words(text):
                n.update(words)
                own.update(words)
            docs.update(own)
            held += len(n) - before
            if held >= HELD_WORDS:
                yield from rows()
                held = 0
    yield from rows()
    if known:
        langs, sources = zip(*sorted(known), strict=True)
        none = [0] * len(langs)
        yield _counted(langs, sources, pa.nulls(len(langs), pa.string()), none, none)


def _counted(lang, source, term: pa.Array, n, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), term, pa.array(n, pa.int64()),
                                       pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each word and documents with it; a row with a null term for each group."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    rows = docs.select(known("lang"), known("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)``, three decimal places at a time, so that no count is too large."""
    total = max(total, 1)
    whole, rest = (counts + 1) // total, (counts + 1) % total
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // total, rest * 1000 % total
    return whole + 1


#: A block of neighbouring words of the reordered vocabulary: its number of words, and for each source with a count in it
#: the runs of equal counts, as the place after each run and the count.
COLUMNS = "lang string, width long, columns array<struct<no:int,ends:array<long>,counts:array<long>>>"
_COLUMN = pa.list_(pa.struct([("no", pa.int32()), ("ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))


def run_lengths(counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal counts: the place after each, and the count."""
    last = np.ones(len(counts), bool)
    last[:-1] = counts[1:] != counts[:-1]
    return ends[last], counts[last]


def _encode_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lang, vectors, sizes = None, [], []

    def block() -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        dense: dict[int, np.ndarray] = {}
        for place, vector in enumerate(vectors):
            for entry in vector:
                dense.setdefault(entry["no"], np.zeros(len(vectors), np.int64))[place] = entry["n"]
        runs = []
        for no in sorted(dense):
            to, counts = run_lengths(dense[no], ends)
            runs.append({"no": no, "ends": to, "counts": counts})
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int(ends[-1])], pa.int64()), pa.array([runs], _COLUMN)],
                                          ["lang", "width", "columns"])

    for batch in batches:
        for own, vector, size in columns(batch, "lang", "vector", "size"):
            if vectors and (own != lang or len(vectors) >= BLOCK):
                yield block()
                vectors, sizes = [], []
            lang = own
            vectors.append(vector)
            sizes.append(size)
    if vectors:
        yield block()


def run_length_columns(vocabulary: DataFrame) -> DataFrame:
    """Blocks of run-length columns of a vocabulary (lang, term, vector of (no, n)).

    Words with equal counts everywhere become one class first; classes are put in order of the sources that they occur in,
    then of their counts, so that a source's equal counts, above all its zeros, lie side by side.
    """
    classes = vocabulary.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("size"))
    keyed = classes.withColumn("support", F.col("vector.no"))
    keys = [F.col("lang"), F.size("support"), F.col("support"), F.col("vector")]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.select("lang", "vector", "size").mapInArrow(_encode_columns, COLUMNS)


def intersected(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of f both ways over two columns of (ends, shares): f once for each stretch on which both are constant."""
    ends = np.union1d(a[0], b[0])
    length = np.diff(ends, prepend=0)
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    square = (p - q) * (p - q)
    return int((square // q * length).sum()), int((square // p * length).sum())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, width, runs, totals, tile in columns(batch, "lang", "width", "columns", "totals", "tile"):
            given = {r["no"]: (np.array(r["ends"], np.int64), np.array(r["counts"], np.int64)) for r in runs}
            absent = np.array([width], np.int64), np.zeros(1, np.int64)
            cols = []
            for no, total in enumerate(totals):
                ends, counts = given.get(no, absent)
                cols.append((ends, shares(counts, total)))
            rows = []
            for x in range(tile * TILE, min(len(cols), (tile + 1) * TILE)):
                for y in range(x + 1, len(cols)):
                    there, back = intersected(cols[x], cols[y])
                    rows += [(x, y, there), (y, x, back)]
            if rows:
                x, y, value = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows)), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(value, pa.int64())],
                    ["lang", "a", "b", "value"])


def pair_sums(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for every two sources of a language, by number; 0 where the language has no word."""
    header = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("no", "total"))).alias("totals")).select(
        "lang", F.col("totals.total").alias("totals"))
    nothing = header.select("lang", F.lit(0).cast("long").alias("width"),
                            F.array().cast("array<struct<no:int,ends:array<long>,counts:array<long>>>").alias("columns"))
    rows = blocks.unionByName(nothing).join(broadcast_if_small(header), "lang")
    tiles = rows.withColumn("tile", F.explode(F.expr(f"sequence(0, CAST((size(totals) - 1) div {TILE} AS INT))")))
    return tiles.mapInArrow(_pairs, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"))


def _share(count: str, total: str) -> Column:
    """The same share as ``shares``, in decimals."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({total} AS DECIMAL(20,0))")


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of (lang, source).

    Words are runs of letters A-Z, a-z and non-ASCII characters, A-Z lower-cased.  A language keeps the words of at least
    ``least_docs`` of its documents.  With p and q the smoothed shares of a kept word in a group and elsewhere, in parts of
    10^9 and rounded down, its value is (p - q)^2 / q, rounded down.  Part ``pair`` compares the group with each other
    source of the language (item), the sum over all kept words; part ``term`` names the words that the group has more of
    than its language, the ``top`` first.  Ranks run from 1 by falling value, then by item in byte order.

    Null text, lang and source are empty strings.  Groups without words are compared like others; a language with one
    source has no pairs; an empty table gives no rows.  Repeated rows and ids count once per row; further columns are
    ignored.  All arithmetic is exact in whole numbers.  What grows with pairs is the result alone: blocks of words are
    compared in many tasks, and their sums are added.
    """
    counts = written(term_counts(docs), "counts")
    numbers = Window.partitionBy("lang").orderBy("source")  # a row per group
    named = written(counts.where("term IS NULL").select("lang", "source", (F.row_number().over(numbers) - 1).alias("no")), "groups")
    known = counts.where("term IS NOT NULL").join(broadcast_if_small(named), ["lang", "source"])
    vocabulary = written(
        known.groupBy("lang", "term").agg(
            F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("no", "n"))).alias("vector"))
        .where(F.col("docs") >= least_docs).drop("docs"), "vocabulary")
    by_lang = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("in_lang").alias("all_n"))
    entries = vocabulary.select("lang", "term", "in_lang", F.explode("vector").alias("e")).select("lang", "term", "in_lang", "e.no", "e.n")
    by_group = entries.groupBy("lang", "no").agg(F.sum("n").alias("group_n"))
    zero = F.lit(0).cast("long")
    groups = written(
        named.join(broadcast_if_small(by_lang), "lang", "left").join(broadcast_if_small(by_group), ["lang", "no"], "left").select(
            "lang", "source", "no", (F.coalesce("group_n", zero) + F.coalesce("kept", zero)).alias("total"),
            (F.coalesce("all_n", zero) + F.coalesce("kept", zero)).alias("lang_total")), "totals")
    sums = pair_sums(written(run_length_columns(vocabulary), "columns"), groups.select("lang", "no", "total"))
    names = broadcast_if_small(named)
    pairs = sums.join(names.withColumnRenamed("no", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("no").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    terms = entries.join(broadcast_if_small(groups), ["lang", "no"]).withColumns(
        {"p": _share("n", "total"), "q": _share("in_lang", "lang_total")}).where("p > q").select(
        "lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = {"pair": pairs.withColumn("rank", F.row_number().over(order)),
              "term": terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)}
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in ranked.items()]
    return parts[0].unionByName(parts[1])


DIVERGENCE_SQL = r"""
WITH doc AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM doc),
word AS (SELECT lang, source, rid, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS rid FROM doc)),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
here AS (SELECT lang, source, term, count(*) AS c FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, sum(c) AS n FROM here GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(s.n, 0) + l.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v)::HUGEINT AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
      LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
      LEFT JOIN size s ON s.lang = g.lang AND s.source = g.source),
both_sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN both_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
           UNION ALL
           SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM term)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
