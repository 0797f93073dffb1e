"""Removal of passages that an earlier document already has: seed on winnowed anchors, extend, keep maximal repeats.

Seeds are hashes of 12 words, winnowed over 39 neighbours: whenever two documents share 50 words, they share the anchor
that stands for those 50.  Only windows of 50 words whose own anchor occurs in two documents are looked at.  A repeat is
extended both ways in steps of one word, by joining these windows with the smallest document that holds each of them;
adjoining windows form the maximal repeats.  That extends a passage against all documents that share it at once, so a
passage in a third of all documents needs no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import WordHashes, columns, lists, signed, window_hashes, written
from runledger.scale import broadcast_if_small

HASHES = WordHashes()


@dataclass(frozen=True)
class Repeats:
    words: int = 50
    seed_words: int = 12

    @property
    def winnow(self) -> int:
        return self.words - self.seed_words + 1


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(hashes: np.ndarray, rule: Repeats) -> np.ndarray:
    """For every window, the smallest seed hash inside it; equal windows have equal anchors."""
    low = window_hashes(hashes, rule.seed_words)
    if len(low) < rule.winnow:
        return np.empty(0, np.uint64)
    reach = 1
    while reach * 2 <= rule.winnow:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = rule.winnow - reach
    return np.minimum(low[: len(low) - rest], low[rest:])


def _profile(rule: Repeats):
    """Size, digest of the words and anchors of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, digests, seeds = [], [], [], []
            for doc_id, text in columns(batch, "doc_id", "text"):
                words = words_in(text)
                ids.append(doc_id)
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                seeds.append(signed(np.unique(anchors(HASHES.array(words), rule))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 batch.column("raw"), lists(seeds, pa.int64())], ["doc_id", "n_words", "digest", "raw", "anchors"])

    return run


def _windows(rule: Repeats):
    """(doc_id, raw, start, window) of the windows whose anchor is one of the document's shared seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, raw, seeds in columns(batch, "doc_id", "text", "raw", "seeds"):
                hashes = HASHES.array(words_in(text))
                at = np.flatnonzero(np.isin(signed(anchors(hashes, rule)), np.array(seeds, np.int64)))
                found = signed(window_hashes(hashes, rule.words)[at])
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), doc_id, np.int64)), pa.array([raw] * len(at), pa.binary()), pa.array(at.astype(np.int32)),
                         pa.array(found)], ["doc_id", "raw", "start", "window"])

    return run


def _cut(rule: Repeats):
    """Spans and the words kept, from the starts of repeated windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans, removed, digests, kept = [], [], [], [], []
            for doc_id, text, starts in columns(batch, "doc_id", "text", "starts"):
                words = words_in(text)
                s = np.unique(np.array(starts, np.int64))
                first = np.flatnonzero(np.diff(s, prepend=-rule.words - 1) > rule.words)
                last = np.append(first[1:], len(s)) - 1
                found = [(int(a), int(b) + rule.words) for a, b in zip(s[first], s[last], strict=True)]
                left, at = [], 0
                for a, b in found:
                    left += words[at:a]
                    at = b
                text = b" ".join(left + words[at:])
                ids.append(doc_id)
                spans.append([{"start": a, "end": b} for a, b in found])
                removed.append(sum(b - a for a, b in found))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                kept.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "digest", "spans", "n_removed", "kept_text"])

    return run


SPANS = "array<struct<start:long,end:long>>"


def repeated_passages(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, spans, kept_text, digest.

    Words are cut at the space and U+0009 to U+000D.  A word is removed if it lies in a window of ``rule.words`` words
    that also starts in a document with a smaller doc_id; windows are judged on the input.  ``spans`` are the maximal
    removed word ranges.  ``kept_text`` joins the words left by one space and is null where nothing was removed (the
    text then stays as it is); ``digest`` is the SHA-256 of all words joined by one space.

    Null and empty texts have no words.  Rows without a doc_id come before and after nobody: nothing is removed from
    them or because of them.  Rows that share a doc_id are not earlier than each other, so they lose the same words only
    to smaller ids.  Empty tables are fine; further columns are ignored.  Windows are compared by 64-bit hashes, whole
    texts by their SHA-256.
    """
    # texts that share a doc_id are told apart by the digest of their bytes
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("raw"))
    profiles = written(docs.mapInArrow(
        _profile(rule), "doc_id long, n_words long, digest binary, raw binary, anchors array<long>"), "profiles")
    named = profiles.where("doc_id IS NOT NULL")
    firsts = written(named.where(F.col("n_words") >= rule.words).groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "firsts")

    # copies of whole texts are settled by their digest; one of each class goes on
    ones = named.join(firsts, "digest").where("doc_id = first_id").select("doc_id", "raw", "anchors")
    seeds = ones.select("doc_id", "raw", F.explode("anchors").alias("anchor"))
    shared = seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    owners = seeds.join(written(shared.select("anchor"), "anchors"), "anchor").groupBy("doc_id", "raw").agg(
        F.collect_set("anchor").alias("seeds"))
    owners = written(owners, "seeds")

    texts = docs.join(broadcast_if_small(owners), ["doc_id", "raw"])
    windows = written(texts.mapInArrow(_windows(rule), "doc_id long, raw binary, start int, window long"), "windows")
    sources = windows.groupBy("window").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("hi")).where("source < hi")
    repeats = windows.join(written(sources.select("window", "source"), "sources"), "window").where("source < doc_id")
    starts = written(repeats.groupBy("doc_id", "raw").agg(F.collect_set("start").alias("starts")), "starts")

    cut = docs.join(broadcast_if_small(starts), ["doc_id", "raw"]).mapInArrow(
        _cut(rule), f"doc_id long, digest binary, spans {SPANS}, n_removed long, kept_text string")
    cut = written(cut.dropDuplicates(["doc_id", "digest"]), "cut").withColumnRenamed("doc_id", "cut_id")
    rows = profiles.drop("anchors", "raw").join(firsts.where("copies > 1").select("digest", "first_id"), "digest", "left")
    whole = F.col("doc_id") > F.col("first_id")
    rows = rows.join(cut.withColumnRenamed("digest", "cut_digest"), (F.col("doc_id") == F.col("cut_id")) & (F.col("digest") == F.col("cut_digest")), "left")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return rows.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, everything).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
        F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"), "digest")
