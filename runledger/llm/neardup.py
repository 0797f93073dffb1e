"""Near-duplicate groups by a multi-index Hamming join over b-bit MinHash signatures.

A signature has 84 symbols of 8 bits in 14 chunks of 6.  Two signatures that differ in at most 27 symbols have, by the
pigeonhole principle, a chunk with at most one error, so they share one of that chunk's six keys "all symbols but one":
every pair within distance 27 meets.  A pair of similarity 0.8 has an error in a symbol with probability below 0.2, so it
stays apart in all chunks with probability 0.345 ** 14 = 3.4e-7.  Whatever meets is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import MIX_A, MIX_B, WordHashes, columns, lists, mixed, signed, window_hashes, with_row_keys, written
from runledger.scale import broadcast_if_small


@dataclass(frozen=True)
class Signature:
    chunks: int = 14
    chunk_symbols: int = 6
    seed: int = 1
    #: Longs of a set's bitmap.  Bits that differ are a lower bound for the shingles that differ, so comparing bitmaps
    #: rules pairs out without ever losing one.
    longs: int = 32

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk_symbols

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        a = draw.integers(0, 2**63, self.symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, draw.integers(0, 2**63, self.symbols, dtype=np.uint64)


SET_SCHEMA = "doc_id long, n long, h1 long, h2 long, symbols binary, bits array<long>"
HASHES = WordHashes()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text with words is one shingle."""
    words = HASHES.array((text or "").encode("utf-8", "surrogatepass").lower().split())
    if 0 < len(words) < size:
        return window_hashes(words, len(words)) ^ MIX_B
    return np.unique(window_hashes(words, size))


def set_key(shingles: np.ndarray) -> np.ndarray:
    """128 bits that stand for the whole set."""
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """Smallest value of each permutation over the set, in blocks, so that long texts need no more memory."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        np.minimum(low, (np.multiply.outer(a, shingles[i : i + block]) + b[:, None]).min(axis=1), out=low)
    return low


def _sign(size: int, signature: Signature):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = signature.factors()
        for batch in batches:
            ids, n, keys, symbols, bitmaps = [], [], [], [], []
            for doc_id, text in columns(batch, "doc_id", "text"):
                s = shingle_hashes(text, size)
                low = mixed(minima(s, a, b) * MIX_A) if len(s) else np.zeros(signature.symbols, np.uint64)
                bits = np.zeros(64 * signature.longs, np.uint8)
                bits[s % np.uint64(len(bits))] = 1
                ids.append(doc_id)
                n.append(len(s))
                keys.append(set_key(s))
                symbols.append((low & np.uint64(255)).astype(np.uint8).tobytes())
                bitmaps.append(np.packbits(bits).view(np.int64))
            key = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]),
                 pa.array(symbols, pa.binary()), lists(bitmaps, pa.int64())],
                ["doc_id", "n", "h1", "h2", "symbols", "bits"])

    return run


def _index(signature: Signature):
    """Keys of a signature: five symbols of a chunk (40 bits) and which five (7 bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = signature.chunk_symbols
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = np.array(batch.column("node").to_pylist(), np.int64)
            flat = np.frombuffer(b"".join(batch.column("symbols").to_pylist()), np.uint8)
            symbols = flat.reshape(len(nodes), signature.chunks, width).astype(np.uint64)
            for left_out in range(width):
                rest = [symbols[:, :, j] for j in range(width) if j != left_out]
                key = np.zeros(rest[0].shape, np.uint64)
                for s in rest:
                    key = (key << np.uint64(8)) | s
                place = np.arange(signature.chunks, dtype=np.uint64) * np.uint64(width) + np.uint64(left_out)
                key = (key << np.uint64(8)) | place[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key.reshape(-1))), pa.array(np.repeat(nodes, signature.chunks))], ["key", "node"])

    return run


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(text, size) for text in batch.column("text").to_pylist()]
            key = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[:, 0]), pa.array(key[:, 1]), lists([signed(s) for s in sets], pa.int64())], ["h1", "h2", "shingles"])

    return run


def _may_link(percent: int, longs: int) -> Column:
    """Sizes and bitmaps allow the similarity: the sets differ in at least as many shingles as the bitmaps in bits."""
    sizes = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    differ = reduce(Column.__add__, (
        F.bit_count(F.get("a.bits", F.lit(i)).bitwiseXOR(F.get("b.bits", F.lit(i)))) for i in range(longs)))
    return sizes & (differ * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent))


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(classes.select("node", "rep", "h1", "h2").join(nodes, "node"), "wanted")
    texts = docs.join(broadcast_if_small(wanted.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = texts.mapInArrow(_shingles(size), "h1 long, h2 long, shingles array<long>").join(
        broadcast_if_small(wanted.select("node", "h1", "h2")), ["h1", "h2"])
    sets = written(sets.select("node", "shingles"), "sets")
    both = broadcast_if_small(pairs).join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached, for every node of ``edges`` (a, b).

    Each round takes the smallest label among neighbours, then the label of that label; it ends when nothing changes.
    A node with very many edges is split by the joins, and its messages are combined before they are shuffled.
    """
    links = written(edges.union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")
    while True:
        heard = links.join(labels, links.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        nearer = written(nearer, "labels")
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(nearer.join(jump, "label", "left").select(
            "node", "old", F.coalesce("further", "label").alias("label")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, signature: Signature = Signature()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words at the space and U+0009 to U+000D.  A set holds the distinct shingles
    of ``shingle`` words; a shorter text with words is one shingle.  Sets are linked if the intersection has at least
    ``percent`` of the union; equal sets are one node.  ``component_id`` is the smallest doc_id that links reach,
    ``kept`` marks it.

    Null and empty texts have empty sets and are linked with nothing.  Rows without a doc_id keep a null component and
    are kept; rows that share a doc_id are judged by their own text each.  Empty tables are fine; further columns are
    ignored.  Shingles are compared by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = written(docs.mapInArrow(_sign(shingle, signature), SET_SCHEMA), "signatures")
    classes = signs.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("symbols").alias("symbols"),
        F.min("bits").alias("bits"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = connected(_links(docs, classes, shingle, percent, signature))
    nodes = classes.join(labels, "node", "left").where("copies > 1 OR label IS NOT NULL").withColumn(
        "label", F.coalesce("label", "node"))
    nodes = written(nodes.select("h1", "h2", "n", "rep", "label"), "nodes")
    smallest = written(nodes.groupBy("label").agg(F.min("rep").alias("component")), "components")
    known = written(nodes.join(smallest, "label").select("h1", "h2", "n", "component"), "known")
    rows = signs.select("doc_id", "n", "h1", "h2").join(known, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, signature: Signature) -> DataFrame:
    """Links between classes that together connect whatever any links connect.

    A first round tests each member of a bucket against the bucket's smallest node, a second one those that are not yet
    connected with a member drawn by hash, which differs from bucket to bucket: at most one candidate per member each.
    The last round tests the pairs of a bucket that are still unconnected; a bucket whose members are all connected,
    such as one of thousands of near copies, has none.
    """
    keys = classes.select("node", "symbols").mapInArrow(_index(signature), "key long, node long")
    buckets = keys.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(keys.join(written(buckets, "buckets"), "key"), "shared")
    facts = classes.select("node", "n", "bits")

    def candidates(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(facts.alias("a"), F.col("x") == F.col("a.node")).join(facts.alias("b"), F.col("y") == F.col("b.node"))
        return pairs.where(_may_link(percent, signature.longs)).select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    first = written(candidates(shared.where("node <> center").select(
        F.col("center").alias("x"), F.col("node").alias("y")).distinct()), "first")
    linked = written(_confirmed(docs, classes, first, shingle, percent), "linked")

    rest = _unconnected(shared.where("members > 2"), connected(linked))
    centers = rest.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.xxhash64("key", "node")).alias("center"))
    drawn = rest.join(centers, "key").where("label <> center.label").select(
        F.col("center.node").alias("x"), F.col("node").alias("y")).distinct()
    drawn = written(candidates(drawn).join(first, ["a", "b"], "left_anti"), "drawn")
    linked = written(linked.union(_confirmed(docs, classes, drawn, shingle, percent)), "linked")

    rest = written(_unconnected(rest, connected(linked)).join(facts, "node"), "rest")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
    last = rest.alias("a").join(rest.alias("b"), apart & _may_link(percent, signature.longs)).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct().join(first.union(drawn), ["a", "b"], "left_anti")
    more = _confirmed(docs, classes, written(last, "last"), shingle, percent)
    return linked.union(more)


def _unconnected(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the buckets whose members do not all have one label."""
    labelled = written(members.select("key", "node").join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label")), "labelled")
    mixed_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return written(labelled.join(written(mixed_keys.select("key"), "mixed"), "key"), "unconnected")


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest doc_id, rows without one last, ties by row key.

    Rows are grouped by their own texts, also if they share a doc_id or have none; rows without words stay.
    """
    rows, key = with_row_keys(docs)
    groups = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), shingle, percent)
    groups = groups.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, "doc_id"), key)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col(key).alias("row"))
    groups = written(groups, "groups")
    several = groups.groupBy("component_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    gone = groups.join(several.select("component_id", F.col("first.row").alias("first")), "component_id").where(
        F.col(key) != F.col("first")).select(key)
    # far fewer rows go than stay, so that texts are not shuffled where the keys that go are small
    return rows.join(broadcast_if_small(written(gone, "gone")), key, "left_anti").select(*docs.columns)
