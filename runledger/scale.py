"""Helpers that keep joins and ordered work safe when sizes and key counts are unknown."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Rows that a task sorts at most, where the number of tasks follows the rows.
TASK_ROWS = 1_000_000

# Range pieces are nodes of a tree with fan-out 8: level l has nodes of width 8**l.
NODE_BITS = 3


@cache
def _local_scratch(application: str) -> str:
    del application
    return tempfile.mkdtemp(prefix="runledger-")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``; where none is set, a local run gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_scratch(spark.sparkContext.applicationId)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure the rows (reading at most ``max_rows`` + 1 of them), not the optimizer's guess."""
    width = F.sum(F.length(F.to_json(F.struct("*"))))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), width).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, **limits) -> DataFrame:
    """Hint a broadcast only for a measured size; otherwise leave the join to the shuffle and AQE."""
    return F.broadcast(df) if is_small(df, **limits) else df


#: Bits of a filter of keys: at least this many per key, and at most 32 MB in all, in rows of 4 KB.
KEY_BITS, MAX_FILTER_BITS, FILTER_ROW_BITS = 16, 28, 15


def filter_size(n: int) -> int:
    """Bits of a filter of ``n`` keys."""
    return 1 << min(MAX_FILTER_BITS, max(FILTER_ROW_BITS, (KEY_BITS * n).bit_length()))


def _place() -> Column:
    return F.col("_bit").bitwiseAND((1 << FILTER_ROW_BITS) - 1)


def _bit(on: Sequence[str], types: Sequence[DataType], size: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(c).cast(t) for c, t in zip(on, types, strict=True))), F.lit(size))


def key_bits(keys: DataFrame, on: Sequence[str], size: int, types: Sequence[DataType]) -> DataFrame:
    """Bitmap of the hashes of the keys, in rows; ``types`` are those of the rows that it is for."""
    bits = keys.select(_bit(on, types, size).alias("_bit"))
    return bits.groupBy(F.shiftright("_bit", FILTER_ROW_BITS).alias("_row")).agg(F.bitmap_construct_agg(_place()).alias("_bits"))


def _marked(rows: DataFrame, bits: DataFrame, size: int, on: Sequence[str]) -> tuple[DataFrame, Column]:
    types = [rows.schema[c].dataType for c in on]
    marked = rows.withColumn("_bit", _bit(on, types, size)).join(
        F.broadcast(bits), F.shiftright("_bit", FILTER_ROW_BITS) == F.col("_row"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(_place(), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked, F.coalesce(F.getbit(byte, _place().bitwiseAND(7).cast("int")) == 1, F.lit(False))


def marked_by_bits(rows: DataFrame, bits: DataFrame, size: int, on: Sequence[str], hit: bool) -> DataFrame:
    """Rows that may equal a key of ``key_bits``, or with ``hit`` false those that equal none."""
    marked, found = _marked(rows, bits, size, on)
    return marked.filter(found if hit else ~found).select(*rows.columns)


def split_by_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str], n: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` that equal none of the ``n`` stored ``keys`` in ``on``, and those that may equal one.

    A bitmap of the keys' hashes is broadcast.  Its size is bounded; with more keys than fit more rows are in doubt, but none
    is ever on the wrong side.
    """
    size = filter_size(n)
    marked, hit = _marked(rows, key_bits(keys, on, size, [rows.schema[c].dataType for c in on]), size, on)
    return marked.filter(~hit).select(*rows.columns), marked.filter(hit).select(*rows.columns)


def _stored_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    path = scratch_dir(rows.sparkSession, "keys")
    keys.select(*on).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(keys.select(*on).schema).parquet(path)


def may_match(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows that equal a key in ``on``, and few others; none is shuffled.  For joins that need no other rows."""
    keys = _stored_keys(rows, keys, on)
    if is_small(keys):
        return rows.join(F.broadcast(keys), list(on), "left_semi").select(*rows.columns)
    return split_by_keys(rows, keys, on, keys.count())[1]


def without_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that equal no key in ``on``, as a left anti join has them; only those that may equal one are shuffled."""
    on = list(on)
    keys = _stored_keys(rows, keys, on)
    if is_small(keys):
        return rows.join(F.broadcast(keys), on, "left_anti")
    clear, doubtful = split_by_keys(rows, keys, on, keys.count())
    return clear.unionByName(doubtful.join(keys, on, "left_anti"))


def join_few(rows: DataFrame, values: DataFrame, on: str) -> DataFrame:
    """Rows with the values of their key, as a left join has them; only rows that may have one are shuffled."""
    path = scratch_dir(rows.sparkSession, "values")
    values.write.option("compression", "zstd").parquet(path)
    values = rows.sparkSession.read.schema(values.schema).parquet(path)
    if is_small(values):
        return rows.join(F.broadcast(values), on, "left")
    clear, doubtful = split_by_keys(rows, values, [on], values.count())
    return doubtful.join(values, on, "left").unionByName(clear, allowMissingColumns=True)


def tasks_for(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS) -> int:
    """How many partitions keep a task's share of ``rows`` the same however many there are; at least the usual number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))


def node_of(point: Column, level: int) -> Column:
    """Tree node of ``point`` at ``level``."""
    return F.shiftright(point, NODE_BITS * level)


def levels_for(max_length: int | None) -> int:
    """How many levels canonical pieces of ranges up to ``max_length`` can use."""
    return max(1, -(-int(max_length or 1).bit_length() // NODE_BITS))


def range_pieces(lo: Column, hi: Column, levels: int) -> Column:
    """Disjoint tree nodes that exactly cover ``[lo, hi)``: array<struct<level, node>>.

    A node is used at its level when it lies in the range and its parent does not, so
    there are at most 2 * 7 pieces per level and looking a point up needs no filter.
    """
    def first(level):
        return F.shiftright(lo + F.lit((1 << NODE_BITS * level) - 1), NODE_BITS * level)

    def nodes(level, begin, end):
        seq = F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(seq, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))

    parts = []
    for level in range(levels):
        begin, end = first(level), node_of(hi, level)
        if level == levels - 1:
            parts.append(nodes(level, begin, end))
            continue
        up_begin, up_end = first(level + 1), node_of(hi, level + 1)
        inner = up_begin < up_end
        left_end = F.when(inner, F.shiftleft(up_begin, NODE_BITS)).otherwise(end)
        right_begin = F.when(inner, F.shiftleft(up_end, NODE_BITS)).otherwise(end)
        parts += [nodes(level, begin, left_end), nodes(level, right_begin, end)]
    return F.flatten(F.array(*parts))


def point_nodes(point: Column, levels: int) -> Column:
    """Every tree node holding ``point``: array<struct<level, node>>."""
    return F.array(*[F.struct(F.lit(n).alias("level"), node_of(point, n).alias("node")) for n in range(levels)])


def previous_in_key(df: DataFrame, key: str, order: Sequence[str], bucket: Column,
                    values: Sequence[str]) -> DataFrame:
    """Add ``prev_<v>`` of the preceding row of the same key, without sorting a key in one task.

    ``bucket`` must not decrease along ``order`` (a time bucket, say).  Rows are sorted
    inside (key, bucket); only one row per bucket crosses to the next bucket.
    """
    packed = F.struct(*values)
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    lasts = rows.groupBy(key, "_bucket").agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    carried = lasts.select(key, "_bucket", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket"))
                           .alias("_carry"))
    joined = rows.withColumn("_prev", F.lag(packed).over(inside)).join(carried, [key, "_bucket"], "left")
    prev = F.coalesce("_prev", "_carry")
    for v in values:
        joined = joined.withColumn(f"prev_{v}", prev[v])
    return joined.drop("_bucket", "_prev", "_carry")


def run_time(name: Column) -> Column:
    """Time in a run name ``yyMMdd_HHmm``; years 69 to 99 belong to the last century."""
    time = F.try_to_timestamp(name, F.lit("yyMMdd_HHmm")).cast("timestamp_ntz")
    return F.when(F.year(time) >= 2069, time - F.expr("INTERVAL 100 YEARS")).otherwise(time)
