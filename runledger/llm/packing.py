"""Packing of token pieces into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from runledger.llm.common import columns
from runledger.llm.tokens import encoder

PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
#: Windows that are balanced together; it bounds a task's memory and the cost of a merge.
BATCH_WINDOWS = 256
#: Pieces shorter than a window by this factor are bundled before they are balanced.
BUNDLES = 16


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Split item numbers into ``windows`` lists of near-equal total size.

    Every item starts as a partial partition of its own.  The two with the largest imbalance are merged again and again,
    the fullest window of one with the emptiest of the other, until one partition is left.
    """
    heap = []
    for i, size in enumerate(sizes):
        totals = np.zeros(windows, np.int64)
        totals[-1] = size
        heap.append((-size, i, totals, [()] * (windows - 1) + [(i,)]))
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(windows)]
    while len(heap) > 1:
        _, n, t1, m1 = heapq.heappop(heap)
        _, _, t2, m2 = heapq.heappop(heap)
        total = t1 + t2[::-1]
        order = np.argsort(total, kind="stable")
        last = len(m2) - 1
        members = [_joined(m1[i], m2[last - i]) for i in order.tolist()]
        total = total[order] - total.min()
        heapq.heappush(heap, (-int(total[-1]), n, total, members))
    return [_flat(m) for m in heap[0][3]]


def _joined(a: tuple, b: tuple) -> tuple:
    return (a, b) if a and b else a or b


def _flat(tree) -> list[int]:
    found, open_ = [], [tree]
    while open_:
        node = open_.pop()
        if isinstance(node, tuple):
            open_.extend(node)
        else:
            found.append(node)
    return sorted(found)


def balance(sizes: list[int], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length), none above ``capacity``, for items of at most ``capacity``.

    The number of windows is the smallest that could hold all.  Differencing makes them near equal.  Where a window
    exceeds the capacity and items may be cut, the excess is cut off its last item and moves to windows with room left;
    where they may not, the number of windows rises until none exceeds it.
    """
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = [[(i, 0, sizes[i]) for i in w] for w in difference(sizes, count)]
        totals = [sum(p[2] for p in w) for w in windows]
        over = sum(max(0, t - capacity) for t in totals)
        if not over:
            return [w for w in windows if w]
        if cut:
            return _levelled(windows, totals, capacity)
        count += max(1, over // capacity)


def _levelled(windows, totals, capacity):
    excess = []
    for w, total in zip(windows, totals, strict=True):
        while total > capacity:
            item, start, length = w.pop()
            keep = max(0, length - (total - capacity))
            if keep:
                w.append((item, start, keep))
            excess.append((item, start + keep, length - keep))
            total -= length - keep
    room = sorted(((capacity - sum(p[2] for p in w), k) for k, w in enumerate(windows)), reverse=True)
    for item, start, length in sorted(excess, key=lambda p: -p[2]):
        while length:
            free, k = room.pop(0)
            take = min(free, length)
            windows[k].append((item, start, take))
            start, length = start + take, length - take
            if free > take:
                _insert(room, (free - take, k))
    return [w for w in windows if w]


def _insert(room: list[tuple[int, int]], entry: tuple[int, int]) -> None:
    """Keep the list in falling order."""
    lo, hi = 0, len(room)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if room[mid] > entry else (lo, mid)
    room.insert(lo, entry)


def bundled(sizes: list[int], least: int) -> list[tuple[list[int], int]]:
    """Items as bundles (item numbers, size) of at least ``least``, but for the last: small items share one, in order.

    The number of bundles is bounded by the total size, however many tiny items there are.
    """
    found: list[tuple[list[int], int]] = []
    open_: list[int] = []
    held = 0
    for i, size in enumerate(sizes):
        if size >= least:
            found.append(([i], size))
            continue
        open_.append(i)
        held += size
        if held >= least:
            found.append((open_, held))
            open_, held = [], 0
    return [*found, (open_, held)] if open_ else found


def within(sizes: list[int], start: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(item, start, length) of the parts of items that lie in a stretch of their bundle."""
    for i, size in enumerate(sizes):
        low, high = max(0, start), min(size, start + length)
        if low < high:
            yield i, low, high - low
        start -= size


def _pack(path: str, end_id: int, capacity: int, literal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, literal).ids
        end = np.array([end_id], "<u4").tobytes()
        part, sequence = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        waiting: list[tuple] = []  # last pieces of documents: doc_id, start, doc_tokens, ids
        held = 0

        def place(doc_id, start, ids, doc_tokens, offset):
            rows.append((doc_id, start, len(ids) // 4, doc_tokens, part << 33 | sequence, offset, ids))

        def settle():
            nonlocal sequence, held
            bundles = bundled([len(p[3]) // 4 for p in waiting], max(1, capacity // BUNDLES))
            for window in balance([size for _, size in bundles], capacity):
                offset = 0
                for b, start, length in window:
                    for i, at, n in within([len(waiting[i][3]) // 4 for i in bundles[b][0]], start, length):
                        doc_id, before, doc_tokens, ids = waiting[bundles[b][0][i]]
                        place(doc_id, before + at, ids[4 * at : 4 * (at + n)], doc_tokens, offset)
                        offset += n
                sequence += 1
            waiting.clear()
            held = 0

        for batch in batches:
            for doc_id, text in columns(batch, "doc_id", "text"):
                ids = encode(text) + end
                total = len(ids) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    place(doc_id, start, ids[4 * start : 4 * (start + capacity)], total, 0)
                    sequence += 1
                if full < total:
                    waiting.append((doc_id, full, total, ids[4 * full :]))
                    held += total - full
                if held >= BATCH_WINDOWS * capacity:
                    settle()
                while len(rows) >= 4096:
                    yield _batch(rows[:4096])
                    rows = rows[4096:]
        if waiting:
            settle()
        for low in range(0, len(rows), 4096):
            yield _batch(rows[low : low + 4096])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, literal_specials: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    A document is its ids, then ``end_id``.  It fills whole sequences first; what is left over, below one sequence, is
    balanced with that of other documents of the same partition, at most 256 windows at a time, so each such batch
    leaves less than one sequence of padding and nothing is shuffled.  Columns: doc_id, start (ids before the piece),
    length, doc_tokens, sequence_id, offset (in its sequence, gapless from 0), ids (little-endian unsigned 32 bits).

    Null and empty texts are the end id alone.  Rows without a doc_id, and rows that repeat one, are packed like all
    others.  An empty table gives no piece; further columns are ignored.  ``literal_specials``: names of special tokens
    in a text are ordinary text.
    """
    return docs.select("doc_id", "text").mapInArrow(_pack(tokenizer, end_id, capacity, literal_specials), PIECES)
