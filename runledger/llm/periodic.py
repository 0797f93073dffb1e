"""Periodic runs of words: a run-length grammar by recompression, and extensions of harmonic-grid candidates looked up in it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import MIX_A, mixed

#: Words of the documents that share one grammar; it bounds a task's memory beside a single text.
GROUP_WORDS = 1 << 19
#: Candidates that are extended together.
STEP = 1 << 20
#: Draws of left and right symbols for a pair round; that with most pairs is taken.
DRAWS = 4

RUN = "array<struct<start:long,length:long,period:long>>"


@dataclass
class Level:
    """One level of the grammar and how it is parsed into the next one.

    ``symbols`` are numbers that are equal for equal strings; ``heads`` has the place where each symbol of the next level
    begins, and the length of this one at its end; ``up`` the symbol of the next level that holds each place.  ``left``
    says which symbols can begin a pair; where it is None the next level has a symbol for each block of equal ones.
    """

    symbols: np.ndarray
    heads: np.ndarray | None = None
    up: np.ndarray | None = None
    left: np.ndarray | None = None


def numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for keys, equal for equal ones, and how many there are."""
    codes, found = pd.factorize(keys)
    return codes, len(found)


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels of a sequence by recompression, up to one whose symbols all differ.

    Blocks of equal symbols become one each, then pairs of a left and a right symbol do, in turn.  What a place is parsed
    to depends on its neighbours alone, so equal strings are parsed alike but for their ends.
    """
    levels = []
    x, kinds = numbered(symbols)
    while kinds < len(x):
        first = np.ones(len(x), bool)
        first[1:] = x[1:] != x[:-1]
        if not first.all():
            heads = np.append(np.flatnonzero(first), len(x))
            levels.append(Level(x, heads, np.cumsum(first) - 1))
            length = np.diff(heads)
            x, kinds = numbered(x[heads[:-1]] * (int(length.max()) + 1) + length)
            continue
        number = np.arange(kinds, dtype=np.uint64)
        best: tuple[int, np.ndarray, np.ndarray] | None = None
        for draw in range(DRAWS):
            side = (mixed(number * MIX_A + np.uint64(len(levels) * DRAWS + draw)) & np.uint64(1)).astype(bool)[x]
            for left in (side, ~side):
                paired = left[:-1] & ~left[1:]
                n = int(np.count_nonzero(paired))
                if best is None or n > best[0]:
                    best = n, left, paired
        _, left, paired = best
        first[1:] = ~paired
        heads = np.append(np.flatnonzero(first), len(x))
        levels.append(Level(x, heads, np.cumsum(first) - 1, left))
        begin = heads[:-1]
        second = np.where(np.diff(heads) == 2, x[np.minimum(begin + 1, len(x) - 1)] + 1, 0)
        x, kinds = numbered(x[begin] * (kinds + 1) + second)
    levels.append(Level(x))
    return levels


def extension(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
    """How many symbols from places ``i`` and ``j`` on are equal, or before them if not ``forward``.

    The sequence must begin and end with a symbol that occurs once, and no ``i`` may equal its ``j``.  Queries climb as
    long as the symbols agree, taking the part that the next level could parse differently, then go down to the first
    place that differs; each takes a number of steps in the logarithm of what it finds.
    """
    step = 1 if forward else -1
    u, v = (i.copy(), j.copy()) if forward else (i - 1, j - 1)
    climbing = np.arange(len(u))
    height = np.zeros(len(u), np.int32)
    for number, level in enumerate(levels):
        a, b = u[climbing], v[climbing]
        same = level.symbols[a] == level.symbols[b]
        height[climbing[~same]] = number
        climbing, a, b = climbing[same], a[same], b[same]
        if not len(climbing):
            break
        if level.left is not None:
            inside = level.left[a] != forward  # a right symbol may end a pair, a left one may begin one
            a, b = a + step * inside, b + step * inside
        else:
            ra, rb = (_rest(level, x, forward) for x in (a, b))
            r = np.minimum(ra, rb)
            a, b = a + step * r, b + step * r
            apart = ra != rb
            u[climbing[apart]], v[climbing[apart]] = a[apart], b[apart]
            height[climbing[apart]] = number
            climbing, a, b = climbing[~apart], a[~apart], b[~apart]
        u[climbing], v[climbing] = level.up[a], level.up[b]
    for number in range(int(height.max(initial=0)) - 1, -1, -1):
        level = levels[number]
        going = np.flatnonzero(height > number)
        a, b = u[going], v[going]
        begin_a, begin_b = level.heads[a], level.heads[b]
        size = np.minimum(level.heads[a + 1] - begin_a, level.heads[b + 1] - begin_b)
        if forward:
            a, b = begin_a, begin_b
        else:
            a, b = level.heads[a + 1] - 1, level.heads[b + 1] - 1
        same = level.symbols[a] == level.symbols[b]
        move = step * (same if level.left is not None else same * size)
        u[going], v[going] = a + move, b + move
    return u - i if forward else i - 1 - u


def _rest(level: Level, x: np.ndarray, forward: bool) -> np.ndarray:
    """Symbols of the block from a place on, or up to it."""
    block = level.up[x]
    return level.heads[block + 1] - x if forward else x - level.heads[block] + 1


def candidates(q: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) of the harmonic grid: multiples of each period below its limit; about ``STEP`` of them at once."""
    count = np.maximum(0, -(-limit // q))
    total = np.cumsum(count)
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        periods = np.repeat(q[at:to], count[at:to])
        ends = np.cumsum(count[at:to])
        places = (np.arange(len(periods)) - np.repeat(ends - count[at:to], count[at:to])) * periods
        yield periods, places
        at = to


def runs_of(texts: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """For each sequence of word numbers its runs as rows of (start, length, period), by start, then period.

    A run is a stretch with smallest period q and at least ``max(least, 2 * q)`` words that cannot be extended.  It holds
    two neighbouring multiples of q, so the maximal stretch around each such pair of equal words is looked up.
    """
    order = sorted((k for k, t in enumerate(texts) if len(t) >= least), key=lambda k: -len(texts[k]))
    out = [np.empty((0, 3), np.int64)] * len(texts)
    if not order:
        return out
    lengths = np.array([len(texts[k]) for k in order])
    starts = np.cumsum(lengths + 1) - lengths  # every text is preceded by a symbol of its own
    base = max(int(texts[k].max()) for k in order) + 1
    x = np.empty(int(starts[-1] + lengths[-1]) + 1, np.int64)
    x[starts - 1] = base + np.arange(len(order))
    x[-1] = base + len(order)
    for k, s in zip(order, starts.tolist(), strict=True):
        x[s : s + len(texts[k])] = texts[k]
    x, _ = numbered(x)
    levels = grammar(x)
    threes = _threes(x)
    q = np.arange(1, int(lengths[0]) // 2 + 1)
    held = np.searchsorted(-lengths, -2 * q, "right")  # the first texts are long enough for q
    limit = (starts + lengths)[held - 1] - q
    found = [np.empty((0, 3), np.int64)]
    cover_period, cover_end = np.ones(len(x), np.int64), np.zeros(len(x), np.int64)
    for period, i in candidates(q, limit):
        j = i + period
        # max(least, 2 q) words need 6 equal ones around the pair, so three on one side, if no run is shorter than 12
        near = threes[i] == threes[j]
        near |= (i >= 3) & (threes[i - 3] == threes[j - 3])
        near &= (x[i] == x[j]) & ((j >= cover_end[i]) | (period % cover_period[i] != 0))  # else in a run of a part of the period
        i, j, period = i[near], j[near], period[near]
        begin = i - extension(levels, i, j, forward=False)
        end = j + extension(levels, i, j)
        good = end - begin >= np.maximum(least, 2 * period)
        new = np.unique(np.stack([begin, end, period], axis=1)[good], axis=0)
        found.append(new)
        for b, e, p in new[new[:, 1] - new[:, 0] >= 64].tolist():
            longer = cover_end[b:e] < e
            cover_period[b:e][longer] = p
            cover_end[b:e][longer] = e
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # a multiple of the period gives the same stretch
    runs = runs[fresh]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    bounds = np.searchsorted(runs[:, 0], starts)
    for k, s, lo, hi in zip(order, starts.tolist(), bounds.tolist(), [*bounds[1:].tolist(), len(runs)], strict=True):
        mine = runs[lo:hi]
        out[k] = np.stack([mine[:, 0] - s, mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
    return out


def _threes(x: np.ndarray) -> np.ndarray:
    """A number for the three symbols from each place on; the last two places have numbers of their own."""
    out = -1 - np.arange(len(x))
    if len(x) >= 3:
        two, kinds = numbered(x[:-1] * (int(x.max()) + 1) + x[1:])
        out[:-2], _ = numbered(two[:-1] * (int(x.max()) + 1) + x[2:])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_RUN = ["start", "length", "period"]


def _batch(doc_ids: list, texts: list[list[bytes]], least: int, kind: pa.DataType) -> pa.RecordBatch:
    numbers = _Numbers()
    runs = runs_of([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in texts], least)
    flat = np.concatenate(runs)
    ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], _RUN)
    kept = [b" ".join(collapsed(w, r)) for w, r in zip(texts, runs, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, kind), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), parts),
         pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"])


def _detect(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list = []
        texts: list[list[bytes]] = []
        held, kind = 0, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                doc_ids.append(doc_id)
                texts.append((text.as_py() or b"").split())
                held += len(texts[-1]) + 1
                if held >= GROUP_WORDS:
                    yield _batch(doc_ids, texts, least, kind)
                    doc_ids, texts, held = [], [], 0
        if doc_ids:
            yield _batch(doc_ids, texts, least, kind)

    return run


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs, collapsed_text.

    Words are runs of characters other than the space and U+0009 to U+000D, numbered from 0.  ``runs`` has (start, length,
    period) of every maximal stretch with smallest period q and at least ``max(least, 2 * q)`` words, by start, then
    period; ``least`` is 12 or more.  ``collapsed_text`` has the words, joined by one space, that no run contains after
    its first period.

    Null and empty texts have no words, no runs and an empty collapsed text.  Rows are judged one by one, whatever their
    doc_ids; an empty table gives an empty one; further columns are ignored.  Nothing is shuffled.  The documents of a
    task share a grammar for every half million words; a text of any length takes n log n steps.
    """
    if least < 12:
        raise ValueError("runs of fewer than 12 words are not looked for")
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_detect(least), f"doc_id {kind}, n_words long, runs {RUN}, collapsed_text string")
