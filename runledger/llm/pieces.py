"""SentencePiece BPE ids of whole texts by merge rounds over flat symbol arrays, and texts from ids."""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import columns

#: The sign that stands for a space inside pieces.
SPACE = "▁"
#: What a lone unknown id decodes to; fixed by the format.
UNKNOWN_TEXT = " ⁇ "
NO_RANK = np.iinfo(np.int32).max
#: Segments whose ids a worker keeps, and the longest that it keeps.
KEPT_SEGMENTS, KEPT_CHARS = 300_000, 64
#: Characters that are merged together, and texts that are cut together; they bound a task's memory beside a text itself.
ROUND_CHARS, TEXTS = 1 << 17, 64
#: Rounds, counted in symbols looked at over symbols given, after which what is left goes through a queue.  Words never
#: need so many; long rows of merges that depend on each other do, such as a million equal signs.
ROUNDS = 24


def _one_per_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one-per-byte", _one_per_byte)


class Pieces:
    """What the ids of a model stand for."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = f" a  \u00e9\t{SPACE}b "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models that keep texts as they are, with a space in front, can be used")
        n = model.get_piece_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(names[i][1:-1], 16) for i in range(n) if model.is_byte(i)}
        self.control = {i for i in range(n) if model.is_control(i)}
        special = {i for i in range(n) if i in self.control or i in self.byte_of or model.is_unknown(i) or model.is_unused(i)}
        self.scored = {names[i]: (i, model.get_score(i)) for i in range(n) if i not in special}
        self.plain = [None if i in special else names[i].replace(SPACE, " ").encode() for i in range(n)]


class Vocabulary(Pieces):
    """Symbols, pair ranks and byte ids of a model; symbol numbers are ids, then one number for all unknown characters."""

    def __init__(self, path: str):
        super().__init__(path)
        ids = {piece: i for piece, (i, _) in self.scored.items()}
        byte = {b: i for i, b in self.byte_of.items()}
        self.byte_ids = np.array([byte[b] for b in range(256)], "<u4")
        self._ranks(ids, {piece: score for piece, (_, score) in self.scored.items()}, len(self.plain))
        self._cuts(ids)
        del self.scored

    def _ranks(self, ids: dict[str, int], score: dict[str, float], n: int) -> None:
        """Every split of a piece into two others is a pair; its rank is the place of the piece's score, the best first."""
        self.size = n + 1
        self.char_symbol = np.full(0x110000, n, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = i
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs: dict[int, int] = {}
        unsafe: set[int] = set()
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in ids and b in ids:
                    pairs[ids[a] * self.size + ids[b]] = i
                unsafe.update(order[score[p]] for p in (a, b) if p in ids and len(p) > 1 and score[p] <= score[piece])
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.made = np.array([pairs[k] for k in keys.tolist()] + [n], np.int32)
        self.rank = np.full(n + 1, NO_RANK, np.int32)
        for piece, i in ids.items():
            self.rank[i] = order[score[piece]]
        #: Ranks whose merge may make a pair of no worse rank: only the first merge of a neighbourhood is certain.
        self.unsafe = np.zeros(len(order) + 1, bool)
        self.unsafe[list(unsafe)] = True
        self.reach = 4 * max(map(len, ids))

    def _cuts(self, ids: dict[str, int]) -> None:
        """No piece holds a space after another sign: nothing merges across such a place, so texts are cut there."""
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids)
        self.segment = re.compile(".+", re.S) if crossing else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        #: Neighbours within some piece, as sorted codes; elsewhere a segment is cut again.
        near = {ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:], strict=False)}
        self.near = np.array(sorted(near), np.int64)

    def pair_symbol(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What two symbols make, or the number of unknown characters if nothing."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], self.size - 1)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def meanings(path: str) -> Pieces:
    """What decoding needs, without the tables of merges."""
    return Pieces(path)


def merge_rounds(chars: np.ndarray, ends: np.ndarray, v: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of segments that lie one after the other in ``chars`` (code points; ``ends`` where each segment ends).

    Each round finds the least pair rank of every segment and merges its pairs from the left without overlap, all
    segments at once; then the arrays close up, and segments without pairs leave.  A sequential merge of the best,
    leftmost pair gives the same: where a merge may create a pair of no worse rank, only the first pair of each
    neighbourhood merges in a round.  Returns (symbol, first character, segment) of what is left, in text order.
    """
    lengths = np.diff(ends, prepend=0)
    seg = np.repeat(np.arange(len(ends)), lengths)
    sym, at = v.char_symbol[chars], np.arange(len(chars))
    made = np.full(len(sym), v.size - 1, np.int32)
    if len(sym) > 1:
        made[:-1] = np.where(seg[1:] == seg[:-1], v.pair_symbol(sym[:-1], sym[1:]), v.size - 1)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    work = rounds * len(sym)
    while len(sym):
        rank = v.rank[made]
        first = np.flatnonzero(np.diff(seg, prepend=-1))
        count = np.diff(first, append=len(sym))
        least = np.minimum.reduceat(rank, first)
        alive = np.repeat(least != NO_RANK, count)
        if not alive.all():
            done.append((sym[~alive], at[~alive], seg[~alive]))
            sym, at, seg, made, rank = sym[alive], at[alive], seg[alive], made[alive], rank[alive]
            least, count = least[least != NO_RANK], count[least != NO_RANK]
            if not len(sym):
                break
        work -= len(sym)
        if work < 0:
            done += _queued(sym, at, seg, v)
            break
        spots = np.flatnonzero(rank == np.repeat(least, count))
        spots = spots[_chosen(spots, at, seg, v.unsafe[rank[spots]], v.reach)]
        sym[spots] = made[spots]
        keep = np.ones(len(sym), bool)
        keep[spots + 1] = False
        new = (np.cumsum(keep) - 1)[spots]
        sym, at, seg, made = sym[keep], at[keep], seg[keep], made[keep]
        touched = np.concatenate([new, new[new > 0] - 1])
        inner = touched[touched + 1 < len(sym)]
        made[touched] = v.size - 1
        inner = inner[seg[inner] == seg[inner + 1]]
        made[inner] = v.pair_symbol(sym[inner], sym[inner + 1])
    if not done:
        return sym, at, seg
    sym, at, seg = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(at, kind="stable")
    return sym[order], at[order], seg[order]


def _chosen(spots: np.ndarray, at: np.ndarray, seg: np.ndarray, unsafe: np.ndarray, reach: int) -> np.ndarray:
    """Which pairs of the least rank merge now: every second one of a chain, or the first one near an unsafe pair."""
    chain = np.ones(len(spots), bool)
    chain[1:] = (np.diff(spots) != 1) | (seg[spots[1:]] != seg[spots[:-1]])
    begin = np.maximum.accumulate(np.where(chain, np.arange(len(spots)), 0))
    ok = (np.arange(len(spots)) - begin) % 2 == 0
    if unsafe.any():
        alone = np.ones(len(spots), bool)
        alone[1:] = (seg[spots[1:]] != seg[spots[:-1]]) | (at[spots[1:]] - at[spots[:-1]] > reach)
        ok = np.where(unsafe, alone, ok)
    return ok


def _queued(sym: np.ndarray, at: np.ndarray, seg: np.ndarray, v: Vocabulary) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rest of long dependent segments, one by one: the best, leftmost pair from a queue, n log n for any text."""
    out = []
    bounds = [*np.flatnonzero(np.diff(seg, prepend=-1)).tolist(), len(sym)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        symbols = sym[lo:hi].tolist()
        n = len(symbols)
        after, before, heap = [*range(1, n), -1], list(range(-1, n - 1)), []
        table: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < 0:
                return
            pair = (symbols[i], symbols[j])
            if pair not in table:
                table[pair] = int(v.pair_symbol(np.array([pair[0]]), np.array([pair[1]]))[0])
            rank = int(v.rank[table[pair]])
            if rank != NO_RANK:
                heapq.heappush(heap, (rank, i, pair))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j < 0 or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = table[pair], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        left = np.array(symbols, np.int32)
        keep = left >= 0
        out.append((left[keep], at[lo:hi][keep], seg[lo:hi][keep]))
    return out


class PieceEncoder(dict):
    """Little-endian unsigned 32-bit ids by segment of text; segments not seen before are merged together in one call."""

    def __init__(self, path: str):
        super().__init__()
        self.v = vocabulary(path)

    def __missing__(self, segment: str) -> bytes:
        return self.long[segment]

    def learn(self, segments: list[str]) -> None:
        """Merge segments, about ``ROUND_CHARS`` characters at once; long ones are kept until the next call only."""
        self.long: dict[str, bytes] = {}
        at = 0
        while at < len(segments):
            size, to = 0, at
            while to < len(segments) and (to == at or size + len(segments[to]) <= ROUND_CHARS):
                size += len(segments[to])
                to += 1
            for segment, ids in zip(segments[at:to], self._merged(segments[at:to]), strict=True):
                (self if len(segment) <= KEPT_CHARS else self.long)[segment] = ids
            at = to

    def _merged(self, segments: list[str]) -> list[bytes]:
        v = self.v
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        near = chars[:-1].astype(np.int64) << 21 | chars[1:]
        where = np.minimum(np.searchsorted(v.near, near), len(v.near) - 1)
        cut = np.zeros(len(chars) + 1, bool)
        cut[1:-1] = v.near[where] != near
        cut[owner] = True
        sym, at, _ = merge_rounds(chars, np.flatnonzero(cut), v)
        unknown = np.flatnonzero(sym == v.size - 1)
        bounds = np.searchsorted(at, owner)
        if not len(unknown):
            flat, bounds = sym.astype("<u4"), bounds.tolist()
        else:
            spelled = [v.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in chars[at[unknown]].tolist()]
            counts = np.ones(len(sym), np.int64)
            counts[unknown] = [len(s) for s in spelled]
            starts = np.concatenate([[0], np.cumsum(counts)])
            flat = np.empty(starts[-1], "<u4")
            known = sym != v.size - 1
            flat[starts[:-1][known]] = sym[known]
            flat[np.repeat(starts[unknown], counts[unknown]) + _steps(counts[unknown])] = np.concatenate(spelled)
            bounds = starts[bounds].tolist()
        data = flat.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *bounds], bounds, strict=False)]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts with the begin and end id; null and empty texts have these two alone."""
        first, last = (np.array([i], "<u4").tobytes() for i in (self.v.begin, self.v.end))
        cut = [self.v.segment.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        seen = set(chain.from_iterable(cut))
        new = seen.difference(self)
        if len(self) + len(new) > KEPT_SEGMENTS:
            self.clear()
            new = seen
        self.learn(list(new))
        return [b"".join([first, *map(self.__getitem__, c), last]) for c in cut]

    def text(self, ids: bytes) -> str:
        """The text of ids: spaces for their sign, the one in front left out, bytes joined to characters where they can be."""
        return text_of(ids, self.v)


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the groups of these sizes."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def text_of(ids: bytes, v: Pieces) -> str:
    numbers = np.frombuffer(ids, "<u4").tolist()
    out: list[bytes] = []
    bare = True  # nothing but control ids so far: the space in front is still to come
    for i in numbers:
        if i in v.control:
            continue
        if i in v.byte_of:
            out.append(bytes([v.byte_of[i]]))
        elif i == v.unknown or v.plain[i] is None:
            out.append(UNKNOWN_TEXT.encode())
        else:
            piece = v.plain[i]
            out.append(piece[1:] if bare and piece.startswith(b" ") else piece)
        bare = False
    return b"".join(out).decode("utf-8", "one-per-byte")


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process."""
    return PieceEncoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                found = own.ids(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every row: the ids of the whole text with begin and end id, little-endian unsigned 32 bits.

    Ids equal those of the sentencepiece library for the model at ``model`` without sampling.  Null and empty texts are
    the begin and the end id.  Rows are encoded one by one, whatever their doc_ids; an empty table gives an empty one;
    further columns are ignored.  Nothing is shuffled.  Models that change texts before they cut them are refused.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _encode(model), f"doc_id {kind}, ids binary")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = meanings(path)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                texts = [None if ids is None else text_of(ids, v) for (ids,) in columns(part, "ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Add ``text``, the text of ``ids``, to rows of (doc_id, ids); null ids have none.

    Control ids are left out, an unknown id becomes its sign, and bytes that make no character become U+FFFD each.
    """
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), f"doc_id {kind}, ids binary, text string")
