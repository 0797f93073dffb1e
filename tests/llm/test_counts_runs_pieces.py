"""Source divergence, periodic runs and SentencePiece ids against brute force and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from runledger.llm import divergence, periodic, pieces
from runledger.llm.queries import PIECES, QUERIES, with_planted_runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000)) + "."


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank, very long and repeated rows, odd characters, and columns with names of results."""
    same = "One two three four two three four two three four two three four two three four, end."
    rows = [(0, same), (1, same), (1, same), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG + " end."), (None, same),
            (None, None), (7, "single"), (8, "a b  c\x1cd <s> <0x0A> ▁ 😀 é\n\n\nx  \x00"), (9, "x " * 50), (20, "a b " * 30)]
    return spark.createDataFrame([(d, t, None if d == 3 else "xy"[(d or 0) % 2], None if d in (1, 4) else f"s{(d or 0) % 3}", 1, "q", 2)
                                  for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n long, term string, runs int")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# source divergence

def terms_by_hand(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def divergence_by_hand(docs, least=3, top=200):
    docs = [(lang or "", source or "", terms_by_hand(text)) for _, text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, words in mine for t in set(words))
        kept = sorted(t for t in seen if seen[t] >= least)
        counts = defaultdict(Counter)
        for _, source, words in mine:
            counts[source].update(t for t in words if t in set(kept))

        def shares(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        whole = shares(sum(counts.values(), Counter()))

        def f(a, b):
            return (a - b) * (a - b) // b

        for s in counts:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(f(p[s][t], whole[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > whole[t]]
            for part, rows, limit in (("pair", pair, None), ("term", term, top)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(rows[:limit], 1)]
    return sorted(out)


def test_divergence(spark, awkward, empty, texts, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 50)
    monkeypatch.setattr(divergence, "HELD_WORDS", 300)
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in awkward.collect()]
    assert sorted(map(tuple, divergence.divergence(awkward).collect())) == divergence_by_hand(docs)
    odd = [(1, "zwei Wörter ÄÖ B b", "de", "a"), (2, "zwei wörter äÖ b", "de", "b"), (3, "ZWEI b x", "de", "b"), (4, None, "de", "c"),
           (5, "only here", "la", "one"), (6, "nothing shared", "la", "two"), (7, None, "no", "words")]
    df = spark.createDataFrame(odd + texts, "doc_id long, text string, lang string, source string")
    found = sorted(map(tuple, divergence.divergence(df).collect()))
    assert found == divergence_by_hand(odd + texts)
    assert ("la", "one", "pair", "two", 0, 1) in found and not [r for r in found if r[0] == "no"]
    assert divergence.divergence(empty).count() == 0
    few = divergence.divergence(df, least_docs=2, top=3)
    assert sorted(map(tuple, few.collect())) == divergence_by_hand(odd + texts, 2, 3)


def test_shares_of_huge_counts():
    draw = random.Random(1)
    for _ in range(200):
        total = draw.randrange(1, 10**15)
        count = draw.randrange(0, total)
        assert divergence.shares(np.array([count]), total).tolist() == [1 + 10**9 * (count + 1) // total]


def test_words_are_not_cut_between_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 3)
    text = "Ab, cd efg  hijklmnop 1q ÄR\n".encode() * 3
    assert [w.decode() for part in divergence._words(text) for w in part] == terms_by_hand(text.decode())


# periodic runs

def runs_by_hand(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed_by_hand(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_sequence(draw):
    n = draw.randrange(0, 130)
    kind = draw.randrange(5)
    if kind == 0:
        return [draw.randrange(2) for _ in range(n)]
    if kind == 1:
        return [draw.randrange(3) for _ in range(n)]
    if kind == 2:
        part = [draw.randrange(9) for _ in range(draw.randrange(1, 15))]
        return (part * 60)[:n] + [draw.randrange(4) for _ in range(10)]
    if kind == 3:
        a, b = [0], [1]
        while len(a) < n:
            a, b = a + b, a
        return a
    return [7] * n


def test_runs_against_all_periods():
    draw = random.Random(4)
    for _ in range(300):
        group = [some_sequence(draw) for _ in range(draw.randrange(1, 6))]
        got = periodic.runs_of([np.array(x, np.int64) for x in group])
        # by start, then period: runs with one start and a longer period are longer
        assert [[tuple(r) for r in g.tolist()] for g in got] == [sorted(runs_by_hand(x), key=lambda r: (r[0], r[2])) for x in group]


def test_extensions_against_symbols():
    draw = random.Random(6)
    for _ in range(60):
        x = np.array([-1, *some_sequence(draw), *some_sequence(draw), -2])
        levels = periodic.grammar(x)
        pairs = [(i, j) for i in range(1, len(x) - 1) for j in range(1, len(x) - 1) if i != j]
        if not pairs:
            continue
        i, j = np.array(pairs).T
        ahead, behind = periodic.extension(levels, i, j), periodic.extension(levels, i, j, forward=False)
        for a, b, n, m in zip(i, j, ahead, behind, strict=True):
            assert (x[a : a + n] == x[b : b + n]).all() and x[a + n] != x[b + n]
            assert (x[a - m : a] == x[b - m : b]).all() and x[a - m - 1] != x[b - m - 1]


def test_long_repetitive_texts():
    for x, count in ((np.zeros(200_000, np.int64), 1), (np.arange(200_000) % 2, 1), (np.arange(100_000) % 30_011, 1), (np.arange(100_000), 0)):
        assert len(periodic.runs_of([x])[0]) == count


def test_periodic_tables(spark, awkward, empty, texts, monkeypatch):
    docs = [(r.doc_id, r.text) for r in awkward.collect()] + [(d, t) for d, t, _, _ in texts[:80]]
    docs = [(d, t) for d, t in docs if len(t or "") < 20_000]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for group in (periodic.GROUP_WORDS, 100):
        monkeypatch.setattr(periodic, "GROUP_WORDS", group)
        found = periodic.periodic_runs(df).collect()
        expected = []
        for d, t in docs:
            w = WORD.findall(t or "")
            runs = sorted(runs_by_hand(w), key=lambda r: (r[0], r[2]))
            expected.append((d, len(w), runs, collapsed_by_hand(w, runs)))
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in found]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert periodic.periodic_runs(empty).count() == 0
    assert periodic.periodic_runs(awkward).count() == awkward.count()
    with pytest.raises(ValueError):
        periodic.periodic_runs(awkward, least=5)


def planted_by_hand(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_query(spark, texts):
    short = [(d, t) for d, t, _, _ in texts if len(t or "") < 12_000]
    found = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(found) == len(texts)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in short) > 10
    for d, t in short:
        w = planted_by_hand(d, t)
        runs = sorted(runs_by_hand(w), key=lambda r: (r[0], r[2]))
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        r = found[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_by_hand(w, runs).encode()).hexdigest()


def test_planted_runs(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = [(r.doc_id, WORD.findall(r.text or "")) for r in with_planted_runs(awkward).collect()]
    assert sorted(got, key=repr) == sorted(((d, planted_by_hand(d, t)) for d, t in rows), key=repr)


# SentencePiece

@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def by_library(model, text):
    return np.array([model.bos_id(), *model.encode(text or ""), model.eos_id()], "<u4").tobytes()


def test_pieces_against_the_library(model):
    draw = random.Random(9)
    own = pieces.PieceEncoder(PIECES)
    signs = ["#", " ", "a", "b", "ab", "=", "-", "\n", "\t", "▁", "é", "漢", "字", "😀", "\x00", "(", ")", ";", "0", "1", "the", "ing",
             "<s>", "<unk>", "<0x0A>", "‍", "\x1c", "//", "*", "'", "word", "e", "�"]
    cases = ["".join(draw.choice(signs[: draw.randrange(1, len(signs) + 1)]) for _ in range(draw.randrange(0, 100))) for _ in range(1500)]
    cases += [" " * n for n in range(40)] + ["#" * n + "x" for n in range(60)] + ["word" + "=" * n for n in range(60)]
    assert own.ids(cases) == [by_library(model, t) for t in cases]
    for text in cases:
        assert pieces.text_of(by_library(model, text), own.v) == model.decode(model.encode(text))


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_queue_after_few_rounds(model, rounds, monkeypatch):
    monkeypatch.setattr(pieces.merge_rounds, "__defaults__", (rounds,))
    cases = ["###" * k + " some words  with   spaces====" + "ab" * k for k in range(60)]
    assert pieces.PieceEncoder(PIECES).ids(cases) == [by_library(model, t) for t in cases]


def test_long_segments(model):
    draw = random.Random(2)
    own = pieces.PieceEncoder(PIECES)
    noise = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(200_000))
    for text in ("a" * 200_000, "#" * 100_000, " " * 100_000, "=-" * 100_000, noise, LONG):
        assert own.ids([text])[0] == by_library(model, text)


def test_small_table_of_segments(model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_SEGMENTS", 5)
    monkeypatch.setattr(pieces, "ROUND_CHARS", 40)
    own = pieces.PieceEncoder(PIECES)
    for text in (LONG[:5000], "one two three", LONG[:3000], "x" * 300 + " " + "x" * 300, ""):
        assert own.ids([text, text + " more"]) == [by_library(model, text), by_library(model, text + " more")]


def test_any_ids_decode_like_the_library(model):
    draw = random.Random(7)
    v = pieces.vocabulary(PIECES)
    for _ in range(1500):
        ids = [draw.choice([draw.randrange(0, 300), draw.randrange(0, 32_000), 259, 28705]) for _ in range(draw.randrange(0, 12))]
        assert pieces.text_of(np.array(ids, "<u4").tobytes(), v) == model.decode(ids)


def test_piece_tables(spark, awkward, empty, texts, model):
    encoded = pieces.encode(awkward, PIECES)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(((r.doc_id, bytes(r.ids)) for r in encoded.collect()), key=repr) == sorted(
        ((d, by_library(model, t)) for d, t in rows), key=repr)
    decoded = sorted(((r.doc_id, r.text) for r in pieces.decode(encoded, PIECES).collect()), key=repr)
    assert decoded == sorted(((d, (t or "").replace("▁", " ")) for d, t in rows), key=repr)
    assert pieces.encode(empty, PIECES).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PIECES).first().text is None
    found = {r.doc_id: r for r in QUERIES["op13_sentencepiece"](spark, SF).collect()}
    for d, t, _, _ in texts:
        ids = by_library(model, t)
        assert (found[d].n_tokens, found[d].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert found[d].decoded_sha256 == hashlib.sha256(model.decode(model.encode(t or "")).encode()).hexdigest()
