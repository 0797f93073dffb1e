"""Registered queries against their SQL, and the pipeline against its parts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import connect, difference
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import components, hits_by_hand
from runledger.llm import quality, secrets
from runledger.llm.queries import ORACLES, QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert difference(spark, connect(SF), SF, name, QUERIES[name], ORACLES.get(name)) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    kept = {r.doc_id: r.doc_tokens for r in docs.collect()}
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == docs.columns
    assert {r.doc_id: r.doc_tokens for r in whole.collect()} == kept
    assert sum(r.length for r in whole.collect()) == sum(kept.values())


def test_pipeline_against_brute_force(spark):
    """All stages after the quality rules by hand: all pairs, all windows, every span, and the tokenizer's own counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [(r.doc_id, r.clean_text) for r in quality.quality(docs.select("doc_id", "text")).where("kept").collect()]
    assert 20 < len(kept) < docs.count() and len({d for d, _ in kept}) == len(kept)
    first = {d for d, _, group in components(kept, 5) if group in (None, d)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: t for d, t in kept if d in first and hits_by_hand(t, items)[1] == 0}
    assert len(left) < len(kept)
    clean = {d: secrets.redacted(t, secrets.spans_of(t, secrets.Novelty()), "[secret]") for d, t in left.items()}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in clean.items()}
    pieces = defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).collect():
        assert p.doc_tokens == len(expected[p.doc_id])
        pieces[p.doc_id].append((p.start, p.length, p.ids_crc32))
    assert pieces.keys() == expected.keys()
    for d, ids in expected.items():
        at = 0
        for start, length, crc in sorted(pieces[d]):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
