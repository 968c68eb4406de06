"""The pipeline stage by stage against plain Python on the smallest delivered tables."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from tidemark.llm import bpe, mixing
from tidemark.llm.queries import BYTE_BPE
from test_operators import bare, linked, plain_simhash, tiktoken_encoding

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="delivered tables absent")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.keep_good_documents(spark, docs, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert all((i in ids) == bool(q) for i, q in labels.items())

    exact = corpus_pipeline.drop_exact_copies(spark, kept, SF)
    best = {}
    for r in kept.collect():
        rank = (-len(r.text or ""), r.doc_id)
        best[bare(r.text)] = min(best.get(bare(r.text), rank), rank)
    assert {r.doc_id for r in exact.collect()} == {i for _, i in best.values()}

    near = corpus_pipeline.drop_near_copies(spark, exact, SF)
    prints = {r.doc_id: plain_simhash(r.text) for r in exact.collect()}
    root, first = linked(list(prints.values())), {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    assert {r.doc_id for r in near.collect()} == set(first.values())

    mixed = corpus_pipeline.mix_sources(spark, near, SF)
    plan = {r.doc_id: r.copies for r in mixing.mixing_plan(near).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(plan)
    assert kept.columns == exact.columns == near.columns == mixed.columns == columns

    coding = tiktoken_encoding()
    text = {r.doc_id: r.text for r in near.collect()}
    coded = corpus_pipeline.encode_tokens(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in coded) == Counter({i: n for i, n in plan.items() if n})
    for r in coded:
        assert r.token_ids == coding.encode_ordinary(text[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    run = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in run) == Counter((r.doc_id, r.decoded_sha256) for r in coded)


def test_pattern_has_no_other_white_space():
    assert bpe.unicode_spaces(public_tokenizers.PATTERN).count("White_Space") == 4
    assert len(bpe.read_ranks(BYTE_BPE)) == 50256
