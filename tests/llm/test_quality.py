from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as E
from regiolens.llm import quality as Q
from tests.llm.conftest import crc

SF = "/root/testdata/sf0.01"


def test_held_out_ranking_and_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = E.queries()["op4_quality"](spark, SF).collect()
    assert len(rows) == len(docs)
    good, bad = [], []
    for r in rows:
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            (good if labels[r.doc_id] else bad).append(r.score)
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert pairs and np.mean(pairs) >= 0.9


def test_blocked_votes_against_brute_force():
    rng = np.random.default_rng(2)
    vocab = [b"red", b"Blue", b"GREEN!!", b"x***", b"12", b"owl", b"and", b"the"]
    texts = [b" ".join(rng.choice(vocab, rng.integers(1, 12))) for _ in range(60)]
    found = [Q.terms(t) for t in texts]
    m = Q.Model(np.ones(Q.DIMS), found[:40], rng.integers(0, 2, 40), rank=8, neighbours=7, sharpness=4.0)
    got = m.score(found[40:])
    v = m.latent(Q.tfidf(found, np.ones(Q.DIMS))).astype(float)
    for i in range(40, 60):
        cos = v[:40] @ v[i]
        near = np.argsort(-cos, kind="stable")[:7]
        w = np.maximum(cos[near], 1e-6) ** 4.0
        if np.sort(cos)[::-1][6] - np.sort(cos)[::-1][7] > 1e-5:  # no tie at the edge
            assert abs(got[i - 40] - (w * m.labels[near]).sum() / w.sum()) < 1e-4


def test_document_frequencies_cover_all_rows(spark):
    texts = ["a b", "a", None, "", "b b c"]
    df, n = Q.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(Q.DIMS, int)
    for t in texts:
        want[Q.terms((t or "").encode())[0]] += 1
    assert n == 5 and (df == want).all()


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, None), (None, 1), (99, 1)], "doc_id long, quality int")
    m = Q.fit(odd_docs, labels)
    assert len(m.labels) == 4  # two rows of id 1, id 3 labelled twice
    out = Q.score_quality(odd_docs, m)
    assert out.columns == [*odd_docs.columns, "_score"] and out.count() == 8
    assert Q.fit(no_docs, labels) is None and Q.fit(odd_docs, labels.limit(0)) is None
    assert {r._score for r in Q.score_quality(odd_docs, None).collect()} == {0.5}
    assert Q.score_quality(no_docs, m).collect() == []


def test_whole_shape_counts():
    """Word shapes that differ far from their start are different terms."""
    a, b = "a1" * 12 + "B", "a1" * 12 + "-"
    shapes = [set(Q.terms(w.encode())[0][Q.terms(w.encode())[0] < Q.SHAPES].tolist()) for w in (a, b)]
    assert shapes[0] != shapes[1]


def test_ties_at_the_edge_go_to_the_samples_first():
    texts = ["same words here"] * 6 + ["other text entirely"] * 3
    found = [Q.terms(t.encode()) for t in texts]
    m = Q.Model(np.ones(Q.DIMS), found, np.array([1, 1, 0, 0, 0, 0, 1, 1, 1]), 4, 3, 8.0)
    assert m.score([Q.terms(b"same words here")])[0] == pytest.approx(2 / 3)
