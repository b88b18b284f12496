from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as E
from regiolens.llm import lang_id as L
from tests.llm.conftest import crc

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    """The n-grams by strings: folded text, blanks around, an end mark."""
    out, blank = [" "], True
    for c in text:
        low = c.lower() if c.isalpha() else " "
        low = low if len(low) == 1 else c
        if low != " " or not blank:
            out.append(low)
        blank = low == " "
    s = "".join(out) + ("" if blank else " ") + "\x01"
    return [s[i:i + L.N] for i in range(len(s) - L.N + 1)]


def test_hashes_are_those_of_the_plain_ngrams(monkeypatch):
    for piece in (3, 7, 400_000):
        monkeypatch.setattr(L, "PIECE", piece)
        for t in ("ab", "Ein  Text, mit 12 Wörtern; und\n\nMEHR!", "é", "a\x00b\x01c", "İstanbul 𝔘nd", "  x"):
            h = np.concatenate([x for x, _ in L.batches_of([t])])
            want = plain_grams(t)
            assert len(h) == len(want), t
            names = dict(zip(want, h, strict=True))
            assert [names[g] for g in want] == list(h) and len(set(h)) == len(set(want))


def test_filter_against_exact_sets():
    rng = np.random.default_rng(1)
    grams = [L.mix64(rng.integers(0, 2**62, 4000, dtype=np.uint64)) for _ in range(70)]
    m = L.Model([f"l{i}" for i in range(70)], grams, bits=16)
    probe = np.concatenate([grams[3][:50], grams[69][:50], L.mix64(rng.integers(0, 2**62, 20_000, dtype=np.uint64))])
    for i, inside in enumerate(m.contained(probe)):
        member = np.isin(probe, grams[i])
        assert inside[member].all()  # no false negative
        assert abs(inside[~member].mean() - m.false_rate[i]) < 0.01  # the correction's rate


def test_held_out_accuracy_and_contract(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op7_language_id"](spark, SF).collect()
    assert len(rows) == len(docs)
    good = Counter()
    for r in rows:
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1
        good[r.held_out, r.lang_pred == docs[r.doc_id].lang] += 1
    assert good[True, True] >= 0.97 * (good[True, True] + good[True, False])


def test_against_exact_counts(spark):
    docs = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the le the le", None), ("12", "en"), (None, "fr")]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    m = L.train(df, min_share=1e-4, flush=3)
    share = defaultdict(Counter)
    for t, lang in docs:
        if t and lang:
            share[lang].update(plain_grams(t))
    total = {k: sum(c.values()) for k, c in share.items()}
    has = {k: {g for g in c if c[g] / total[k] >= 0.25 * max(share[j][g] / total[j] for j in total)} for k, c in share.items()}
    got = {r.text: r.lang_pred for r in L.identify(df, m).collect()}
    for t in ("the cat and the dog", "le chat et le chien", "the le the le"):
        hits = {k: sum(g in has[k] for g in plain_grams(t)) for k in has}
        assert hits[got[t]] == max(hits.values())
    assert got["12"] == "und" and got[None] == "und"


def test_odd_rows(spark, odd_docs, no_docs):
    m = L.train(odd_docs)
    out = L.identify(odd_docs.withColumn("lang_pred", odd_docs.text), m)
    assert out.columns == [*odd_docs.columns, "lang_pred", "lang_score"]
    rows = out.collect()
    assert len(rows) == 8 and {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    assert all(r.lang_pred in m.langs for r in rows if r.doc_id not in (2, 3, 4))
    kept = L.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 5
    assert L.keep_identified(no_docs).count() == 0
    assert {r.lang_pred for r in L.identify(odd_docs, L.train(no_docs)).collect()} == {"und"}
