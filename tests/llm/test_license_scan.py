from __future__ import annotations

import re
import time

import regex

import __spark_entry__ as E
from regiolens.llm import license_scan as L
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def base(text):
    """The base rule by word lists."""
    w = WORD.findall((text or "").translate(LOW))
    at = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), sorted(at)


def test_query_against_word_lists(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op2_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, at = base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        labels = {x for _, x in at}
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",") if r.labels else [])
        assert 0 <= r.score <= 1
    assert any(r.n_base for r in rows)


def test_seeds_lose_nothing_against_whole_text_search():
    s = L.Scanner(L.PHRASES, L.NOTICES, L.CHARS_PER_EDIT)
    texts = ["x All rigths reserved. y", "Permission is herby granted, free of charge to any persn obtaining a copy of",
             "Licenced under the Apache Licence, Version 2.0", "al rights reservd", "all the rights are reserved",
             "nothing here", "spdx-license-identifer: mit", "c c by", "This program is free sofware; you can redistribute it"
             " and/or modify it under"]
    for t in texts:
        hay = b" ".join(t.encode().translate(L._TO_WORDS).split()).decode("latin-1")
        want = set()
        for notice, label, k, _, _ in s.notices:
            if regex.search(rf"(?:{regex.escape(notice)}){{e<={k}}}", hay):
                want.add(label)
        got = {h["label"] for h in s.scan(t.encode())[1] if not h["exact"]}
        assert got == want, t
    n, hits = s.scan("Ünder: All  rights,\nreserved!".encode())
    assert n == 4 and [(h["word"], h["start"], h["end"]) for h in hits if h["exact"]] == [(1, 7, 28)]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = L.scan_licenses(odd_docs).collect()
    assert len(rows) == 8 and sum(len(r.hits) > 0 for r in rows) == 2
    assert {r.n_words for r in rows if r.id in (2, 3, 4)} == {0}
    assert [r.n_words for r in rows if r.id == 5] == [60_000]
    assert L.scan_licenses(no_docs).collect() == []


def test_many_hits_stay_linear():
    scanner = L.Scanner(L.PHRASES, L.NOTICES, L.CHARS_PER_EDIT)
    took = []
    for n in (20_000, 40_000):
        started = time.time()
        words, hits = scanner.scan(("ü all rights reserved x " * n).encode())
        took.append(time.time() - started)
        assert words == 5 * n and sum(h["exact"] for h in hits) == n
        assert [(h["word"], h["start"]) for h in hits if h["exact"]][-1] == (5 * n - 4, 24 * (n - 1) + 2)
    assert took[1] < 4 * took[0] + 1
