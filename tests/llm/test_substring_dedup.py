from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiolens.llm import packed
from regiolens.llm import substring_dedup as S


def brute(rows, window=20):
    """Every window of every row in order; a later one of equal words covers its words."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least: dict[tuple, tuple] = {}
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            least[k] = min(least.get(k, order(i)), order(i))
    out = []
    for i, w in enumerate(words):
        gone, seen = set(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if least[k] < order(i) or k in seen:
                gone.update(range(s, s + window))
            seen.add(k)
        out.append((rows[i][0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_words, sum(x.end - x.start for x in r.removed), r.kept_text) for r in df.collect())


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def planted(seed, n=120):
    """Texts that share passages of 15 to 90 words at random places, copies, cycles."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("éxyz") * rnd.randint(0, 2) + str(rnd.randint(0, 30))
    shared = [[word() for _ in range(rnd.randint(15, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [word() for _ in range(rnd.randint(0, 40))]
            p = rnd.choice(shared)
            a = rnd.randint(0, len(p) // 2)
            w += p[a:a + rnd.randint(1, len(p))]
        rows.append((i * 3 - 50, rnd.choice([" ", "\n", " \t"]).join(w)))
    cycle = " ".join(["u v w"] * 30)
    return [*rows, (7000, rows[5][1]), (7001, rows[5][1]), (8000, cycle), (8001, "x " + cycle), (8002, "one " * 25)]


@pytest.mark.parametrize("seed,unit", [(1, 2_000_000), (2, 500), (3, 3000)])
def test_equals_brute_force(spark, seed, unit):
    rows = planted(seed)
    random.Random(seed).shuffle(rows)
    assert got(S.dedup_substrings(docs_of(spark, rows).repartition(3), unit_bytes=unit)) == brute(rows)


def test_other_windows_and_levels(spark):
    rows = planted(4, 60)
    for window, first in ((40, 10), (16, 2), (8, 4)):
        assert got(S.dedup_substrings(docs_of(spark, rows), window=window, first=first, unit_bytes=2000)) == brute(rows, window)
    with pytest.raises(ValueError):
        S.dedup_substrings(docs_of(spark, rows), window=20, first=7)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(None, passage), (None, passage), (None, "x " + passage), (9, passage), (9, passage), (9, "y " + passage),
             (-4, passage[:-1]), (10, "z" * 3_000_000 + " " + passage)]
    more = docs_of(spark, rows).selectExpr("*", "1 as id", "'u' as unit", "2 as n", "3 as keys", "4 as spans", "5 as _row", "6 as texts")
    assert got(S.dedup_substrings(more, unit_bytes=400)) == brute(rows)
    assert S.dedup_substrings(no_docs).collect() == []
    assert S.dedup_substrings(docs_of(spark, [(1, None), (2, "few words")])).count() == 2  # no window at all


def test_query_on_given_table(spark, tmp_path):
    rows = planted(5, 40)
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in S.op13_query(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert len(out) == len(rows)
    for i, n, gone, kept in want:
        r = out[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_hot_passage_is_one_entry_a_unit(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"own{i} " + passage) for i in range(300)]
    out = S.dedup_substrings(docs_of(spark, rows).repartition(4), unit_bytes=5000)
    assert out.where(F.size("removed") > 0).count() == 299


def test_packing():
    rnd = np.random.default_rng(0)
    for a in (np.zeros(0, np.int64), np.array([-3, 5]), np.array([2**63 - 1, -2**63]), rnd.integers(-9, 9, 100)):
        assert (packed.unpack_ints(packed.pack_ints(a)) == a).all()
    keys = np.unique(rnd.integers(0, 2**64, 1000, dtype=np.uint64))
    cut = packed.split(keys, 7)
    for p, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
        assert all(int(k) * 7 >> 64 == p for k in keys[i:j])
