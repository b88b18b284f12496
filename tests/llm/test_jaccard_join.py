from __future__ import annotations

import random
import re

import numpy as np
import pytest

import __spark_entry__ as E
from regiolens.llm import jaccard_join as J
from regiolens.llm import shingles as S
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def plain_set(text):
    w = WORD.findall((text or "").translate(LOW))
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    """component by id, over all pairs"""
    sets = [(i, plain_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    by_token = {}
    for k, (_, s) in enumerate(sets):
        for t in s:
            by_token.setdefault(t, []).append(k)
    seen = set()
    for ks in by_token.values():
        for i in ks:
            for j in ks:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    (a, x), (b, y) = sets[i], sets[j]
                    if 100 * len(x & y) >= 80 * len(x | y):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def corpus(seed, docs=160, vocab=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocab)}"
    line = [word() for _ in range(12)]
    out = []
    for _ in range(docs):
        if out and rng.random() < 0.6:
            w = list(rng.choice(out))
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        else:
            w = [word() for _ in range(int(np.exp(rng.uniform(0, 5.5))))]
            if rng.random() < 0.5:
                w = line + w
        out.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    rng.shuffle(rows)
    return rows


def test_hashes_match_plain_sets(monkeypatch):
    texts = ["a b c d e f A B C D E F", "", None, " \t\n", "x", "one two", "é ü ß x y z", "a" * 200 + " b", "\x0ba\x0cb c\rd e",
             "w " * 50 + "q", "x\x1cy z"]
    want = [len(plain_set(t)) for t in texts]
    for chunk in (1 << 20, 16):
        monkeypatch.setattr(S, "CHUNK", chunk)
        got = S.sets_of([t.encode() if t is not None else None for t in texts])
        assert [len(s) for s in got] == want
        again = S.sets_of(["A B c d E  f a b\tc d e f".encode()])[0]
        assert (got[0] == again).all()


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**62, rng.integers(1, 900), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.5, 1)],
                                      rng.integers(0, 2**62, rng.integers(0, 200), dtype=np.uint64)]))
        if len(y):
            assert S.sketch_distance(S.parity_sketch(x), S.parity_sketch(y)) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("seed", [1, 2])
def test_units_find_every_pair(seed):
    """Every similar pair shares a used key in some round's partition, or its larger set is short there."""
    rows = corpus(seed, 250)
    sets = S.sets_of([t.encode() for _, t in rows])
    none = np.zeros(0, np.uint64)
    entries, short = {}, {}
    for own, band, need in J._lookups(np.array([len(x) for x in sets])):
        for b in np.unique(band):
            pick = band == b
            sig = J.Signatures([sets[i] for i in own[pick]], band[pick], 3)
            key, at, _ = sig.entries()
            for k, i in zip(key, own[pick][at], strict=True):
                entries.setdefault(int(i), set()).add((int(b), int(k)))
            lack = sig.units(pick.sum(), none) < need[pick]
            short.update({(int(i), int(b)): bool(x) for i, x in zip(own[pick], lack, strict=True)})
    found = 0
    for i in range(len(sets)):
        for j in range(i):
            x, y = sorted((sets[i], sets[j]), key=len)
            inter = len(np.intersect1d(x, y))
            if len(x) and 100 * inter >= 80 * (len(x) + len(y) - inter):
                found += 1
                small, large = (i, j) if len(sets[i]) <= len(sets[j]) else (j, i)
                b = int(J.band_of(np.array([len(sets[small])]))[0])
                shared = {k for bb, k in entries[small] if bb == b} & {k for bb, k in entries[large] if bb == b}
                assert shared or short[large, b]
    assert found > 50 and sum(short.values()) < 0.02 * len(short)


@pytest.mark.parametrize("options", [{}, {"hot_pairs": 3, "entries_per_part": 3000, "small": 50}])
def test_components_against_all_pairs(spark, options):
    rows = corpus(5)
    rows += [(1000 + i, "the same text for many documents here " * 3) for i in range(40)]  # a hot group of copies
    rows += [(2000, None), (2001, ""), (2002, "short"), (2003, "SHORT"), (2004, "a b c d"), (2005, "a b c d e")]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = J.similar_components(df, **options).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r.n_shingles == len(plain_set(texts[r.doc_id])) and r.component_id == want[r.doc_id]


def test_query_at_small_scale(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in E.queries()["op8_jaccard_join"](spark, SF).collect()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.union(spark.createDataFrame([(6, "another text of some seven words", None, None, 1)], no_docs.schema)
                        .selectExpr("*", "1", "2", "'x'", "3", "4", "5", "6"))
    got = J.similar_components(df).collect()
    assert len(got) == 9 and {r.component_id for r in got if r.doc_id is None} == {None}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id is not None)
    assert sorted(r.n_shingles for r in got if r.doc_id == 6) == [1, 2]
    kept = J.keep_representatives(df)  # the two texts under id 6 are different documents
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 6]
    assert J.similar_components(no_docs).collect() == [] and J.keep_representatives(no_docs).collect() == []


@pytest.mark.parametrize("names", [["_id", "_row", "row_number", "gone_id", "unit"], ["ROW_NUMBER", "r", "c", "i", "at"]])
def test_columns_of_any_name_are_kept(spark, names):
    for ids in ((1, 2, 3), (1, 1, 3)):
        texts = ["a b c d e f", "a b c d e f", "q r s t u v"]
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr(
            "*", *[f"{i} as {n}" for i, n in enumerate(names)])
        kept = J.keep_representatives(df)
        assert kept.columns == df.columns
        assert sorted(tuple(r)[2:] for r in kept.collect()) == [tuple(range(len(names)))] * 2


def test_texts_of_one_common_line(spark):
    """Short texts of a line that all share, and words of their own: pairs do not grow with their square."""
    rng = random.Random(8)
    line = [f"c{i}" for i in range(12)]
    word = lambda: f"o{rng.randrange(10**9)}"
    rows = [(i, " ".join(line + [word() for _ in range(2)])) for i in range(1500)]
    rows += [(2000 + i, " ".join(line + [f"few{i % 40}", word()])) for i in range(800)]  # own shingles that some share
    rows += [(3000, " ".join(line)), (3001, " ".join(line + ["end"])), (3002, " ".join(["begin", *line]))]
    sets = [plain_set(t) for _, t in rows]
    want = brute_small(rows, sets)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    verify = J.verify

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return verify(pairs, *rest)

    J.verify = counting
    try:
        got = {r.doc_id: r.component_id for r in J.similar_components(df).collect()}
    finally:
        J.verify = verify
    assert got == want
    assert sum(seen) < 30 * len(rows)


def test_near_copies_around_one_text(spark):
    """Edits of one text, some too far from all others, some twice there: links all found, pairs few."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 700):
        w = list(base)
        for at in rng.sample(range(150), 1 + i % 5):
            w[at] = f"own{rng.randrange(10**9)}" if rng.random() < 0.8 else f"few{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t) for i, t in rows[::7]]
    sets = [plain_set(t) for _, t in rows]
    seen = []
    verify = J.verify

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return verify(pairs, *rest)

    J.verify = counting
    try:
        got = {r.doc_id: r.component_id for r in J.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    finally:
        J.verify = verify
    assert got == brute_small(rows, sets)
    assert len(set(got.values())) > 100 and sum(seen) < 50 * len(rows)


def test_bounds_hold_for_every_similar_pair():
    """No similar pair is ruled out by lone elements, sizes or a pivot."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(120) < rng.uniform(0.8, 1)], rng.integers(0, 2**62, rng.integers(0, 15), dtype=np.uint64)]))
            for _ in range(60)]
    keys, held = np.unique(np.concatenate(sets), return_counts=True)
    lone = [int((held[np.searchsorted(keys, s)] == 1).sum()) for s in sets]
    apart = lambda x, y: len(np.setxor1d(x, y))
    met = 0
    for p in range(0, 60, 7):
        d = [apart(s, sets[p]) for s in sets]
        far = [2 * lone[i] if i == p else d[i] for i in range(60)]
        near = [0 if i == p else 2 * lone[i] - d[i] for i in range(60)]
        for i in range(60):
            for j in range(i):
                x, y = sets[i], sets[j]
                if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
                    met += 1
                    most = (len(x) + len(y)) // 9
                    assert max(2 * lone[i] + len(y) - len(x), 2 * lone[j] + len(x) - len(y)) <= apart(x, y) <= most
                    assert max(far[i] + near[j], near[i] + far[j]) <= apart(x, y)
    assert met > 200


def brute_small(rows, sets):
    """Components over all pairs of the same or neighbouring sizes, without a token index."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, x) in enumerate(zip((r[0] for r in rows), sets, strict=True)):
        for j in range(i):
            y = sets[j]
            if 100 * len(x & y) >= 80 * (len(x) + len(y) - len(x & y)):
                p, q = find(a), find(rows[j][0])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def test_short_sets_find_partners_by_single_elements(spark):
    """No key may be used at all: every set is short, and every link is still found."""
    rows = corpus(9, 120)
    want = brute(rows)
    for small in (1_000_000, 50):
        got = J.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), hot_pairs=0, small=small, hub_keys=1).collect()
        assert {r.doc_id: r.component_id for r in got} == want
