from __future__ import annotations

import random

import __spark_entry__ as E
from regiolens.llm import decontaminate as D
from tests.llm.conftest import SF


def plain_distance(p, t):
    """Best substring edit distance by the full table."""
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
        row = new
    return min(row)


def test_myers_against_the_full_table():
    rng = random.Random(3)
    for _ in range(60):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        best = min(D.myers(p, t), default=len(p))
        assert min(best, len(p)) == plain_distance(p, t)
        if m := D.best_match(p, t, len(p) - 1):
            assert plain_distance(p, t[m[1]:m[2]]) == m[0] == best


def test_pieces_lose_nothing():
    rng = random.Random(5)
    words = ["the", "cat", "sat", "upon", "some", "mat", "with", "grey", "owls"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 30)))) for i in range(12)]
    m = D.Matcher(items, D.CHARS_PER_EDIT, D.MIN_WORDS)
    for _ in range(80):
        text, k, ids = rng.choice(m.items)
        s = list(text)
        for _ in range(rng.randint(0, 2 * k + 1)):
            at = rng.randrange(len(s))
            s[at:at + 1] = rng.choice([[], ["q"], [s[at], "q"]])
        hay = " ".join(rng.choice(words) for _ in range(20)) + " " + "".join(s) + " " + " ".join(rng.choice(words) for _ in range(9))
        want = {i: d for i, (t, k, _) in enumerate(m.items) if (d := plain_distance(t, hay)) <= k}
        assert {i: d for i, d, _, _ in m.find(hay)} == want


def test_query_finds_planted_items(spark):
    items = {r.item_id: D.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: D.normalise(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    rows = E.queries()["op1_decontaminate"](spark, SF).collect()
    assert want <= {(r.doc_id, r.item_id) for r in rows} and want
    for r in rows:
        assert r.distance <= r.item_chars // D.CHARS_PER_EDIT
        assert plain_distance(items[r.item_id], docs[r.doc_id]) == r.distance


def test_blocks_and_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "word word word word word word"), (1, "word word word word word word"), (2, None), (3, ""),
                                   (4, "of the"), (None, "the and of the and"), (6, "quite another test item here")],
                                  "item_id long, text string")
    one = D.find_leaks(odd_docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in one) == [(0, 0), (0, 4), (5, 1), (5, 1)]  # short items as whole words
    many = D.find_leaks(odd_docs, bench, block_chars=10).collect()
    assert sorted(map(str, many)) == sorted(map(str, one))
    kept = D.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 6
    assert D.find_leaks(no_docs, bench).count() == 0
    assert D.find_leaks(odd_docs, bench.limit(0)).count() == 0 and D.drop_contaminated(odd_docs, bench.limit(0)).count() == 8


def test_short_items_match_as_whole_words(spark):
    items = [(1, "forty two"), (2, "yes"), (3, ""), (4, None), (5, "a longer item of some nine words in all")]
    docs = [(1, "the answer is Forty-Two."), (2, "forty twos"), (3, "eyes"), (4, "Yes"), (5, "x A longer item, of some nine words in all y"), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.first_word, r.last_word) for r in D.find_leaks(df, bench).collect())
    assert got == [(1, 1, 0, 3, 4), (4, 2, 0, 0, 0), (5, 5, 0, 1, 9)]
    kept = D.drop_contaminated(df.selectExpr("*", "1 as _row", "2 as _text", "3 as leaks"), bench, block_chars=10)
    assert kept.columns == ["doc_id", "text", "_row", "_text", "leaks"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6]  # short items are no ground to drop a document
