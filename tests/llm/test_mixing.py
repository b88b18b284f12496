from __future__ import annotations

from collections import defaultdict

from regiolens.llm import mixing as M


def level_targets(sizes, weights, share=1.5, most=2.0):
    """Share, cap what is above, share the excess anew, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = share * sum(sizes.values()) - sum(fixed.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def check(spark, rows, **more):
    out = M.mix_to_weights(docs_of(spark, rows), **more).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = level_targets(dict(sizes), M.WEIGHTS)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9)  # cut at the exact word
    return out


def test_targets_and_cuts_with_a_hot_source(spark):
    rows = [(i, "w " * (i % 13), "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    out = check(spark, rows, rows_per_range=20)
    again = M.mix_to_weights(docs_of(spark, rows[::-1]).repartition(7), rows_per_range=33).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_nulls_ties_empty(spark, odd_docs, no_docs):
    check(spark, [(None, None, None), (1, "a b c", None), (1, "a b c", None), (2, "", "x"), (3, "q", "y"), (4, "ä b c", "é")])
    assert len(M.mix_to_weights(odd_docs).collect()) == 8
    assert M.mix_to_weights(no_docs).collect() == []
    zero = M.mix_to_weights(docs_of(spark, [(1, "", "a"), (2, None, "b")])).collect()
    assert [(r.taken, r.target) for r in zero] == [(0, 0.0), (0, 0.0)]


def test_rows_sharing_an_id_are_spread(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"),
                                  F.lit("s").alias("source"))
    key = F.substring(F.md5(F.concat(F.lit("17:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":s:"), F.md5("text"))), 1, 1)
    assert df.groupBy(key.alias("k")).count().agg(F.max("count")).first()[0] < 300
    assert M.mix_to_weights(df, rows_per_range=100).agg(F.sum("taken")).first()[0] == 9000


def test_names_of_any_kind_are_kept(spark):
    names = ["_id", "_source", "_hash", "_rows", "_text_hash", "row", "row_id", "mix_id", "mix_hash", "text_hash"]
    df = docs_of(spark, [(1, "a b c", "x"), (2, "d e", "y"), (2, "d e", "y")]).selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    out = M.mix_documents(df)
    assert out.columns == [*df.columns, "size", "source_size", "target", "epochs", "cut_words", "taken"]
    assert {tuple(r)[3:3 + len(names)] for r in out.collect()} == {tuple(range(len(names)))}
