from __future__ import annotations

import math

import numpy as np

import __spark_entry__ as E
from regiolens.llm import embedding_dedup as D


def brute(rows, threshold=0.95):
    """(links, component) by row, over all pairs"""
    ok = [i for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    by = {}
    for i in ok:
        by.setdefault(len(rows[i][1]), []).append(i)
    for ids in by.values():
        x = np.array([rows[i][1] for i in ids], dtype=float)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for p, q in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            i, j = ids[p], ids[q]
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    comp = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            comp.setdefault(find(i), []).append(rows[i][0])
    return links, [min(comp[find(i)]) if rows[i][0] is not None else None for i in range(len(rows))]


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = D.near_duplicates(df, **more).collect()
    rows = [(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for v, e in rows]
    links, comp = brute(rows)
    want = sorted(zip([v for v, _ in rows], links, comp, strict=True), key=str)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_groups_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for size in (1, 2, 3, 40, 150, 1, 1, 5):
        centre = rng.standard_normal(24)
        for _ in range(size):
            rows.append((at, (centre + 0.12 * rng.standard_normal(24)).tolist()))
            at += 1
    rows += [(1000 + i, rows[4][1]) for i in range(60)] + [rows[2], rows[2]]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [None] + [1.0] * 23), (2004, [float("nan")] * 24),
             (2005, [float("inf")] * 24), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[0][1]), (2008, [1e-30] * 24)]
    check(spark, rows)
    check(spark, rows, k=4, wide=8)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5)], "vec_id long, embedding array<float>, node int")
    df = df.selectExpr("*", "1 as id", "2 as vec", "3 as comp")
    assert [tuple(r)[:4] for r in D.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert D.near_duplicates(df.limit(0)).collect() == []


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links, comp = brute(rows)
    got = {r.vec_id: r for r in E.queries()["op6_embedding_dedup"](spark, sf).collect()}
    assert len(got) == len(rows)
    right = sum(got[v].n_links == n and got[v].component_id == c for (v, _), n, c in zip(rows, links, comp, strict=True))
    assert all(got[v].n_links <= n for (v, _), n in zip(rows, links, strict=True))
    assert right >= 0.99 * len(rows)


def nested(rng, outer, size, dim, near, far):
    """Groups of two dense halves: cosine ``near`` ** 2 inside a half, also times ``far`` between them."""
    rows = []
    tilt = lambda v, c: c * v + math.sqrt(1 - c * c) * (w := rng.standard_normal(dim), w - (w @ v) * v)[1] / np.linalg.norm(w - (w @ v) * v)
    for _ in range(outer):
        first = rng.standard_normal(dim)
        first /= np.linalg.norm(first)
        for centre in (first, tilt(first, far)):
            rows += [tilt(centre, near) for _ in range(size)]
    return [(i, r.tolist()) for i, r in enumerate(rows)]


def test_links_between_dense_groups_that_no_list_has_place_for(spark):
    check(spark, nested(np.random.default_rng(5), 1, 400, 64, 0.999, 0.963))


def test_all_pairs_where_the_recall_stays_low(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((400, 24))
    rows = [(i, (centres[i % 400] + 0.12 * rng.standard_normal(24)).tolist()) for i in range(2000)]
    check(spark, rows, k=2, wide=2, tables=1, rounds=0, max_draws=1)
