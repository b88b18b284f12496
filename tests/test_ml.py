"""Isolation forest (A11) and PIN clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from regiolens.operators import cluster as C
from regiolens.operators import iforest as IF
from regiolens.params import Params
from regiolens.sources.loader import derive_columns
from tests.conftest import FACT_DDL, d


def _planted(spark, n=1000, far=20):
    rng = np.random.default_rng(7)
    x = rng.normal(100, 10, size=(n, 3))
    x[:far] = rng.normal(400, 10, size=(far, 3))
    rows = [(i, d(2025, 1, 1), "Bihar", "Patna", 800001, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(x)]
    return derive_columns(spark.createDataFrame(rows, FACT_DDL))


def test_c_factor():
    assert IF.c_factor(np.array([1, 2]))[0] == 0.0 and IF.c_factor(np.array([2]))[0] == 1.0
    assert IF.c_factor(np.array([256]))[0] == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_forest_finds_planted_outliers(spark):
    df = _planted(spark)
    params = Params(forest_trees=100)
    out = IF.isolation_forest(df, params=params).toPandas()
    assert out["ml_anomaly_score"].between(-1, 0).all()
    worst = set(out.nsmallest(20, "ml_anomaly_score")["record_id"])
    assert len(worst & set(range(20))) >= 18
    assert out["ml_is_anomaly"].sum() == pytest.approx(0.04 * len(out), abs=3)


def test_forest_is_partition_independent(spark):
    df = _planted(spark, n=400, far=5)
    params = Params(forest_trees=30)
    a = IF.isolation_forest(df, params=params).orderBy("record_id").toPandas()
    b = IF.isolation_forest(df.repartition(5), params=params).orderBy("record_id").toPandas()
    assert np.allclose(a["ml_anomaly_score"], b["ml_anomaly_score"])


def test_forest_keeps_repeated_rows(spark):
    from regiolens.operators import anomaly as A

    df = _planted(spark, n=400, far=5)
    df = df.union(df.limit(50))
    out = A.anomaly_scored(IF.isolation_forest(df.drop("record_id"), params=Params(forest_trees=20)))
    assert out.count() == 450 and "ml_is_anomaly" in out.columns


def test_draws_follow_the_copies():
    """Each copy enters each tree with the share's chance, whether a row has one copy or a million."""
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    for share in (1.0, 0.3, 0.004, 1e-5):
        row, tree, key = IF.tree_draws(h, np.ones(len(h), np.int64), 50, share)
        assert abs(len(row) - len(h) * 50 * share) <= 6 * np.sqrt(len(h) * 50 * share) + 1e-9
        assert len(set(zip(row.tolist(), tree.tolist()))) == len(row)  # one copy enters a tree once
        assert np.bincount(tree, minlength=50).std() <= 3 * np.sqrt(len(h) * share) + 1
        hot = np.array([1, 1_000_000, 3], np.int64)
        if share < 0.01:
            row, tree, key = IF.tree_draws(h[:3], hot, 50, share)
            want = 1_000_000 * 50 * share
            assert abs((row == 1).sum() - want) < 6 * np.sqrt(want) and len(np.unique(key)) == len(key)
    again = IF.tree_draws(h[::-1], np.ones(len(h), np.int64), 50, 0.004)
    first = IF.tree_draws(h, np.ones(len(h), np.int64), 50, 0.004)
    assert sorted(again[2].tolist()) == sorted(first[2].tolist())  # draws do not depend on the batch


def test_commonest_row_is_not_the_most_abnormal(spark):
    """A third of all rows equal: with and without ids the same scores, and rows are flagged."""
    rng = np.random.default_rng(5)
    x = rng.normal(100, 10, size=(6000, 3))
    x[:2000] = (104, 97, 101)
    rows = [(i, d(2025, 1, 1), "Bihar", "Patna", 800001, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(x)]
    df = derive_columns(spark.createDataFrame(rows, FACT_DDL))
    params = Params(forest_trees=100)
    ids = IF.isolation_forest(df, params=params).toPandas()
    no = IF.isolation_forest(df.drop("record_id"), params=params).toPandas()
    hot = lambda t: t[(t.age_0_5 == 104) & (t.age_5_17 == 97) & (t.age_18_greater == 101)]
    assert len(hot(no)) >= 2000 and abs(hot(ids).ml_anomaly_score.iloc[0] - hot(no).ml_anomaly_score.iloc[0]) < 0.03
    for t in (ids, no):
        assert hot(t).ml_anomaly_score.iloc[0] > t.ml_anomaly_score.quantile(0.25)
        assert 0 < t.ml_is_anomaly.sum() <= 0.05 * len(t) and not hot(t).ml_is_anomaly.any()


def test_all_rows_equal(spark):
    rows = [(i, d(2025, 1, 1), "Bihar", "Patna", 800001, 1, 2, 3) for i in range(50)]
    out = IF.isolation_forest(derive_columns(spark.createDataFrame(rows, FACT_DDL)), params=Params(forest_trees=5)).toPandas()
    assert out.ml_anomaly_score.nunique() == 1 and not out.ml_is_anomaly.any()


def test_exact_percentile(spark):
    from pyspark.sql import functions as F

    from regiolens.functions.ranks import exact_percentile

    df = spark.range(5000).select((-F.abs(F.hash("id") % 997) / 1000.0).alias("x")).union(spark.range(300).selectExpr("-0.5d x"))
    for q in (0.0, 0.04, 0.31, 0.5, 1.0):
        assert exact_percentile(df, "x", q, -1.0, 0.0) == pytest.approx(df.agg(F.percentile("x", q)).first()[0], abs=1e-12)
    assert exact_percentile(df.limit(0), "x", 0.5, -1.0, 0.0) is None


def test_clusters_and_summary(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        base = [5, 5, 5] if i < 20 else ([500, 50, 20] if i < 40 else [20, 20, 3000])
        v = [int(b + rng.integers(0, 3)) for b in base]
        rows.append((i, d(2025, 1, 1), "A", "B", 100000 + i, *v))
    fact = derive_columns(spark.createDataFrame(rows, FACT_DDL))
    cl = C.pincode_clusters(fact, params=Params(n_clusters=3), restarts=3)
    labels = {r.pincode: r.cluster for r in cl.collect()}
    assert len(set(labels[100000 + i] for i in range(20))) == 1
    assert len(set(labels.values())) == 3
    s = {r.cluster: r for r in C.cluster_summary(cl).collect()}
    assert s[2].characteristics == "Medium-enrollment, 18-greater-dominant"
    assert s[0].characteristics.startswith("Low-enrollment")


def test_too_few_pins_gives_no_clusters(spark, tiny_fact):
    assert C.pincode_clusters(tiny_fact, params=Params(n_clusters=50)).count() == 0


def test_restarts_together_reach_the_lowest_cost(spark):
    """All restarts in one aggregate a step: a cost no higher than the best of ten separate fits."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, 0.7, size=(150, 2)) for c in ((0, 0), (6, 0), (0, 6), (7, 7), (3, 3))])
    pts = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    cost, centres = C.lloyd(pts, ["a", "b"], [C.start_centres(x, 5, s) for s in range(10)])
    f = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(pts)
    best = min(KMeans(k=5, seed=s, featuresCol="f").fit(f).summary.trainingCost for s in range(10))
    assert cost <= best * 1.0001
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert near.min(axis=1).sum() == pytest.approx(cost)


def test_clusters_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(4)
    rows = [(i, d(2025, 1, 1), "A", "B", 100000 + i, *(int(v) for v in rng.integers(1, 900, 3))) for i in range(200)]
    fact = derive_columns(spark.createDataFrame(rows, FACT_DDL))
    a, b = (sorted(tuple(r) for r in C.pincode_clusters(f, params=Params(n_clusters=4), restarts=4).collect())
            for f in (fact, fact.repartition(6)))
    assert a == b


def test_lloyd_step_sums_against_numpy(spark):
    """One pass gives every start's sums, ties to the first centre, a bounded result a task."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, size=(5000, 2)).astype(float)
    centres = rng.integers(0, 20, size=(3, 4, 2)).astype(float)
    centres[2, 3] = centres[2, 1]  # an exact tie
    pts = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").repartition(7)
    got = {(r["start"], r["cluster"]): (r["rows"], r["cost"], r["s0"], r["s1"]) for r in C.moved_sums(pts, ["a", "b"], centres).collect()}
    want = {}
    for i, c in enumerate(centres):
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        for j in set(far.argmin(axis=1)):
            mine = far.argmin(axis=1) == j
            want[i, j] = (mine.sum(), far[mine, j].sum(), *x[mine].sum(axis=0))
    assert got == want and (2, 3) not in got


def test_lloyd_steps_read_points_in_even_parts(spark):
    """The totals are so small that one task may write them; the steps must still use all cores."""
    rng = np.random.default_rng(6)
    rows = [(i, d(2025, 1, 1), "A", "B", 100000 + i, *(int(v) for v in rng.integers(1, 900, 3))) for i in range(2000)]
    paths = []
    C.pincode_clusters(derive_columns(spark.createDataFrame(rows, FACT_DDL)), params=Params(n_clusters=3), restarts=2, paths=paths)
    per = spark.read.parquet(paths[-1]).selectExpr("input_file_name() f").groupBy("f").count().collect()
    assert len(per) == spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in per) < 2 * 2000 / len(per)


def test_path_lengths_against_a_plain_walk():
    """Level-wise steps end in the leaf that the node table leads to, in every chunk,
    and need a fixed number of array steps for a chunk however deep its rows go."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 40, size=(700, 3)).astype(float)
    x[:5] = x[5]  # equal rows end above the height limit
    trees = [IF.grow_tree(x[rng.choice(700, 64, replace=False)], t, 3, 6) for t in range(12)]
    trees.append(IF.grow_tree(x[:5], 12, 3, 6))  # a single leaf
    arrays = IF._forest_arrays(pd.concat(trees))

    def walk(row, nodes):
        by = {n.node: n for n in nodes.itertuples()}
        n = by[0]
        while n.feature >= 0:
            n = by[n.left if row[n.feature] < n.threshold else n.right]
        return n.depth + float(IF.c_factor(np.array([n.size]))[0])

    want = [np.mean([walk(r, nodes) for nodes in trees]) for r in x[:60]]
    assert IF.path_lengths(x[:60], arrays) == pytest.approx(want, abs=1e-12)
    assert (IF.path_lengths(x, arrays, chunk=64) == IF.path_lengths(x, arrays)).all()
    assert [f.shape for f in arrays[0]] == [(13, 2**level) for level in range(len(arrays[0]))] and len(arrays[0]) <= 6
    assert len(IF.path_lengths(x[:0], arrays)) == 0
