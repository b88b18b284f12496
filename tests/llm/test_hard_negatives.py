from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiolens.llm import hard_negatives as H


def brute(rows, every=10, k=5):
    ok = []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * x) for x in v]
        if sum(x * x for x in ints) < 2**63:
            ok.append((i, lab, ints))
    out = []
    for n, (i, lab, v) in enumerate(ok):
        if i % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for m, (j, _, w) in enumerate(ok) if m != n and len(w) == len(v))
        for ps, pid, _ in [x for x in s if ok[x[2]][1] == lab][:k]:
            neg = [x for x in s if ok[x[2]][1] != lab and -80 * ps <= -100 * x[0] <= -100 * ps][:k]
            out += [(i, pid, r, j, -ps, -ns) for r, (ns, j, _) in enumerate(neg, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def mine(df, every=10, **more):
    return H.mine_hard_negatives(df, F.col("vec_id") % every == 0, **more)


def clustered(seed, n=400, dim=8):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centers[rnd.integers(6)] + 0.4 * rnd.normal(size=dim)
        rows.append((i * 5, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rnd.integers(3)) if i % 3 else 0))
    return rows


@pytest.mark.parametrize("more", [{}, {"block_rows": 16, "rows_per_part": 60, "anchor_rows": 7, "group_blocks": 3},
                                  {"block_rows": 3, "anchor_rows": 1000, "group_blocks": 1000}])
def test_equals_brute_force(spark, more):
    rows = clustered(1)
    out = got(mine(frame(spark, rows).repartition(3), **more))
    assert out == brute(rows) and len(out) > 100


def test_ties_repeats_and_hot_vector(spark):
    rows = clustered(2, 120)
    v = rows[0][1]
    rows += [(1000 + i, v, i % 2) for i in range(150)] + [rows[4], rows[4], (1100, v, 0)]
    random.Random(5).shuffle(rows)
    out = got(mine(frame(spark, rows), block_rows=8, rows_per_part=40, anchor_rows=5, group_blocks=2))
    assert out == brute(rows)


def test_odd_rows(spark):
    big = [1e4, -2e4, 3e4]
    rows = [(0, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 2.9], 2), (2, None, 1), (3, [1.0, None, 2.0], 1), (4, [1.0, math.nan, 2.0], 1),
            (5, [math.inf, 1.0, 2.0], 2), (6, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 1), (7, [1.0, 2.0], 1), (10, [1.0, 2.1], 2),
            (8, [], 1), (20, [], 2), (30, [], 1), (9, [0.0, 0.0, 0.0], 2), (40, [0.0, 0.0, 0.0], 1), (50, big, 1), (51, big, 1),
            (52, [x * 0.9 for x in big], 2), (60, [3e38, 1.0, 1.0], 1), (70, [-1.0, -2.0, -3.0], 1), (80, [1.0, 2.0, 3.0], 1),
            (80, [1.0, 2.0, 3.0], 1)]
    df = frame(spark, rows).selectExpr("*", "1 as id", "2 as row", "3 as block", "4 as part", "5 as score", "'x' as vec")
    assert got(mine(df)) == brute(rows)
    assert mine(frame(spark, [])).collect() == []
    assert mine(frame(spark, [(0, None, 1)])).collect() == []


def test_zone_maps_leave_blocks_out_and_lose_nothing(spark):
    """Bounds hold every score, and separate clusters are not all read."""
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(-300, 300, (20, 6)), rnd.integers(-300, 300, (50, 6))
    down, up = H.bounds(a, b.min(axis=0)[None].astype(float), b.max(axis=0)[None].astype(float))
    s = H.scores(a, b)
    assert (s >= down).all() and (s <= up).all()
    who = H.Anchors.__new__(H.Anchors)
    who.vec, who.label, who.lists, who.least = np.array([[100, 0]]), np.array(["x"], object), [[{"score": 10000}]], [9000]
    zone = lambda lo, hi, lab: {"lo": np.array(lo, float).tobytes(), "hi": np.array(hi, float).tobytes(), "label": lab}
    zones = [zone([90, 0], [110, 5], "y"), zone([-5, 0], [20, 9], "y"), zone([150, 0], [160, 9], "y"), zone([90, 0], [110, 5], "x")]
    assert who.wants(zones, 80, 100).tolist() == [[True, False, False, False]]
    assert who.wants(zones, None, None).tolist() == [[False, False, False, True]]


def test_hilbert_neighbours():
    """Consecutive places on the curve are neighbouring cells."""
    for dim in (2, 3):
        cells = np.stack(np.meshgrid(*[np.arange(8)] * dim), -1).reshape(-1, dim)
        order = np.array([int.from_bytes(k) for k in H.hilbert_keys(cells)]).argsort()
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_window_of():
    for p in range(-30, 200):
        lo, hi = H.window_of(p, 80, 100)
        assert [s for s in range(-300, 300) if 80 * p <= 100 * s <= 100 * p] == list(range(lo, hi + 1))
