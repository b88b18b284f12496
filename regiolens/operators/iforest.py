"""Isolation forest on Spark.

Algorithm: Liu, Ting, Zhou, "Isolation Forest", ICDM 2008.

1. Sampling (distributed, deterministic, one scheme for every row count and
   every kind of row): rows are grouped to distinct feature values with their
   counts, so a value that a third of all rows hold is one row here.  Each of
   its copies is a candidate for each tree with probability ``4 * psi / n`` (1
   for small tables), independently; the draws of a value skip from one success
   to the next, so they cost as much as there are successes.  Each draw has a
   hash key, and ``row_number() over (partition by tree order by key) <= psi``
   keeps ``psi = min(256, n)`` copies per tree (each tree partition holds about
   4*psi candidates: bounded by the parameters, not the data).  The sample
   depends on the feature values alone: no row id, no partitioning.
2. Growing: ``groupBy(tree).applyInPandas`` builds one isolation tree per
   group (random feature, random split inside the node's range, height limit
   ``ceil(log2 psi)``), returning its nodes.
3. Scoring: the forest (at most trees x (2*psi - 1) nodes, bounded by the
   parameters) is collected once, laid out level by level and broadcast; a pandas
   UDF walks all trees with NumPy and gives the score as a column of the row.
4. Flag: score below the ``contamination`` percentile of all scores, found by
   counting scores in fixed ranges and narrowing down to the exact ranks.

Score convention: ``-2 ** (-E[h(x)] / c(psi))`` (range -1..0, lower is more
abnormal), as scikit-learn's ``score_samples``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiolens.functions.ranks import exact_percentile
from regiolens.params import DEFAULT_PARAMS, Params
from regiolens.schema import DEFAULT_SCHEMA, FactSchema
from regiolens.session import write_table

EULER = 0.5772156649


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over ``n`` points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()), T.StructField("depth", T.IntegerType()),
])


def grow_tree(x: np.ndarray, tree: int, seed: int, height_limit: int) -> pd.DataFrame:
    """One isolation tree over the sample ``x`` (rows sorted for determinism)."""
    rng = np.random.default_rng([seed, tree])
    nodes = []  # (node, feature, threshold, left, right, size, depth)
    stack = [(0, np.arange(len(x)), 0)]
    next_id = 1
    while stack:
        nid, idx, depth = stack.pop()
        sub = x[idx]
        if depth >= height_limit or len(idx) <= 1:
            nodes.append((nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            nodes.append((nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        left, right = next_id, next_id + 1
        next_id += 2
        nodes.append((nid, f, thr, left, right, len(idx), depth))
        stack.append((right, idx[~go_left], depth + 1))
        stack.append((left, idx[go_left], depth + 1))
    out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
    out.insert(0, "tree", tree)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def tree_draws(hashes: np.ndarray, counts: np.ndarray, trees: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws ``(row, tree, key)``: each of a row's ``counts`` copies is drawn for
    each tree with probability ``share``, on its own.  A row's ``counts * trees``
    chances lie in one line; the gap to the next success is geometric, from the
    row's hash and the number of the draw, so the draws depend on nothing else."""
    last = counts.astype(np.int64) * trees
    active, at = np.arange(len(hashes)), np.full(len(hashes), -1.0)
    rows, places, done, step = [], [], 0, 1
    seeds = _mix(hashes.astype(np.uint64) + _STEP)
    while len(active):
        number = (np.arange(done, done + step, dtype=np.uint64) + np.uint64(1)) * _STEP
        u = ((_mix(seeds[active][:, None] + number) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        gap = np.floor(np.log(u) / np.log1p(-share)) if share < 1 else np.zeros_like(u)
        spot = at[active][:, None] + np.cumsum(gap + 1, axis=1)
        hit = spot < last[active][:, None]
        rows.append(np.broadcast_to(active[:, None], spot.shape)[hit])
        places.append(spot[hit].astype(np.int64))
        at[active] = spot[:, -1]
        active = active[hit[:, -1]]
        done += step
        step = max(1, min(4096, 2 * step, 2_000_000 // max(1, len(active))))
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    key = _mix(seeds[row] ^ _mix(place.astype(np.uint64) * _STEP + np.uint64(1))).view(np.int64)
    return row, (place % trees).astype(np.int32), key


def fit_forest(df: DataFrame, features: Sequence[str], params: Params = DEFAULT_PARAMS,
               n_rows: int | None = None) -> pd.DataFrame:
    """Grow the forest on Spark; returns the node table (bounded by the
    parameters)."""
    trees, seed = params.forest_trees, params.seed
    n = n_rows if n_rows is not None else df.count()
    psi = int(min(params.forest_subsample, n))
    if psi < 2:
        raise ValueError("isolation forest needs at least two rows")
    height = int(math.ceil(math.log2(psi)))
    share = min(1.0, 4.0 * psi / n)
    cols = [f"_x{i}" for i in range(len(features))]
    x = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(a) for a, c in zip(cols, features, strict=True)])
    distinct = x.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).select(F.xxhash64(F.lit(seed), *cols).alias("_h"), "_n", *cols)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, tree, key = tree_draws(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), trees, share)
            for i in range(0, len(row), 100_000):  # a value that most rows hold has many draws
                part = slice(i, i + 100_000)
                values = [b.column(2 + j).take(pa.array(row[part])) for j in range(len(cols))]
                yield pa.RecordBatch.from_arrays([pa.array(tree[part]), pa.array(key[part]), *values], names=["tree", "_key", *cols])

    cand = distinct.mapInArrow(draw, ", ".join(["tree int", "_key long", *[f"{c} double" for c in cols]]))
    w = Window.partitionBy("tree").orderBy("_key", *cols)
    sample = cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= psi).drop("_rn")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", *cols])
        return grow_tree(pdf[cols].to_numpy(dtype=float), int(pdf["tree"].iloc[0]), seed, height)

    nodes = sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    out = nodes.toPandas()  # at most trees * (2*psi - 1) rows
    out.attrs["psi"] = psi
    return out


def _forest_arrays(nodes: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The forest level by level: features and thresholds ``[tree, place]`` of each
    level, and the path length at each place below the last.  A row left of the
    threshold at place ``p`` goes to ``2 p + 1``, else to ``2 p``; a leaf above the
    last level hands its rows down (to the right of a threshold none is left of)."""
    trees, width = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
    feature, left, right = (np.full((trees, width), -1, dtype=np.int64) for _ in range(3))
    threshold, leaf_len = np.zeros((trees, width)), np.zeros((trees, width))
    t, nd = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    for a, c in ((feature, "feature"), (threshold, "threshold"), (left, "left"), (right, "right")):
        a[t, nd] = nodes[c].to_numpy()
    leaf_len[t, nd] = nodes["depth"].to_numpy() + c_factor(nodes["size"].to_numpy())
    tree, at = np.arange(trees)[:, None], np.zeros((trees, 1), dtype=np.int64)
    features, thresholds = [], []
    while (inner := feature[tree, at] >= 0).any():
        features.append(np.where(inner, feature[tree, at], 0))
        thresholds.append(np.where(inner, threshold[tree, at], -np.inf))
        below = np.where(inner, right[tree, at], at), np.where(inner, left[tree, at], at)
        at = np.stack(below, axis=2).reshape(trees, -1)
    return features, thresholds, leaf_len[tree, at]


def path_lengths(x: np.ndarray, arrays, chunk: int = 10_000) -> np.ndarray:
    """Mean path length of each row of ``x`` over all trees: ``chunk`` rows, which
    stay in the processor's cache, take one step at a time down every tree."""
    features, thresholds, leaf_len = arrays
    total = np.zeros(len(x))
    for a in range(0, len(x), chunk):
        part = np.ascontiguousarray(x[a:a + chunk])
        flat, first = part.ravel(), np.arange(len(part)) * part.shape[1]
        place, at = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        value, edge, go_left = np.empty(len(part)), np.empty(len(part)), np.empty(len(part), bool)
        for t in range(len(leaf_len)):
            place[:] = 0
            for f, thr in zip(features, thresholds, strict=True):
                # mode="clip" only spares a copy: every place is in range
                f[t].take(place, out=at, mode="clip")
                at += first
                flat.take(at, out=value, mode="clip")
                thr[t].take(place, out=edge, mode="clip")
                np.less(value, edge, out=go_left)
                place += place
                place += go_left
            total[a:a + chunk] += leaf_len[t].take(place, out=edge, mode="clip")
    return total / len(leaf_len)


def isolation_forest(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS,
                     features: Sequence[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` with ``ml_anomaly_score`` and ``ml_is_anomaly``
    as further columns (no key, no join: repeated rows stay repeated).

    The scored rows are written once to the checkpoint folder; the threshold
    and every later read use that table (``paths`` collects its place).  Fewer
    than two rows get no score.
    """
    features = list(features) if features is not None else schema.present_all(df)
    n = df.count()
    if n < 2:
        return df.withColumns({"ml_anomaly_score": F.lit(None).cast("double"), "ml_is_anomaly": F.lit(False)})
    nodes = fit_forest(df, features, params, n)
    cpsi = float(c_factor(np.array([nodes.attrs["psi"]]))[0])
    bc = df.sparkSession.sparkContext.broadcast(_forest_arrays(nodes))

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([c.astype(float).fillna(0.0).to_numpy() for c in xs])
        h = path_lengths(x, bc.value) if len(x) else np.zeros(0)
        return pd.Series(-np.power(2.0, -h / cpsi))

    scored = write_table(df.withColumn("ml_anomaly_score", score(*[F.col(c).cast("double") for c in features])),
                         "isolation_forest", paths)
    thr = exact_percentile(scored, "ml_anomaly_score", params.contamination, -1.0, 0.0)
    return scored.withColumn("ml_is_anomaly", F.coalesce(F.col("ml_anomaly_score") < F.lit(thr), F.lit(False)))
