"""PIN-code clustering (D21-D25): k-means, all restarts at once.

PIN totals of the age columns are standardised (mean and sample std; the
population std would only scale all distances).  Every restart starts from
k-means++ centres (Arthur, Vassilvitskii, SODA 2007) settled on a bounded sample
of PINs; each Lloyd step then moves the centres of all restarts in one pass over
all PINs, which are stored in even parts (NumPy inside the tasks, ``restarts x k``
partial sums a task), until none moves.  The
lowest cost wins, the first restart on ties.  Cluster ids are renumbered by their
mean total so labels do not depend on the initialisation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolens.params import DEFAULT_PARAMS, Params
from regiolens.plans import marts
from regiolens.schema import DEFAULT_SCHEMA, FactSchema
from regiolens.session import write_table

SAMPLE = 4000  # PINs the starting centres are chosen from
STEPS = 50
POINTS_PER_TASK = 500_000
CHUNK = 2000  # points whose distances to all centres are held at once


def pincode_totals(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Age sums per PIN, PINs whose sum is not positive dropped."""
    ms = schema.present_measures(fact)
    pins = marts.group_totals(fact, [schema.unit], ms, schema)
    return pins.where(sum(F.col(m) for m in ms) > 0)


def start_centres(x: np.ndarray, k: int, seed: int, steps: int = STEPS) -> np.ndarray:
    """k-means++ centres of the sample ``x``, settled by Lloyd steps on it."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        pick = rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x))
        centres = np.vstack([centres, x[pick]])
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(axis=1))
    for _ in range(steps):
        mine = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[mine == j].mean(axis=0) if (mine == j).any() else centres[j] for j in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def nearest(xs: list[Column], centres: np.ndarray) -> Column:
    """Struct (cost, cluster) of the nearest centre, the first on ties."""
    return F.array_min(F.array(*[F.struct(
        sum(((x - F.lit(float(v))) * (x - F.lit(float(v))) for x, v in zip(xs, c, strict=True)), F.lit(0.0)).alias("cost"),
        F.lit(j).alias("cluster")) for j, c in enumerate(centres)]))


def moved_sums(points: DataFrame, cols: list[str], centres: np.ndarray) -> DataFrame:
    """``start, cluster``, rows, cost and coordinate sums of the points nearest to
    each centre of ``centres[start, cluster]`` (the first on ties); a task sends
    one row for each of them, whatever its points."""
    starts, k, dims = centres.shape
    flat = centres.reshape(starts * k, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = np.zeros(starts * k, np.int64), np.zeros((dims + 1, starts * k))
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                x = [b.column(j).slice(at, CHUNK).to_numpy(zero_copy_only=False) for j in range(dims)]
                far = sum((x[j] - flat[:, j, None]) ** 2 for j in range(dims)).reshape(starts, k, -1)
                mine = far.argmin(axis=1)  # (starts, points)
                place = (mine + np.arange(starts)[:, None] * k).ravel()
                rows += np.bincount(place, minlength=starts * k)
                for j, w in enumerate([far.min(axis=1).ravel(), *(np.tile(v, starts) for v in x)]):
                    sums[j] += np.bincount(place, weights=w, minlength=starts * k)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (some // k, some % k, rows[some], *sums[:, some])],
                                         names=["start", "cluster", "rows", "cost", *names])

    names = [f"s{j}" for j in range(dims)]
    part = points.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(
        run, ", ".join(["start long", "cluster long", "rows long", "cost double", *[f"{c} double" for c in names]]))
    return part.groupBy("start", "cluster").agg(*[F.sum(c).alias(c) for c in ("rows", "cost", *names)])


def lloyd(points: DataFrame, cols: list[str], starts: list[np.ndarray], steps: int = STEPS, tol: float = 1e-6) -> tuple[float, np.ndarray]:
    """Move the centres of all starts together; the lowest cost and its centres."""
    centres = [c.copy() for c in starts]
    cost = [float("inf")] * len(starts)
    moving = set(range(len(starts)))
    for _ in range(steps):
        if not moving:
            break
        live = sorted(moving)
        got = moved_sums(points, cols, np.stack([centres[i] for i in live])).collect()
        for at, i in enumerate(live):
            mine = [r for r in got if r["start"] == at]
            cost[i] = sum(r["cost"] for r in mine)
            moved = centres[i].copy()
            for r in mine:  # a centre without points stays
                moved[r["cluster"]] = [r[f"s{j}"] / r["rows"] for j in range(len(cols))]
            if np.abs(moved - centres[i]).max() <= tol:
                moving.discard(i)
            centres[i] = moved
    best = min(range(len(starts)), key=lambda i: (round(cost[i], 9), i))
    return cost[best], centres[best]


def pincode_clusters(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS,
                     restarts: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """(pincode, ages..., cluster); empty when fewer PINs than k.  The
    PIN totals are stored once (``paths`` collects where)."""
    ms = schema.present_measures(fact)
    stored: list[str] = []
    pins = write_table(pincode_totals(fact, schema), "pincode_totals", stored)
    if paths is not None:
        paths.extend(stored)
    k = params.n_clusters
    n = params.cluster_restarts if restarts is None else restarts
    st = pins.agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"m{i}") for i, m in enumerate(ms)],
                  *[F.stddev_samp(m).alias(f"s{i}") for i, m in enumerate(ms)]).first()
    if st["n"] < k:
        return pins.withColumn("cluster", F.lit(None).cast("int")).limit(0)
    cols = [f"_x{i}" for i in range(len(ms))]
    points = pins.withColumns({c: (F.col(m) - F.lit(st[f"m{i}"])) / F.lit(st[f"s{i}"] or 1.0)
                               for i, (c, m) in enumerate(zip(cols, ms, strict=True))})
    # the totals are one small file a few tasks wrote; every step reads them with all cores
    spread = max(pins.sparkSession.sparkContext.defaultParallelism, st["n"] // POINTS_PER_TASK + 1)
    points = write_table(points.repartition(spread, schema.unit), "pincode_points", stored)
    if paths is not None:
        paths.append(stored[-1])
    # the same PINs whatever the partitioning
    sample = points.orderBy(F.xxhash64(schema.unit, F.lit(params.seed)), schema.unit).limit(SAMPLE).select(*cols).toPandas().to_numpy()
    _, centres = lloyd(points, cols, [start_centres(sample, k, params.seed + i) for i in range(n)])
    labelled = points.select(schema.unit, *ms, nearest([F.col(c) for c in cols], centres)["cluster"].alias("_raw_cluster"))
    # renumber clusters by mean row total (deterministic labels)
    order = labelled.groupBy("_raw_cluster").agg(F.avg(sum(F.col(m) for m in ms)).alias("_mean"))
    ranks = order.select("_raw_cluster", (F.expr("row_number() over (order by _mean, _raw_cluster)") - 1)
                         .cast("int").alias("cluster"))  # k rows
    return labelled.join(F.broadcast(ranks), "_raw_cluster").drop("_raw_cluster")


def cluster_summary(clusters: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Size, mean (truncated) and total per age, characteristic text."""
    ms = [m for m in schema.measures if m in clusters.columns]
    g = clusters.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        *[F.avg(m).cast("long").alias(f"avg_{m}") for m in ms],
        *[F.sum(m).cast("long").alias(f"total_{m}") for m in ms],
        F.avg(sum(F.col(m) for m in ms)).alias("_mean_total"))
    size_char = (F.when(F.col("_mean_total") > 10000, "High-enrollment")
                 .when(F.col("_mean_total") > 1000, "Medium-enrollment").otherwise("Low-enrollment"))
    # dominant group: largest total, first column on ties
    ranked = F.array(*[F.struct(F.col(f"total_{m}").alias("t"), F.lit(-i).alias("o"),
                                F.lit(m.replace("age_", "").replace("_", "-")).alias("name"))
                       for i, m in enumerate(ms)])
    dominant = F.array_max(ranked)["name"]
    return g.select("cluster", "size", *[f"avg_{m}" for m in ms], *[f"total_{m}" for m in ms],
                    F.concat(size_char, F.lit(", "), dominant, F.lit("-dominant")).alias("characteristics"))
