"""Near-duplicate vectors by NN-descent.

A first neighbour graph comes from blocks of vectors with equal random-
hyperplane codes (large blocks are split by a hash): exact cosines inside a
block, each vector keeps its nearest ``k``.  Rounds of neighbours-of-neighbours
joins refine it: the members of each list are brought together and compared
with one another, and lists keep their best.  Where a list is full of linked
vectors it is saturated and gets ``wide`` places instead of ``k``.  An audit
compares bounded sample of vectors with all others, in blocks; while its recall
of links is under ``recall`` new codes are drawn and joined in.

Lists are a cap, so no component is built from them alone: of all links met in
a block or join a spanning forest is kept (each node and the root of its group
there), whether or not the lists have place for them.  Saturated groups have an
exact way: components that hold a full list are compared in block pairs, which
counts every link in them.  Where the recall is still too low after the last
draw, all vectors of a length are compared in block pairs, which finds every
link (n * n / 2 comparisons).
Equal vectors are one node throughout (and count as links of each other).
Cosines are dot products of unit vectors in double precision.

Defined results: a null, empty or zero vector, and one with a null or
non-finite component, links with nothing and is its own component; vectors of
different lengths don't link; rows with a null id link with nothing and have a
null component; repeated rows are vectors of their own; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiolens.llm.common import Scratch, clusters_of, table

BLOCK = 256
PAIR_BLOCK = 2048
SLICE = 256


def unit(v) -> np.ndarray:
    x = np.asarray(v, dtype=np.float64)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    blobs = col.to_pylist()
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _nodes(vectors: DataFrame) -> DataFrame:
    """``node, rep, copies, dim, unit`` for every distinct usable vector."""
    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([unit(v).tobytes() for v in b.column(4).to_pylist()],
                                                                       pa.binary())],
                                             names=["node", "rep", "copies", "dim", "unit"])

    d = (vectors.where("usable and id is not null").groupBy("node")
         .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("vec").alias("vec"))
         .select("node", "rep", "copies", F.size("vec").alias("dim"), "vec"))
    return d.mapInArrow(norm, "node long, rep long, copies long, dim int, unit binary")


def _codes(nodes: DataFrame, tables: range, bits: int) -> DataFrame:
    """``node, block``: the block of each node in each table."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            node, dims = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim in np.unique(dims):
                pick = np.flatnonzero(dims == dim)
                x = _matrix(b.column(2).take(pa.array(pick)))
                for t in tables:
                    if (int(dim), t) not in planes:
                        planes[int(dim), t] = np.random.default_rng([int(dim), t]).standard_normal((int(dim), bits))
                    side = (x @ planes[int(dim), t] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(node[pick]), pa.array(np.full(len(pick), t, np.int32)),
                                                      pa.array(np.full(len(pick), dim, np.int32)), pa.array(side)],
                                                     names=["node", "t", "dim", "code"])

    codes = nodes.select("node", "dim", "unit").mapInArrow(code, "node long, t int, dim int, code long")
    sizes = codes.groupBy("t", "dim", "code").agg(F.count("*").alias("c"))
    part = F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("c") / BLOCK))
    return codes.join(sizes, ["t", "dim", "code"]).select("node", F.xxhash64("t", "dim", "code", part).alias("block"))


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Puts the links ``i, j`` into ``root``, the smallest member of each place's group."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root[:] = root[root]


def _found(us: list, vs: list, cs: list, node: np.ndarray, root: np.ndarray) -> pa.Table:
    """Directed edges, and a row without cosine from each node to its root."""
    tree = np.flatnonzero(root != np.arange(len(root)))
    cos = pa.array(np.concatenate([np.zeros(0), *cs]))
    return pa.table({"u": np.concatenate([np.zeros(0, np.int64), *us, node[tree]]),
                     "v": np.concatenate([np.zeros(0, np.int64), *vs, node[root[tree]]]),
                     "cos": pa.concat_arrays([cos, pa.nulls(len(tree), pa.float64())])})


def _top(edges: DataFrame, wide_nodes: DataFrame | None, k: int, wide: int) -> DataFrame:
    """The best ``k`` (``wide`` for wide nodes) neighbours of each node (``listed``),
    from directed edges ``u, v, cos``, and all rows of the forest (``tree``)."""
    e = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"), F.max(F.col("cos").isNull()).alias("tree"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc_nulls_last("cos"), "v"))
    e = e.withColumn("place", rank)
    places = F.lit(k)
    if wide_nodes is not None:
        e = e.join(wide_nodes.select("u", F.lit(True).alias("more")), "u", "left")
        places = F.when(F.col("more"), wide).otherwise(k)
    e = e.select("u", "v", "cos", "tree", (F.col("cos").isNotNull() & (F.col("place") <= places)).alias("listed"))
    return e.where("listed or tree")


def _block_edges(blocks: DataFrame, nodes: DataFrame, k: int, floor: float, threshold: float) -> DataFrame:
    """Directed edges to each node's nearest ``k`` inside its blocks, and the
    forest of all links there."""
    def near(t: pa.Table) -> pa.Table:
        node, x = t.column("node").to_numpy(), _matrix(t.column("unit"))
        us, vs, cs, root = [], [], [], np.arange(len(node))
        for a in range(0, len(node), SLICE):
            cos = x[a:a + SLICE] @ x.T
            cos[np.arange(len(cos)), np.arange(a, a + len(cos))] = -2.0
            i, j = np.nonzero(cos >= threshold)
            _merge(root, a + i, j)
            best = np.argpartition(-cos, min(k, len(node)) - 1, axis=1)[:, :k]
            c = np.take_along_axis(cos, best, 1)
            i, j = np.nonzero(c >= floor)
            us.append(node[a + i])
            vs.append(node[best[i, j]])
            cs.append(c[i, j])
        return _found(us, vs, cs, node, root)

    rows = blocks.join(nodes.select("node", "unit"), "node")
    return rows.groupBy("block").applyInArrow(near, "u long, v long, cos double")


def _joined(lists: DataFrame, nodes: DataFrame, floor: float, threshold: float, parts: int, k: int) -> DataFrame:
    """Directed edges among the nearest ``k`` members of each list (neighbours of
    neighbours), and the forest of all links there: k * k comparisons a node at
    most, however wide its list."""
    def local(t: pa.Table) -> pa.Table:
        u, v, near = (t.column(c).to_numpy() for c in ("u", "v", "cos"))
        x = _matrix(t.column("unit"))
        order = np.lexsort((v, -near, u))
        cut = np.flatnonzero(np.concatenate([[True], np.diff(u[order]) != 0, [True]]))
        us, vs, cs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        members, place = np.unique(v, return_inverse=True)
        root, hops = np.arange(len(members)), [np.zeros((2, 0), np.int64)]
        for a, b in zip(cut, cut[1:], strict=False):
            rows = order[a:min(b, a + k)]
            cos = x[rows] @ x[rows].T
            i, j = np.nonzero(np.triu(cos >= floor, 1))
            linked = cos[i, j] >= threshold
            hops.append(np.stack([place[rows[i[linked]]], place[rows[j[linked]]]]))
            us += [v[rows[i]], v[rows[j]]]
            vs += [v[rows[j]], v[rows[i]]]
            cs += [cos[i, j], cos[i, j]]
        _merge(root, *np.concatenate(hops, axis=1))
        out = [np.concatenate(c) for c in (us, vs, cs)]
        # a pair met in many lists is emitted once a task
        _, first = np.unique(np.stack(out[:2]), axis=1, return_index=True)
        return _found(*([c[first]] for c in out), members, root)

    rows = lists.join(nodes.select(F.col("node").alias("v"), "unit", "dim"), "v")
    return (rows.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(parts))).groupBy("part", "dim")
            .applyInArrow(local, "u long, v long, cos double"))


def _sample_links(nodes: DataFrame, threshold: float, size: int) -> DataFrame:
    """``u, v``: all links of a bounded sample of nodes, against all nodes."""
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(size).select("node", "dim", "unit").collect()
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in chosen}:
        rows = [r for r in chosen if r["dim"] == dim]
        queries[dim] = (np.array([r["node"] for r in rows]), np.stack([np.frombuffer(r["unit"], np.float64) for r in rows]))
    known = nodes.sparkSession.sparkContext.broadcast(queries)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, dims = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in known.value:
                    continue
                ids, q = known.value[int(dim)]
                pick = np.flatnonzero(dims == dim)
                x = _matrix(b.column(2).take(pa.array(pick)))
                for a in range(0, len(pick), SLICE):
                    i, j = np.nonzero(x[a:a + SLICE] @ q.T >= threshold)
                    v, u = node[pick[a + i]], ids[j]
                    yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    return nodes.select("node", "dim", "unit").mapInArrow(compare, "u long, v long")


def _exact_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``node, links`` (weighted by copies) and a ``root`` among the members
    ``comp, node, dim, copies, unit`` of each component, one row a block pair:
    the roots of all rows are a forest of all links."""
    per = members.groupBy("comp", "dim").agg(F.count("*").alias("c"))
    number = F.ceil(F.col("c") / PAIR_BLOCK).cast("int")
    m = (members.join(per, ["comp", "dim"]).withColumn("blocks", number)
         .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("comp", "dim", "node", "copies", "unit", "mine", F.least("mine", "other").alias("i"),
                 F.greatest("mine", "other").alias("j"))

    def count(t: pa.Table) -> pa.Table:
        mine, i, j = t.column("mine").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        node, copies, x = t.column("node").to_numpy(), t.column("copies").to_numpy().astype(np.float64), _matrix(t.column("unit"))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        links, root = np.zeros(len(node)), np.arange(len(node))
        for a in range(0, len(left), SLICE):
            rows = left[a:a + SLICE]
            linked = x[rows] @ x[right].T >= threshold
            if i == j:
                linked[np.arange(len(rows)), np.arange(a, a + len(rows))] = False
            p, q = np.nonzero(linked)
            _merge(root, rows[p], right[q])
            links[rows] += linked @ copies[right]
            if i != j:
                links[right] += copies[rows] @ linked
        return pa.table({"node": node, "links": links.astype(np.int64), "root": node[root]})

    return m.groupBy("comp", "dim", "i", "j").applyInArrow(count, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                    k: int = 16, wide: int = 64, tables: int = 6, floor: float = 0.6, recall: float = 0.99,
                    audit: int = 500, rounds: int = 4, settle: float = 0.002, max_draws: int = 5) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept, and the audit's
    recall."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    good = (F.col("vec").isNotNull() & (F.size("vec") > 0)
            & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vec", lambda x: x != 0))
    rows = rows.select("id", "vec", F.coalesce(good, F.lit(False)).alias("usable"), F.xxhash64("vec").alias("node"))
    slim = scratch.store("rows", rows.select("id", "usable", "node"))
    nodes = scratch.store("nodes", _nodes(rows))
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / (BLOCK * 0.75))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 5_000 + 1)
    edges, wide_nodes, measured = None, None, 1.0
    forest: list[DataFrame] = []

    def listed_of(found: DataFrame) -> DataFrame:
        """The lists; the forest's rows are kept apart."""
        found = scratch.store("next", found)
        forest.append(scratch.store(f"forest-{len(forest)}", found.where("tree").select(F.col("u").alias("a"), F.col("v").alias("b"))))
        return found.where("listed").select("u", "v", "cos")

    for draw in range(max_draws):
        fresh = _block_edges(_codes(nodes, range(draw * tables, (draw + 1) * tables), bits), nodes, k, floor, threshold)
        lists = scratch.store("lists", listed_of(_top(fresh if edges is None else fresh.union(edges), wide_nodes, k, wide)))
        size = lists.count()
        for _ in range(rounds):
            # where a list is full of links, it gets more places
            wide_nodes = scratch.store("wide", lists.groupBy("u").agg(F.count("*").alias("c"), F.min("cos").alias("last"))
                                       .where((F.col("c") >= k) & (F.col("last") >= threshold)).select("u"))
            back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos")
            more = lists.union(back).union(_joined(lists, nodes, floor, threshold, parts, k))
            new = listed_of(_top(more, wide_nodes, k, wide))
            gained = new.join(lists, ["u", "v"], "left_anti").count()
            lists = scratch.store("lists", new)
            size = max(1, lists.count())
            if gained <= settle * size:
                break
        edges = lists
        links = scratch.store("links", lists.where(F.col("cos") >= threshold).select("u", "v")
                              .union(lists.where(F.col("cos") >= threshold).select("v", "u")).distinct())
        joins = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
        for part in forest:
            joins = joins.union(part)
        roots = scratch.store("roots", clusters_of(spark, joins, scratch))
        # audit: a link counts as found when both ends have come into one component
        # and it is listed, or the lists there are full (then it is counted exactly)
        full = scratch.store("full", lists.where(F.col("cos") >= threshold).groupBy("u").agg(F.count("*").alias("c"))
                             .where(F.col("c") >= k).join(roots, F.col("u") == F.col("node")).select("root").distinct())
        truth = _sample_links(nodes, threshold, audit)
        seen = (truth.join(links.withColumn("listed", F.lit(1)), ["u", "v"], "left")
                .join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left")
                .join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
                .join(full.select(F.col("root").alias("ru"), F.lit(1).alias("exact")), "ru", "left"))
        got = seen.agg(F.count("*"), F.count(F.when(F.col("listed").isNotNull() | (F.col("exact").isNotNull() & (
            F.col("ru") == F.col("rv"))), 1))).first()
        measured = got[1] / got[0] if got[0] else 1.0
        if measured >= recall:
            break
    everything = measured < recall
    if everything:  # no list is relied on: all pairs, in block pairs
        pairs = scratch.store("pairs", _exact_counts(nodes.select(F.lit(0).alias("comp"), "node", "dim", "copies", "unit"), threshold))
        joins = pairs.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots, measured = scratch.store("roots", clusters_of(spark, joins, scratch)), 1.0
    comps = nodes.join(roots, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("comp"))
    comps = scratch.store("comps", comps)
    if not everything:
        crowded = comps.join(full.select(F.col("root").alias("comp")), "comp", "left_semi")
        pairs = _exact_counts(crowded.join(nodes.select("node", "dim", "unit"), "node").select("comp", "dim", "node", "copies", "unit"),
                              threshold)
    exact = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    listed = (links.join(comps.select(F.col("node").alias("v"), "copies"), "v").groupBy(F.col("u").alias("node"))
              .agg(F.sum("copies").alias("near")))
    least = comps.groupBy("comp").agg(F.min("rep").alias("component"))
    done = scratch.store("done", comps.join(listed, "node", "left").join(exact, "node", "left").join(least, "comp").select(
        F.col("node").alias("mine"), "component",
        (F.coalesce("links", "near", F.lit(0)) + F.col("copies") - 1).alias("links")))
    for name in ("lists", "next", "wide", "links", "roots", "full", "comps", "nodes", "pairs", *(f"forest-{i}" for i in range(len(forest)))):
        scratch.drop(name)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return (slim.join(done, (F.col("node") == F.col("mine")) & F.col("usable") & F.col("id").isNotNull(), "left")
            .select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
                    F.lit(round(measured, 6)).alias("audit_recall")))


def op6_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
