"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Every component becomes an integer (``floor(scale * x)``); scores are integer
inner products.  Rows are range-sorted by vector length, label and the place of
the vector on a Hilbert curve through all dimensions, cut into blocks of
``block_rows`` rows and written as Parquet, one row a block, with the least and
greatest value of each dimension (the zone map).

An anchor's score with any row of a block lies within the interval that interval
arithmetic gives for its vector and the block's zone map.  Positives: the home
block, which holds the anchor itself, gives a first lower bound of its
``positives``-th best score; blocks of its label whose interval reaches it are
read.  Negatives: blocks with other labels whose interval meets one of the
anchor's windows are read.  The choice needs zone maps only; then the chosen
blocks meet the anchors that chose them, in groups of bounded size (a part of at
most ``anchor_rows`` anchors and ``group_blocks`` blocks or so), each group
returns at most the wanted number of rows per list, and ranks are taken over
those.  Nothing but counts comes to the driver.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part, nor do vectors with an integer square sum of 2**63 or
more (no 64-bit score holds it; all other scores fit); vectors of different
lengths have no score; repeated rows are rows of their own (each copy is another
row, and an anchor of its own); ties go to the smaller id; empty vectors score
0; a negative positive score has an empty window; extra columns are not read; an
empty table gives no rows; ids, labels and vectors are all that is read, so there
are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolens.llm.common import Scratch, rows_of, table

BITS = 3  # a dimension, on the curve
_STEP = 512  # row numbers kept for a block
_LEAST = np.iinfo(np.int64).min


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place on the Hilbert curve of each row of cell numbers (0 to 2**bits - 1),
    as binary values that sort like it."""
    x = cells.astype(np.uint8).T.copy()
    if not len(x):
        return [b""] * len(cells)
    for b in range(bits - 1, 0, -1):  # undo the turns of the sub-cubes, from the largest down
        low = np.uint8((1 << b) - 1)
        for i in range(len(x)):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap).astype(np.uint8)
            x[i] ^= swap.astype(np.uint8)
    x = np.bitwise_xor.accumulate(x, axis=0)  # Gray code
    turn = np.zeros(x.shape[1], np.uint8)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, np.uint8((1 << b) - 1), np.uint8(0))
    x ^= turn
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)])
    return [r.tobytes() for r in np.packbits(planes.T, axis=1)]


def pack_rows(m: np.ndarray) -> bytes:
    """Integer rows in the narrowest width, which the first byte tells."""
    top = int(np.abs(m).max()) if m.size else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + m.astype(f"<i{width}").tobytes()


def unpack_rows(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).reshape(n, -1).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact (doubles hold them while they stay under 2**53)."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval of the scores of each row of ``a`` with any vector between lo and hi."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    slack = 1e-9 * (np.abs(up) @ np.maximum(np.abs(lo), np.abs(hi)).T + np.abs(down) @ np.maximum(np.abs(lo), np.abs(hi)).T)
    return least - slack, most + slack  # rounding of the doubles never shuts a block out


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest integer s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), high * positive // 100


def best(s: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of ``at`` with the highest scores, ties by id, then row."""
    if len(at) > k:
        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((rows[at], ids[at], ~s[at]))][:k]


def make_blocks(vectors: DataFrame, scratch: Scratch, scale: int, block_rows: int, rows_per_part: int) -> DataFrame:
    """``vectors(id, label, vec, anchor)`` -> the stored table of blocks."""
    x = F.col("vec")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    src = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    span = src.agg(F.min(F.array_min("vec")).alias("lo"), F.max(F.array_max("vec")).alias("hi"), F.count("*").alias("n")).first()
    lo, cell = span["lo"] or 0.0, max((span["hi"] or 0.0) / 2**BITS - (span["lo"] or 0.0) / 2**BITS, 1e-300)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(2)
            dims = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            first = vecs.offsets.to_numpy() - vecs.offsets[0].as_py()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = flat[(first[at][:, None] + np.arange(d)).astype(np.int64)] if d else np.zeros((len(at), 0))
                with np.errstate(over="ignore"):
                    ints = np.floor(scale * v)
                    fits = (ints * ints).sum(axis=1) < 2.0**63 * (1 - 1e-9)
                at, v, ints = at[fits], v[fits], ints[fits].astype(np.int64)
                cells = np.clip(np.floor(v / cell - lo / cell), 0, 2**BITS - 1).astype(np.uint8)
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array([int(d)] * len(at), pa.int32()),
                     pa.array(hilbert_keys(cells), pa.binary()), pa.array([pack_rows(r) for r in ints], pa.binary())],
                    names=["id", "label", "anchor", "dim", "key", "vec"])

    rows = src.select("id", "label", "vec", "anchor").mapInArrow(keyed, "id long, label string, anchor boolean, dim int, key binary, vec binary")
    parts = max(1, -(-span["n"] // rows_per_part))
    # the id splits the range of a vector that very many rows share
    ordered = rows.repartitionByRange(parts, "dim", "label", "key", "id").sortWithinPartitions("dim", "label", "key", "id")
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("label", pa.string()), ("n", pa.int32()), ("ids", pa.binary()),
                        ("anchors", pa.binary()), ("mat", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 40
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            nonlocal block
            m = np.concatenate([unpack_rows(r["vec"], 1) for r in held])
            row = {"block": block, "dim": held[0]["dim"], "label": held[0]["label"], "n": len(held),
                   "ids": np.array([r["id"] for r in held], np.int64).tobytes(),
                   "anchors": np.array([bool(r["anchor"]) for r in held]).tobytes(), "mat": pack_rows(m),
                   "lo": m.min(axis=0).astype(np.float64).tobytes(), "hi": m.max(axis=0).astype(np.float64).tobytes()}
            block += _STEP
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) == block_rows or (held[0]["dim"], held[0]["label"]) != (r["dim"], r["label"])):
                    yield out()
                held.append(r)
        if held:
            yield out()

    return scratch.store("blocks", ordered.mapInArrow(cut, "block long, dim int, label string, n int, ids binary, anchors binary, "
                                                           "mat binary, lo binary, hi binary"))


def home_anchors(blocks: DataFrame, positives: int) -> DataFrame:
    """Anchors with ``least``: a score that ``positives`` other rows of the label
    reach in the home block (null where the block has fewer)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                at = np.flatnonzero(np.frombuffer(r["anchors"], bool))
                m, ids = unpack_rows(r["mat"], r["n"]), np.frombuffer(r["ids"], np.int64)
                s = scores(m[at], m)
                s[np.arange(len(at)), at] = _LEAST
                least = [None] * len(at) if r["n"] <= positives else np.partition(s, r["n"] - positives, axis=1)[:, r["n"] - positives].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["block"] + at), pa.array(ids[at]), pa.array([r["dim"]] * len(at), pa.int32()),
                     pa.array([r["label"]] * len(at), pa.string()), pa.array([pack_rows(v) for v in m[at]], pa.binary()),
                     pa.array(least, pa.int64())], names=["row", "id", "dim", "label", "vec", "least"])

    has = F.instr(F.hex("anchors"), "01") > 0
    return blocks.where(has).select("block", "dim", "label", "n", "ids", "anchors", "mat").mapInArrow(
        run, "row long, id long, dim int, label string, vec binary, least long")


class Anchors:
    """The anchors of one part that have vectors of one length."""

    def __init__(self, t: pa.Table, dim: int):
        rows = [r for r in t.to_pylist() if r["dim"] == dim]
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], object)
        self.vec = np.concatenate([unpack_rows(r["vec"], 1) for r in rows]) if rows else np.zeros((0, dim), np.int64)
        self.least = [r.get("least") for r in rows]
        self.lists = [r.get("lists") or [] for r in rows]

    def wants(self, dim_blocks: list[dict], low: int | None, high: int | None) -> np.ndarray:
        """Whether each anchor must read each block (``low`` None: for positives)."""
        lo, hi = (np.stack([np.frombuffer(z[c], np.float64) for z in dim_blocks]) for c in ("lo", "hi"))
        labels = np.array([z["label"] for z in dim_blocks], object)
        same = self.label[:, None] == labels[None, :]
        down, up = bounds(self.vec, lo, hi)
        if low is None:
            least = np.array([-np.inf if x is None else x * (1.0 - np.sign(x) * 1e-15) - 1 for x in self.least])
            return same & (up >= least[:, None])
        out = np.zeros_like(same)
        for i, ps in enumerate(self.lists):
            for p in ps:
                a, b = window_of(p["score"], low, high)
                if a <= b:
                    out[i] |= (up[i] >= a * (1 - 1e-15) - 1) & (down[i] <= b * (1 + 1e-15) + 1)  # 0 <= a <= b here
        return out & ~same


def _by_dim(t: pa.Table) -> Iterator[tuple[int, list[dict]]]:
    rows = t.to_pylist()
    for d in sorted({r["dim"] for r in rows}):
        yield d, [r for r in rows if r["dim"] == d]


def chosen_blocks(anchors: DataFrame, blocks: DataFrame, n_parts: int, n_blocks: int, low: int | None, high: int | None,
                  zones_a_group: int = 2048) -> DataFrame:
    """``(part, block)``: the blocks that some anchor of the part must read, from
    the zone maps alone."""
    groups = max(1, -(-n_blocks // zones_a_group))
    zones = blocks.select("block", "dim", "label", "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("zone_group"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    mine = anchors.withColumn("zone_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(a: pa.Table, z: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and z.num_rows:
            for d, rows in _by_dim(z):
                group = Anchors(a, d)
                for i in range(0, len(rows) if len(group.row) else 0, 256):
                    wanted = group.wants(rows[i:i + 256], low, high).any(axis=0)
                    found += [r["block"] for r, w in zip(rows[i:i + 256], wanted, strict=True) if w]
        part = a.column("part")[0].as_py() if a.num_rows else 0
        return pa.table({"part": pa.array([part] * len(found), pa.int32()), "block": pa.array(found, pa.int64())})

    return mine.groupBy("part", "zone_group").cogroup(zones.groupBy("part", "zone_group")).applyInArrow(run, "part int, block long")


def read_blocks(anchors: DataFrame, blocks: DataFrame, pairs: DataFrame, groups: int, k: int, low: int | None, high: int | None) -> DataFrame:
    """Per group of blocks the k best rows of each anchor's list(s):
    ``(anchor, positive, row, id, score)``; ``positive`` is null when ``low`` is."""
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("block_group")
    held = pairs.join(blocks.drop("anchors"), "block").select("*", group)
    mine = anchors.withColumn("block_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    schema = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(a: pa.Table, z: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for d, rows in _by_dim(z) if a.num_rows and z.num_rows else ():
            who = Anchors(a, d)
            if not len(who.row):
                continue
            wanted = np.concatenate([who.wants(rows[i:i + 256], low, high) for i in range(0, len(rows), 256)], axis=1)
            size = np.array([r["n"] for r in rows])
            mat = np.concatenate([unpack_rows(r["mat"], r["n"]) for r in rows])
            ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
            row = np.concatenate([r["block"] + np.arange(r["n"]) for r in rows])
            for i in range(len(who.row)):
                read = np.flatnonzero(np.repeat(wanted[i], size))
                if not len(read):
                    continue
                s = scores(who.vec[i:i + 1], mat[read])[0]
                i_ids, i_row = ids[read], row[read]
                if low is None:
                    lists = [(None, best(s, i_ids, i_row, np.flatnonzero(i_row != who.row[i]), k))]
                else:
                    lists = []
                    for p in who.lists[i]:
                        x, y = window_of(p["score"], low, high)
                        lists.append((p["row"], best(s, i_ids, i_row, np.flatnonzero((s >= x) & (s <= y)), k)))
                out += [(int(who.row[i]), p, int(i_row[j]), int(i_ids[j]), int(s[j])) for p, at in lists for j in at]
        return pa.Table.from_pydict({c: [r[n] for r in out] for n, c in enumerate(schema.names)}, schema=schema)

    keys = ["part", "block_group"]
    return mine.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, "anchor long, positive long, row long, id long, score long")


def _searched(scratch: Scratch, name: str, anchors: DataFrame, blocks: DataFrame, n_parts: int, n_blocks: int, k: int, group_blocks: int,
              low: int | None = None, high: int | None = None) -> DataFrame:
    pairs = scratch.store(f"{name}_pairs", chosen_blocks(anchors, blocks, n_parts, n_blocks, low, high))
    most = pairs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    found = read_blocks(anchors, blocks, pairs, max(1, -(-most // group_blocks)), k, low, high)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id", "row")
    return scratch.store(name, found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def mine_hard_negatives(vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                        scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = 256,
                        rows_per_part: int = 50_000, anchor_rows: int = 2048, group_blocks: int = 64) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)`` for the rows where ``anchor`` holds: negatives have another
    label and score ``low`` to ``high`` percent of the positive's score."""
    if block_rows > _STEP:
        raise ValueError(f"at most {_STEP} rows a block")
    scratch = Scratch(vectors.sparkSession, "negatives")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                         F.col(vector_col).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    blocks = make_blocks(src, scratch, scale, block_rows, rows_per_part)
    home = scratch.store("home", home_anchors(blocks, positives))
    n_blocks, n_parts = blocks.count(), max(1, -(-home.count() // anchor_rows))
    # parts of neighbours on the curve
    anchors = scratch.store("anchors", home.repartitionByRange(n_parts, "row").withColumn("part", F.spark_partition_id()))
    pos = _searched(scratch, "positives", anchors, blocks, n_parts, n_blocks, positives, group_blocks)
    lists = pos.groupBy("anchor").agg(F.collect_list(F.struct("row", "id", "score")).alias("lists"))  # at most ``positives`` each
    owned = scratch.store("owned", anchors.join(lists, F.col("anchor") == F.col("row")).drop("anchor", "least"))
    neg = _searched(scratch, "negatives", owned, blocks, n_parts, n_blocks, negatives, group_blocks, low, high)
    out = (neg.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
           .join(owned.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("lists").alias("p"))
                 .select("anchor", "anchor_id", F.col("p.row").alias("positive"), F.col("p.id").alias("positive_id"),
                         F.col("p.score").alias("positive_score")), ["anchor", "positive"])
           .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    out = scratch.store("out", out)
    for name in ("blocks", "home", "anchors", "positives", "positives_pairs", "owned", "negatives", "negatives_pairs"):
        scratch.drop(name)
    return out


ORACLE = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op12_query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
