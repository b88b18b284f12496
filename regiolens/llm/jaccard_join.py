"""Exact Jaccard self-join on shingle sets by universe partition.

Two sets x, y with Jaccard >= 0.8 differ in at most H = (|x| + |y|) // 9
elements, and their sizes fall in the same or in neighbouring size bands.

Lone elements first.  An element that no other set holds is a difference to every
partner, and no more than a fifth of a set may be differences.  All elements of
small sets, and those of a fixed part of the universe of large ones, are counted
(packed, one entry a unit of rows); sets with too many lone elements have no
partner and go no further.  The others leave their known lone elements out, and
what they ``spent`` that way is taken off their budget.  The distinct sets that are left are
then counted once more, all their elements and each set once whatever its copies.

Universe partition.  Each band hashes the universe into segments.  A segment may
be used exactly (one unit: its two subsets are equal) or with its one-deletion
neighbourhood (two units: they differ by at most one element), or be left out
(none).  If the segments a set uses yield more units than its budget, some used
segment must match, so looking up segment subsets finds every pair.  Allocation
by cost: the first few segments of a band also index their one-deletion
neighbourhoods; the units they add pay for segments that cost too much - empty
ones, and keys whose pairs exceed ``hot_pairs``.  A deletion spends one difference
more, and keys only bring together entries whose spent differences fit the
pair's budget, so texts of one common line and words of their own do not meet.

Sets that can't reach their units (short ones) get segments of one element: of
``|x| // 5 + 1 - spent`` elements a partner must hold one, and the rarest are
taken.  That always ends, with every pair found.

Components come from cheap first rounds: under each of the sets' smallest keys one
set of every component is verified against one hub.  Sets under keys that still stand
for more than ``BUSY`` pairs learn their distance to one pivot; with the lone elements
this bounds the distance of any two of a pivot from below, so those around one text
meet only where they can be similar.  Afterwards only pairs across components are verified - exactly, on the sets, after a parity sketch has ruled out those
that provably differ too much.  Equal sets are one node all along.

Defined results: null, empty and blank texts have the empty set, are linked
with nothing and are their own component; rows with a null id are linked with
nothing (null component); rows that share an id each count with their own text;
repeated rows are one node; texts of any length are whole sets; extra columns,
whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolens.llm import packed
from regiolens.llm.common import Scratch, clusters_of, lean, mix64, read_units, releasing, releasing_group, rows_of, slices, table, unused
from regiolens.llm.shingles import fingerprint, parity_sketch, sets_of, sketch_distance

HUB_KEYS = 2
HOT_PAIRS = 4000
BUSY = 64  # pairs of a key above which its sets are compared with a pivot first
SMALL = 1_000_000  # rows that may be broadcast; above it the same join shuffles
FULL = 64  # sets up to this size have all their elements counted
CLASSES = 4  # spent differences told apart in joins; the last class holds the rest
_ENTRY = "key long, fp long, n long, comp long, spent long"
_PLACED = f"{_ENTRY}, pivot long, far long, near long"
_SETS = ["fp", "n", "spent", "elements", "comp", "pivot", "far", "near"]
_K1, _K2, _K3 = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


@cache
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size, segments, segments with neighbourhoods) of every band."""
    low, seg, near = [], [], []
    lo = 1
    while lo < 1 << 40:
        nxt = lo * 5 // 4 + 1
        hi = nxt - 1
        most = (hi + hi * 5 // 4) // 9  # differences of a pair whose smaller set is here
        m = most + 1 if hi > 40 else max(1, (most + 3) // 2)
        # units to spare: the empty segments of the smallest and largest sets, and a few
        spare = 0.0
        for s in (lo, hi, hi * 5 // 4):
            need = (min(s, hi) + s) // 9 + 1
            empty = m * np.exp(-s / m)
            spare = max(spare, need - m + empty + 2.5 * np.sqrt(empty + 0.25))
        low.append(lo)
        seg.append(m)
        near.append(min(m, int(np.ceil(max(0.0, spare) * 1.25)) + 2))
        lo = nxt
    return np.array(low), np.array(seg), np.array(near)


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(bands()[0], sizes, side="right") - 1


class Signatures:
    """Keys of a list of sets in the partition of one band each."""

    def __init__(self, sets: list[np.ndarray], band: np.ndarray, seed: int):
        _, seg, near = bands()
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        m = seg[band]
        salt = mix64(band.astype(np.uint64) * _K1 + np.array([seed + 1], np.uint64) * _K2)
        h = mix64(tokens ^ salt[owner])
        segment = (((h >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        first = np.cumsum(m) - m
        cell = first[owner] + segment
        value = mix64(tokens + _K3)
        total = np.zeros(int(m.sum()), dtype=np.uint64)
        np.add.at(total, cell, value)
        count = np.bincount(cell, minlength=len(total))
        self.cell_owner = np.repeat(np.arange(len(sets)), m)
        number = np.arange(len(total)) - first[self.cell_owner]
        cell_salt = mix64(salt[self.cell_owner] + number.astype(np.uint64) * _K2)
        self.used = count > 0
        self.near = self.used & (number < near[band][self.cell_owner]) & (count >= 2)
        self.key = mix64(total ^ cell_salt)  # the whole subset of each cell
        pick = self.near[cell]
        self.near_cell = cell[pick]
        self.near_key = mix64((total[self.near_cell] - value[pick]) ^ cell_salt[self.near_cell])  # one element less

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, set, differences spent) of all subsets and neighbourhoods."""
        key = np.concatenate([self.key[self.used], self.near_key])
        own = np.concatenate([self.cell_owner[self.used], self.cell_owner[self.near_cell]])
        return key, own, np.repeat([0, 1], [int(self.used.sum()), len(self.near_key)])

    def units(self, n: int, hot: np.ndarray) -> np.ndarray:
        """Units of each of the n sets when the hot keys are left out."""
        ok = self.used & ~_member(self.key, hot)
        both = self.near & ok
        if len(self.near_key):
            both[self.near_cell[_member(self.near_key, hot)]] = False
        return np.bincount(self.cell_owner, weights=ok.astype(np.int64) + both, minlength=n).astype(np.int64)


def _member(x: np.ndarray, within: np.ndarray) -> np.ndarray:
    if not len(within):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(within, x), len(within) - 1)
    return within[at] == x


def _lookups(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(set numbers, band, units needed): each set in its own band, and in the
    band below where a similar set may lie."""
    band = band_of(np.maximum(sizes, 1))
    own = np.flatnonzero(sizes > 0)
    yield own, band[own], 2 * sizes[own] // 9 + 1
    high = bands()[0][band] - 1  # largest size of the band below
    down = np.flatnonzero((sizes > 1) & (5 * high >= 4 * sizes))
    yield down, band[down] - 1, (high[down] + sizes[down]) // 9 + 1


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


# --- lone elements ------------------------------------------------------------------

def _in_part(s: np.ndarray) -> np.ndarray:
    """The part (three eighths) of the universe that large sets count."""
    return (mix64(s ^ _K1) >> np.uint64(61)) < np.uint64(3)


def _counted_elements(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct counted elements of the sets, with 2 where several sets hold one.
    Sets of up to 5/4 FULL count all, as partners of those that ask for all."""
    take = [s if 4 * len(s) <= 5 * FULL else s[_in_part(s)] for s in sets]
    keys, n = np.unique(np.concatenate(take) if take else np.zeros(0, np.uint64), return_counts=True)
    return keys, np.minimum(n, 2)


def _unit_sets(texts: list[str | None]) -> list[np.ndarray]:
    return sets_of([(t or "").encode("utf-8", "replace") for t in texts])


def _more_than_one(group: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(group, weights=n)[group] > 1


def counted(units: DataFrame) -> DataFrame:
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                keys, n = _counted_elements(_unit_sets(r["texts"]))
                yield pa.RecordBatch.from_pydict({"unit": [r["unit"]], "keys": [keys.tobytes()], "vals": [packed.pack_ints(n)], "n": [len(keys)]})

    return units.mapInArrow(run, "unit long, keys binary, vals binary, n long")


def described(units: DataFrame, bits: DataFrame, size: int) -> DataFrame:
    """A row a document: its address, id, n, fp, and for those that may have a
    partner the spent differences, the set without lone elements, and its sketch."""
    schema = pa.schema([("unit", pa.int64()), ("at", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()),
                        ("spent", pa.int64()), ("elements", pa.binary()), ("sketch", pa.binary())])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                sets = _unit_sets(r["texts"])
                keys, _ = _counted_elements(sets)  # as they were sent
                several = packed.answered(r["bits"])
                rows = {name: [] for name in schema.names}
                for i, (s, x) in enumerate(zip(sets, r["ids"], strict=True)):
                    lone = np.zeros(len(s), bool)
                    if len(s):
                        asked = np.ones(len(s), bool) if len(s) <= FULL else _in_part(s)
                        lone[asked] = ~several[np.searchsorted(keys, s[asked])]
                    spent = int(lone.sum())
                    alive = len(s) > 0 and x is not None and spent <= len(s) // 5
                    for name, v in zip(schema.names, (r["unit"], i, x, len(s), fingerprint(s), spent, s[~lone].tobytes() if alive else None,
                                                      parity_sketch(s) if alive else None), strict=True):
                        rows[name].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return packed.with_answers(units, bits, size).mapInArrow(
        run, "unit long, at int, id long, n long, fp long, spent long, elements binary, sketch binary")


def _nodes(sets: DataFrame, small: int) -> DataFrame:
    """One row for each distinct set that may have a partner."""
    alive = sets.where("elements is not null")
    rep = alive.groupBy("fp").agg(F.min(F.struct("id", "unit", "at")).alias("r"), F.count("*").alias("copies")).select(
        "r.unit", "r.at", "copies")
    if rep.count() <= small:
        rep = F.broadcast(rep)
    return alive.join(rep, ["unit", "at"]).select("fp", F.col("id").alias("rep"), "n", "spent", "elements", "sketch", "copies")


_NODE = ["fp", "rep", "n", "spent", "elements", "sketch", "copies"]


def bundled(nodes: DataFrame, unit_bytes: int) -> DataFrame:
    """Nodes in units of about ``unit_bytes`` of elements, a row a unit."""
    from pyspark import TaskContext

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(slices(batches, "elements", unit_bytes)):
            ends = pa.array([0, b.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), *[pa.ListArray.from_arrays(ends, c) for c in b.columns]], names=["unit", *_NODE])

    return nodes.select(*_NODE).mapInArrow(run, "unit long, fp array<long>, rep array<long>, n array<long>, spent array<long>, "
                                                "elements array<binary>, sketch array<binary>, copies array<long>")


def _bundle_elements(r: dict) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.uint64) for x in r["elements"]])


def bundles_counted(bundles: DataFrame) -> DataFrame:
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                keys, n = np.unique(_bundle_elements(r), return_counts=True)
                yield pa.RecordBatch.from_pydict({"unit": [r["unit"]], "keys": [keys.tobytes()], "vals": [packed.pack_ints(np.minimum(n, 2))]})

    return bundles.select("unit", "elements").mapInArrow(run, "unit long, keys binary, vals binary")


def thinned(bundles: DataFrame, bits: DataFrame, size: int) -> DataFrame:
    """The nodes without the elements that no other node holds, which count as
    spent; no elements where too many are lone for a partner."""
    schema = pa.schema([(c, pa.binary() if c in ("elements", "sketch") else pa.int64()) for c in _NODE])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                every = _bundle_elements(r)
                several = packed.answered(r["bits"])[np.unique(every, return_inverse=True)[1]]
                end = np.cumsum([len(x) // 8 for x in r["elements"]]).tolist()
                spent, left = [], []
                for i, j, n, before in zip([0, *end], end, r["n"], r["spent"], strict=False):
                    spent.append(before + j - i - int(several[i:j].sum()))
                    left.append(every[i:j][several[i:j]].tobytes() if spent[-1] <= n // 5 else None)
                yield pa.RecordBatch.from_pydict({**{c: r[c] for c in _NODE}, "spent": spent, "elements": left}, schema=schema)

    return packed.with_answers(bundles, bits, size).mapInArrow(
        run, "fp long, rep long, n long, spent long, elements binary, sketch binary, copies long")


class Batch:
    """Sets of a batch of nodes or members."""

    def __init__(self, b: pa.RecordBatch):
        self.sets = [np.frombuffer(x, np.uint64) for x in b.column("elements").to_pylist()]
        self.fp, self.n, self.spent = (b.column(c).to_numpy() for c in ("fp", "n", "spent"))


# --- candidate pairs ----------------------------------------------------------------

def _similar(a: Column, b: Column) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _fits(na: Column, sa: Column, nb: Column, sb: Column) -> Column:
    """Whether the spent differences are within a pair's budget: each set has its
    own ones, and as many more or fewer on the other side as their sizes differ."""
    return F.greatest(2 * sa + nb - na, 2 * sb + na - nb) <= F.floor((na + nb) / 9)


def hub_pairs(members: DataFrame, hub_keys: int, seed: int) -> DataFrame:
    """Under each of the sets' smallest keys one set of every component, against
    one hub: pairs grow with the components that share a key, not their square."""
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "elements"):
            x, comp = Batch(b), b.column("comp").to_numpy()
            sig = Signatures(x.sets, band_of(x.n), seed)
            key, at = sig.key[sig.used], sig.cell_owner[sig.used]
            order = np.lexsort((key, at))
            key, at = key[order], at[order]
            first = np.searchsorted(at, np.arange(len(x.sets)))
            keep = np.arange(len(at)) - first[at] < hub_keys
            at = at[keep]
            yield pa.RecordBatch.from_arrays([_i64(key[keep]), _i64(x.fp[at]), _i64(x.n[at]), _i64(comp[at]), _i64(x.spent[at])],
                                             names=["key", "fp", "n", "comp", "spent"])

    keyed = members.select("fp", "n", "spent", "elements", "comp").mapInArrow(run, _ENTRY)
    one = keyed.groupBy("key", "comp").agg(F.min(F.struct("spent", "fp", "n")).alias("r"))
    hubs = one.groupBy("key").agg(F.min(F.struct("r", "comp")).alias("h"), F.count("*").alias("c")).where("c > 1")
    ok = (F.col("comp") != F.col("h.comp")) & _similar(F.col("r.n"), F.col("h.r.n")) & _fits(
        F.col("r.n"), F.col("r.spent"), F.col("h.r.n"), F.col("h.r.spent"))
    return (one.join(hubs, "key").where(ok)
            .select(F.least("r.fp", "h.r.fp").alias("a"), F.greatest("r.fp", "h.r.fp").alias("b")).distinct())


def merged(members: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``members`` with the components that ``links`` join made one; None where
    there is nothing to join."""
    comp = lambda c: members.select(F.col("fp").alias(c), F.col("comp").alias(f"c{c}"))
    edges = scratch.store("joined", links.join(comp("a"), "a").join(comp("b"), "b").where("ca <> cb")
                          .select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if edges.isEmpty():
        return None
    roots = clusters_of(members.sparkSession, edges, scratch)
    return members.join(roots, members.comp == roots.node, "left").withColumn("comp", F.coalesce("root", "comp")).drop("node", "root")


def verify(pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``pairs(a, b)`` with 100 * intersection >= 80 * union.  Pairs that
    the sketches rule out for certain are dropped first (a few bytes a pair);
    only the sets of the rest are shuffled."""
    @releasing
    def ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (b.column(2).to_numpy() + b.column(3).to_numpy()) // 9
            keep = [sketch_distance(x, y) <= m for x, y, m in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), most, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)], names=["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    @releasing
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "xa", 4_000_000), "xb", 4_000_000):
            keep = []
            for na, nb, x, y in zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * both >= 80 * (na + nb - both))  # lone elements are in no intersection
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, col: nodes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col(col).alias(f"x{c}"))
    close = (pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").select("a", "b", "na", "nb", "xa", "xb")
             .mapInArrow(ruled_out, "a long, b long, na long, nb long"))
    close = scratch.store("close", close)
    return (close.join(side("a", "elements").drop("na"), "a").join(side("b", "elements").drop("nb"), "b")
            .select("a", "b", "na", "nb", "xa", "xb").mapInArrow(exact, "a long, b long"))


def key_costs(members: DataFrame, parts: int, limit: float, flush: int = 400_000) -> DataFrame:
    """``key, cost``: keys that lie in more than one component, and the pairs
    across components they stand for (no more than the spent differences allow)."""
    @releasing
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            k, c, s, n, z, y = _grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cut = packed.split(k, parts)
            full = [i for i in range(parts) if cut[i] < cut[i + 1]]
            blobs = [[a[cut[i]:cut[i + 1]].tobytes() for i in full] for a in (k, c, s, n, z, y)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]],
                                              names=["part", "k", "c", "s", "n", "z", "y"])

        for b in slices(batches, "elements"):
            x, comp = Batch(b), b.column("comp").to_numpy()
            for own, band, _ in _lookups(x.n):
                key, at, more = Signatures([x.sets[i] for i in own], band, 1).entries()
                row = own[at]
                spent = x.spent[row] + more
                keep = spent <= x.n[row] // 4
                row = row[keep]
                sizes = x.n[row].astype(np.int32)
                held.append((key[keep], comp[row], spent[keep].astype(np.int32), np.ones(len(row), np.int32), sizes, sizes))
                size += len(row)
                if size >= flush:
                    yield out()
                    size = 0
        if size:
            yield out()

    @releasing_group
    def combine(t: pa.Table) -> pa.Table:
        k, c, s, n, z, y = _grouped(*(np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()]) for name, kind in
                                      (("k", np.uint64), ("c", np.int64), ("s", np.int32), ("n", np.int32), ("z", np.int32), ("y", np.int32))))
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        inside = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
        per = np.add.reduceat(n.astype(np.float64), inside)  # rows of a component under a key
        at = np.searchsorted(inside, first)
        total, square, comps = np.add.reduceat(per, at), np.add.reduceat(per**2, at), np.diff(np.append(at, len(inside)))
        cost = (total**2 - square) / 2
        end = np.append(first, len(k))
        for i in np.flatnonzero(cost > limit):
            rows = slice(end[i], end[i + 1])
            by = np.bincount(np.minimum(s[rows], 63), weights=n[rows], minlength=64)
            large, least = int(z[rows].max()), int(y[rows].min())
            most = 2 * large // 9
            by[(most + large - least) // 2 + 1:] = 0  # as far as sizes can differ here, these fit no pair
            upto = np.cumsum(by)
            cost[i] = min(cost[i], sum(by[j] * upto[min(most - j, 63)] for j in range(64) if by[j] and most >= j) / 2)
        many = comps > 1
        return pa.table({"key": _i64(k[first][many]), "cost": pa.array(cost[many])})

    cols = members.select("fp", "n", "spent", "elements", "comp")
    return (cols.mapInArrow(emit, "part int, k binary, c binary, s binary, n binary, z binary, y binary")
            .groupBy("part").applyInArrow(combine, "key long, cost double"))


def _grouped(k: np.ndarray, c: np.ndarray, s: np.ndarray, n: np.ndarray, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, component, spent), sorted by them, with summed counts, the greatest and the least size."""
    order = np.lexsort((s, c, k))
    k, c, s, n, z, y = (x[order] for x in (k, c, s, n, z, y))
    if not len(k):
        return k, c, s, n, z, y
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])]))
    return k[first], c[first], s[first], np.add.reduceat(n, first), np.maximum.reduceat(z, first), np.minimum.reduceat(y, first)


def lookups(members: DataFrame, hot: np.ndarray, wanted: np.ndarray | None) -> DataFrame:
    """Entries of ``placed`` sets under the wanted keys (None: all but the hot ones), and
    one row without a key for each set that has too few units in a band."""
    known = members.sparkSession.sparkContext.broadcast((hot, wanted))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, wanted = known.value
        for b in slices(batches, "elements"):
            x, rest = Batch(b), [b.column(c).to_numpy() for c in ("pivot", "far", "near")]
            comp = b.column("comp").to_numpy()
            for own, band, need in _lookups(x.n):
                if not len(own):
                    continue
                sig = Signatures([x.sets[i] for i in own], band, 1)
                key, at, more = sig.entries()
                row = own[at]
                spent = x.spent[row] + more
                keep = (_member(key, wanted) if wanted is not None else ~_member(key, hot)) & (spent <= x.n[row] // 4)
                row, few = row[keep], own[sig.units(len(own), hot) < need - x.spent[own]]
                rows = np.concatenate([row, few])
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([_i64(key[keep]), pa.nulls(len(few), pa.int64())]), _i64(x.fp[rows]), _i64(x.n[rows]), _i64(comp[rows]),
                    _i64(np.concatenate([spent[keep], x.spent[few]])), *[_i64(c[rows]) for c in rest]],
                    names=["key", "fp", "n", "comp", "spent", "pivot", "far", "near"])

    return members.select(*_SETS).mapInArrow(run, _PLACED)


# --- distances to pivots -------------------------------------------------------------

def placed(members: DataFrame, pivots: DataFrame | None) -> DataFrame:
    """``members`` with their ``pivots(fp, pivot, far, near)``, or each its own pivot.

    x with s lone elements and, without them, the distance d to the pivot has ``far`` =
    s + d and ``near`` = s - d.  Two sets of a pivot differ in both's lone elements and
    in |d - d'| more: the greater of far + near' and near + far'."""
    known = pivots is not None
    got = members.join(pivots, "fp", "left") if known else members
    own = {"pivot": F.col("fp"), "far": 2 * F.col("spent"), "near": F.lit(0).cast("long")}
    return got.withColumns({c: F.coalesce(c, x) if known else x for c, x in own.items()})


def pivots_of(members: DataFrame, busy: np.ndarray, nodes: DataFrame) -> DataFrame:
    """Each set under a busy key, and the least spent of these keys' hubs: one exact
    comparison a set."""
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "xa", 4_000_000), "xb", 4_000_000):
            n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                 for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True)]
            apart = b.column("na").to_numpy() + b.column("nb").to_numpy() - 2 * np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), _i64(apart), _i64(2 * b.column("sa").to_numpy() - apart)],
                                             names=["fp", "pivot", "far", "near"])

    keyed = lookups(placed(members, None), np.zeros(0, np.uint64), busy).where("key is not null")
    hubs = keyed.groupBy("key").agg(F.min(F.struct("spent", "fp")).alias("h")).select("key", "h.*").toArrow()  # one row a busy key
    key, spent, fp = (hubs.column(c).to_numpy() for c in ("key", "spent", "fp"))
    order = np.argsort(key.view(np.uint64))
    known = members.sparkSession.sparkContext.broadcast((key.view(np.uint64)[order], spent[order], fp[order]))

    @releasing
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spent, fp = known.value
        for b in slices(batches, "elements"):
            x = Batch(b)
            for own, band, _ in _lookups(x.n):
                under, at, _ = Signatures([x.sets[i] for i in own], band, 1).entries()
                keep = _member(under, key)
                hub, row = np.searchsorted(key, under[keep]), own[at[keep]]
                first = np.lexsort((fp[hub], spent[hub], row))
                row, at = np.unique(row[first], return_index=True)
                hub = hub[first[at]]
                yield pa.RecordBatch.from_arrays([_i64(x.fp[row]), _i64(spent[hub]), _i64(fp[hub])], names=["fp", "spent", "b"])

    chosen = (members.select("fp", "n", "spent", "elements").mapInArrow(choose, "fp long, spent long, b long")
              .groupBy("fp").agg(F.min(F.struct("spent", "b"))["b"].alias("b")).where("fp <> b"))
    a = nodes.select("fp", F.col("n").alias("na"), F.col("spent").alias("sa"), F.col("elements").alias("xa"))
    b = nodes.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("xb"))
    return chosen.join(a, "fp").join(b, "b").withColumnRenamed("fp", "a").mapInArrow(run, "fp long, pivot long, far long, near long")


def _class() -> Column:
    return F.least("spent", F.lit(CLASSES))


def entry_pairs(asking: DataFrame, answering: DataFrame, both_ask: bool) -> DataFrame:
    """Pairs across components that share a key and whose spent differences fit
    their budget; the join goes by key and class of spent differences, so entries
    that cannot fit never meet.  Where both sides ask, each pair is met once."""
    room = F.floor(F.col("n") / 4) - F.col("spent")  # differences left for any partner
    top = F.least(_class(), room) if both_ask else F.least(F.lit(CLASSES), room)
    place = lambda side: [F.col(c).alias(f"{c}{side}") for c in ("pivot", "far", "near")]
    x = asking.where(room >= 0).select("key", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("spent").alias("sa"),
                                       *place("a"), _class().alias("cla"), F.explode(F.sequence(F.lit(0).cast("long"), top.cast("long"))).alias("class"))
    y = answering.select("key", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("spent").alias("sb"),
                         *place("b"), _class().cast("long").alias("class"))
    ok = (F.col("ca") != F.col("cb")) & _similar(F.col("na"), F.col("nb")) & _fits(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"))
    apart = F.greatest(F.col("fara") + F.col("nearb"), F.col("neara") + F.col("farb"))
    ok = ok & ((F.col("pivota") != F.col("pivotb")) | (apart <= F.floor((F.col("na") + F.col("nb")) / 9)))
    if both_ask:
        ok = ok & ((F.col("cla") > F.col("class")) | (F.col("a") < F.col("b")))
    return x.join(y, ["key", "class"]).where(ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def element_pairs(members: DataFrame, short: DataFrame, scratch: Scratch, small: int) -> DataFrame:
    """Pairs of the short sets by segments of one element: of any ``n // 5 + 1 -
    spent`` elements of a set a partner holds one, and the rarest are asked for."""
    cols = members.select(*_SETS)

    def spread(batches: Iterator[pa.RecordBatch], asked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "elements"):
            x, rest = Batch(b), [b.column(c).to_numpy() for c in ("pivot", "far", "near")]
            comp = b.column("comp").to_numpy()
            key = np.concatenate(x.sets) if x.sets else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(len(x.sets)), [len(s) for s in x.sets])
            if asked is not None:
                keep = _member(key, asked)
                key, row = key[keep], row[keep]
            yield pa.RecordBatch.from_arrays([_i64(key), _i64(x.fp[row]), _i64(x.n[row]), _i64(comp[row]), _i64(x.spent[row]),
                                              *[_i64(c[row]) for c in rest]], names=["key", "fp", "n", "comp", "spent", "pivot", "far", "near"])

    mine = scratch.store("short_elements", cols.join(short, "fp", "left_semi").mapInArrow(releasing(lambda b: spread(b, None)), _PLACED))
    keys = mine.select("key").distinct()
    if keys.count() <= small:
        asked = members.sparkSession.sparkContext.broadcast(_sorted_keys(keys))
        every = cols.mapInArrow(releasing(lambda b: spread(b, asked.value)), _PLACED)
    else:
        every = cols.mapInArrow(releasing(lambda b: spread(b, None)), _PLACED).join(keys, "key", "left_semi")
    every = scratch.store("elements", every)
    freq = every.groupBy("key").count()
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("count", "key"))  # the elements of one set
    rare = mine.join(freq, "key").withColumn("rank", rank).where(F.col("rank") <= F.floor(F.col("n") / 5) + 1 - F.col("spent"))
    return entry_pairs(rare.drop("rank", "count"), every, False)


@lean
def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hub_keys: int = HUB_KEYS, hub_rounds: int = 3,
                       hot_pairs: int = HOT_PAIRS, small: int = SMALL, entries_per_part: int = 750_000,
                       unit_bytes: int = 2_000_000) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable
    by links) and n_copies (rows with the same set)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    units = read_units(docs, scratch, id_col, text_col, unit_bytes)
    sent = scratch.store("counted", counted(units))
    total = sent.agg(F.sum("n")).first()[0] or 0
    bits = scratch.store("bits", packed.answer(packed.deal(sent.where("n > 0"), packed.parts_for(total)), _more_than_one))
    sets = scratch.store("sets", described(units, bits, total // 8))
    for name in ("units", "counted", "bits"):
        scratch.drop(name)
    # copies hold each other's elements: what is lone among distinct sets shows only now
    bundles = scratch.store("bundles", bundled(_nodes(sets, small), 2 * unit_bytes), **{"parquet.block.size": str(16 << 20)})
    total = bundles.agg(F.sum(F.aggregate("elements", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    bits = scratch.store("bits", packed.answer(packed.deal(bundles_counted(bundles), packed.parts_for(total // 8)), _more_than_one))
    nodes = scratch.store("nodes", thinned(bundles, bits, total // 64))
    for name in ("bundles", "bits"):
        scratch.drop(name)
    members = nodes.where("elements is not null").withColumn("comp", F.col("fp"))
    for seed in range(hub_rounds):  # the same groups meet under other keys each time
        links = verify(scratch.store("pairs", hub_pairs(members, hub_keys, seed + 2)), nodes, scratch)
        more = merged(members, links, scratch)
        if more is None:
            break
        members = scratch.store("members", more)

    n_entries = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = float(hot_pairs)
    costs = scratch.store("costs", key_costs(members, int(0.7 * n_entries // entries_per_part) + 1, min(limit, float(BUSY))))
    busy, _ = _above(costs, float(BUSY), small)
    pivots = scratch.store("pivots", pivots_of(members, busy, nodes)) if len(busy) else None
    members = scratch.store("members", placed(members, pivots))
    hot, limit = _above(costs, limit, small)
    found = costs.count()
    kept = costs.where(F.col("cost") <= limit)
    wanted = _sorted_keys(kept) if found <= small else None
    entries = scratch.store("entries", lookups(members, hot, wanted))
    e = entries.where("key is not null")
    if wanted is None:
        e = e.join(kept.select("key"), "key", "left_semi")
    pairs = entry_pairs(e, e, True)
    short = scratch.store("short", entries.where("key is null").select("fp").distinct())
    if not short.isEmpty():
        pairs = pairs.union(element_pairs(members, short, scratch, small)).distinct()
    links = verify(scratch.store("pairs", pairs), nodes, scratch)
    slim = members.select("fp", "rep", "copies", "comp")
    more = merged(slim, links, scratch)
    alone = nodes.where("elements is null").select("fp", "rep", "copies", F.col("fp").alias("comp"))
    place = (slim if more is None else more).select(*slim.columns).union(alone)
    least = place.groupBy("comp").agg(F.min("rep").alias("component"))
    named = scratch.store("named", place.join(least, "comp").select(F.col("fp").alias("node"), "component", "copies"))
    out = scratch.store("out", sets.join(named, sets.fp == named.node, "left")
                        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                                F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
                                F.coalesce("copies", F.lit(1)).alias("n_copies")))
    for name in list(scratch.paths):
        if name != "out":
            scratch.drop(name)
    return out


def _above(costs: DataFrame, limit: float, small: int) -> tuple[np.ndarray, float]:
    """The keys that cost more than ``limit``, and that limit: raised where there
    are more of them than may be broadcast."""
    while costs.where(F.col("cost") > limit).count() > small:
        limit = max(8 * limit, 1.0)
    return _sorted_keys(costs.where(F.col("cost") > limit)), limit


def _sorted_keys(keys: DataFrame) -> np.ndarray:
    """Keys of a table checked to be small, sorted as unsigned numbers."""
    got = keys.select("key").toArrow().column("key").to_numpy()  # eight bytes a key, no row objects
    return np.sort(got.astype(np.int64).view(np.uint64))


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL,
                         **more) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one each: the row with
    the smallest id there.  Rows that share an id are told apart: each goes by its
    own text, and of copies under one id the first in the stored table stays.
    Rows without an id or with an empty set stay; columns of any name are kept as
    they are."""
    number, gone_id = unused(docs, "row_number"), unused(docs, "gone_id")
    once = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()
    scratch = Scratch(docs.sparkSession, "keep")
    if once:
        rows, key = docs, id_col
        found = similar_components(docs, id_col=id_col, text_col=text_col, small=small, **more)
        gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone_id))
    else:
        key = number
        rows = scratch.store("rows", docs.withColumn(number, F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())))
        found = similar_components(rows, id_col=number, text_col=text_col, small=small, **more).select(
            F.col(number).alias("r"), F.col("component_id").alias("c")).where("r is not null")
        found = scratch.store("found", found.join(rows.select(F.col(number).alias("r"), F.col(id_col).alias("i")), "r"))
        first = found.groupBy("c").agg(F.min(F.struct("i", "r"))["r"].alias("r"))
        gone = found.join(first, "r", "left_anti").select(F.col("r").alias(gone_id))
    gone = scratch.store("gone", gone)
    gone = F.broadcast(gone) if gone.count() <= small else gone
    return rows.join(gone, F.col(key) == F.col(gone_id), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_query(spark, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
