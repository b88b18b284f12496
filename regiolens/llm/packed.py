"""Sorted hashes packed into binary rows, for shuffles of very many small entries.

A unit (a slice of the input) keeps its distinct 64-bit keys sorted in one
binary value, with one number a key beside it.  ``deal`` cuts them at the bounds
of ``parts`` even key ranges, so a key's entries of all units meet in one group,
one entry a unit at most: a key that a third of all rows hold costs no more than
one entry a unit.  Groups answer in bits, one for each entry in the order sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolens.llm.common import releasing, releasing_group

ENTRIES = 1_000_000  # a group, on average


def pack_ints(a: np.ndarray) -> bytes:
    """Whole numbers as 9 bytes (width, least value) and differences to the least."""
    if not len(a):
        return b""
    low = int(a.min())
    span = int(a.max()) - low
    width = 1 if span < 1 << 8 else 2 if span < 1 << 16 else 4 if span < 1 << 32 else 8
    rest = (a.astype(np.int64).view(np.uint64) - np.uint64(low % (1 << 64))).astype(f"<u{width}")
    return bytes([width]) + low.to_bytes(8, "little", signed=True) + rest.tobytes()


def unpack_ints(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    low = int.from_bytes(b[1:9], "little", signed=True)
    rest = np.frombuffer(b, f"<u{b[0]}", offset=9).astype(np.uint64)
    return (rest + np.uint64(low % (1 << 64))).view(np.int64)


def key_bounds(parts: int) -> np.ndarray:
    """First key of each range after the first."""
    return np.array([-((-i << 64) // parts) for i in range(1, parts)], dtype=np.uint64)


def parts_for(entries: int) -> int:
    return max(1, -(-int(entries) // ENTRIES))


def split(keys: np.ndarray, parts: int) -> list[int]:
    """Where ``keys`` (sorted) is cut into the ranges."""
    return [0, *np.searchsorted(keys, key_bounds(parts)).tolist(), len(keys)]


def deal(units: DataFrame, parts: int) -> DataFrame:
    """``units(unit, keys, vals)`` -> ``(part, unit, n, keys, vals)`` cut by key range."""
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {x: [] for x in ("part", "unit", "n", "keys", "vals")}
            for unit, k, v in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                keys, vals = np.frombuffer(k, np.uint64), unpack_ints(v)
                cut = split(keys, parts)
                for p, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
                    if j > i:
                        for name, x in zip(rows, (p, unit, j - i, keys[i:j].tobytes(), pack_ints(vals[i:j])), strict=True):
                            rows[name].append(x)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
                [("part", pa.int64()), ("unit", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())]))

    return units.select("unit", "keys", "vals").mapInArrow(run, "part long, unit long, n long, keys binary, vals binary")


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k, np.uint64) for k in t.column("keys").to_pylist()]
    vals = [unpack_ints(v) for v in t.column("vals").to_pylist()]
    return np.concatenate(keys), np.concatenate(vals)


def answer(dealt: DataFrame, judge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """One row a unit: ``(unit, bits)`` with the judged bit of every key sent, as an
    array of ``(part, n, bits)``.  ``judge(group, values)`` gets the entries of
    one range: the dense number of each entry's key, and its value."""
    @releasing_group
    def run(t: pa.Table) -> pa.Table:
        keys, vals = _entries(t)
        bits = judge(np.unique(keys, return_inverse=True)[1], vals)
        out, a = [], 0
        for n in t.column("n").to_pylist():
            out.append(np.packbits(bits[a:a + n]).tobytes())
            a += n
        return pa.table({"part": t.column("part"), "unit": t.column("unit"), "n": t.column("n"), "bits": pa.array(out, pa.binary())})

    got = dealt.groupBy("part").applyInArrow(run, "part long, unit long, n long, bits binary")
    return got.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("part", "n", "bits"))).alias("bits"))


BROADCAST = 32 << 20  # bytes of answers that may be broadcast; above it units are shuffled


def with_answers(units: DataFrame, answers: DataFrame, size: int) -> DataFrame:
    """``units`` with the columns of ``answers(unit, ...)``, ``size`` bytes in all."""
    return units.join(F.broadcast(answers) if size <= BROADCAST else answers, "unit", "left")


def answered(bits: list[dict] | None) -> np.ndarray:
    """The bits of one unit's keys, in key order."""
    if not bits:
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in bits]).astype(bool)


def totals(dealt: DataFrame, least: int) -> DataFrame:
    """``(key, n)`` of all keys whose values add up to ``least`` or more."""
    @releasing_group
    def run(t: pa.Table) -> pa.Table:
        keys, vals = _entries(t)
        u, at = np.unique(keys, return_inverse=True)
        n = np.zeros(len(u), np.int64)
        np.add.at(n, at, vals)
        keep = n >= least
        return pa.table({"key": pa.array(u[keep].view(np.int64)), "n": pa.array(n[keep])})

    return dealt.select("part", "keys", "vals").groupBy("part").applyInArrow(run, "key long, n long")
