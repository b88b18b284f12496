"""Exact order statistics of a continuous column.

``percentile`` keeps one map entry per distinct value and merges all of them in
one task.  Two ways without that:

* :func:`exact_percentiles` takes many ranks of many columns in two passes: KLL
  sketches (a few thousand values each, whatever the rows) bracket every wanted
  rank, and one counting pass settles it: how many values lie below the bracket
  and on its ends, and the few values inside.  Where the inside is too much to
  bring over, a sketch of it narrows the bracket and the pass is repeated.
* :func:`nth_smallest` counts values in fixed ranges; the range holding the
  wanted rank is split again until it holds one value, so a pass moves
  ``ranges`` counts a task and the driver sees ``ranges`` numbers.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nth_smallest(df: DataFrame, col: str, rank: int, lo: float, hi: float, ranges: int = 4096) -> float:
    """The value with ``rank`` smaller-or-equal values before it (0 is the least),
    among the non-null values, all within [lo, hi]."""
    x = F.col(col).cast("double")
    while True:
        inside = df.where((x >= lo) & (x <= hi))
        width = (hi - lo) / ranges
        if width <= 0 or lo + width == lo:
            return inside.agg(F.min(x)).first()[0]
        place = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(ranges - 1))
        counts = sorted(inside.groupBy(place.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"),
                                                             F.max(x).alias("hi")).collect(), key=lambda r: r["lo"])
        for r in counts:
            if rank < r["n"]:
                break
            rank -= r["n"]
        if r["lo"] == r["hi"]:
            return r["lo"]
        if rank == 0:
            return r["lo"]
        if rank == r["n"] - 1:
            return r["hi"]
        lo, hi = r["lo"], r["hi"]


def exact_percentile(df: DataFrame, col: str, fraction: float, lo: float, hi: float) -> float | None:
    """Linearly interpolated percentile, as ``percentile`` gives it."""
    n = df.where(F.col(col).isNotNull()).count()
    if not n:
        return None
    at = fraction * (n - 1)
    low = nth_smallest(df, col, math.floor(at), lo, hi)
    if at == math.floor(at):
        return low
    return low + (at - math.floor(at)) * (nth_smallest(df, col, math.ceil(at), lo, hi) - low)


SKETCH_K = 2000
GRID = 256  # quantiles read off a bracket's sketch


def _sketch_error(k: int) -> float:
    """Rank error (as a share of the rows) that a KLL sketch keeps with 99%."""
    return 2.296 / k**0.9021


@dataclass
class _Bracket:
    """Values of a column between two of its values, and the ranks looked for in it."""

    col: str
    lo: float
    hi: float
    expected: float  # values inside, roughly
    ranks: list[int]


def _number(col: str) -> Column:
    x = F.col(f"`{col}`").cast("double")
    return F.when(~F.isnan(x), x)


def _bracket_counts(b: _Bracket, most: int, k: int) -> Column:
    x = _number(b.col)
    inside = F.when((x > b.lo) & (x < b.hi), x)
    few = b.expected <= most
    sketch = F.kll_sketch_agg_double(inside, F.lit(k))
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    narrowed = F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, grid))
    return F.struct(F.count_if(x < b.lo).alias("below"), F.count_if(x == b.lo).alias("at_lo"), F.count(inside).alias("inside"),
                    F.count_if(x == b.hi).alias("at_hi"),
                    (F.sort_array(F.collect_list(inside)) if few else F.lit(None).cast("array<double>")).alias("values"),
                    (F.lit(None).cast("array<double>") if few else narrowed).alias("grid"))


def exact_percentiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], most: int = 50_000,
                      k: int = SKETCH_K) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles of each column's values (nulls and NaN
    left out), as ``percentile`` gives them; None for a column without values.
    At most about ``most`` values a bracket come to the driver."""
    if not wanted:
        return {}
    slack = 1.5 * _sketch_error(k)
    points = {c: sorted({min(1.0, max(0.0, f + d)) for f in fs for d in (-slack, slack)}) for c, fs in wanted.items()}

    def first(c: str) -> Column:
        sketch = F.kll_sketch_agg_double(_number(c), F.lit(k))
        at = F.array(*[F.lit(p) for p in points[c]])
        return F.struct(F.count(_number(c)).alias("n"), F.min(_number(c)).alias("lo"), F.max(_number(c)).alias("hi"),
                        F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, at)).alias("q"))

    names = list(wanted)
    stats = dict(zip(names, df.agg(*[first(c).alias(f"c{i}") for i, c in enumerate(names)]).first(), strict=True))
    open_: list[_Bracket] = []
    for c, fs in wanted.items():
        s = stats[c]
        if not s["n"]:
            continue
        value = {0.0: s["lo"], 1.0: s["hi"], **dict(zip(points[c], s["q"], strict=True))}
        value[0.0], value[1.0] = s["lo"], s["hi"]
        for f in sorted(set(fs)):
            at = f * (s["n"] - 1)
            lo, hi = value[min(1.0, max(0.0, f - slack))], value[min(1.0, max(0.0, f + slack))]
            open_.append(_Bracket(c, lo, hi, 3 * slack * s["n"], sorted({math.floor(at), math.ceil(at)})))
    found: dict[tuple[str, int], float] = {}
    while open_:
        got = df.agg(*[_bracket_counts(b, most, k).alias(f"b{i}") for i, b in enumerate(open_)]).first()
        open_ = [b for old, r in zip(open_, got, strict=True) for b in _settle(old, r, found, stats[old.col], k)]

    def percentile(c: str, f: float) -> float | None:
        n = stats[c]["n"]
        if not n:
            return None
        at = f * (n - 1)
        a, b = math.floor(at), math.ceil(at)
        x, y = found[c, a], found[c, b]
        return x if a == b or x == y else (b - at) * x + (at - a) * y

    return {c: [percentile(c, f) for f in fs] for c, fs in wanted.items()}


def _settle(b: _Bracket, r, found: dict[tuple[str, int], float], stats, k: int) -> list[_Bracket]:
    """Write the ranks the counts settle into ``found``; narrower brackets for the rest."""
    rest: dict[tuple[float, float], _Bracket] = {}

    def again(lo: float, hi: float, expected: float, rank: int) -> None:
        rest.setdefault((lo, hi), _Bracket(b.col, lo, hi, expected, [])).ranks.append(rank)

    for rank in b.ranks:
        place = rank - r["below"] - r["at_lo"]
        if rank < r["below"]:  # the sketch was off by more than its error
            again(stats["lo"], b.lo, r["below"], rank)
        elif place < 0:
            found[b.col, rank] = b.lo
        elif place < r["inside"]:
            if r["values"] is not None:
                found[b.col, rank] = r["values"][place]
                continue
            share, slack = place / r["inside"], 1.5 * _sketch_error(k) + 1 / GRID
            i, j = math.floor((share - slack) * GRID), math.ceil((share + slack) * GRID)
            lo = b.lo if i < 0 else r["grid"][i]
            hi = b.hi if j > GRID else r["grid"][j]
            again(lo, hi, 3 * slack * r["inside"], rank)
        elif b.lo < b.hi and place < r["inside"] + r["at_hi"]:
            found[b.col, rank] = b.hi
        else:
            again(b.hi, stats["hi"], stats["n"] - r["below"], rank)
    return list(rest.values())
