"""Null-, zero- and ANSI-safe column expressions used by every operator.

Spark runs with ANSI mode on: ``x/0`` and bad casts raise.  These helpers give
the reference's pandas semantics the rulings settle on: NULL instead of
NaN/inf, two-valued flags, row sums that skip nulls when asked.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """``num / den`` as DOUBLE, NULL when the denominator is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct_change(cur, prev) -> Column:
    """Percent change ``(cur - prev) / prev * 100``; NULL when prev is 0/NULL."""
    return ratio(col(cur) - col(prev), prev) * F.lit(100.0)


def flag(cond: Column) -> Column:
    """Two-valued boolean: NULL comparisons count as False."""
    return F.coalesce(cond, F.lit(False))


def count_true(conds: Iterable[Column]) -> Column:
    out = F.lit(0)
    for c in conds:
        out = out + flag(c).cast("int")
    return out


def any_true(conds: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | flag(c)
    return out


def row_sum_skipna(cols: Sequence[str]) -> Column:
    """Row sum that treats NULL as 0 (``df[cols].sum(axis=1)``)."""
    out = F.lit(0).cast("long")
    for c in cols:
        out = out + F.coalesce(F.col(c).cast("long"), F.lit(0))
    return out


def row_sum(cols: Sequence[str]) -> Column:
    """Row sum that propagates NULL (``a + b + c``)."""
    out = F.col(cols[0])
    for c in cols[1:]:
        out = out + F.col(c)
    return out


def sum0(c) -> Column:
    """SUM that returns 0 (not NULL) over an all-NULL or empty group, as BIGINT."""
    return F.coalesce(F.sum(col(c)), F.lit(0)).cast("long")


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """``abs(a-b) <= atol + rtol*abs(b)``; NULL on either side is not close."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return flag(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))


def percentiles(c, fractions: Sequence[float], approx: bool = False, accuracy: int = 10000) -> Column:
    """Array of percentiles; exact (linear interpolation) unless ``approx``."""
    arr = F.array(*[F.lit(float(f)) for f in fractions])
    if approx:
        return F.percentile_approx(col(c).cast("double"), arr, accuracy)
    return F.percentile(col(c).cast("double"), arr)


def rule_rows(rules: Sequence[tuple[Column, Column]], rank_name: str = "rank",
              text_name: str = "recommendation", fallback: str | None = None) -> Column:
    """Array of (rank, text) for the rules whose condition holds.

    ``rules`` is a list of (condition, text) pairs over a one-row frame; with a
    ``fallback`` the text is returned alone when no rule fires.  Explode the
    result with ``inline``.
    """
    structs = F.array(*[
        F.struct(F.lit(i + 1).alias(rank_name), flag(cond).alias("fire"), text.alias(text_name))
        for i, (cond, text) in enumerate(rules)
    ])
    fired = F.filter(structs, lambda s: s["fire"])
    fired = F.transform(fired, lambda s: F.struct(s[rank_name].alias(rank_name), s[text_name].alias(text_name)))
    if fallback is None:
        return fired
    return F.when(F.size(fired) > 0, fired).otherwise(
        F.array(F.struct(F.lit(len(rules) + 1).alias(rank_name), F.lit(fallback).alias(text_name))))


def element_label(idx: Column, labels: Sequence[str]) -> Column:
    """0-based index into a literal label list."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), idx.cast("int") + 1)
