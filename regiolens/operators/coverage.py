"""Coverage of any period from stored sketches.

``coverage_mart`` keeps one row per day and district with the record count and a
theta sketch of the units (PINs) seen.  Sketches are mergeable, so the coverage
of any days, states or districts is a union of rows of the mart, without the
fact; and two periods' sketches tell which units stayed, came and went.  A
sketch keeps at most ``2 ** lg_size`` hashes: counts up to that are exact, larger
ones have a relative standard error of about ``2 ** (-lg_size / 2)``.  Exact
counts from the fact (``describe.coverage``) remain the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolens.schema import DEFAULT_SCHEMA, FactSchema

LG_SIZE = 14
SKETCH = "units_sketch"


def coverage_mart(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, lg_size: int = LG_SIZE) -> DataFrame:
    """``(date, state, district, records, units_sketch)``; NULL keys kept."""
    return fact.groupBy(schema.date, *schema.geo).agg(
        F.count(F.lit(1)).alias("records"), F.theta_sketch_agg(F.col(schema.unit).cast("long"), F.lit(lg_size)).alias(SKETCH))


def _estimate(sketch: Column) -> Column:
    return F.round(F.theta_sketch_estimate(sketch)).cast("long")


def _between(mart: DataFrame, start: str | None, end: str | None, schema: FactSchema) -> DataFrame:
    d = F.col(schema.date)
    if start is not None:
        mart = mart.where(d >= F.lit(start).cast("date"))
    return mart.where(d <= F.lit(end).cast("date")) if end is not None else mart


def coverage_from_mart(mart: DataFrame, start: str | None = None, end: str | None = None, by: Sequence[str | Column] = (),
                       schema: FactSchema = DEFAULT_SCHEMA, lg_size: int = LG_SIZE) -> DataFrame:
    """Records, distinct states and district names (exact) and PINs (estimated)
    of the days from ``start`` to ``end``, per ``by`` group or one row."""
    rows = _between(mart, start, end, schema)
    aggs = [F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.count_distinct(schema.state).alias("num_states"),
            F.count_distinct(schema.district).alias("num_districts"),
            F.coalesce(_estimate(F.theta_union_agg(SKETCH, F.lit(lg_size))), F.lit(0)).alias("num_pincodes")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def coverage_change(mart: DataFrame, before: tuple[str, str], after: tuple[str, str], by: Sequence[str] = (),
                    schema: FactSchema = DEFAULT_SCHEMA, lg_size: int = LG_SIZE) -> DataFrame:
    """Per ``by`` group the units seen in both periods, only in the later one and
    only in the earlier one (set operations on two unions, one pass)."""
    d = F.col(schema.date)
    inside = [d.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in (before, after)]
    old, new = (F.theta_union_agg(F.when(x, F.col(SKETCH)), F.lit(lg_size)) for x in inside)
    g = mart.where(inside[0] | inside[1])
    both = g.groupBy(*by).agg(old.alias("_old"), new.alias("_new")) if by else g.agg(old.alias("_old"), new.alias("_new"))
    return both.select(*by, _estimate(F.theta_intersection("_old", "_new")).alias("kept"),
                       _estimate(F.theta_difference("_new", "_old")).alias("came"),
                       _estimate(F.theta_difference("_old", "_new")).alias("went"))
