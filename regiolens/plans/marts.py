"""Shared aggregates reused by several operators (build once, reuse).

Every mart is a distributed ``groupBy`` with map-side partial aggregation, so a
hot key (one state holding a third of the rows) is pre-aggregated in each task
before the shuffle and never lands whole in one task.  Null keys are dropped
first, as a pandas ``groupby`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiolens.functions.exprs import percentiles, sum0
from regiolens.functions.ranks import exact_percentiles
from regiolens.params import DEFAULT_PARAMS, Params
from regiolens.schema import DEFAULT_SCHEMA, FactSchema


def not_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond) if keys else df


def group_totals(fact: DataFrame, keys: Sequence[str], measures: Sequence[str] | None = None,
                 schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Sum of each measure per key (0 for all-NULL groups), NULL keys dropped."""
    measures = list(measures) if measures is not None else schema.present_all(fact)
    return not_null_keys(fact, keys).groupBy(*keys).agg(*[_sum_of(fact, m).alias(m) for m in measures])


def _sum_of(df: DataFrame, c: str):
    """BIGINT sum of count columns, DOUBLE sum of fractional ones (0 when empty)."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
    return sum0(c)


def day_district_totals(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Sums per (day, state, district), NULL keys kept: every section built from
    sums over days, months, states or districts gives the same result on this
    table as on the fact, because sums of sums are sums."""
    cols = schema.present_all(fact)
    return (fact.groupBy(schema.date, *schema.geo).agg(*[_sum_of(fact, m).alias(m) for m in cols])
            .withColumn(schema.year_month, F.trunc(F.col(schema.date), "MM")))


def district_totals(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    return group_totals(fact, list(schema.geo), schema=schema)


def state_totals(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    return group_totals(fact, [schema.state], schema=schema)


def daily_totals(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    return group_totals(fact, [schema.date], schema=schema)


def monthly_totals(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, keys: Sequence[str] = ()) -> DataFrame:
    ym = fact.withColumn(schema.year_month, F.trunc(F.col(schema.date), "MM")) \
        if schema.year_month not in fact.columns else fact
    return group_totals(ym, [*keys, schema.year_month], schema=schema)


def column_stats(df: DataFrame, cols: Sequence[str], fractions: Sequence[float],
                 params: Params = DEFAULT_PARAMS, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sample std and the requested percentiles of each column.

    Output columns ``<c>_mean``, ``<c>_std``, ``<c>_q`` (array in ``fractions``
    order), per ``keys`` group or one row.  The one row's percentiles are exact
    from sketches and a counting pass (:func:`exact_percentiles`, two small
    aggregates run here); ``approx_percentiles`` takes a sketch's answer in one
    pass.  Groups keep a value->count map each (small for count data).
    """
    if keys or params.approx_percentiles:
        aggs = stat_columns(cols, fractions, params)
    else:
        aggs = stat_columns(cols, fractions, params, exact_percentiles(df, {c: fractions for c in cols}))
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def stat_columns(cols: Sequence[str], fractions: Sequence[float], params: Params = DEFAULT_PARAMS,
                 known: dict[str, list[float | None]] | None = None) -> list[Column]:
    """The aggregates of :func:`column_stats`; ``known`` percentiles enter as values."""
    aggs = []
    for c in cols:
        q = percentiles(c, fractions, params.approx_percentiles, params.approx_accuracy) if known is None else known_percentiles(known[c])
        aggs += [
            F.avg(F.col(c).cast("double")).alias(f"{c}_mean"),
            F.stddev_samp(F.col(c).cast("double")).alias(f"{c}_std"),
            q.alias(f"{c}_q"),
        ]
    return aggs


def known_percentiles(values: Sequence[float | None]) -> Column:
    """Percentiles found before as an array (null where there are no values)."""
    if any(v is None for v in values):
        return F.lit(None).cast("array<double>")
    return F.array(*[F.lit(float(v)) for v in values])
