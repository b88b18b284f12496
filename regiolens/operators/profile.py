"""Filters, generic aggregation and the dataset profile (Q1-Q5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolens.functions.exprs import sum0
from regiolens.plans.marts import not_null_keys
from regiolens.schema import DEFAULT_SCHEMA, FactSchema


def filter_by_date_range(fact: DataFrame, start: str | None = None, end: str | None = None,
                         schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Q1: inclusive on both ends, either bound optional (pushed to the scan)."""
    d = F.col(schema.date)
    if start:
        fact = fact.where(d >= F.to_date(F.lit(start)))
    if end:
        fact = fact.where(d <= F.to_date(F.lit(end)))
    return fact


def drilldown(fact: DataFrame, state: str | None = None, district: str | None = None,
              schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Q2: state, then district selection."""
    if state is not None:
        fact = fact.where(F.col(schema.state) == state)
    if district is not None:
        fact = fact.where(F.col(schema.district) == district)
    return fact


def distinct_values(fact: DataFrame, column: str) -> DataFrame:
    """Q2: distinct non-null values of one column (for pick lists)."""
    return fact.where(F.col(column).isNotNull()).select(column).distinct()


def aggregate(fact: DataFrame, group_by: Sequence[str], agg_func: str = "sum",
              schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Q3: sum / mean of M, or row count as ``record_count``, by any dimensions."""
    g = not_null_keys(fact, group_by).groupBy(*group_by)
    cols = schema.present_all(fact)
    if agg_func == "sum":
        return g.agg(*[sum0(c).alias(c) for c in cols])
    if agg_func == "mean":
        return g.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    if agg_func == "count":
        return g.agg(F.count(F.lit(1)).alias("record_count"))
    raise ValueError(f"Unsupported aggregation function: {agg_func}")


def dataset_profile(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Q4/Q5: one scan -> rows, date range, coverage, totals and per-column nulls."""
    d = F.col(schema.date)
    return fact.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(d).alias("min_date"),
        F.max(d).alias("max_date"),
        F.datediff(F.max(d), F.min(d)).cast("long").alias("span_days"),
        F.count_distinct(schema.state).alias("num_states"),
        F.count_distinct(schema.district).alias("num_districts"),
        F.count_distinct(schema.unit).alias("num_pincodes"),
        *[sum0(c).alias(f"sum_{c}") for c in schema.present_all(fact)],
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{c}") for c in fact.columns],
    )
