"""Report tables: the data behind the reference's charts and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiolens.functions.exprs import sum0
from regiolens.plans import marts
from regiolens.schema import DEFAULT_SCHEMA, FactSchema


def daily_ma30(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, window: int = 30) -> DataFrame:
    """Daily total with a 30-day moving average (NULL until 30 days)."""
    d = marts.group_totals(fact, [schema.date], [schema.total], schema)
    w = Window.orderBy(schema.date).rowsBetween(-(window - 1), 0)  # over the daily aggregate only
    return d.select(schema.date, schema.total,
                    F.when(F.count(F.lit(1)).over(w) == window, F.avg(F.col(schema.total).cast("double")).over(w))
                    .alias("ma_30"))


def age_totals(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Total per age column (measures only), ascending."""
    ms = schema.present_measures(fact)
    one = fact.agg(*[sum0(m).alias(m) for m in ms])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("age_group"), F.col(m).alias("total"))
                                         for m in ms]))).orderBy("total")


def key_figures(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of headline figures assembled from one-row section tables.

    ``parts`` maps a section name to a one-row DataFrame; each enters as a
    scalar subquery (no joins between them).
    """
    names = list(parts)
    base = parts[names[0]]
    for n in names[1:]:
        p = parts[n]
        row = p.select(F.struct(*p.columns).alias("r")).scalar()
        base = base.withColumns({c: row[c] for c in p.columns})
    return base
