"""Time-series preparation.

Series are long tables ``(keys..., ds, y...)``: with ``keys=()`` one national
series as in the reference, with ``keys=[state, district]`` one series per
district (the many-series Spark job).  Every window is partitioned by the
series keys and runs over monthly/daily aggregates, whose length is bounded
by the calendar, never by the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolens.plans import marts
from regiolens.schema import DEFAULT_SCHEMA, FactSchema

FREQ = {"M": ("MM", "1 month"), "D": (None, "1 day")}
DS = "ds"


def _period(df: DataFrame, freq: str, schema: FactSchema) -> Column:
    if freq == "M":
        return F.trunc(F.col(schema.date), "MM")
    if freq == "D":
        return F.col(schema.date).cast("date")
    raise ValueError(f"Unsupported frequency: {freq}")


def prepare_series(fact: DataFrame, freq: str = "M", keys: Sequence[str] = (),
                   measures: Sequence[str] | None = None, schema: FactSchema = DEFAULT_SCHEMA,
                   interpolate: bool = True) -> DataFrame:
    """Sums per period, regular calendar, time-weighted interpolation.

    Missing periods between a series' first and last period are added and
    filled by linear interpolation in time (days between the neighbours).
    """
    if freq not in FREQ:
        raise ValueError(f"Unsupported frequency: {freq}")
    measures = list(measures) if measures is not None else schema.present_all(fact)
    keys = list(keys)
    base = fact.withColumn(DS, _period(fact, freq, schema))
    sums = marts.group_totals(base, [*keys, DS], measures, schema)
    step = F.expr(f"INTERVAL {FREQ[freq][1]}")
    spine = sums.groupBy(*keys).agg(F.min(DS).alias("_lo"), F.max(DS).alias("_hi")).select(
        *keys, F.explode(F.sequence("_lo", "_hi", step)).alias(DS))
    dense = spine.join(sums.withColumn("_present", F.lit(True)), [*keys, DS], "left")
    if not interpolate:
        return dense.withColumn("_present", F.coalesce("_present", F.lit(False))).withColumnRenamed(
            "_present", "observed")
    before = Window.partitionBy(*keys).orderBy(DS).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(DS).rowsBetween(0, Window.unboundedFollowing)
    present = F.col("_present").isNotNull()
    d0 = F.last(F.when(present, F.col(DS)), ignorenulls=True).over(before)
    d1 = F.first(F.when(present, F.col(DS)), ignorenulls=True).over(after)
    out = dense.withColumns({"_d0": d0, "_d1": d1})
    frac = F.try_divide(F.datediff(F.col(DS), F.col("_d0")).cast("double"),
                        F.datediff(F.col("_d1"), F.col("_d0")).cast("double"))
    filled = {}
    for m in measures:
        y0 = F.last(F.when(present, F.col(m)), ignorenulls=True).over(before)
        y1 = F.first(F.when(present, F.col(m)), ignorenulls=True).over(after)
        filled[m] = F.when(present, F.col(m).cast("double")).otherwise(
            y0.cast("double") + (y1 - y0).cast("double") * frac)
    out = out.withColumns(filled).withColumn("observed", present)
    return out.drop("_present", "_d0", "_d1")


LAGS = (1, 2, 3, 6, 12)
ROLLS = (3, 6, 12)


def ml_features(series: DataFrame, target: str = "total_enrollment", keys: Sequence[str] = (),
                shifted: bool = False) -> DataFrame:
    """Calendar features, lags, rolling mean/std; rows with nulls dropped.

    Rolling windows include the current value like the reference
    (``shifted=True`` ends them at the previous value instead, ruling R10).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(DS)
    y = F.col(target).cast("double")
    cols = {"month": F.month(DS), "quarter": F.quarter(DS), "year": F.year(DS), "day_of_year": F.dayofyear(DS)}
    for k in LAGS:
        cols[f"{target}_lag_{k}"] = F.lag(y, k).over(w)
    end = -1 if shifted else 0
    for n in ROLLS:
        ww = w.rowsBetween(end - n + 1, end)
        full = F.count(y).over(ww) == n
        cols[f"{target}_ma_{n}"] = F.when(full, F.avg(y).over(ww))
        cols[f"{target}_std_{n}"] = F.when(full, F.stddev_samp(y).over(ww))
    out = series.select(*keys, DS, y.alias(target)).withColumns(cols)
    return out.na.drop()


def feature_names(target: str = "total_enrollment") -> list[str]:
    return (["month", "quarter", "year", "day_of_year"] + [f"{target}_lag_{k}" for k in LAGS]
            + [f"{target}_{s}_{n}" for n in ROLLS for s in ("ma", "std")])


def error_metrics(pairs: DataFrame, actual: str, fitted: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE% (2 decimals) of fitted vs actual per series.

    MAPE skips points with an actual of 0 (their ratio is undefined).
    """
    e = F.col(actual).cast("double") - F.col(fitted).cast("double")
    g = pairs.where(F.col(fitted).isNotNull() & F.col(actual).isNotNull()).groupBy(*keys)
    return g.agg(F.round(F.avg(F.abs(e)), 2).alias("mae"),
                 F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
                 F.round(F.avg(F.abs(F.try_divide(e, F.col(actual).cast("double")))) * 100, 2).alias("mape"))
