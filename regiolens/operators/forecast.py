"""Ensemble, surge alerts and forecast report tables.

All tables are keyed by the series keys, so the same code serves the single
national series and one series per district.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolens.functions.exprs import rule_rows
from regiolens.operators.series import DS
from regiolens.params import DEFAULT_PARAMS, SURGE_CONTEXT, SURGE_CONTEXT_DEFAULT, Params


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ensemble(forecasts: Sequence[DataFrame], metrics: Sequence[DataFrame], keys: Sequence[str] = ()
             ) -> tuple[DataFrame, DataFrame]:
    """equal-weight mean of the valid models' forecasts per series and step,
    cut to the shortest valid horizon; metrics are the mean of the models'.
    A series without a valid model gets an error row."""
    keys = list(keys)
    fc = _union(forecasts)
    met = _union(metrics)
    valid = met.where(F.col("status") == "ok").select(*keys, "model")
    vfc = fc.join(valid, [*keys, "model"], "left_semi")
    horizon = vfc.groupBy(*keys, "model").agg(F.max("step").alias("_h")).groupBy(*keys).agg(
        F.min("_h").alias("_hmin"))
    if keys:
        cut = vfc.join(horizon, keys, "inner")
    else:
        cut = vfc.withColumn("_hmin", horizon.select(F.struct("_hmin")).scalar()["_hmin"])
    efc = cut.where(F.col("step") <= F.col("_hmin")).groupBy(*keys, "step", DS).agg(
        F.avg("yhat").alias("yhat")).select(*keys, F.lit("ensemble").alias("model"), "step", DS, "yhat")
    vmet = met.join(valid, [*keys, "model"], "left_semi")
    emet_ok = vmet.groupBy(*keys).agg(
        F.round(F.avg("mae"), 2).alias("mae"), F.round(F.avg("rmse"), 2).alias("rmse"),
        F.round(F.avg("mape"), 2).alias("mape"),
        F.array_join(F.sort_array(F.collect_list("model")), ",").alias("component_models"))
    emet = met.select(*keys).distinct().join(emet_ok, keys, "left") if keys else emet_ok
    emet = emet.select(*keys, F.lit("ensemble").alias("model"), "mae", "rmse", "mape", "component_models",
                       F.when(F.col("component_models").isNull() | (F.col("component_models") == ""),
                              "error: No valid forecasts to ensemble").otherwise("ok").alias("status"))
    return efc, emet


def surge_context(month: Column) -> Column:
    """context text of the forecast period's calendar month."""
    out = None
    for mo, text in SURGE_CONTEXT.items():
        out = F.when(month == mo, text) if out is None else out.when(month == mo, text)
    return out.otherwise(SURGE_CONTEXT_DEFAULT)


def history_stats(series: DataFrame, target: str, keys: Sequence[str] = (), params: Params = DEFAULT_PARAMS
                  ) -> DataFrame:
    """Per series: P95 threshold, mean and sample std of the history."""
    y = F.col(target).cast("double")
    return series.groupBy(*keys).agg(F.percentile(y, params.surge_percentile / 100.0).alias("threshold"),
                                     F.avg(y).alias("hist_mean"), F.stddev_samp(y).alias("hist_std"))


def surges(forecast: DataFrame, series: DataFrame, target: str, keys: Sequence[str] = (),
           params: Params = DEFAULT_PARAMS) -> DataFrame:
    """forecast periods above the P95 of the series' history."""
    keys = list(keys)
    st = history_stats(series, target, keys, params)
    if keys:
        j = forecast.join(st, keys, "inner")
    else:
        row = st.select(F.struct(*st.columns).alias("s")).scalar()
        j = forecast.withColumns({c: row[c] for c in ("threshold", "hist_mean", "hist_std")})
    v = F.col("yhat")
    hit = j.where(v > F.col("threshold"))
    return hit.select(
        *keys, F.col("step").alias("period"), DS,
        F.round(v, 2).alias("forecasted_value"), F.round("threshold", 2).alias("threshold"),
        F.round(F.try_divide(v - F.col("hist_mean"), F.col("hist_std")), 2).alias("z_score"),
        F.round(F.try_divide(v - F.col("threshold"), F.col("threshold")) * 100, 2).alias("pct_above_threshold"),
        surge_context(F.month(DS)).alias("context"))


def surge_summary(forecast: DataFrame, series: DataFrame, target: str, keys: Sequence[str] = (),
                  params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Per series: surge detected, number of surge periods, threshold."""
    keys = list(keys)
    st = history_stats(series, target, keys, params).select(*keys, "threshold")
    s = surges(forecast, series, target, keys, params)
    n = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_surge_periods"))
    if keys:
        out = st.join(n, keys, "left")
    else:
        out = st.withColumn("num_surge_periods", s.select(F.count(F.lit(1))).scalar())
    out = out.withColumn("num_surge_periods", F.coalesce("num_surge_periods", F.lit(0)).cast("long"))
    return out.select(*keys, (F.col("num_surge_periods") > 0).alias("surge_detected"), "num_surge_periods",
                      F.round("threshold", 2).alias("surge_threshold"))


def history_summary(series: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """F16: mean, median, std, min, max (2 decimals) and the trend direction."""
    y = F.col(target).cast("double")
    return series.groupBy(*keys).agg(
        F.round(F.avg(y), 2).alias("mean"), F.round(F.percentile(y, 0.5), 2).alias("median"),
        F.round(F.stddev_samp(y), 2).alias("std"), F.round(F.min(y), 2).alias("min"),
        F.round(F.max(y), 2).alias("max"),
        F.when(F.max_by(y, DS) > F.min_by(y, DS), "increasing").otherwise("decreasing").alias("trend"))


def forecast_band(fc: DataFrame, width: float = 0.10) -> DataFrame:
    """T4: forecast with its 95% band, or +-10% where the model has none."""
    return fc.withColumns({
        "band_lower": F.coalesce(F.col("lower_95"), F.col("yhat") * (1 - width)) if "lower_95" in fc.columns
        else F.col("yhat") * (1 - width),
        "band_upper": F.coalesce(F.col("upper_95"), F.col("yhat") * (1 + width)) if "upper_95" in fc.columns
        else F.col("yhat") * (1 + width)})


def forecast_recommendations(surge_sum: DataFrame, ens_metrics: DataFrame, history: DataFrame,
                             keys: Sequence[str] = ()) -> DataFrame:
    """rule texts per series."""
    keys = list(keys)
    if keys:
        j = surge_sum.join(ens_metrics.select(*keys, "mape"), keys, "left").join(
            history.select(*keys, "trend"), keys, "left")
    else:
        m = ens_metrics.select(F.struct("mape").alias("s")).scalar()
        h = history.select(F.struct("trend").alias("s")).scalar()
        j = surge_sum.withColumns({"mape": m["mape"], "trend": h["trend"]})
    mape = F.col("mape")
    rules = [
        (F.col("surge_detected"), F.format_string(
            "ALERT: Enrollment surge predicted in %d period(s). Prepare additional capacity and resources.",
            F.col("num_surge_periods"))),
        (mape > 15, F.format_string(
            "Forecast accuracy moderate (MAPE=%s%%). Consider improving data quality and feature engineering.",
            mape.cast("string"))),
        (mape < 5, F.format_string("Forecast accuracy high (MAPE=%s%%). Confidence in predictions is strong.",
                                   mape.cast("string"))),
        (F.col("trend") == "increasing",
         F.lit("Enrollment shows increasing trend. Plan for sustained capacity expansion.")),
    ]
    return j.select(*keys, F.inline(rule_rows(
        rules, fallback="Forecast suggests stable enrollment patterns. Maintain current capacity planning.")))
