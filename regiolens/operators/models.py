"""Forecast models over many series at once (F4, F5, F10, F11 + two simple models).

Every model returns two tidy tables:

* forecasts ``(keys..., model, step, ds, yhat, lower_80, upper_80, lower_95, upper_95)``
* metrics   ``(keys..., model, n_points, mae, rmse, mape, aic, bic, status)``

``status`` is ``'ok'`` or ``'error: ...'`` (a short series gives an error row,
never an exception).  Seasonal naive and trailing-mean models are plain SQL
(they feed the SQL-checkable ensemble path); Holt-Winters is a pure Spark fold
(``aggregate`` over the per-series value array, one row per series x
parameter triple); seasonal ARIMA is a per-series NumPy fit in
``applyInPandas`` (groups hold one series: bounded by the number of periods);
boosted trees are fitted the same way, all rounds of a series in one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiolens.operators.boosting import fit_boosted
from regiolens.operators.series import DS, LAGS, ROLLS, error_metrics, feature_names, ml_features
from regiolens.operators.statespace import kalman
from regiolens.params import DEFAULT_PARAMS, Params

FORECAST_COLS = ("model", "step", DS, "yhat", "lower_80", "upper_80", "lower_95", "upper_95")
METRIC_COLS = ("model", "n_points", "mae", "rmse", "mape", "aic", "bic", "status")
Z = {0.80: 1.2815515655446004, 0.95: 1.959963984540054}


def _null_bands(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in ("lower_80", "upper_80", "lower_95", "upper_95")})


def _steps(series: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """(keys, step, ds, _last) grid of future periods per series (monthly)."""
    last = series.groupBy(*keys).agg(F.max(DS).alias("_last"), F.count(F.lit(1)).alias("n_points"))
    return last.select(*keys, "_last", "n_points", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")) \
        .withColumn(DS, F.add_months("_last", F.col("step")))


# --- seasonal naive and trailing mean (SQL-expressible) ---------------------------

def seasonal_naive(series: DataFrame, target: str, keys: Sequence[str] = (), horizon: int = 6,
                   period: int = 12) -> tuple[DataFrame, DataFrame]:
    """yhat(step) = value one season before the forecast period."""
    keys = list(keys)
    grid = _steps(series, keys, horizon)
    back = F.col("step") - F.lit(period) * F.ceil(F.col("step") / F.lit(period)).cast("int")
    grid = grid.withColumn("_src", F.add_months("_last", back))
    src = series.select(*keys, F.col(DS).alias("_src"), F.col(target).cast("double").alias("yhat"))
    fc = grid.join(src, [*keys, "_src"], "left").select(*keys, F.lit("seasonal_naive").alias("model"),
                                                        "step", DS, "yhat")
    fc = _null_bands(fc)
    w = Window.partitionBy(*keys).orderBy(DS)
    pairs = series.select(*keys, F.col(target).cast("double").alias("_y"),
                          F.lag(F.col(target).cast("double"), period).over(w).alias("_f"))
    met = _metrics(series, pairs, keys, "seasonal_naive", period + 1)
    return fc, met


def trailing_mean(series: DataFrame, target: str, keys: Sequence[str] = (), horizon: int = 6,
                  window: int = 12) -> tuple[DataFrame, DataFrame]:
    """yhat = mean of the last ``window`` periods, for every step."""
    keys = list(keys)
    grid = _steps(series, keys, horizon)
    w = Window.partitionBy(*keys).orderBy(DS)
    lastmean = series.select(*keys, DS, F.when(F.count(F.lit(1)).over(w.rowsBetween(-(window - 1), 0)) == window,
                                               F.avg(F.col(target).cast("double")).over(
                                                   w.rowsBetween(-(window - 1), 0))).alias("yhat"))
    fc = grid.join(lastmean.withColumnRenamed(DS, "_last"), [*keys, "_last"], "left").select(
        *keys, F.lit("trailing_mean").alias("model"), "step", DS, "yhat")
    fc = _null_bands(fc)
    fit = F.when(F.count(F.lit(1)).over(w.rowsBetween(-window, -1)) == window,
                 F.avg(F.col(target).cast("double")).over(w.rowsBetween(-window, -1)))
    pairs = series.select(*keys, F.col(target).cast("double").alias("_y"), fit.alias("_f"))
    met = _metrics(series, pairs, keys, "trailing_mean", window + 1)
    return fc, met


def _metrics(series: DataFrame, pairs: DataFrame, keys: Sequence[str], model: str, min_points: int) -> DataFrame:
    keys = list(keys)
    m = error_metrics(pairs, "_y", "_f", keys)
    if keys:
        out = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points")).join(m, keys, "left")
    else:  # one series: the point count enters as a scalar subquery
        out = m.withColumn("n_points", series.select(F.count(F.lit(1))).scalar())
    ok = F.col("n_points") >= min_points
    return out.select(*keys, F.lit(model).alias("model"), "n_points",
                      *[F.when(ok, F.col(c)).alias(c) for c in ("mae", "rmse", "mape")],
                      F.lit(None).cast("double").alias("aic"), F.lit(None).cast("double").alias("bic"),
                      F.when(ok, "ok").otherwise(F.lit(f"error: fewer than {min_points} periods")).alias("status"))


# --- Holt-Winters (additive trend and season), pure Spark ---------------------------

HW_GRID = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)


def holt_winters(series: DataFrame, target: str, keys: Sequence[str] = (), horizon: int = 6, period: int = 12,
                 grid: Sequence[float] = HW_GRID, fixed: tuple[float, float, float] | None = None,
                 materialize_fit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Additive Holt-Winters; (alpha, beta, gamma) by least squares over a grid.

    Per series the values form one array (its length is the number of periods);
    the grid is exploded so each (series, alpha, beta, gamma) row folds the
    array with ``aggregate`` on the executors; ``min_by`` keeps the best fit.
    Initial state: level = mean of the first season, trend = mean seasonal
    difference / period, season = first season minus level.
    """
    keys = list(keys)
    m = period
    arr = series.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(DS).alias("d"), F.col(target).cast("double").alias("v"))))
        .alias("_pts"))
    arr = arr.select(*keys, F.transform("_pts", lambda p: p["v"]).alias("_y"),
                     F.element_at("_pts", -1)["d"].alias("_last"), F.size("_pts").alias("n_points"))
    triples = [fixed] if fixed is not None else list(itertools.product(grid, grid, grid))
    g = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c)).alias("g"))
                  for a, b, c in triples])
    ok = F.col("n_points") >= 2 * m
    # CPU-heavy rows (one fold each): spread series x grid over all cores with an
    # explicit partition count (AQE would coalesce the small input into one task)
    par = series.sparkSession.sparkContext.defaultParallelism
    good = arr.where(ok).select("*", F.explode(g).alias("_p")).repartition(par, *keys, "_p")
    y = F.col("_y")
    first = F.slice(y, 1, m)
    second = F.slice(y, m + 1, m)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    l0 = total(first) / m
    b0 = (total(second) - total(first)) / float(m * m)
    s0 = F.transform(first, lambda x: x - l0)
    a, b, gm = F.col("_p")["a"], F.col("_p")["b"], F.col("_p")["g"]
    init = F.struct(l0.alias("l"), b0.alias("b"), s0.alias("s"), F.lit(0.0).alias("sse"), F.lit(0.0).alias("sae"),
                    F.lit(0.0).alias("sape"), F.lit(0).alias("napes"))
    idx = F.zip_with(y, F.sequence(F.lit(0), F.size(y) - 1), lambda v, i: F.struct(v.alias("v"), i.alias("i")))

    def step(acc: Column, e: Column) -> Column:
        v, i = e["v"], e["i"]
        j = F.pmod(i, F.lit(m))
        s_old = F.element_at(acc["s"], j + 1)
        yhat = acc["l"] + acc["b"] + s_old
        l_new = a * (v - s_old) + (1 - a) * (acc["l"] + acc["b"])
        b_new = b * (l_new - acc["l"]) + (1 - b) * acc["b"]
        s_new = gm * (v - l_new) + (1 - gm) * s_old
        err = v - yhat
        return F.struct(
            l_new.alias("l"), b_new.alias("b"),
            F.transform(acc["s"], lambda x, k: F.when(k == j, s_new).otherwise(x)).alias("s"),
            (acc["sse"] + err * err).alias("sse"), (acc["sae"] + F.abs(err)).alias("sae"),
            (acc["sape"] + F.when(v != 0, F.abs(err / v)).otherwise(0.0)).alias("sape"),
            (acc["napes"] + F.when(v != 0, 1).otherwise(0)).alias("napes"))

    fitted = good.select(*keys, "_last", "n_points", "_p", F.aggregate(idx, init, step).alias("_st"))
    best = fitted.groupBy(*keys).agg(
        F.min_by(F.struct("_last", "n_points", "_p", "_st"), F.col("_st")["sse"]).alias("_b")).where(
        F.col("_b").isNotNull()).select(*keys, "_b.*")  # a global aggregate over no series yields one NULL row
    if materialize_fit:  # forecasts and metrics both read the fitted states: fold once
        from regiolens.session import materialize

        best = materialize(best)
    n = F.col("n_points").cast("double")
    met_ok = best.select(
        *keys, F.lit("holt_winters").alias("model"), "n_points",
        F.round(F.col("_st")["sae"] / n, 2).alias("mae"),
        F.round(F.sqrt(F.col("_st")["sse"] / n), 2).alias("rmse"),
        F.round(F.try_divide(F.col("_st")["sape"], F.col("_st")["napes"].cast("double")) * 100, 2).alias("mape"),
        F.lit(None).cast("double").alias("aic"), F.lit(None).cast("double").alias("bic"),
        F.lit("ok").alias("status"),
        F.col("_p")["a"].alias("alpha"), F.col("_p")["b"].alias("beta"), F.col("_p")["g"].alias("gamma"))
    met_err = arr.where(~ok).select(
        *keys, F.lit("holt_winters").alias("model"), "n_points",
        *[F.lit(None).cast("double").alias(c) for c in ("mae", "rmse", "mape", "aic", "bic")],
        F.lit(f"error: fewer than {2 * m} periods").alias("status"),
        *[F.lit(None).cast("double").alias(c) for c in ("alpha", "beta", "gamma")])
    steps = best.select(*keys, "_last", "n_points", "_st", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    season_idx = F.pmod(F.col("n_points") - 1 + F.col("step"), F.lit(m)) + 1
    fc = steps.select(*keys, F.lit("holt_winters").alias("model"), "step",
                      F.add_months("_last", F.col("step")).alias(DS),
                      (F.col("_st")["l"] + F.col("step") * F.col("_st")["b"]
                       + F.element_at(F.col("_st")["s"], season_idx)).alias("yhat"))
    return _null_bands(fc), met_ok.unionByName(met_err)


# --- Seasonal ARIMA by Hannan-Rissanen (per series, NumPy in applyInPandas) --------

def _lagmat(x: np.ndarray, lags: Sequence[int]) -> tuple[np.ndarray, int]:
    k = max(lags)
    rows = len(x) - k
    return np.column_stack([x[k - lg:k - lg + rows] for lg in lags]), k


def _ols(X: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    A = X.T @ X + ridge * np.eye(X.shape[1])
    return np.linalg.solve(A, X.T @ y)


def fit_sarima(y: np.ndarray, horizon: int, period: int = 12, ar=(1, 2), ma=(1, 2), sar=(1,), sma=(1,),
               levels=(0.80, 0.95)) -> dict:
    """SARIMA(p,1,q)(P,1,Q,s) on one series by Hannan-Rissanen least squares.

    w = (1-B)(1-B^s) y; a long AR on w gives residual estimates; w is then
    regressed on its lags and the residual lags.  At these coefficients the
    Kalman filter gives the exact likelihood (AIC, BIC), the one-step fitted
    values and the joint distribution of the next w, which undoing both
    differences turns into forecasts and intervals of y.
    """
    y = np.asarray(y, dtype=float)
    n = len(y)
    s = period
    w = y[s + 1:] - y[s:-1] - y[1:-s] + y[:-s - 1]
    ar_l = sorted(set(ar) | {s * k for k in sar})
    ma_l = sorted(set(ma) | {s * k for k in sma})
    if len(w) < 2 * max(ar_l + ma_l) + 6:
        raise ValueError(f"series too short for seasonal differencing and lags ({n} points)")
    if np.allclose(w, w[0]):
        # no variation after differencing: the differenced series is constant
        ar_l, ma_l = [], []
    p_long = int(min(max(ar_l + ma_l + [1]) + 2, len(w) // 3))
    Xl, k = _lagmat(w, list(range(1, p_long + 1)))
    phi_long = _ols(np.column_stack([np.ones(len(Xl)), Xl]), w[k:]) if len(Xl) else np.zeros(p_long + 1)
    e = np.zeros_like(w)
    e[k:] = w[k:] - np.column_stack([np.ones(len(Xl)), Xl]) @ phi_long
    lags = [("w", lg) for lg in ar_l] + [("e", lg) for lg in ma_l]
    start = k + (max([lg for _, lg in lags]) if lags else 0)
    rows = np.arange(start, len(w))
    if lags:
        X = np.column_stack([np.ones(len(rows))] + [(w if src == "w" else e)[rows - lg] for src, lg in lags])
    else:
        X = np.ones((len(rows), 1))
    beta = _ols(X, w[rows])
    phi = {lg: float(c) for c, (src, lg) in zip(beta[1:], lags, strict=True) if src == "w"}
    theta = {lg: float(c) for c, (src, lg) in zip(beta[1:], lags, strict=True) if src == "e"}
    kf = kalman(w, float(beta[0]), phi, theta)
    sigma2, n_eff, kpar = kf.sigma2, len(w) - kf.skip, len(beta) + 1
    known = n_eff > 0 and sigma2 > 1e-12 * max(1.0, float(np.mean(y * y)))  # an exact fit has no likelihood
    ll = kf.log_likelihood() if known else None
    aic = 2 * kpar - 2 * ll if known else None
    bic = kpar * float(np.log(n_eff)) - 2 * ll if known else None
    # in-sample one-step values of y: what the filter expected of w, differences undone
    fitted = np.full(n, np.nan)
    at = np.arange(kf.skip, len(w))
    fitted[at + s + 1] = (w - kf.v)[at] + y[at + s] + y[at + 1] - y[at]
    ahead, cov = kf.ahead(horizon)
    yv = np.concatenate([y, np.zeros(horizon)])
    integrate = np.zeros((horizon, horizon))  # what a unit of w in one period adds to y in the later ones
    for h in range(horizon):
        yv[n + h] = ahead[h] + yv[n + h - 1] + yv[n + h - s] - yv[n + h - s - 1]
        integrate[h, h] = 1.0
        for lag, sign in ((1, 1.0), (s, 1.0), (s + 1, -1.0)):
            if h >= lag:
                integrate[h] += sign * integrate[h - lag]
    yhat = yv[n:]
    se = np.sqrt(np.maximum(sigma2 * np.diag(integrate @ cov @ integrate.T), 0.0))
    bands = {lv: (yhat - Z[lv] * se, yhat + Z[lv] * se) for lv in levels}
    return {"yhat": yhat, "bands": bands, "fitted": fitted, "aic": aic, "bic": bic}


def sarima(series: DataFrame, target: str, keys: Sequence[str] = (), horizon: int = 6,
           params: Params = DEFAULT_PARAMS, materialize_fit: bool = False) -> tuple[DataFrame, DataFrame]:
    """seasonal ARIMA per series with ``groupBy(keys).applyInPandas``."""
    keys = list(keys)
    p, _, q = params.sarima_order
    P, _, Q, s = params.seasonal_order
    key_fields = [series.schema[k] for k in keys]
    out_schema = T.StructType(key_fields + [
        T.StructField("kind", T.StringType()), T.StructField("step", T.IntegerType()),
        T.StructField(DS, T.DateType()), T.StructField("yhat", T.DoubleType()),
        T.StructField("lower_80", T.DoubleType()), T.StructField("upper_80", T.DoubleType()),
        T.StructField("lower_95", T.DoubleType()), T.StructField("upper_95", T.DoubleType()),
        T.StructField("n_points", T.LongType()), T.StructField("mae", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()), T.StructField("mape", T.DoubleType()),
        T.StructField("aic", T.DoubleType()), T.StructField("bic", T.DoubleType()),
        T.StructField("status", T.StringType())])
    names = [f.name for f in out_schema.fields]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DS)
        kv = {k: pdf[k].iloc[0] for k in keys}
        yv = pdf[target].to_numpy(dtype=float)
        n = len(yv)
        base = {**kv, "n_points": n}
        try:
            r = fit_sarima(yv, horizon, s, tuple(range(1, p + 1)), tuple(range(1, q + 1)),
                           tuple(range(1, P + 1)), tuple(range(1, Q + 1)), params.confidence_levels)
        except (ValueError, np.linalg.LinAlgError) as exc:
            out = pd.DataFrame([{**base, "kind": "metrics", "status": f"error: {exc}"}], columns=names)
            out[DS] = pd.Series([None], dtype="object")  # all-missing dates must stay objects for Arrow
            return out
        f = r["fitted"]
        mask = ~np.isnan(f)
        err = yv[mask] - f[mask]
        nz = yv[mask] != 0
        last = pd.Timestamp(pdf[DS].iloc[-1])
        rows = [{**base, "kind": "metrics", "mae": round(float(np.mean(np.abs(err))), 2) if len(err) else None,
                 "rmse": round(float(np.sqrt(np.mean(err ** 2))), 2) if len(err) else None,
                 "mape": round(float(np.mean(np.abs(err[nz] / yv[mask][nz])) * 100), 2) if nz.any() else None,
                 "aic": None if r["aic"] is None else round(r["aic"], 2),
                 "bic": None if r["bic"] is None else round(r["bic"], 2), "status": "ok"}]
        lo80, hi80 = r["bands"].get(0.80, (np.full(horizon, np.nan),) * 2)
        lo95, hi95 = r["bands"].get(0.95, (np.full(horizon, np.nan),) * 2)
        for h in range(horizon):
            rows.append({**base, "kind": "forecast", "step": h + 1,
                         DS: (last + pd.DateOffset(months=h + 1)).date(), "yhat": float(r["yhat"][h]),
                         "lower_80": float(lo80[h]), "upper_80": float(hi80[h]),
                         "lower_95": float(lo95[h]), "upper_95": float(hi95[h])})
        return pd.DataFrame(rows, columns=names)

    src = series.select(*keys, DS, F.col(target).cast("double").alias(target))
    if keys:  # one fit per group: hash-spread the series over all cores first
        src = src.repartition(series.sparkSession.sparkContext.defaultParallelism, *keys)
    grouped = src.groupBy(*keys) if keys else None
    if not keys:
        src = src.withColumn("_one", F.lit(0))
        grouped = src.groupBy("_one")
        res = grouped.applyInPandas(lambda pdf: fit(pdf.drop(columns=["_one"])), out_schema)
    else:
        res = grouped.applyInPandas(fit, out_schema)
    if materialize_fit:  # forecasts and metrics come from the same fits: run them once
        from regiolens.session import materialize

        res = materialize(res)
    fc = res.where(F.col("kind") == "forecast").select(*keys, F.lit("sarima").alias("model"), "step", DS, "yhat",
                                                      "lower_80", "upper_80", "lower_95", "upper_95")
    met = res.where(F.col("kind") == "metrics").select(*keys, F.lit("sarima").alias("model"), "n_points", "mae",
                                                      "rmse", "mape", "aic", "bic", "status")
    return fc, met


# --- Gradient-boosted trees: one fit per series, all rounds inside its task ----------

def _gbt_rows(pdf: pd.DataFrame, target: str, horizon: int, params: Params, rounds: int, min_rows: int,
              recursive: bool) -> list[dict]:
    """Metrics, forecasts and importances of one series from its feature rows."""
    pdf = pdf.sort_values(DS)
    n, names = len(pdf), feature_names(target)
    if n < min_rows:
        return []
    x, y = pdf[names].to_numpy(dtype=float), pdf[target].to_numpy(dtype=float)
    cut = n - (min(horizon, 3) if n - horizon < 12 else horizon)
    model = fit_boosted(x[:cut], y[:cut], rounds, params.gbt_depth, params.gbt_rate)
    err = y[cut:] - model.predict(x[cut:])
    nz = y[cut:] != 0
    rows = [{"kind": "metrics", "n_points": n, "mae": round(float(np.abs(err).mean()), 2),
             "rmse": round(float(np.sqrt((err * err).mean())), 2),
             "mape": round(float(np.abs(err[nz] / y[cut:][nz]).mean()) * 100, 2) if nz.any() else None, "status": "ok"}]
    last, past, yhat = pd.Timestamp(pdf[DS].iloc[-1]), list(y), float(model.predict(x[-1:])[0])
    for step in range(1, horizon + 1):
        ds = last + pd.DateOffset(months=step)
        if recursive:  # each prediction enters the next step's lags and windows
            yhat = float(model.predict(np.array([_next_features(past, ds)]))[0])
            past.append(yhat)
        rows.append({"kind": "forecast", "step": step, DS: ds.date(), "yhat": yhat})
    return rows + [{"kind": "importance", "feature": f, "importance": float(v)} for f, v in zip(names, model.importance(), strict=True)]


def _next_features(past: Sequence[float], ds: pd.Timestamp) -> list[float]:
    """Feature values of the period after ``past`` (windows end at its last value)."""
    rolls = [v for k in ROLLS for v in (float(np.mean(past[-k:])), float(np.std(past[-k:], ddof=1)))]
    return [ds.month, ds.quarter, ds.year, ds.dayofyear, *(past[-k] for k in LAGS), *rolls]


def gbt_forecast(series: DataFrame, target: str, keys: Sequence[str] = (), horizon: int = 6,
                 params: Params = DEFAULT_PARAMS, max_iter: int | None = None, min_rows: int = 24,
                 shifted: bool = False, recursive: bool = False,
                 materialize_fit: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """boosted trees, one model per series fitted in its own task.

    Features: calendar, lags, rolling stats (F6-F9).  The last ``horizon``
    feature rows of each series are the test set (``min(horizon, 3)`` when fewer
    than 12 would remain for training); series with fewer than ``min_rows``
    feature rows get an error row.  By default the future value repeats the
    prediction of the last feature row and rolling windows include the current
    value (ruling R10).  ``shifted=True`` ends the rolling windows at the
    previous value; ``recursive=True`` (implies ``shifted``) predicts step by
    step, feeding each prediction back into the lags of the next step.  Returns
    forecasts, metrics and feature importances (mean gain of a feature's splits,
    as a share).  A group is one series, bounded by the calendar.
    """
    keys = list(keys)
    shifted = shifted or recursive
    rounds = params.gbt_trees if max_iter is None else max_iter
    feats = ml_features(series, target, keys, shifted=shifted)
    fields = {"kind": T.StringType(), "step": T.IntegerType(), DS: T.DateType(), "yhat": T.DoubleType(), "n_points": T.LongType(),
              "mae": T.DoubleType(), "rmse": T.DoubleType(), "mape": T.DoubleType(), "status": T.StringType(),
              "feature": T.StringType(), "importance": T.DoubleType()}
    out_schema = T.StructType([series.schema[k] for k in keys] + [T.StructField(n, t) for n, t in fields.items()])
    by = keys or ["_one"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _gbt_rows(pdf, target, horizon, params, rounds, min_rows, recursive)
        out = pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **r} for r in rows], columns=out_schema.names)
        return out.astype({DS: "object"}).where(out.notna(), None)

    src = feats if keys else feats.withColumn("_one", F.lit(0))
    if keys:  # one fit per group: hash-spread the series over all cores first
        src = src.repartition(series.sparkSession.sparkContext.defaultParallelism, *keys)
    res = src.groupBy(*by).applyInPandas(fit, out_schema)
    if materialize_fit:  # forecasts, metrics and importances come from the same fits: run them once
        from regiolens.session import materialize

        res = materialize(res)
    none = lambda *cols: [F.lit(None).cast("double").alias(c) for c in cols]
    met_ok = res.where(F.col("kind") == "metrics").select(
        *keys, F.lit("gbt").alias("model"), "n_points", "mae", "rmse", "mape", *none("aic", "bic"), "status")
    counts = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        bad = counts.join(feats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, "left")
    else:
        bad = counts.withColumn("_rows", feats.select(F.count(F.lit(1))).scalar())
    met_err = bad.where(F.coalesce(F.col("_rows"), F.lit(0)) < min_rows).select(
        *keys, F.lit("gbt").alias("model"), F.col("_n").cast("long").alias("n_points"),
        *none("mae", "rmse", "mape", "aic", "bic"),
        F.lit("error: Insufficient data for ML forecasting").alias("status"))
    fc = res.where(F.col("kind") == "forecast").select(*keys, F.lit("gbt").alias("model"), "step", DS, "yhat")
    imp = res.where(F.col("kind") == "importance").select(*keys, "feature", "importance")
    return _null_bands(fc), met_ok.unionByName(met_err), imp
