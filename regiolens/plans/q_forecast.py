"""Registered queries: forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolens.operators import forecast as FO
from regiolens.operators import models as MO
from regiolens.operators import series as SE
from regiolens.params import DEFAULT_PARAMS as PR
from regiolens.params import SURGE_CONTEXT, SURGE_CONTEXT_DEFAULT
from regiolens.plans.fact_store import stored, stored_many
from regiolens.plans.oracle_sql import FACT, M, div, r6, rnd
from regiolens.plans.q_describe import fact
from regiolens.plans.registry import register
from regiolens.schema import DEFAULT_SCHEMA as S

T = S.total
GEO = list(S.geo)
H = PR.horizon_long


def national_series(spark, sf_dir, freq="M"):
    return SE.prepare_series(fact(spark, sf_dir), freq, [], M)


def district_series(spark, sf_dir):
    return SE.prepare_series(fact(spark, sf_dir), "M", GEO, [T])


# --- oracle pieces -----------------------------------------------------------------

def _series_ctes(keys: list[str], cols: list[str], freq: str = "M", name: str = "ser") -> str:
    kk = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    period = "year_month" if freq == "M" else "date"
    step = "INTERVAL 1 MONTH" if freq == "M" else "INTERVAL 1 DAY"
    notnull = " AND ".join([f"{k} IS NOT NULL" for k in keys] + [f"{period} IS NOT NULL"])
    sums = ", ".join(f"CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS {c}" for c in cols)
    using = ", ".join([*keys, "ds"])
    wb = f"OVER ({part}ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wa = f"OVER ({part}ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    lasts = ", ".join(f"last_value(CASE WHEN present THEN {c} END IGNORE NULLS) {wb} AS {c}__0, "
                      f"first_value(CASE WHEN present THEN {c} END IGNORE NULLS) {wa} AS {c}__1" for c in cols)
    frac = div("datediff('day', d0, ds)", "datediff('day', d0, d1)")
    vals = ", ".join(f"CASE WHEN present THEN CAST({c} AS DOUBLE) ELSE CAST({c}__0 AS DOUBLE) + "
                     f"CAST({c}__1 - {c}__0 AS DOUBLE) * {frac} END AS {c}" for c in cols)
    return f"""{name}_s AS (SELECT {kk}{period} AS ds, {sums} FROM fact WHERE {notnull} GROUP BY {kk}{period}),
{name}_b AS (SELECT {kk}MIN(ds) AS lo, MAX(ds) AS hi FROM {name}_s {'GROUP BY ' + ', '.join(keys) if keys else ''}),
{name}_sp AS (SELECT {kk}CAST(unnest(generate_series(lo, hi, {step})) AS DATE) AS ds FROM {name}_b),
{name}_d AS (SELECT sp.*, {', '.join('s.' + c for c in cols)}, s.ds IS NOT NULL AS present
             FROM {name}_sp sp LEFT JOIN {name}_s s USING ({using})),
{name}_i AS (SELECT *, last_value(CASE WHEN present THEN ds END IGNORE NULLS) {wb} AS d0,
                    first_value(CASE WHEN present THEN ds END IGNORE NULLS) {wa} AS d1, {lasts} FROM {name}_d),
{name} AS (SELECT {kk}ds, {vals}, present AS observed FROM {name}_i)"""


def _series_out(keys, cols) -> str:
    return ", ".join([*keys, "ds"] + [f"{r6(c)} AS {c}" for c in cols] + ["observed"])


@register("monthly_series", f"{FACT},\n{_series_ctes([], M)} SELECT {_series_out([], M)} FROM ser")
def q_monthly_series(spark, sf_dir):
    """National monthly series on a regular calendar."""
    return national_series(spark, sf_dir)


@register("district_monthly_series", f"{FACT},\n{_series_ctes(GEO, [T])} SELECT {_series_out(GEO, [T])} FROM ser")
def q_district_series(spark, sf_dir):
    """One monthly series per district, gaps interpolated in time."""
    return district_series(spark, sf_dir)


@register("daily_series", f"{FACT},\n{_series_ctes([], M, 'D')} SELECT {_series_out([], M)} FROM ser")
def q_daily_series(spark, sf_dir):
    return national_series(spark, sf_dir, "D")


def _features_sql() -> str:
    y = f"CAST({T} AS DOUBLE)"
    cols = ["month(ds) AS month", "quarter(ds) AS quarter", "year(ds) AS year", "dayofyear(ds) AS day_of_year"]
    cols += [f"LAG({y}, {k}) OVER w AS {T}_lag_{k}" for k in SE.LAGS]
    for n in SE.ROLLS:
        fr = f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols += [f"CASE WHEN COUNT({y}) OVER {fr} = {n} THEN AVG({y}) OVER {fr} END AS {T}_ma_{n}",
                 f"CASE WHEN COUNT({y}) OVER {fr} = {n} THEN stddev_samp({y}) OVER {fr} END AS {T}_std_{n}"]
    names = SE.feature_names(T)
    out = ", ".join(["ds", f"{r6(T)} AS {T}"] + [f"{r6(c)} AS {c}" if c.startswith(T) else c for c in names])
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in names)
    return f"""{FACT},\n{_series_ctes([], [T])},
fe AS (SELECT ds, {y} AS {T}, {', '.join(cols)} FROM ser WINDOW w AS (ORDER BY ds))
SELECT {out} FROM fe WHERE {notnull}"""


@register("ml_features", _features_sql())
def q_ml_features(spark, sf_dir):
    """Calendar, lag and rolling features of the national total."""
    return SE.ml_features(national_series(spark, sf_dir), T)


# --- simple models, ensemble, surges (SQL-checkable path) -----------------------------

_KK = ", ".join(GEO)


def _simple_ctes(keys: list[str]) -> str:
    kk = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    ak = "".join(f"l.{k}, " for k in keys)
    on = " AND ".join([f"s.{k} = g.{k}" for k in keys] + ["s.ds = g.src"])
    on2 = " AND ".join([f"m.{k} = g.{k}" for k in keys] + ["m.ds = g.last_ds"])
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    y = f"CAST({T} AS DOUBLE)"
    fr12 = f"({part}ORDER BY ds ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
    frp = f"({part}ORDER BY ds ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"

    def metrics(model: str, pairs: str, minp: int) -> str:
        e = "(y - f)"
        jk = " AND ".join([f"n.{k} = p.{k}" for k in keys]) or "TRUE"
        nk = "".join(f"n.{k}, " for k in keys)
        return f"""SELECT {nk}'{model}' AS model, n.n_points,
  CASE WHEN n.n_points >= {minp} THEN {rnd(f'AVG(ABS({e}))', 2)} END AS mae,
  CASE WHEN n.n_points >= {minp} THEN {rnd(f'SQRT(AVG({e} * {e}))', 2)} END AS rmse,
  CASE WHEN n.n_points >= {minp} THEN {rnd(f'AVG(ABS({div(e, "y")})) * 100', 2)} END AS mape,
  CAST(NULL AS DOUBLE) AS aic, CAST(NULL AS DOUBLE) AS bic,
  CASE WHEN n.n_points >= {minp} THEN 'ok' ELSE 'error: fewer than {minp} periods' END AS status
FROM cnt n LEFT JOIN (SELECT * FROM {pairs} WHERE f IS NOT NULL AND y IS NOT NULL) p ON {jk}
GROUP BY {nk}n.n_points"""

    return f"""cnt AS (SELECT {kk}COUNT(*) AS n_points, MAX(ds) AS last_ds FROM ser {grp}),
grid AS (SELECT {ak}l.last_ds, h.step, CAST(l.last_ds + to_months(CAST(h.step AS INT)) AS DATE) AS ds,
                CAST(l.last_ds + to_months(CAST(h.step - 12 * CEIL(h.step / 12.0) AS INT)) AS DATE) AS src
         FROM cnt l CROSS JOIN range(1, {H + 1}) AS h(step)),
snf AS (SELECT {''.join(f'g.{k}, ' for k in keys)}'seasonal_naive' AS model, CAST(g.step AS BIGINT) AS step, g.ds,
               CAST(s.{T} AS DOUBLE) AS yhat FROM grid g LEFT JOIN ser s ON {on}),
lm AS (SELECT {kk}ds, CASE WHEN COUNT(*) OVER {fr12} = 12 THEN AVG({y}) OVER {fr12} END AS m12 FROM ser),
tmf AS (SELECT {''.join(f'g.{k}, ' for k in keys)}'trailing_mean' AS model, CAST(g.step AS BIGINT) AS step, g.ds,
               m.m12 AS yhat FROM grid g LEFT JOIN lm m ON {on2}),
snp AS (SELECT {kk}{y} AS y, LAG({y}, 12) OVER ({part}ORDER BY ds) AS f FROM ser),
tmp AS (SELECT {kk}{y} AS y, CASE WHEN COUNT(*) OVER {frp} = 12 THEN AVG({y}) OVER {frp} END AS f FROM ser),
snm AS ({metrics('seasonal_naive', 'snp', 13)}),
tmm AS ({metrics('trailing_mean', 'tmp', 13)}),
allf AS (SELECT * FROM snf UNION ALL SELECT * FROM tmf),
allm AS (SELECT * FROM snm UNION ALL SELECT * FROM tmm),
valid AS (SELECT {kk}model FROM allm WHERE status = 'ok'),
vf AS (SELECT f.* FROM allf f SEMI JOIN valid v USING ({', '.join([*keys, 'model'])})),
hz AS (SELECT {kk}MIN(h) AS hmin FROM (SELECT {kk}model, MAX(step) AS h FROM vf GROUP BY {kk}model) {grp}),
ef AS (SELECT {''.join(f'f.{k}, ' for k in keys)}'ensemble' AS model, f.step, f.ds, AVG(f.yhat) AS yhat
       FROM vf f {'JOIN hz USING (' + ', '.join(keys) + ')' if keys else ', hz'} WHERE f.step <= hz.hmin
       GROUP BY {''.join(f'f.{k}, ' for k in keys)}f.step, f.ds),
vm AS (SELECT m.* FROM allm m SEMI JOIN valid v USING ({', '.join([*keys, 'model'])})),
em AS (SELECT {kk}'ensemble' AS model, {rnd('AVG(mae)', 2)} AS mae, {rnd('AVG(rmse)', 2)} AS rmse,
              {rnd('AVG(mape)', 2)} AS mape, string_agg(model, ',' ORDER BY model) AS component_models,
              'ok' AS status FROM vm {grp}),
hs AS (SELECT {kk}quantile_cont({y}, {PR.surge_percentile / 100.0}) AS threshold, AVG({y}) AS hist_mean,
              stddev_samp({y}) AS hist_std FROM ser {grp}),
sg AS (SELECT {''.join(f'e.{k}, ' for k in keys)}e.step AS period, e.ds, {rnd('e.yhat', 2)} AS forecasted_value,
              {rnd('h.threshold', 2)} AS threshold, {rnd(div('e.yhat - h.hist_mean', 'h.hist_std'), 2)} AS z_score,
              {rnd(div('e.yhat - h.threshold', 'h.threshold') + ' * 100', 2)} AS pct_above_threshold,
              CASE {' '.join(f"WHEN month(e.ds) = {mo} THEN '{t}'" for mo, t in SURGE_CONTEXT.items())}
                   ELSE '{SURGE_CONTEXT_DEFAULT}' END AS context
       FROM ef e {'JOIN hs h USING (' + ', '.join(keys) + ')' if keys else ', hs h'} WHERE e.yhat > h.threshold),
ss AS (SELECT {''.join(f'h.{k}, ' for k in keys)}COALESCE(c.n, 0) > 0 AS surge_detected,
              CAST(COALESCE(c.n, 0) AS BIGINT) AS num_surge_periods, {rnd('h.threshold', 2)} AS surge_threshold
       FROM hs h LEFT JOIN (SELECT {kk}COUNT(*) AS n FROM sg {grp}) c {'USING (' + ', '.join(keys) + ')' if keys else 'ON TRUE'}),
hy AS (SELECT {kk}{rnd(f'AVG({y})', 2)} AS mean, {rnd(f'quantile_cont({y}, 0.5)', 2)} AS median,
              {rnd(f'stddev_samp({y})', 2)} AS std, {rnd(f'MIN({y})', 2)} AS min, {rnd(f'MAX({y})', 2)} AS max,
              CASE WHEN arg_max({y}, ds) > arg_min({y}, ds) THEN 'increasing' ELSE 'decreasing' END AS trend
       FROM ser {grp})"""


_DIST_SIMPLE = f"{FACT},\n{_series_ctes(GEO, [T])},\n{_simple_ctes(GEO)}"
_NAT_SIMPLE = f"{FACT},\n{_series_ctes([], [T])},\n{_simple_ctes([])}"
_BANDS = ", CAST(NULL AS DOUBLE) AS lower_80, CAST(NULL AS DOUBLE) AS upper_80, " \
         "CAST(NULL AS DOUBLE) AS lower_95, CAST(NULL AS DOUBLE) AS upper_95"


def simple_models(spark, sf_dir, keys=GEO):
    s = district_series(spark, sf_dir) if keys else SE.prepare_series(fact(spark, sf_dir), "M", [], [T])
    f1, m1 = MO.seasonal_naive(s, T, keys, H)
    f2, m2 = MO.trailing_mean(s, T, keys, H)
    return s, [f1, f2], [m1, m2]


@register("forecast_seasonal_naive", f"{_DIST_SIMPLE} SELECT {_KK}, model, step, ds, {r6('yhat')} AS yhat{_BANDS} FROM snf")
def q_seasonal_naive(spark, sf_dir):
    _, fcs, _ = simple_models(spark, sf_dir)
    return fcs[0]


@register("forecast_trailing_mean", f"{_DIST_SIMPLE} SELECT {_KK}, model, step, ds, {r6('yhat')} AS yhat{_BANDS} FROM tmf")
def q_trailing_mean(spark, sf_dir):
    _, fcs, _ = simple_models(spark, sf_dir)
    return fcs[1]


@register("forecast_metrics", f"{_DIST_SIMPLE} SELECT * FROM allm")
def q_forecast_metrics(spark, sf_dir):
    """MAE / RMSE / MAPE of the simple models per district."""
    _, _, mets = simple_models(spark, sf_dir)
    return mets[0].unionByName(mets[1])


def simple_ensemble(spark, sf_dir, keys=GEO):
    s, fcs, mets = simple_models(spark, sf_dir, keys)
    ef, em = FO.ensemble(fcs, mets, keys)
    return s, ef, em


@register("ensemble_forecast", f"{_DIST_SIMPLE} SELECT {_KK}, model, step, ds, {r6('yhat')} AS yhat FROM ef")
def q_ensemble(spark, sf_dir):
    """F13 per district over the seasonal-naive and trailing-mean models."""
    return simple_ensemble(spark, sf_dir)[1]


@register("ensemble_metrics", f"{_DIST_SIMPLE} SELECT * FROM em")
def q_ensemble_metrics(spark, sf_dir):
    return simple_ensemble(spark, sf_dir)[2]


@register("surge_periods", f"{_DIST_SIMPLE} SELECT * FROM sg")
def q_surges(spark, sf_dir):
    """F14/F15 per district on the simple ensemble."""
    s, ef, _ = simple_ensemble(spark, sf_dir)
    return FO.surges(ef, s, T, GEO)


@register("surge_summary", f"{_DIST_SIMPLE} SELECT * FROM ss")
def q_surge_summary(spark, sf_dir):
    s, ef, _ = simple_ensemble(spark, sf_dir)
    return FO.surge_summary(ef, s, T, GEO)


@register("history_summary", f"{_DIST_SIMPLE} SELECT * FROM hy")
def q_history(spark, sf_dir):
    """F16 per district."""
    return FO.history_summary(district_series(spark, sf_dir), T, GEO)


@register("forecast_recommendations", f"""{_NAT_SIMPLE},
r AS (
  SELECT 1 AS rank, printf('ALERT: Enrollment surge predicted in %d period(s). Prepare additional capacity and resources.', num_surge_periods) AS recommendation FROM ss WHERE surge_detected
  UNION ALL SELECT 2, 'Forecast accuracy moderate (MAPE=' || CAST(mape AS VARCHAR) || '%). Consider improving data quality and feature engineering.' FROM em WHERE mape > 15
  UNION ALL SELECT 3, 'Forecast accuracy high (MAPE=' || CAST(mape AS VARCHAR) || '%). Confidence in predictions is strong.' FROM em WHERE mape < 5
  UNION ALL SELECT 4, 'Enrollment shows increasing trend. Plan for sustained capacity expansion.' FROM hy WHERE trend = 'increasing')
SELECT * FROM r UNION ALL SELECT 5, 'Forecast suggests stable enrollment patterns. Maintain current capacity planning.' WHERE NOT EXISTS (SELECT 1 FROM r)""")
def q_forecast_recs(spark, sf_dir):
    """F18 for the national series (simple ensemble)."""
    s, ef, em = simple_ensemble(spark, sf_dir, [])
    return FO.forecast_recommendations(FO.surge_summary(ef, s, T), em, FO.history_summary(s, T))


@register("chart_forecast_band", f"""{_NAT_SIMPLE}
SELECT model, step, ds, {r6('yhat')} AS yhat, {r6('yhat * 0.9')} AS band_lower, {r6('yhat * 1.1')} AS band_upper FROM ef""")
def q_forecast_band(spark, sf_dir):
    """T4: national ensemble with a +-10% band (no model interval)."""
    _, ef, _ = simple_ensemble(spark, sf_dir, [])
    return FO.forecast_band(ef)


@register("chart_forecast_band_with_interval", f"""{_NAT_SIMPLE}
SELECT model, step, ds, {r6('yhat')} AS yhat, {r6("CASE WHEN step % 2 = 0 THEN yhat - step * 10.0 ELSE yhat * 0.9 END")} AS band_lower,
       {r6("CASE WHEN step % 2 = 0 THEN yhat + step * 10.0 ELSE yhat * 1.1 END")} AS band_upper FROM ef""")
def q_forecast_band_interval(spark, sf_dir):
    """T4: a model's own 95% interval where it has one (here every other step), else +-10%."""
    _, ef, _ = simple_ensemble(spark, sf_dir, [])
    own = F.when(F.col("step") % 2 == 0, F.col("step") * 10.0)
    bands = ef.withColumns({"lower_95": F.col("yhat") - own, "upper_95": F.col("yhat") + own})
    return FO.forecast_band(bands).drop("lower_95", "upper_95")


# --- model families (rows-only checks; pytest covers them on known series) -----------

def district_models(spark, sf_dir, family: str):
    """Per-district forecasts and metrics of one model family, fitted once per session."""
    fit = {"hw": MO.holt_winters, "sarima": MO.sarima}[family]
    return stored_many(spark, f"district_{family}", (sf_dir,),
                       lambda: fit(district_series(spark, sf_dir), T, GEO, H, materialize_fit=True))


@register("forecast_holt_winters")
def q_hw(spark, sf_dir):
    """F5 per district: additive Holt-Winters, parameters by grid search."""
    return district_models(spark, sf_dir, "hw")[0]


@register("holt_winters_metrics")
def q_hw_metrics(spark, sf_dir):
    return district_models(spark, sf_dir, "hw")[1]


@register("forecast_sarima")
def q_sarima(spark, sf_dir):
    """F4 per district: seasonal ARIMA (2,1,2)(1,1,1,12), intervals at 80/95%."""
    return district_models(spark, sf_dir, "sarima")[0]


@register("sarima_metrics")
def q_sarima_metrics(spark, sf_dir):
    return district_models(spark, sf_dir, "sarima")[1]


def national_models(spark, sf_dir):
    """National series and the three model families, each fitted once per session."""
    s = stored(spark, "national_series", (sf_dir,), lambda: SE.prepare_series(fact(spark, sf_dir), "M", [], [T]))
    hw = stored_many(spark, "national_hw", (sf_dir,), lambda: MO.holt_winters(s, T, [], H, materialize_fit=True))
    sa = stored_many(spark, "national_sarima", (sf_dir,), lambda: MO.sarima(s, T, [], H, materialize_fit=True))
    gb = stored_many(spark, "national_gbt", (sf_dir,), lambda: MO.gbt_forecast(s, T, [], H))
    return s, hw, sa, gb


@register("forecast_gbt")
def q_gbt(spark, sf_dir):
    """F10/F11 on the national series: boosted trees, flat future."""
    return national_models(spark, sf_dir)[3][0]


@register("gbt_feature_importance")
def q_gbt_importance(spark, sf_dir):
    return national_models(spark, sf_dir)[3][2]


@register("ensemble_all_models")
def q_ensemble_all(spark, sf_dir):
    """F13 over Holt-Winters, SARIMA and boosted trees (national series)."""
    s, hw, sa, gb = national_models(spark, sf_dir)
    ef, _ = FO.ensemble([hw[0], sa[0], gb[0]], [hw[1], sa[1], gb[1]])
    return ef


def _report_row(s, ef, em):
    one = em.select(F.lit(H).cast("long").alias("forecast_horizon"), "mae", "rmse", "mape", "component_models", "status")
    for part in (FO.surge_summary(ef, s, T), FO.history_summary(s, T)):
        row = part.select(F.struct(*part.columns).alias("r")).scalar()
        one = one.withColumns({c: row[c] for c in part.columns})
    return one


@register("forecast_report")
def q_forecast_report(spark, sf_dir):
    """national report row: horizon, history, ensemble metrics, surges."""
    s, hw, sa, gb = national_models(spark, sf_dir)
    return _report_row(s, *FO.ensemble([hw[0], sa[0], gb[0]], [hw[1], sa[1], gb[1]]))


@register("forecast_report_simple", f"""{_NAT_SIMPLE}
SELECT CAST({H} AS BIGINT) AS forecast_horizon, em.mae, em.rmse, em.mape, em.component_models, em.status, ss.*, hy.* FROM em, ss, hy""")
def q_forecast_report_simple(spark, sf_dir):
    """F17 on the simple models, which SQL can express."""
    return _report_row(*simple_ensemble(spark, sf_dir, []))


@register("forecast_gbt_by_district")
def q_gbt_district(spark, sf_dir):
    """F10 pooled: one boosted-tree model over the series of all districts."""
    return stored_many(spark, "district_gbt", (sf_dir,), lambda: MO.gbt_forecast(district_series(spark, sf_dir), T, GEO, H))[0]


# --- Holt-Winters with fixed parameters: checked by a recursive CTE -----------------

HW_FIXED = (0.3, 0.1, 0.2)


def _hw_fixed_sql() -> str:
    a, b, g = (f"CAST({x!r} AS DOUBLE)" for x in HW_FIXED)
    m = PR.seasonal_period
    v = "y[t + 1]"
    s_old = f"s[t % {m} + 1]"
    l_new = f"({a} * ({v} - {s_old}) + (1 - {a}) * (l + b))"
    b_new = f"({b} * ({l_new} - l) + (1 - {b}) * b)"
    s_new = f"({g} * ({v} - {l_new}) + (1 - {g}) * {s_old})"
    s_list = f"list_transform(range(1, {m + 1}), lambda i: CASE WHEN i = t % {m} + 1 THEN {s_new} ELSE s[i] END)"
    total = "list_reduce({}, lambda acc, x: acc + x)"
    first, second = f"y[1:{m}]", f"y[{m + 1}:{2 * m}]"
    return f"""WITH RECURSIVE {FACT[len('WITH '):]},
{_series_ctes(GEO, [T])},
arr AS (SELECT state, district, list({T} ORDER BY ds) AS y, MAX(ds) AS last_ds, COUNT(*) AS n FROM ser
        GROUP BY state, district HAVING COUNT(*) >= {2 * m}),
init AS (SELECT *, {total.format(first)} / {m} AS l0,
                ({total.format(second)} - {total.format(first)}) / {float(m * m)} AS b0 FROM arr),
hw(state, district, y, n, last_ds, t, l, b, s) AS (
  SELECT state, district, y, n, last_ds, 0, l0, b0, list_transform({first}, lambda x: x - l0) FROM init
  UNION ALL
  SELECT state, district, y, n, last_ds, t + 1, {l_new}, {b_new}, {s_list} FROM hw WHERE t < n)
SELECT h.state, h.district, 'holt_winters' AS model, CAST(st.step AS BIGINT) AS step,
       CAST(h.last_ds + to_months(CAST(st.step AS INT)) AS DATE) AS ds,
       {r6(f"h.l + st.step * h.b + h.s[(h.n - 1 + st.step) % {m} + 1]")} AS yhat,
       CAST(NULL AS DOUBLE) AS lower_80, CAST(NULL AS DOUBLE) AS upper_80,
       CAST(NULL AS DOUBLE) AS lower_95, CAST(NULL AS DOUBLE) AS upper_95
FROM hw h CROSS JOIN range(1, {H + 1}) AS st(step) WHERE h.t = h.n"""


@register("forecast_holt_winters_fixed", _hw_fixed_sql())
def q_hw_fixed(spark, sf_dir):
    """F5 per district with fixed (alpha, beta, gamma): the fold checked against a recursive CTE."""
    fc, _ = MO.holt_winters(district_series(spark, sf_dir), T, GEO, H, fixed=HW_FIXED)
    return fc
