"""Forecasting (F1-F18): known series, error rows, ensemble and surge facts."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiolens.operators import forecast as FO
from regiolens.operators import models as MO
from regiolens.operators import series as SE

T = "total_enrollment"


def _series(spark, values, start=dt.date(2018, 1, 1), key=None):
    rows = []
    for i, v in enumerate(values):
        y, m = divmod(start.month - 1 + i, 12)
        rows.append(((key,) if key else ()) + (dt.date(start.year + y, m + 1, 1), float(v)))
    ddl = ("k string, " if key else "") + f"ds date, {T} double"
    return spark.createDataFrame(rows, ddl)


def known(n, level=1000.0, trend=10.0, amp=100.0):
    t = np.arange(n)
    return level + trend * t + amp * np.sin(2 * np.pi * t / 12)


def hw_numpy(y, a, b, g, m=12, horizon=6):
    l, bb = y[:m].mean(), (y[m:2 * m].sum() - y[:m].sum()) / (m * m)
    s = list(y[:m] - l)
    sse = 0.0
    for t, v in enumerate(y):
        j = t % m
        yhat = l + bb + s[j]
        sse += (v - yhat) ** 2
        l_new = a * (v - s[j]) + (1 - a) * (l + bb)
        bb = b * (l_new - l) + (1 - b) * bb
        s[j] = g * (v - l_new) + (1 - g) * s[j]
        l = l_new
    n = len(y)
    fc = [l + h * bb + s[(n - 1 + h) % m] for h in range(1, horizon + 1)]
    return sse, np.array(fc)


def test_holt_winters_matches_numpy_for_fixed_parameters(spark):
    y = known(48) + np.random.default_rng(3).normal(0, 5, 48)
    fc, met = MO.holt_winters(_series(spark, y), T, [], 6, fixed=(0.3, 0.1, 0.2))
    sse, expected = hw_numpy(y, 0.3, 0.1, 0.2)
    got = np.array([r.yhat for r in fc.orderBy("step").collect()])
    assert got == pytest.approx(expected, rel=1e-9)
    assert met.first().rmse == pytest.approx(round(np.sqrt(sse / 48), 2))


def test_holt_winters_grid_is_best_of_grid(spark):
    y = known(60)
    _, met = MO.holt_winters(_series(spark, y), T, [], 6)
    r = met.first()
    best = min(hw_numpy(y, a, b, g)[0] for a in MO.HW_GRID for b in MO.HW_GRID for g in MO.HW_GRID)
    assert r.rmse == pytest.approx(round(np.sqrt(best / 60), 2))


def test_sarima_on_known_series(spark):
    y = known(80)
    fc, met = MO.sarima(_series(spark, y), T, [], 6)
    truth = known(86)[80:]
    got = fc.orderBy("step").collect()
    assert np.array([r.yhat for r in got]) == pytest.approx(truth, rel=0.02)
    assert all(r.lower_95 <= r.lower_80 <= r.yhat <= r.upper_80 <= r.upper_95 for r in got)
    assert met.first().status == "ok"


def test_short_series_gives_error_rows(spark):
    s = _series(spark, [100, 110, 120])
    assert MO.holt_winters(s, T)[1].first().status.startswith("error")
    assert MO.sarima(s, T)[1].first().status.startswith("error")
    assert MO.seasonal_naive(s, T)[1].first().status.startswith("error")


def test_gbt_structure_and_error_rows(spark):
    long_ = _series(spark, known(80), key="long")
    short = _series(spark, [100, 110, 120], key="short")
    fc, met, imp = MO.gbt_forecast(long_.unionByName(short), T, ["k"], 6, max_iter=5)
    m = {r.k: r for r in met.collect()}
    assert m["long"].status == "ok" and m["short"].status.startswith("error")
    vals = {r.yhat for r in fc.where("k = 'long'").collect()}
    assert len(vals) == 1  # flat future (reference behaviour)
    assert sorted(r.feature for r in imp.collect()) == sorted(SE.feature_names(T))


def test_ensemble_mean_and_shortest_horizon(spark):
    f1 = spark.createDataFrame([("a", s, dt.date(2020, s, 1), 100.0) for s in (1, 2, 3)],
                               "model string, step int, ds date, yhat double")
    f2 = spark.createDataFrame([("b", s, dt.date(2020, s, 1), 200.0) for s in (1, 2)],
                               "model string, step int, ds date, yhat double")
    mets = spark.createDataFrame([("a", 10.0, 20.0, 5.0, "ok"), ("b", 30.0, 40.0, 15.0, "ok")],
                                 "model string, mae double, rmse double, mape double, status string")
    ef, em = FO.ensemble([f1, f2], [mets])
    assert [r.yhat for r in ef.orderBy("step").collect()] == [150.0, 150.0]
    r = em.first()
    assert (r.mae, r.rmse, r.mape, r.component_models, r.status) == (20.0, 30.0, 10.0, "a,b", "ok")


def test_ensemble_without_valid_models(spark):
    f1 = spark.createDataFrame([("a", 1, dt.date(2020, 1, 1), 100.0)], "model string, step int, ds date, yhat double")
    mets = spark.createDataFrame([("a", None, None, None, "error: x")],
                                 "model string, mae double, rmse double, mape double, status string")
    ef, em = FO.ensemble([f1], [mets])
    assert ef.count() == 0 and em.first().status.startswith("error")


def test_surge_detected_at_two_and_a_half_times_mean(spark):
    hist = _series(spark, [100, 90, 110, 95, 105, 100, 98, 102, 100, 97, 103, 100])
    fc = spark.createDataFrame([(1, dt.date(2019, 1, 1), 250.0), (2, dt.date(2019, 4, 1), 100.0)],
                               "step int, ds date, yhat double")
    s = FO.surges(fc, hist, T).collect()
    assert len(s) == 1 and s[0].period == 1 and s[0].context == "Routine Enrollment Cycle"
    summ = FO.surge_summary(fc, hist, T).first()
    assert summ.surge_detected and summ.num_surge_periods == 1
    ctx = spark.createDataFrame([(m,) for m in (3, 4, 11, 12)], "m int").select(FO.surge_context(F.col("m"))).collect()
    assert [r[0] for r in ctx] == ["End of Financial Year - Resource Alignment",
                                   "New School Session - Child Enrollment Drive",
                                   "Post-Harvest - Rural Enrollment Spike", "Routine Enrollment Cycle"]


def test_interpolation_of_gaps(spark):
    from regiolens.sources.loader import derive_columns
    from tests.conftest import FACT_DDL

    rows = [(1, dt.date(2025, 1, 1), "A", "B", 800001, 10, 0, 0), (2, dt.date(2025, 3, 1), "A", "B", 800001, 69, 0, 0)]
    s = SE.prepare_series(derive_columns(spark.createDataFrame(rows, FACT_DDL)), "M", [], ["age_0_5"])
    got = {r.ds.month: (r.age_0_5, r.observed) for r in s.collect()}
    assert got[1] == (10.0, True) and got[3] == (69.0, True)
    assert got[2][0] == pytest.approx(10 + 59 * 31 / 59) and got[2][1] is False  # weighted by days


def test_ml_features_drop_incomplete_rows(spark):
    f = SE.ml_features(_series(spark, known(30)), T)
    assert f.count() == 30 - 12
    r = f.orderBy("ds").first()
    assert r[f"{T}_lag_12"] == pytest.approx(known(30)[0])
    assert r[f"{T}_ma_3"] == pytest.approx(known(30)[10:13].mean())


def test_history_summary_trend(spark):
    h = FO.history_summary(_series(spark, [5, 3, 9]), T).first()
    assert (h.mean, h.median, h.min, h.max, h.trend) == (5.67, 5.0, 3.0, 9.0, "increasing")


def autocovariances(phi, theta, n, terms=4000):
    """From the weights of past shocks (unit variance)."""
    psi = np.zeros(terms)
    psi[0] = 1.0
    for j in range(1, terms):
        psi[j] = theta.get(j, 0.0) + sum(c * psi[j - k] for k, c in phi.items() if j >= k)
    return np.array([psi[:terms - h] @ psi[h:] for h in range(n)])


@pytest.mark.parametrize("phi,theta", [({}, {}), ({1: 0.6}, {}), ({}, {1: -0.7, 4: 0.3}), ({1: 0.4, 2: -0.3, 6: 0.2}, {1: 0.5, 6: -0.4})])
def test_likelihood_is_the_normal_density(phi, theta):
    """Kalman filter against the multivariate normal density with the model's covariance."""
    from regiolens.operators.statespace import kalman

    rng = np.random.default_rng(3)
    w, const, s2 = rng.normal(2, 1.5, size=14), 1.3, 2.25
    kf = kalman(w, const, phi, theta)
    gamma = autocovariances(phi, theta, 24)
    cov = s2 * gamma[np.abs(np.subtract.outer(np.arange(24), np.arange(24)))]
    x, c = w - const / (1 - sum(phi.values())), cov[:14, :14]
    want = -0.5 * (14 * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + x @ np.linalg.solve(c, x))
    assert kf.log_likelihood(s2) == pytest.approx(want, abs=1e-8)
    assert kf.log_likelihood() >= max(kf.log_likelihood(kf.sigma2 * k) for k in (0.9, 1.1))
    # forecasts: the conditional normal distribution given the sample
    means, var = kf.ahead(10)
    k = np.linalg.solve(c, cov[:14, 14:])
    assert means == pytest.approx(const / (1 - sum(phi.values())) + k.T @ x, abs=1e-8)
    assert s2 * var == pytest.approx(cov[14:, 14:] - cov[14:, :14] @ k, abs=1e-7)


def test_likelihood_without_a_stationary_state():
    from regiolens.operators.statespace import kalman

    rng = np.random.default_rng(4)
    w = np.cumsum(rng.normal(size=80))
    kf = kalman(w, 0.0, {1: 1.0}, {})  # a random walk: the first value tells nothing
    d = np.diff(w)
    assert kf.skip == 1
    assert kf.log_likelihood(1.0) == pytest.approx(-0.5 * (79 * np.log(2 * np.pi) + d @ d), abs=1e-4)


def test_sarima_interval_covers():
    """95% intervals of simulated series hold about 95% of the values that follow."""
    rng = np.random.default_rng(9)
    inside = 0
    for _ in range(60):
        e = rng.normal(size=140) * 20
        w = np.zeros(140)
        for t in range(1, 140):
            w[t] = 0.5 * w[t - 1] + e[t] + 0.3 * e[t - 1]
        y = list(known(13))
        for x in w:
            y.append(x + y[-1] + y[-12] - y[-13])
        r = MO.fit_sarima(np.array(y[:-3]), 3)
        lo, hi = r["bands"][0.95]
        inside += int(np.sum((np.array(y[-3:]) >= lo) & (np.array(y[-3:]) <= hi)))
        assert r["bic"] > r["aic"]
    assert inside >= 0.85 * 180


def test_boosted_split_is_the_best_one():
    """One stump: the cut with the greatest gain among all cuts of all features."""
    from regiolens.operators.boosting import fit_boosted

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)).round(1)
    y = 3 * (x[:, 2] > 0.35) + rng.normal(size=60) * 0.1
    g = y.mean() - y
    gains = {}
    for j in range(5):
        for lo, hi in zip(np.unique(x[:, j])[:-1], np.unique(x[:, j])[1:], strict=True):
            left = x[:, j] < (lo + hi) / 2
            gains[j, (lo + hi) / 2] = sum(g[s].sum() ** 2 / (s.sum() + 1.0) for s in (left, ~left))
    m = fit_boosted(x, y, rounds=1, depth=1, rate=1.0)
    j, c = max(gains, key=gains.get)
    assert (m.trees[0].feature[0], m.trees[0].cut[0]) == (j, pytest.approx(c))
    left = x[:, j] < c
    assert m.predict(x[left])[0] == pytest.approx(y.mean() - g[left].sum() / (left.sum() + 1.0))
    assert m.importance()[j] == 1.0


def test_boosting_fits_and_generalises():
    from regiolens.operators.boosting import fit_boosted

    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, size=(3000, 6))
    y = 5 * x[:, 0] * x[:, 1] + np.sin(3 * x[:, 2])
    m = fit_boosted(x[:2000], y[:2000], rounds=200, max_bins=64)
    assert np.sqrt(np.mean((m.predict(x[2000:]) - y[2000:]) ** 2)) < 0.25 * y.std()
    assert set(np.argsort(-m.importance())[:3]) == {0, 1, 2}
    flat = fit_boosted(x[:50], np.full(50, 7.0), rounds=5)
    assert np.allclose(flat.predict(x), 7.0) and flat.importance().sum() == 0


def test_gbt_error_bound_per_series(spark):
    """Seasonal series of very different sizes: each has its own model, errors of a few percent."""
    a = _series(spark, known(96, trend=0.0), key="a")
    b = _series(spark, known(96, trend=0.0) * 1000, key="b")
    fc, met, imp = MO.gbt_forecast(a.unionByName(b), T, ["k"], 6)
    m = {r.k: r for r in met.collect()}
    assert m["a"].mape < 5 and m["b"].mape == pytest.approx(m["a"].mape, abs=0.2)
    one = MO.gbt_forecast(a.drop("k"), T, [], 6)
    assert one[1].first().mae == m["a"].mae and one[0].first().yhat == pytest.approx(fc.where("k = 'a'").first().yhat)
    assert imp.groupBy("k").agg(F.round(F.sum("importance"), 6).alias("s")).where("s = 1").count() == 2


def test_next_features_equal_the_windows(spark):
    import pandas as pd

    y = known(40)
    rows = SE.ml_features(_series(spark, y), T, shifted=True).orderBy("ds").toPandas()
    got = MO._next_features(list(y[:39]), pd.Timestamp(rows["ds"].iloc[-1]))
    assert got == pytest.approx(rows[SE.feature_names(T)].iloc[-1].tolist())


def test_gbt_recursive_uses_its_own_predictions(spark):
    s = _series(spark, known(60, trend=20.0, amp=0.0))
    fc, met, _ = MO.gbt_forecast(s, T, [], 4, max_iter=20, recursive=True)
    rows = fc.orderBy("step").collect()
    assert [r.step for r in rows] == [1, 2, 3, 4]
    assert [r.ds for r in rows] == [dt.date(2023, 1, 1), dt.date(2023, 2, 1), dt.date(2023, 3, 1), dt.date(2023, 4, 1)]
    assert met.first().status == "ok"
    assert all(r.yhat is not None for r in rows)
