"""Anomaly operators (A1-A19) on hand-made frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiolens.operators import anomaly as A
from regiolens.sources.loader import derive_columns
from tests.conftest import FACT_DDL, d


def _outlier_fact(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(100, 10, 100).round().astype(int).tolist()
    vals[0] = 500
    rows = [(i, d(2025, 1, 1 + i % 28), "Bihar", "Patna", 800001, int(v), 50, 20) for i, v in enumerate(vals)]
    return derive_columns(spark.createDataFrame(rows, FACT_DDL))


def test_statistical_known_outlier(spark):
    out = A.statistical_anomalies(_outlier_fact(spark))
    r = out.where("record_id = 0").first()
    assert r.age_0_5_zscore_anomaly and r.age_0_5_iqr_anomaly and r.age_0_5_quantile_anomaly
    assert r.age_0_5_is_anomaly and r.has_statistical_anomaly
    # 2-of-3 vote invariant
    bad = out.where(F.col("age_0_5_is_anomaly") & ((F.col("age_0_5_zscore_anomaly").cast("int")
                    + F.col("age_0_5_iqr_anomaly").cast("int") + F.col("age_0_5_quantile_anomaly").cast("int")) < 2))
    assert bad.count() == 0
    # constant column: no z-score at all
    assert out.where("age_5_17_zscore IS NOT NULL").count() == 0


def test_temporal_zero_to_positive_is_sudden(spark):
    rows = [(i, d(2025, 1, i + 1), "Bihar", "Patna", 800001, v, 0, 0) for i, v in enumerate([0, 10, 10, 10, 30])]
    t = {r.date.day: r for r in A.temporal_anomalies(derive_columns(spark.createDataFrame(rows, FACT_DDL))).collect()}
    assert t[2].age_0_5_sudden_change  # 0 -> 10
    assert t[2].age_0_5_pct_change is None
    assert not t[3].age_0_5_sudden_change
    assert t[5].age_0_5_pct_change == pytest.approx(200.0) and t[5].age_0_5_sudden_change
    assert t[4].age_0_5_ma30 == pytest.approx(30 / 4)


def test_geographic_rows_basis(tiny_fact):
    g = {r.district: r for r in A.geographic_anomalies(tiny_fact).collect()}
    rows = [r.total_enrollment for r in tiny_fact.where("state = 'Bihar'").collect()]
    mean, std = np.mean(rows), np.std(rows, ddof=1)
    assert g["Patna"].total_enrollment_state_zscore == pytest.approx((180 - mean) / (std + 1e-8))
    gd = {r.district: r for r in A.geographic_anomalies(tiny_fact, basis="districts").collect()}
    assert gd["Surat"].total_enrollment_state_zscore is None  # one district in the state: no std


@pytest.mark.parametrize("count,z,expected", [
    (0, 9.0, 0), (1, 3.0, 1), (2, 3.9, 1), (2, 4.5, 2), (4, 5.9, 2), (5, 1.0, 3), (6, 9.0, 3),
    (7, 7.9, 3), (7, 8.0, 4), (14, 12.0, 4)])
def test_severity_table(spark, count, z, expected):
    df = spark.createDataFrame([(count, z)], "c int, z double")
    assert df.select(A.severity_expr(F.col("c"), F.col("z"))).first()[0] == expected


def test_severity_reason_and_label(spark):
    df = spark.createDataFrame([(True, False, 5.0, True), (True, False, 1.0, True), (False, False, 0.0, False)],
                               "f1 boolean, f2 boolean, z double, has_temporal_anomaly boolean")
    out = A.compute_severity(df, ["f1", "f2"], ["z"]).collect()
    assert [(r.severity_score, r.severity_label, r.anomaly_reason) for r in out] == [
        (2, "MEDIUM", "Potential Data Quality Error"), (1, "LOW", "Operational Batch Delay"),
        (0, "NORMAL", "Normal")]


def test_scored_and_report(spark):
    f = _outlier_fact(spark)
    scored = A.anomaly_scored(f)
    assert scored.count() == 100
    summ = A.anomaly_summary(f, scored=scored).first()
    assert summ.total_records == 100 and summ.statistical_anomalies >= 1
    recs = A.anomaly_recommendations(A.anomaly_summary(f, scored=scored)).collect()
    assert len(recs) >= 1
