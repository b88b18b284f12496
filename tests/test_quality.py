"""Data-quality operators on hand-made frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiolens.operators import quality as V
from regiolens.params import DEFAULT_PARAMS
from regiolens.sources.loader import derive_columns
from tests.conftest import FACT_DDL, d


def _fact(spark, rows):
    return derive_columns(spark.createDataFrame(rows, FACT_DDL))


def test_dri_weights_sum_to_one():
    assert sum(DEFAULT_PARAMS.dri_weights) == pytest.approx(1.0)


def test_dri_components_clean_data_is_one(tiny_fact):
    r = V.dri(tiny_fact).first()
    assert (r.completeness, r.consistency, r.validity, r.dri_score, r.assessment) == (1.0, 1.0, 1.0, 1.0, "PASS")


def test_dri_components_with_defects(spark):
    rows = [
        (1, d(2025, 1, 1), "Bihar", "Patna", 800001, 1, 2, 3),
        (2, None, "Bihar", "Patna", 800001, None, 2, 3),      # null date and null age
        (3, d(2025, 1, 2), "Bihar", "Patna", 99999, 1, -2, 3),  # bad PIN, negative age
        (4, d(2025, 1, 3), "Bihar", "Gaya", 800002, 1, 1, 1),
    ]
    df = _fact(spark, rows)
    c = V.dri_components(df).first()
    ncols = len(df.columns)
    # row 2: date + 6 calendar columns + age + total are null
    assert c.completeness == pytest.approx((4 * ncols - 9) / (4 * ncols))
    assert c.consistency == pytest.approx(3 / 4)  # null total is inconsistent
    checks = [3 / 4, 3 / 4, 4 / 4, 3 / 4, 3 / 4]  # ages >= 0 (x3), date present, PIN valid
    assert c.validity == pytest.approx(sum(checks) / len(checks))


def test_dri_by_district_groups(tiny_fact):
    out = {(r.state, r.district): r.dri_score for r in V.dri(tiny_fact, by=["state", "district"]).collect()}
    assert set(out) == {("Bihar", "Patna"), ("Bihar", "Gaya"), ("Gujarat", "Surat")}
    assert all(v == 1.0 for v in out.values())


def test_k_anonymity_never_keeps_small_groups(tiny_fact):
    kept = V.k_anonymity(tiny_fact, ["state", "district"], k=4)
    sizes = {(r.state, r.district): r["count"] for r in kept.groupBy("state", "district").count().collect()}
    assert sizes == {("Bihar", "Patna"): 4, ("Gujarat", "Surat"): 5}
    assert all(v >= 4 for v in sizes.values())


def test_extreme_values_flags_known_outlier(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(100, 10, 100).round().astype(int).tolist()
    vals[0] = 500
    rows = [(i, d(2025, 1, 1), "Bihar", "Patna", 800001, int(v), 50, 20) for i, v in enumerate(vals)]
    out = V.extreme_values(_fact(spark, rows))
    first = out.where("record_id = 0").first()
    assert first.age_0_5_extreme_pct and first.age_0_5_extreme_iqr and first.age_0_5_extreme_zscore
    assert first.age_0_5_is_extreme and first.has_extreme_values
    # constant columns: std = 0 gives no z-score flag
    assert out.where("age_5_17_extreme_zscore").count() == 0


def test_quality_rules_counts_all_duplicate_rows(spark):
    rows = [
        (1, d(2025, 1, 1), "Bihar", "Patna", 800001, 1, 1, 1),
        (2, d(2025, 1, 1), "Bihar", "Patna", 800001, 2, 2, 2),
        (3, d(2025, 1, 1), "Bihar", "Patna", 800001, 3, 3, 3),
        (4, d(2025, 1, 2), "Bihar", "Patna", 800001, 1, -1, 1),
    ]
    r = {x.rule + ":" + x.column_name: x for x in V.quality_rules(_fact(spark, rows)).collect()}
    dup = r["no_duplicates:date,state,district,pincode"]
    assert dup.violations == 3 and not dup.passed and dup.sample_ids == "1"
    neg = r["no_negative_enrollments:age_5_17"]
    assert neg.violations == 1 and neg.sample_ids == "4"
    assert r["no_negative_enrollments:age_0_5"].passed


def test_duplicate_rows_and_missing(spark):
    rows = [(1, d(2025, 1, 1), "Bihar", "Patna", 800001, 1, 1, 1)] * 3 + [
        (2, d(2025, 1, 1), "Bihar", "Patna", 800001, None, 1, 1)]
    df = _fact(spark, rows)
    assert V.duplicate_rows(df).first().duplicate_records == 2
    miss = {r.column_name: r.missing for r in V.missing_by_column(df).collect()}
    assert miss == {"age_0_5": 1, "total_enrollment": 1}


def test_invalid_states_and_report(spark, tiny_fact):
    bad = tiny_fact.withColumn("state", F.when(F.col("record_id") == 1, "Atlantis").otherwise(F.col("state")))
    assert [r.state for r in V.invalid_states(bad).collect()] == ["Atlantis"]
    rep = V.validation_report(bad)
    assert rep.select("overall_status").distinct().collect()[0][0] is False


def test_quality_recommendations_fallback(tiny_fact):
    rep = V.quality_report(tiny_fact)
    recs = [r.recommendation for r in V.quality_recommendations(rep).collect()]
    assert recs == ["Data quality is satisfactory for analysis"]
