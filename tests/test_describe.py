"""Descriptive operators (D1-D20, D26) on hand-made frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regiolens.operators import describe as D


def _gini(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return D.gini(df, "x").first().gini


def test_gini_equal_is_zero(spark):
    assert _gini(spark, [100, 100, 100, 100, 100]) == pytest.approx(0.0, abs=1e-12)


def test_gini_one_has_all(spark):
    assert _gini(spark, [1000, 0, 0, 0, 0]) == pytest.approx(0.8)


def test_gini_with_ties_matches_rank_formula(spark):
    import numpy as np

    vals = [5, 3, 3, 9, 1, 3, 7, 7]
    s = np.sort(vals)
    n = len(s)
    expected = 2 * np.sum(np.arange(1, n + 1) * s) / (n * s.sum()) - (n + 1) / n
    assert _gini(spark, vals) == pytest.approx(expected)


def test_monthly_trends(tiny_fact):
    t = {r.year_month.month: r for r in D.monthly_trends(tiny_fact).collect()}
    assert [t[m].total_enrollment for m in (1, 2, 3)] == [183, 332, 286]
    jan, feb = t[1], t[2]
    assert jan.total_enrollment_mom_change is None
    assert feb.total_enrollment_mom_change == pytest.approx(
        (feb.total_enrollment - jan.total_enrollment) / jan.total_enrollment * 100)
    assert t[3].total_ma_3m == pytest.approx((jan.total_enrollment + feb.total_enrollment + t[3].total_enrollment) / 3)
    assert t[2].total_ma_3m is None and t[3].total_ma_6m is None


def test_district_inequity_and_underserved(tiny_fact):
    rows = {r.district: r for r in D.district_inequity(tiny_fact).collect()}
    gaya = rows["Gaya"]
    assert gaya.total_enrollment == 1 + 2 + 0 + 3 + 4 + 5 + 2 + 2 + 2
    assert gaya.child_adult_ratio == pytest.approx((1 + 3 + 2 + 2 + 4 + 2) / 7)
    under = [r.district for r in D.underserved_districts(tiny_fact).collect()]
    assert under == ["Gaya"]  # below half of the median district total


def test_child_adult_ratio_zero_adults(spark):
    from regiolens.sources.loader import derive_columns
    from tests.conftest import FACT_DDL, d

    df = derive_columns(spark.createDataFrame([(1, d(2025, 1, 1), "A", "B", 800001, 2, 3, 0)], FACT_DDL))
    r = D.child_adult_ratio(df).first()
    assert (r.children, r.adults, r.child_adult_ratio, r.adult_inclusion_gap) == (5, 0, 0.0, "Low")
    assert D.district_inequity(df).first().child_adult_ratio is None


def test_summary_statistics_percentiles(tiny_fact):
    import numpy as np

    s = {r.column_name: r for r in D.summary_statistics(tiny_fact).collect()}
    vals = [r.age_0_5 for r in tiny_fact.select("age_0_5").collect()]
    assert s["age_0_5"].median == pytest.approx(round(float(np.percentile(vals, 50)), 2))
    assert s["age_0_5"].p90 == pytest.approx(round(float(np.percentile(vals, 90)), 2))
    assert s["age_0_5"].sum == sum(vals)


def test_inequity_recommendations(tiny_fact):
    # district totals 180, 21, 600: CV = 299.14 / 267 = 1.12 > 1
    recs = D.inequity_recommendations(D.inequity_facts(tiny_fact)).collect()
    assert [r.recommendation for r in recs] == [
        "High enrollment inequality detected (CV=1.12). Geographic disparities require policy intervention."]
    equal = tiny_fact.where("district = 'Patna'")
    recs = D.inequity_recommendations(D.inequity_facts(equal)).collect()
    assert [r.recommendation for r in recs] == ["Enrollment distribution is relatively equitable."]


def test_monthly_trends_calendar_option(spark):
    import datetime as dt

    from regiolens.sources.loader import derive_columns
    from tests.conftest import FACT_DDL

    rows = [(i, dt.date(2024 + (i // 12), i % 12 + 1, 1), "A", "B", 800001, 10 + i, 0, 0) for i in range(14) if i != 5]
    f = derive_columns(spark.createDataFrame(rows, FACT_DDL))
    by_rows = {r.year_month: r for r in D.monthly_trends(f).collect()}
    by_cal = {r.year_month: r for r in D.monthly_trends(f, calendar=True).collect()}
    last = dt.date(2025, 2, 1)
    # 12 rows back skips the missing June; 12 calendar months back is Feb 2024 (value 11)
    assert by_rows[last].total_enrollment_yoy_change == pytest.approx((23 - 10) / 10 * 100)
    assert by_cal[last].total_enrollment_yoy_change == pytest.approx((23 - 11) / 11 * 100)
    assert len(by_cal) == 14 and len(by_rows) == 13


def test_inequity_cv_rule_takes_the_unrounded_value(spark):
    facts = spark.createDataFrame([(10, 5, 1.0004, 0), (10, 5, 1.0, 0)], "total_districts long, median_enrollment long, cv double, "
                                  "underserved_count long")
    assert [r.recommendation[:4] for r in D.inequity_recommendations(facts.where("cv > 1")).collect()] == ["High"]
    assert D.rounded_inequity(facts).first().coefficient_of_variation == 1.0
    assert D.inequity_recommendations(facts.where("cv = 1")).first().recommendation.startswith("Enrollment distribution")


def test_gini_of_many_values_needs_no_single_window(spark):
    import numpy as np

    n = 1_000_000
    df = spark.range(n).selectExpr("id % 3 as g", "cast(id * id as double) + 0.5 as v")
    x = np.sort(np.arange(n, dtype=float) ** 2 + 0.5)
    want = 2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n
    assert abs(D.gini(df, "v").first().gini - want) < 1e-9
    few = D.gini(df.where("id < 3000"), "v", ["g"], per_range=50).collect()
    for r in few:
        y = np.sort([float(i) ** 2 + 0.5 for i in range(3000) if i % 3 == r.g])
        m = len(y)
        assert abs(r.gini - (2 * (np.arange(1, m + 1) * y).sum() / (m * y.sum()) - (m + 1) / m)) < 1e-9


def test_exact_percentiles_in_two_passes(spark):
    """A million continuous values, several ranks of several columns: two aggregates, the same numbers."""
    from regiolens.functions.ranks import exact_percentiles

    class Counting:
        def __init__(self, df):
            self.df, self.passes = df, 0

        def agg(self, *cols):
            self.passes += 1
            return self.df.agg(*cols)

    fr = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    h = F.xxhash64("id").cast("double")
    df = spark.range(1_000_000).select(h.alias("x"), F.exp(h / 2e18).alias("skew"), F.pmod("id", F.lit(7)).alias("few"),
                                       F.when(F.col("id") % 3 > 0, 5.0).otherwise(h).alias("hot"),
                                       F.when(F.col("id") < 2, F.lit(1.5)).alias("nulls"), F.lit(None).cast("double").alias("none"))
    c = Counting(df)
    got = exact_percentiles(c, {k: fr for k in df.columns})
    assert c.passes == 2 and got["none"] == [None] * len(fr)
    want = df.agg(*[F.percentile(k, fr).alias(k) for k in df.columns]).first()
    for k in df.columns[:-1]:
        assert got[k] == want[k]
    assert exact_percentiles(df.limit(0), {"x": [0.5]}) == {"x": [None]}


def test_exact_percentiles_where_brackets_are_too_full(spark):
    """Few values may come over: brackets are narrowed pass by pass, with the same result."""
    from regiolens.functions.ranks import exact_percentiles

    df = spark.range(60_000).select(F.xxhash64("id").cast("double").alias("x"), (F.col("id") % 900).alias("y"))
    fr = [0.001, 0.3, 0.5, 0.999]
    got = exact_percentiles(df, {"x": fr, "y": fr}, most=20, k=64)
    want = df.agg(F.percentile("x", fr).alias("x"), F.percentile("y", fr).alias("y")).first()
    assert got == {"x": want["x"], "y": want["y"]}


def test_gini_ranges_are_split_again(spark, monkeypatch):
    """More ranges needed than one cut makes: no window holds more than per_range values."""
    monkeypatch.setattr(D, "SPLITS", 8)
    df = spark.range(6000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("v", F.abs("v"))
    placed = df.groupBy("g", F.col("v").alias("_x")).agg(F.count("*").cast("double").alias("_c")).withColumn(
        "_r", F.expr("cast(array() as array<int>)"))
    for _ in range(8):
        if placed.groupBy("g", "_r").count().agg(F.max("count")).first()[0] <= 5:
            break
        placed = D._split_ranges(placed, ["g"], 5)
    assert placed.groupBy("g", "_r").count().agg(F.max("count"), F.count("*")).first()[1] > 1000
    w = placed.groupBy("g", "_r").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).orderBy("g", "_r").collect()
    assert all(a.hi < b.lo for a, b in zip(w, w[1:], strict=False) if a.g == b.g)  # ranges sort like their values
    for by in ([], ["g"]):
        a = {tuple(r)[:-1]: r.gini for r in D.gini(df, "v", by, per_range=5).collect()}
        b = {tuple(r)[:-1]: r.gini for r in D.gini(df, "v", by).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_coverage_from_sketches(spark):
    from regiolens.operators import coverage as CV

    fact = spark.range(40_000).select(
        F.date_add(F.lit(dt.date(2025, 1, 1)), (F.col("id") % 50).cast("int")).alias("date"), F.concat(F.lit("s"), F.col("id") % 4).alias("state"),
        F.concat(F.lit("d"), F.col("id") % 9).alias("district"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("pincode"))
    mart = CV.coverage_mart(fact).cache()
    r = CV.coverage_from_mart(mart, "2025-01-05", "2025-01-20").first()
    part = fact.where("date between '2025-01-05' and '2025-01-20'")
    want = D.coverage(part).first()
    assert (r.records, r.num_states, r.num_districts) == (part.count(), want.num_states, want.num_districts)
    assert r.num_pincodes == want.num_pincodes  # fewer than the sketch holds: exact
    whole, true = CV.coverage_from_mart(mart).first().num_pincodes, D.coverage(fact).first().num_pincodes
    assert true > 2**CV.LG_SIZE and abs(whole - true) < 4 * 2 ** (-CV.LG_SIZE / 2) * true
    small = CV.coverage_from_mart(CV.coverage_mart(fact, lg_size=8), lg_size=8).first().num_pincodes
    assert abs(small - true) < 4 * 2**-4 * true
    by = {x.state: x.num_pincodes for x in CV.coverage_from_mart(mart, by=["state"]).collect()}
    assert by == {x.state: x.num_pincodes for x in fact.groupBy("state").agg(F.count_distinct("pincode").alias("num_pincodes")).collect()}
    empty = CV.coverage_from_mart(mart, "2030-01-01").first()
    assert (empty.records, empty.num_states, empty.num_pincodes) == (0, 0, 0)
    a, b = (fact.where(f"date between '{x}' and '{y}'").select("pincode").dropna().distinct() for x, y in
            (("2025-01-01", "2025-01-10"), ("2025-01-11", "2025-01-20")))
    ch = CV.coverage_change(mart, ("2025-01-01", "2025-01-10"), ("2025-01-11", "2025-01-20")).first()
    assert (ch.kept, ch.came, ch.went) == (a.intersect(b).count(), b.subtract(a).count(), a.subtract(b).count())
