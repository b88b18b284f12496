"""Policy operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from regiolens.operators import policy as P
from regiolens.params import Scenario


def test_district_data_zero_adults_counts_as_one(spark):
    from regiolens.sources.loader import derive_columns
    from tests.conftest import FACT_DDL, d

    df = derive_columns(spark.createDataFrame([(1, d(2025, 1, 1), "A", "B", 800001, 2, 3, 0)], FACT_DDL))
    assert P.district_data(df).first().child_adult_ratio == pytest.approx(5.0)


def test_priority_scores_and_tiers(tiny_fact):
    dist = P.district_data(tiny_fact)
    pr = {r.district: r for r in P.priority_scores(dist, inequity=dist).collect()}
    assert max(r.priority_score for r in pr.values()) == pytest.approx(100.0)
    # the largest district has enrollment score 0
    assert pr["Surat"].enrollment_score == pytest.approx(0.0)
    assert pr["Surat"].required_centers == math.ceil(600 / 500) and pr["Surat"].required_staff == 6
    for r in pr.values():
        if r.priority_score <= 0:
            assert r.priority_tier is None


def test_tier_expression_bounds(spark):
    df = spark.createDataFrame([(0.0,), (0.01,), (25.0,), (25.01,), (75.0,), (100.0,)], "s double")
    assert [r[0] for r in df.select(P.tier_expr(F.col("s"))).collect()] == [
        None, "Low", "Low", "Medium", "High", "Critical"]


def test_tier_summary_has_all_tiers(tiny_fact):
    dist = P.district_data(tiny_fact)
    ts = P.tier_summary(P.priority_scores(dist, inequity=dist)).collect()
    assert [r.priority_tier for r in sorted(ts, key=lambda r: r.tier_rank)] == ["Low", "Medium", "High", "Critical"]
    pr = P.priority_scores(dist, inequity=dist)
    tiered = pr.where("priority_tier IS NOT NULL").agg(F.sum("total_enrollment")).first()[0]
    assert sum(r.total_enrollment for r in ts) == tiered


def test_policy_simulation_scenarios(tiny_fact):
    dist = P.district_data(tiny_fact)
    sims = {r.scenario: r for r in P.policy_simulation(dist, [
        Scenario("all15", 15.0, None), Scenario("listed", 20.0, ("Patna", "Gaya")), Scenario("none", 15.0, ())
    ]).collect()}
    base = 180 + 21 + 600
    assert sims["all15"].baseline_enrollment == base
    assert sims["all15"].simulated_enrollment == int(base * 1.15)
    assert sims["all15"].additional_centers == math.ceil(base * 0.15 / 500)
    assert sims["all15"].districts_affected == 3
    assert sims["listed"].absolute_increase == int((180 + 21) * 0.2)
    assert sims["listed"].districts_affected == 2
    assert sims["none"].absolute_increase == 0 and sims["none"].districts_affected == 0


def test_interventions_and_recommendations(tiny_fact):
    dist = P.district_data(tiny_fact)
    iv = P.interventions(dist)
    kinds = {(r.district, r.intervention_type) for r in iv.collect()}
    assert ("Gaya", "Low Enrollment") in kinds  # 21 < 0.6 * mean(267)
    assert ("Surat", "High Inequity") in kinds  # every ratio > 0.7
    pr = P.priority_scores(dist, inequity=dist)
    recs = [r.recommendation for r in P.strategic_recommendations(P.resource_totals(pr), iv).collect()]
    assert recs[-1].startswith("Implement continuous monitoring")
