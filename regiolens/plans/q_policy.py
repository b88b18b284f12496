"""Registered queries: policy impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolens.operators import policy as P
from regiolens.operators import quality as V
from regiolens.params import DEFAULT_PARAMS as PR
from regiolens.params import PRIORITY_TIERS, Scenario
from regiolens.plans.oracle_sql import BOTH, DIRTY, FACT, MS, div, r6, rnd, sums
from regiolens.plans.fact_store import stored
from regiolens.plans.q_anomaly import _severity_ctes, scored_table
from regiolens.plans.q_describe import fact
from regiolens.plans.q_forecast import _series_ctes, _simple_ctes, simple_ensemble
from regiolens.plans.q_quality import _dri_select, dirty_fact
from regiolens.plans.registry import register
from regiolens.schema import DEFAULT_SCHEMA as S

GEO = list(S.geo)


def district_table(spark, sf_dir):
    """District totals (one row per district), written once per session."""
    return stored(spark, "district_data", (sf_dir,), lambda: P.district_data(fact(spark, sf_dir)))


def priority_table(spark, sf_dir):
    """District data, its own ratio as the inequity input, per-district DRI of the raw feed."""
    d = district_table(spark, sf_dir)
    dri = stored(spark, "dri_by_district", (sf_dir,), lambda: V.dri(dirty_fact(spark, sf_dir), by=GEO))
    return P.priority_scores(d, inequity=d, dri_scores=dri)


# --- oracle pieces ---------------------------------------------------------------

_KIDS = " + ".join(S.children)
_ADULT = S.adults[0]
_DIST_CTE = f"""pdist AS (SELECT state, district, {sums()} FROM fact
                WHERE state IS NOT NULL AND district IS NOT NULL GROUP BY state, district),
pdd AS (SELECT *, {div(_KIDS, f'CASE WHEN {_ADULT} = 0 THEN 1 ELSE {_ADULT} END')} AS child_adult_ratio FROM pdist)"""


def _dri_cte() -> str:
    body = _dri_select(GEO)[len(DIRTY) + 2:]
    c_cte, final = body.split("\nSELECT ", 1)
    return f"{c_cte},\ndri AS (SELECT {final})"


def _tier_case(col: str) -> str:
    parts, lo = [], 0.0
    for name, hi in PRIORITY_TIERS:
        parts.append(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{name}'")
        lo = hi
    return "CASE " + " ".join(parts) + " END"


w1, w2, w3, w4 = PR.priority_weights
_PRIO_BODY = f"""{_DIST_CTE},
{_dri_cte()},
j AS (SELECT d.*, r.dri_score FROM pdd d LEFT JOIN dri r ON d.state = r.state AND d.district = r.district),
sc AS (SELECT *, 1.0 - {div('total_enrollment', '(SELECT MAX(CAST(total_enrollment AS DOUBLE)) FROM pdd)')} AS enrollment_score,
              COALESCE({div('ABS(child_adult_ratio - (SELECT quantile_cont(child_adult_ratio, 0.5) FROM j))',
                            '(SELECT stddev_samp(child_adult_ratio) FROM j)')}, 0.0) AS inequity_score,
              0.0 AS forecast_score,
              1.0 - COALESCE(dri_score, {PR.default_dri}) AS dri_priority_score FROM j),
p0 AS (SELECT *, {w1} * enrollment_score + {w2} * inequity_score + {w3} * forecast_score
                 + {w4} * dri_priority_score AS raw FROM sc),
p1 AS (SELECT * EXCLUDE (raw), {rnd(div('raw', '(SELECT MAX(raw) FROM p0)') + ' * 100', 2)} AS priority_score FROM p0),
pr AS (SELECT *, {_tier_case('priority_score')} AS priority_tier,
              CAST(CEIL(CAST(total_enrollment AS DOUBLE) / {PR.enrollment_per_center}) AS BIGINT) AS required_centers,
              CAST(CEIL(CAST(total_enrollment AS DOUBLE) / {PR.enrollment_per_staff}) AS BIGINT) AS required_staff
       FROM p1)"""
_PRIORITY_CTE = f"{BOTH},\n{_PRIO_BODY}"

PRIORITY_COLS = [*GEO, *MS, "total_enrollment", "child_adult_ratio", "dri_score", "enrollment_score",
                 "inequity_score", "forecast_score", "dri_priority_score", "priority_score", "priority_tier",
                 "required_centers", "required_staff"]
_DOUBLES = {"child_adult_ratio", "dri_score", "enrollment_score", "inequity_score", "forecast_score",
            "dri_priority_score", "priority_score"}


def _pcols(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(f"{r6(p + c)} AS {c}" if c in _DOUBLES else p + c for c in PRIORITY_COLS)


# --- P1-P12 ------------------------------------------------------------------------

@register("district_data", f"{FACT},\n{_DIST_CTE} SELECT state, district, {', '.join(MS)}, total_enrollment, "
                           f"{r6('child_adult_ratio')} AS child_adult_ratio FROM pdd")
def q_district_data(spark, sf_dir):
    return district_table(spark, sf_dir)


@register("priority_scores", f"{_PRIORITY_CTE} SELECT {_pcols()} FROM pr")
def q_priority(spark, sf_dir):
    """Flagship: district priority with inequity and per-district DRI inputs."""
    return priority_table(spark, sf_dir).select(*PRIORITY_COLS)


_JOINED = "j AS (SELECT d.*, r.dri_score FROM pdd d LEFT JOIN dri r ON d.state = r.state AND d.district = r.district)"
_DEMAND_BODY = _PRIO_BODY.replace(_JOINED, """dem AS (SELECT state, district, SUM(yhat) AS forecasted_enrollment FROM ef GROUP BY state, district),
j AS (SELECT d.*, r.dri_score, f.forecasted_enrollment FROM pdd d
      LEFT JOIN dri r ON d.state = r.state AND d.district = r.district
      LEFT JOIN dem f ON d.state = f.state AND d.district = f.district)""").replace(
    "0.0 AS forecast_score",
    f"COALESCE({div('forecasted_enrollment', '(SELECT MAX(forecasted_enrollment) FROM j)')}, 0.0) AS forecast_score")


@register("priority_scores_with_demand", f"{BOTH},\n{_series_ctes(GEO, [S.total])},\n{_simple_ctes(GEO)},\n{_DEMAND_BODY}\n"
                                         f"SELECT {_pcols()} FROM pr")
def q_priority_demand(spark, sf_dir):
    """Forecast demand (simple ensemble per district) as the third component."""
    d = district_table(spark, sf_dir)
    dri = stored(spark, "dri_by_district", (sf_dir,), lambda: V.dri(dirty_fact(spark, sf_dir), by=GEO))
    demand = simple_ensemble(spark, sf_dir)[1].groupBy(*GEO).agg(F.sum("yhat").alias("forecasted_enrollment"))
    return P.priority_scores(d, inequity=d, forecast=demand, dri_scores=dri).select(*PRIORITY_COLS)


@register("resource_allocation", f"""{_PRIORITY_CTE}
SELECT CAST(COALESCE(SUM(required_centers), 0) AS BIGINT) AS total_required_centers,
       CAST(COALESCE(SUM(required_staff), 0) AS BIGINT) AS total_required_staff,
       COUNT(*) FILTER (WHERE priority_tier = 'Critical') AS critical_districts FROM pr""")
def q_resource_totals(spark, sf_dir):
    return P.resource_totals(priority_table(spark, sf_dir))


_TIERS_VALUES = ", ".join(f"('{n}', {i})" for i, (n, _) in enumerate(PRIORITY_TIERS))
_TIER_SUMMARY_CTE = f"""{_PRIORITY_CTE},
tiers AS (SELECT * FROM (VALUES {_TIERS_VALUES}) t(priority_tier, tier_rank)),
g AS (SELECT priority_tier, SUM(total_enrollment) AS te, SUM(required_centers) AS rc, SUM(required_staff) AS rs,
             COUNT(*) AS nd FROM pr WHERE priority_tier IS NOT NULL GROUP BY priority_tier),
ts AS (SELECT t.priority_tier, CAST(t.tier_rank AS BIGINT) AS tier_rank,
              CAST(COALESCE(g.te, 0) AS BIGINT) AS total_enrollment, CAST(COALESCE(g.rc, 0) AS BIGINT) AS required_centers,
              CAST(COALESCE(g.rs, 0) AS BIGINT) AS required_staff, CAST(COALESCE(g.nd, 0) AS BIGINT) AS num_districts
       FROM tiers t LEFT JOIN g ON t.priority_tier = g.priority_tier)"""


@register("tier_summary", f"{_TIER_SUMMARY_CTE} SELECT * FROM ts")
def q_tier_summary(spark, sf_dir):
    return P.tier_summary(priority_table(spark, sf_dir))


@register("allocation_strategy", f"""{_TIER_SUMMARY_CTE},
a AS (SELECT 1 AS rank, printf('PRIORITY 1: Allocate %d centers and %d staff to %d critical districts',
                               required_centers, required_staff, num_districts) AS strategy
      FROM ts WHERE priority_tier = 'Critical' AND num_districts > 0
      UNION ALL
      SELECT 2, printf('PRIORITY 2: Deploy %d centers to %d high-priority districts', required_centers, num_districts)
      FROM ts WHERE priority_tier = 'High' AND num_districts > 0)
SELECT * FROM a UNION ALL SELECT 3, 'No critical resource allocation needs identified' WHERE NOT EXISTS (SELECT 1 FROM a)""")
def q_allocation_strategy(spark, sf_dir):
    return P.allocation_strategy(P.tier_summary(priority_table(spark, sf_dir)))


_TOP_COLS = [*GEO, "total_enrollment", "priority_score", "priority_tier", "required_centers", "required_staff"]


@register("top_priority", f"{_PRIORITY_CTE} SELECT {', '.join(_TOP_COLS)} FROM pr "
                          f"ORDER BY priority_score DESC NULLS LAST, state, district LIMIT 50")
def q_top_priority(spark, sf_dir):
    return P.top_priority(priority_table(spark, sf_dir), 50)


@register("chart_top10", f"{_PRIORITY_CTE} SELECT {', '.join(_TOP_COLS)} FROM pr "
                         f"ORDER BY priority_score DESC NULLS LAST, state, district LIMIT 10")
def q_chart_top10(spark, sf_dir):
    """Top-10 priority districts."""
    return P.top_priority(priority_table(spark, sf_dir), 10)


@register("tier_distribution", f"{_PRIORITY_CTE} SELECT priority_tier, COUNT(*) AS num_districts FROM pr "
                               f"WHERE priority_tier IS NOT NULL GROUP BY priority_tier")
def q_tier_distribution(spark, sf_dir):
    return P.tier_distribution(priority_table(spark, sf_dir))


# --- P13-P17, P21 ----------------------------------------------------------------------

def interventions_table(spark, sf_dir):
    """All four triggers: low enrollment, inequity, forecast surge (simple
    per-district ensemble) and row-level data-quality anomalies."""
    from regiolens.operators import forecast as FO
    from regiolens.plans.q_forecast import simple_ensemble

    f = fact(spark, sf_dir)
    s, ef, _ = simple_ensemble(spark, sf_dir)
    surges = FO.surges(ef, s, S.total, GEO)
    scored = scored_table(spark, sf_dir)
    return P.interventions(district_table(spark, sf_dir), anomalies=scored, surges=surges)


_IV_BODY = f"""iv AS (
  SELECT state, district, total_enrollment, 'Low Enrollment' AS intervention_type, 'High' AS urgency,
         'Increase outreach and enrollment campaigns' AS recommended_action FROM pdd
  WHERE CAST(total_enrollment AS DOUBLE) < (SELECT AVG(CAST(total_enrollment AS DOUBLE)) FROM pdd) * {PR.low_enrollment_fraction}
  UNION ALL
  SELECT state, district, total_enrollment, 'High Inequity', 'Medium', 'Investigate demographic disparities'
  FROM pdd WHERE child_adult_ratio > {PR.inequity_high}
  UNION ALL
  SELECT state, district, total_enrollment, 'Forecast Surge', 'Critical', 'Prepare additional capacity immediately'
  FROM pdd WHERE (state, district) IN (SELECT state, district FROM sg)
  UNION ALL
  SELECT state, district, total_enrollment, 'Data Quality', 'High', 'Audit enrollment processes and data collection'
  FROM sv WHERE severity_score >= 3)"""


def _iv_head(head: str) -> str:
    """CTE head with the per-district simple forecasts (for the surge trigger)."""
    from regiolens.plans.q_forecast import _series_ctes, _simple_ctes

    return f"{head},\n{_series_ctes(GEO, [S.total])},\n{_simple_ctes(GEO)}"


_IV_CTE = f"{_severity_ctes(_iv_head(FACT))},\n{_DIST_CTE},\n{_IV_BODY}"


@register("interventions", f"{_IV_CTE} SELECT * FROM iv")
def q_interventions(spark, sf_dir):
    return interventions_table(spark, sf_dir)


@register("intervention_counts", f"""{_IV_CTE}
SELECT 'urgency' AS dimension, urgency AS value, COUNT(*) AS interventions FROM iv GROUP BY urgency
UNION ALL SELECT 'intervention_type', intervention_type, COUNT(*) FROM iv GROUP BY intervention_type""")
def q_intervention_counts(spark, sf_dir):
    return P.intervention_counts(interventions_table(spark, sf_dir))


@register("chart_interventions", f"""{_IV_CTE}
SELECT intervention_type, COUNT(*) AS interventions FROM iv GROUP BY intervention_type""")
def q_chart_interventions(spark, sf_dir):
    """T5: intervention counts by type."""
    c = P.intervention_counts(interventions_table(spark, sf_dir))
    return c.where("dimension = 'intervention_type'").selectExpr("value AS intervention_type", "interventions")


_URG = ", ".join(f"'{u}'" for u in P.URGENCY_ORDER)


@register("first_interventions", f"""{_IV_CTE}
SELECT * FROM iv ORDER BY list_position([{_URG}], urgency), intervention_type, state, district,
         total_enrollment DESC LIMIT 100""")
def q_first_interventions(spark, sf_dir):
    return P.first_interventions(interventions_table(spark, sf_dir), 100)


@register("strategic_recommendations", f"""{_severity_ctes(_iv_head(BOTH))},
{_PRIO_BODY},
{_IV_BODY},
t AS (SELECT CAST(COALESCE(SUM(required_centers), 0) AS BIGINT) AS centers,
             COUNT(*) FILTER (WHERE priority_tier = 'Critical') AS crit,
             (SELECT COUNT(*) FILTER (WHERE urgency = 'Critical') FROM iv) AS imm FROM pr)
SELECT 1 AS rank, printf('URGENT: %d districts require immediate attention. Deploy rapid response teams for enrollment acceleration.', crit) AS recommendation FROM t WHERE crit > 0
UNION ALL SELECT 2, printf('Large-scale infrastructure needed: %d enrollment centers. Consider phased rollout strategy.', centers) FROM t WHERE centers > 1000
UNION ALL SELECT 3, printf('%d districts need critical interventions. Establish dedicated task force.', imm) FROM t WHERE imm > 0
UNION ALL SELECT 4, 'Implement continuous monitoring system to track policy impact and adjust strategies.'""")
def q_strategic(spark, sf_dir):
    pr = priority_table(spark, sf_dir)
    return P.strategic_recommendations(P.resource_totals(pr), interventions_table(spark, sf_dir))


# --- P18-P19 ---------------------------------------------------------------------------

SIM_SCENARIOS = (
    Scenario("Universal Outreach Campaign", 15.0, None),
    Scenario("Baseline growth", 10.0, None),
    Scenario("Targeted districts", 20.0, ("NATION_1-BUILDING", "NATION_2-MACHINERY", "NATION_3-AUTOMOBILE")),
    Scenario("Empty target list", 15.0, ()),
)


def _sim_sql() -> str:
    aggs = ["CAST(COALESCE(SUM(total_enrollment), 0) AS BIGINT) AS base"]
    rows = []
    for i, s in enumerate(SIM_SCENARIOS):
        if s.target_districts is None:
            hit = "TRUE"
        elif len(s.target_districts) == 0:
            hit = "FALSE"
        else:
            hit = "COALESCE(district IN (" + ", ".join(f"'{d}'" for d in s.target_districts) + "), FALSE)"
        mult = 1 + s.enrollment_increase_pct / 100.0
        aggs.append(f"CAST(COALESCE(SUM(CASE WHEN {hit} THEN total_enrollment ELSE 0 END), 0) AS BIGINT) AS t{i}")
        aggs.append(f"COUNT(*) FILTER (WHERE {hit} AND CAST(total_enrollment AS DOUBLE) * {mult!r} > total_enrollment) AS a{i}")
        pct = f"CAST({float(s.enrollment_increase_pct)!r} AS DOUBLE)"
        inc = f"(CAST(t{i} AS DOUBLE) * ({pct} / 100.0))"
        sim = f"(CAST(base AS DOUBLE) + {inc})"
        dlt = f"({sim} - CAST(base AS DOUBLE))"
        tgt = "all" if s.target_districts is None else ",".join(s.target_districts)
        rows.append(
            f"SELECT '{s.name}' AS scenario, {pct} AS enrollment_increase_pct, '{tgt}' AS target_districts, "
            f"base AS baseline_enrollment, CAST(TRUNC({sim}) AS BIGINT) AS simulated_enrollment, "
            f"CAST(TRUNC({dlt}) AS BIGINT) AS absolute_increase, "
            f"COALESCE({rnd(div(dlt, 'base') + ' * 100', 2)}, 0.0) AS percentage_increase, "
            f"CAST(CEIL({dlt} / {PR.enrollment_per_center}) AS BIGINT) AS additional_centers, "
            f"CAST(CEIL({dlt} / {PR.enrollment_per_staff}) AS BIGINT) AS additional_staff, "
            f"a{i} AS districts_affected FROM one")
    return f"{FACT},\n{_DIST_CTE},\none AS (SELECT {', '.join(aggs)} FROM pdd)\n" + " UNION ALL ".join(rows)


@register("policy_simulation", _sim_sql())
def q_policy_simulation(spark, sf_dir):
    """Default 15% scenario plus three more, in one aggregate."""
    return P.policy_simulation(district_table(spark, sf_dir), SIM_SCENARIOS)
