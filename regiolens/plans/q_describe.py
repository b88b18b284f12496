"""Registered queries: sources, profile and descriptive analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolens.operators import describe as D
from regiolens.operators import profile as Q
from regiolens.params import INEQUITY_FINE, INEQUITY_TEXTS
from regiolens.plans.fact_store import stored
from regiolens.plans.oracle_sql import DIRTY, FACT, M, MS, div, r6, rnd, sums
from regiolens.plans.registry import register
from regiolens.schema import DEFAULT_SCHEMA as S
from regiolens.sources.loader import derive_columns
from regiolens.sources.tpch import break_totals, dirty_enrollment_from_tpch, enrollment_from_tpch


def fact(spark, sf_dir):
    """Derived fact of the adapter view, written once per session."""
    return stored(spark, "fact", (sf_dir,), lambda: derive_columns(enrollment_from_tpch(spark, sf_dir)))


def dirty(spark, sf_dir):
    """Derived fact with injected defects, written once per session."""
    return stored(spark, "dirty_fact", (sf_dir,), lambda: break_totals(derive_columns(dirty_enrollment_from_tpch(spark, sf_dir))))


PCT = [f"pct_{m}" for m in MS]
FACT_COLS = ["record_id", "date", "state", "district", "pincode", *MS, "total_enrollment", *PCT,
             "year", "month", "quarter", "year_month", "day_of_week", "week_of_year"]


def _fact_select(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(f"{r6(p + c)} AS {c}" if c in PCT else f"{p}{c}" for c in FACT_COLS)


# --- sources / profile -------------------------------------------------------------

@register("fact_derived", f"{FACT} SELECT {_fact_select()} FROM fact")
def q_fact_derived(spark, sf_dir):
    """S10-S13 over the adapter view."""
    return fact(spark, sf_dir).select(*FACT_COLS)


@register("dirty_fact_derived", f"{DIRTY} SELECT {_fact_select()} FROM dirty")
def q_dirty_fact_derived(spark, sf_dir):
    """S10-S13 over the view with injected defects (null, negative, bad PIN/date, duplicates)."""
    return dirty(spark, sf_dir).select(*FACT_COLS)


@register("date_range_filter",
          f"{FACT} SELECT {_fact_select()} FROM fact WHERE date >= DATE '1997-01-01' AND date <= DATE '1998-12-31'")
def q_date_range(spark, sf_dir):
    return Q.filter_by_date_range(fact(spark, sf_dir), "1997-01-01", "1998-12-31").select(*FACT_COLS)


@register("drilldown_filter",
          f"{FACT} SELECT {_fact_select()} FROM fact WHERE state = 'NATION_7' AND district = 'NATION_7-BUILDING'")
def q_drilldown(spark, sf_dir):
    return Q.drilldown(fact(spark, sf_dir), "NATION_7", "NATION_7-BUILDING").select(*FACT_COLS)


@register("districts_of_state",
          f"{FACT} SELECT DISTINCT district FROM fact WHERE state = 'NATION_7' AND district IS NOT NULL")
def q_districts_of_state(spark, sf_dir):
    return Q.distinct_values(Q.drilldown(fact(spark, sf_dir), "NATION_7"), S.district)


@register("aggregate_by_state_month",
          f"{FACT} SELECT state, year_month, {sums()} FROM fact "
          f"WHERE state IS NOT NULL AND year_month IS NOT NULL GROUP BY state, year_month")
def q_agg_state_month(spark, sf_dir):
    return Q.aggregate(fact(spark, sf_dir), [S.state, S.year_month], "sum")


@register("aggregate_mean_by_state",
          f"{FACT} SELECT state, {', '.join(f'{r6(f'AVG({c})')} AS {c}' for c in M)} FROM fact "
          f"WHERE state IS NOT NULL GROUP BY state")
def q_agg_mean_state(spark, sf_dir):
    return Q.aggregate(fact(spark, sf_dir), [S.state], "mean")


@register("record_count_by_district",
          f"{FACT} SELECT state, district, COUNT(*) AS record_count FROM fact "
          f"WHERE state IS NOT NULL AND district IS NOT NULL GROUP BY state, district")
def q_count_district(spark, sf_dir):
    return Q.aggregate(fact(spark, sf_dir), [S.state, S.district], "count")


_ALL_COLS = FACT_COLS
_PROFILE_SQL = f"""{DIRTY}
SELECT COUNT(*) AS total_records, MIN(date) AS min_date, MAX(date) AS max_date,
       CAST(datediff('day', MIN(date), MAX(date)) AS BIGINT) AS span_days,
       COUNT(DISTINCT state) AS num_states, COUNT(DISTINCT district) AS num_districts,
       COUNT(DISTINCT pincode) AS num_pincodes,
       {', '.join(f'CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS sum_{c}' for c in M)},
       {', '.join(f'CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls_{c}' for c in _ALL_COLS)}
FROM dirty"""


@register("dataset_profile", _PROFILE_SQL)
def q_profile(spark, sf_dir):
    """Q4/Q5 over the view with defects (so null counts are not all zero)."""
    return Q.dataset_profile(dirty(spark, sf_dir).select(*FACT_COLS))


# --- D1-D5 -------------------------------------------------------------------------

def _trend_sql(limit: bool) -> str:
    w, w3, w6 = "w", "w3", "w6"
    cols = ", ".join(M)
    mom = ", ".join(
        f"{r6(div(f'{c} - LAG({c}, 1) OVER {w}', f'LAG({c}, 1) OVER {w}') + ' * 100')} AS {c}_mom_change" for c in M)
    yoy = ", ".join(
        f"{r6(div(f'{c} - LAG({c}, 12) OVER {w}', f'LAG({c}, 12) OVER {w}') + ' * 100')} AS {c}_yoy_change" for c in M)
    sql = f"""{FACT},
m AS (SELECT year_month, {sums()} FROM fact WHERE year_month IS NOT NULL GROUP BY year_month),
t AS (
SELECT year_month, {cols}, {mom}, {yoy},
       {r6(f'CASE WHEN COUNT(*) OVER {w3} = 3 THEN AVG(CAST(total_enrollment AS DOUBLE)) OVER {w3} END')} AS total_ma_3m,
       {r6(f'CASE WHEN COUNT(*) OVER {w6} = 6 THEN AVG(CAST(total_enrollment AS DOUBLE)) OVER {w6} END')} AS total_ma_6m
FROM m
WINDOW {w} AS (ORDER BY year_month),
       {w3} AS (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       {w6} AS (ORDER BY year_month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT * FROM t"""
    return sql + (" ORDER BY year_month DESC LIMIT 12" if limit else "")


@register("monthly_trends", _trend_sql(False))
def q_monthly_trends(spark, sf_dir):
    return D.monthly_trends(fact(spark, sf_dir))


@register("monthly_trends_last12", _trend_sql(True))
def q_monthly_trends_last12(spark, sf_dir):
    return D.last_months(D.monthly_trends(fact(spark, sf_dir)), 12)


# --- D6-D10 ------------------------------------------------------------------------

@register("top_states",
          f"{FACT} SELECT state, {sums()} FROM fact WHERE state IS NOT NULL GROUP BY state "
          f"ORDER BY total_enrollment DESC, state LIMIT 10")
def q_top_states(spark, sf_dir):
    return D.top_states(fact(spark, sf_dir))


@register("top_districts",
          f"{FACT} SELECT state, district, {sums()} FROM fact WHERE state IS NOT NULL AND district IS NOT NULL "
          f"GROUP BY state, district ORDER BY total_enrollment DESC, state, district LIMIT 20")
def q_top_districts(spark, sf_dir):
    return D.top_districts(fact(spark, sf_dir))


_GINI_SQL = f"""{FACT},
s AS (SELECT state, CAST(COALESCE(SUM(total_enrollment), 0) AS DOUBLE) AS x FROM fact
      WHERE state IS NOT NULL GROUP BY state),
r AS (SELECT x, ROW_NUMBER() OVER (ORDER BY x) AS i FROM s),
g AS (SELECT 2 * SUM(i * x) / (COUNT(*) * NULLIF(SUM(x), 0)) - (COUNT(*) + 1.0) / COUNT(*) AS gini FROM r)
SELECT {rnd('gini', 3)} AS gini_coefficient,
       CASE WHEN gini < 0.3 THEN 'Low inequality - relatively uniform distribution'
            WHEN gini < 0.5 THEN 'Moderate inequality - some concentration'
            ELSE 'High inequality - significant concentration' END AS interpretation
FROM g"""


@register("gini_states", _GINI_SQL)
def q_gini_states(spark, sf_dir):
    return D.gini_states(fact(spark, sf_dir))


@register("coverage",
          f"{FACT} SELECT COUNT(DISTINCT state) AS num_states, COUNT(DISTINCT district) AS num_districts, "
          f"COUNT(DISTINCT pincode) AS num_pincodes FROM fact")
def q_coverage(spark, sf_dir):
    return D.coverage(fact(spark, sf_dir))


# --- D11-D15 -----------------------------------------------------------------------

_AGE_OVERALL_SQL = f"""{FACT},
s AS (SELECT {sums(MS)} FROM fact),
l AS ({' UNION ALL '.join(f"SELECT '{m}' AS age_group, {m} AS total, {' + '.join(MS)} AS grand_total FROM s" for m in MS)})
SELECT age_group, total, {rnd(div('total', 'grand_total') + ' * 100', 2)} AS proportion, grand_total FROM l"""


@register("age_mix_overall", _AGE_OVERALL_SQL)
def q_age_overall(spark, sf_dir):
    return D.age_mix_overall(fact(spark, sf_dir))


_AGE_STATE_CTE = f"""{FACT},
s0 AS (SELECT state, {sums(MS)} FROM fact WHERE state IS NOT NULL GROUP BY state),
s AS (SELECT *, {' + '.join(MS)} AS total, {', '.join(f"{rnd(div(m, ' + '.join(MS)) + ' * 100', 2)} AS pct_{m}" for m in MS)} FROM s0)"""


@register("age_mix_by_state", f"{_AGE_STATE_CTE} SELECT * FROM s")
def q_age_state(spark, sf_dir):
    return D.age_mix_by_state(fact(spark, sf_dir))


@register("child_heavy_states",
          f"{_AGE_STATE_CTE} SELECT state, {r6(' + '.join(f'pct_{m}' for m in S.children))} AS child_pct FROM s "
          f"ORDER BY child_pct DESC, state LIMIT 5")
def q_child_heavy(spark, sf_dir):
    return D.child_heavy_states(fact(spark, sf_dir))


@register("adult_heavy_states",
          f"{_AGE_STATE_CTE} SELECT state, pct_{S.adults[0]} FROM s ORDER BY pct_{S.adults[0]} DESC, state LIMIT 5")
def q_adult_heavy(spark, sf_dir):
    return D.adult_heavy_states(fact(spark, sf_dir))


_KIDS = " + ".join(f"COALESCE(SUM({m}), 0)" for m in S.children)
_ADULTS = " + ".join(f"COALESCE(SUM({m}), 0)" for m in S.adults)


@register("child_adult_ratio", f"""{FACT},
t AS (SELECT CAST({_KIDS} AS BIGINT) AS children, CAST({_ADULTS} AS BIGINT) AS adults FROM fact),
u AS (SELECT *, COALESCE({rnd(div('children', 'adults'), 2)}, 0.0) AS child_adult_ratio FROM t)
SELECT *, CASE WHEN child_adult_ratio > 1.5 THEN 'Critical - High Child/Adult Skew'
               WHEN child_adult_ratio > 1.0 THEN 'Moderate' ELSE 'Low' END AS adult_inclusion_gap FROM u""")
def q_child_adult(spark, sf_dir):
    return D.child_adult_ratio(fact(spark, sf_dir))


# --- D16-D20 -----------------------------------------------------------------------

_DISTRICT_CTE = f"""{FACT},
d0 AS (SELECT state, district, {sums()} FROM fact WHERE state IS NOT NULL AND district IS NOT NULL
       GROUP BY state, district),
d AS (SELECT *, {' + '.join(S.children)} AS children,
             {r6(div(' + '.join(S.children), ' + '.join(S.adults)))} AS child_adult_ratio FROM d0)"""


@register("district_inequity", f"{_DISTRICT_CTE} SELECT * FROM d")
def q_district_inequity(spark, sf_dir):
    return D.district_inequity(fact(spark, sf_dir))


@register("high_ratio_districts",
          f"{_DISTRICT_CTE} SELECT * FROM d WHERE child_adult_ratio > 2.0 "
          f"ORDER BY child_adult_ratio DESC, state, district LIMIT 20")
def q_high_ratio(spark, sf_dir):
    return D.high_ratio_districts(fact(spark, sf_dir))


_UNDER = ("SELECT * FROM d WHERE CAST(total_enrollment AS DOUBLE) < "
          "(SELECT quantile_cont(CAST(total_enrollment AS DOUBLE), 0.5) FROM d) * 0.5")


@register("underserved_districts", f"{_DISTRICT_CTE} {_UNDER}")
def q_underserved(spark, sf_dir):
    return D.underserved_districts(fact(spark, sf_dir))


_INEQ_CTE = f"""{_DISTRICT_CTE},
u AS ({_UNDER}),
s AS (SELECT COUNT(*) AS total_districts,
             CAST(TRUNC(quantile_cont(CAST(total_enrollment AS DOUBLE), 0.5)) AS BIGINT) AS median_enrollment,
             stddev_samp(CAST(total_enrollment AS DOUBLE)) / NULLIF(AVG(CAST(total_enrollment AS DOUBLE)), 0) AS cv,
             (SELECT COUNT(*) FROM u) AS underserved_count FROM d)"""


@register("inequity_summary", f"{_INEQ_CTE} SELECT total_districts, median_enrollment, {rnd('cv', 3)} AS coefficient_of_variation, "
                              f"underserved_count FROM s")
def q_inequity_summary(spark, sf_dir):
    return D.inequity_summary(fact(spark, sf_dir))


def _ineq_recs(facts: str) -> str:
    few, some, cv = INEQUITY_TEXTS
    return f"""r AS (
  SELECT 1 AS rank, printf('{few}', underserved_count) AS recommendation FROM {facts} WHERE underserved_count > 100
  UNION ALL SELECT 2, printf('{some}', underserved_count) FROM {facts} WHERE underserved_count > 50 AND underserved_count <= 100
  UNION ALL SELECT 3, printf('{cv}', {rnd('cv', 2)}) FROM {facts} WHERE cv > 1.0)
SELECT * FROM r UNION ALL SELECT 4, '{INEQUITY_FINE}' WHERE NOT EXISTS (SELECT 1 FROM r)"""


@register("inequity_recommendations", f"{_INEQ_CTE},\n{_ineq_recs('s')}")
def q_inequity_recs(spark, sf_dir):
    return D.inequity_recommendations(D.inequity_facts(fact(spark, sf_dir)))


@register("inequity_recommendations_rules", f"{_INEQ_CTE},\nt AS (SELECT cv * 20 AS cv, underserved_count + 101 AS underserved_count "
                                            f"FROM s),\n{_ineq_recs('t')}")
def q_inequity_rules(spark, sf_dir):
    """D20 with the facts raised so that the conditional rules fire."""
    f = D.inequity_facts(fact(spark, sf_dir))
    return D.inequity_recommendations(f.withColumns({"cv": F.col("cv") * 20, "underserved_count": F.col("underserved_count") + 101}))


# --- D26 ---------------------------------------------------------------------------

def _summary_sql() -> str:
    parts = []
    for c in M:
        x = f"CAST({c} AS DOUBLE)"
        qs = ", ".join(f"{rnd(f'quantile_cont({x}, {f})', 2)} AS p{int(round(f * 100))}" for f in D.SUMMARY_FRACTIONS)
        parts.append(
            f"SELECT '{c}' AS column_name, COUNT({c}) AS count, CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS sum, "
            f"{rnd(f'AVG({x})', 2)} AS mean, {rnd(f'quantile_cont({x}, 0.5)', 2)} AS median, "
            f"{rnd(f'stddev_samp({x})', 2)} AS std, CAST(MIN({c}) AS BIGINT) AS min, CAST(MAX({c}) AS BIGINT) AS max, "
            f"{qs} FROM dirty")
    return f"{DIRTY} " + " UNION ALL ".join(parts)


@register("summary_statistics", _summary_sql())
def q_summary_statistics(spark, sf_dir):
    """D26 over the view with defects (nulls and negatives in the measures)."""
    return D.summary_statistics(dirty(spark, sf_dir))

