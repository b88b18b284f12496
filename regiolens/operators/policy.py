"""Policy impact.

Inputs are district-level tables (one row per state/district).  Maxima,
medians and deviations over districts enter as scalar subqueries; the
optional inputs (inequity ratio, forecast demand, per-district DRI) are LEFT
joins on (state, district).  Scenarios are evaluated together in one
aggregate with one conditional sum per scenario (no cross join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolens.functions.exprs import flag, ratio, rule_rows
from regiolens.params import DEFAULT_PARAMS, POLICY_TEXTS, PRIORITY_TIERS, Params, Scenario
from regiolens.plans import marts
from regiolens.schema import DEFAULT_SCHEMA, FactSchema


def district_data(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """District totals and child/adult ratio, zero adults counted as one."""
    d = marts.district_totals(fact, schema)
    kids = sum(F.col(m) for m in schema.children)
    adults = sum(F.col(m) for m in schema.adults)
    return d.withColumn("child_adult_ratio", ratio(kids, F.when(adults == 0, F.lit(1)).otherwise(adults)))


def _scalar(df: DataFrame, expr: Column) -> Column:
    return df.select(expr).scalar()


def tier_expr(score: Column) -> Column:
    """(0,25] Low, (25,50] Medium, (50,75] High, (75,100] Critical; else NULL."""
    out = None
    lo = 0.0
    for name, hi in PRIORITY_TIERS:
        cond = (score > lo) & (score <= hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
        lo = hi
    return out


def priority_scores(district: DataFrame, inequity: DataFrame | None = None, forecast: DataFrame | None = None,
                    dri_scores: DataFrame | None = None, schema: FactSchema = DEFAULT_SCHEMA,
                    params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Component scores, weighted priority scaled to 100, tier, resources.

    ``inequity``: (state, district, child_adult_ratio); ``forecast``: (state,
    district, forecasted_enrollment); ``dri_scores``: (state, district,
    dri_score).  A missing input gives a 0 component, as in the reference; the
    inequity input replaces a ratio column already on ``district`` (R13).
    """
    geo = list(schema.geo)
    t = F.col(schema.total).cast("double")
    p = district
    if inequity is not None:
        p = p.drop("child_adult_ratio").join(inequity.select(*geo, "child_adult_ratio"), geo, "left")
    if forecast is not None:
        p = p.join(forecast.select(*geo, "forecasted_enrollment"), geo, "left")
    if dri_scores is not None:
        p = p.join(dri_scores.select(*geo, "dri_score"), geo, "left")
    enrollment = F.lit(1.0) - F.try_divide(t, _scalar(district, F.max(t)))
    if inequity is not None:
        r = F.col("child_adult_ratio")
        st = _scalar(p, F.struct(F.percentile(r, 0.5).alias("med"), F.stddev_samp(r).alias("sd")))  # one pass
        inequity_s = F.coalesce(F.try_divide(F.abs(r - st["med"]), st["sd"]), F.lit(0.0))
    else:
        inequity_s = F.lit(0.0)
    if forecast is not None:
        fc = F.col("forecasted_enrollment").cast("double")
        forecast_s = F.coalesce(F.try_divide(fc, _scalar(p, F.max(fc))), F.lit(0.0))
    else:
        forecast_s = F.lit(0.0)
    dri_s = (F.lit(1.0) - F.coalesce(F.col("dri_score"), F.lit(params.default_dri))) if dri_scores is not None \
        else F.lit(0.0)
    w1, w2, w3, w4 = params.priority_weights
    p = p.withColumns({"enrollment_score": enrollment, "inequity_score": inequity_s,
                       "forecast_score": forecast_s, "dri_priority_score": dri_s})
    raw = (w1 * F.col("enrollment_score") + w2 * F.col("inequity_score") + w3 * F.col("forecast_score")
           + w4 * F.col("dri_priority_score"))
    p = p.withColumn("_raw", raw)
    score = F.round(F.try_divide(F.col("_raw"), _scalar(p, F.max("_raw"))) * 100, 2)
    p = p.withColumn("priority_score", score).drop("_raw")
    return p.withColumns({
        "priority_tier": tier_expr(F.col("priority_score")),
        "required_centers": F.ceil(t / params.enrollment_per_center).cast("long"),
        "required_staff": F.ceil(t / params.enrollment_per_staff).cast("long"),
    })


def tier_summary(priority: DataFrame) -> DataFrame:
    """Sums per tier; all four tiers present (0 when empty)."""
    spark = priority.sparkSession
    tiers = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(PRIORITY_TIERS)],
                                  "priority_tier string, tier_rank int")
    g = priority.where(F.col("priority_tier").isNotNull()).groupBy("priority_tier").agg(
        F.sum("total_enrollment").cast("long").alias("total_enrollment"),
        F.sum("required_centers").cast("long").alias("required_centers"),
        F.sum("required_staff").cast("long").alias("required_staff"),
        F.count(F.lit(1)).alias("num_districts"))
    out = F.broadcast(tiers).join(g, "priority_tier", "left")  # 4-row literal side
    return out.select("priority_tier", "tier_rank",
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                        for c in ("total_enrollment", "required_centers", "required_staff", "num_districts")])


def top_priority(priority: DataFrame, n: int = 50, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """P10: the ``n`` highest priority districts (ties by keys)."""
    return priority.orderBy(F.col("priority_score").desc_nulls_last(), schema.state, schema.district).limit(n).select(
        schema.state, schema.district, schema.total, "priority_score", "priority_tier", "required_centers",
        "required_staff")


def resource_totals(priority: DataFrame) -> DataFrame:
    """Total centers, staff and critical districts."""
    return priority.agg(F.coalesce(F.sum("required_centers"), F.lit(0)).cast("long").alias("total_required_centers"),
                        F.coalesce(F.sum("required_staff"), F.lit(0)).cast("long").alias("total_required_staff"),
                        F.count_if(F.col("priority_tier") == "Critical").alias("critical_districts"))


def allocation_strategy(summary: DataFrame) -> DataFrame:
    """Strategy lines for the Critical and High tiers that have districts."""
    s = summary.where(F.col("num_districts") > 0)
    crit = s.where(F.col("priority_tier") == "Critical").select(
        F.lit(1).alias("rank"),
        F.format_string("PRIORITY 1: Allocate %d centers and %d staff to %d critical districts",
                        "required_centers", "required_staff", "num_districts").alias("strategy"))
    high = s.where(F.col("priority_tier") == "High").select(
        F.lit(2).alias("rank"),
        F.format_string("PRIORITY 2: Deploy %d centers to %d high-priority districts",
                        "required_centers", "num_districts").alias("strategy"))
    both = crit.unionByName(high)
    none = summary.agg(F.count_if((F.col("num_districts") > 0) & F.col("priority_tier").isin("Critical", "High"))
                       .alias("_n")).where(F.col("_n") == 0).select(
        F.lit(3).alias("rank"), F.lit("No critical resource allocation needs identified").alias("strategy"))
    return both.unionByName(none)


# --- P13-P17 --------------------------------------------------------------------

INTERVENTION_COLS = ("state", "district", "total_enrollment", "intervention_type", "urgency", "recommended_action")
URGENCY_ORDER = ("Critical", "High", "Medium", "Low")


def _tag(df: DataFrame, kind: str, urgency: str, action: str, schema: FactSchema) -> DataFrame:
    return df.select(schema.state, schema.district, F.col(schema.total).cast("long").alias("total_enrollment"),
                     F.lit(kind).alias("intervention_type"), F.lit(urgency).alias("urgency"),
                     F.lit(action).alias("recommended_action"))


def interventions(district: DataFrame, anomalies: DataFrame | None = None, surges: DataFrame | None = None,
                  schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Low enrollment, high inequity, forecast surge, data quality.

    ``anomalies`` is a row table with ``severity_score`` (one intervention per
    row with severity >= 3, so a district may repeat); ``surges`` is (state,
    district) of districts with a forecast surge.
    """
    t = F.col(schema.total).cast("double")
    mean_total = _scalar(district, F.avg(t))
    parts = [_tag(district.where(t < mean_total * params.low_enrollment_fraction),
                  "Low Enrollment", "High", "Increase outreach and enrollment campaigns", schema)]
    if "child_adult_ratio" in district.columns:
        parts.append(_tag(district.where(F.col("child_adult_ratio") > params.inequity_high),
                          "High Inequity", "Medium", "Investigate demographic disparities", schema))
    if surges is not None:
        s = district.join(surges.select(*schema.geo).distinct(), list(schema.geo), "left_semi")
        parts.append(_tag(s, "Forecast Surge", "Critical", "Prepare additional capacity immediately", schema))
    if anomalies is not None:
        parts.append(_tag(anomalies.where(F.col("severity_score") >= 3), "Data Quality", "High",
                          "Audit enrollment processes and data collection", schema))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def intervention_counts(iv: DataFrame) -> DataFrame:
    """Counts by urgency and by type in one long table."""
    by_u = iv.groupBy(F.col("urgency").alias("value")).agg(F.count(F.lit(1)).alias("interventions")) \
        .select(F.lit("urgency").alias("dimension"), "value", "interventions")
    by_t = iv.groupBy(F.col("intervention_type").alias("value")).agg(F.count(F.lit(1)).alias("interventions")) \
        .select(F.lit("intervention_type").alias("dimension"), "value", "interventions")
    return by_u.unionByName(by_t)


def first_interventions(iv: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` interventions by urgency, type and district."""
    rank = F.array_position(F.array(*[F.lit(u) for u in URGENCY_ORDER]), F.col("urgency"))
    return iv.orderBy(rank, "intervention_type", "state", "district", F.col("total_enrollment").desc()).limit(n)


# --- P18-P19 --------------------------------------------------------------------

def policy_simulation(district: DataFrame, scenarios: Sequence[Scenario] | None = None,
                      schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Raise district totals by a percentage for all or listed districts.

    Every scenario is one conditional sum in a single aggregate.  Ruling R15:
    the simulated total is ``baseline + pct * targeted`` over exact integer
    sums, then truncated.  Summing ``total * (1 + pct)`` per district in floating
    point depends on the order of addition (100 at 15 % is 114.99..., cut to
    114, alone, and 115 beside other districts), so it has no result that holds
    for every partitioning; the exact sum has, and differs by at most one.
    """
    scenarios = list(params.scenarios if scenarios is None else scenarios)
    t = F.col(schema.total)
    aggs = [F.coalesce(F.sum(t), F.lit(0)).cast("long").alias("_base")]
    for i, s in enumerate(scenarios):
        hit = F.lit(True) if s.target_districts is None else F.col(schema.district).isin(list(s.target_districts))
        hit = flag(hit)
        aggs.append(F.coalesce(F.sum(F.when(hit, t).otherwise(0)), F.lit(0)).cast("long").alias(f"_t{i}"))
        aggs.append(F.count_if(hit & (t.cast("double") * (1 + s.enrollment_increase_pct / 100.0) > t)).alias(f"_a{i}"))
    one = district.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(s.name).alias("scenario"), F.lit(float(s.enrollment_increase_pct)).alias("enrollment_increase_pct"),
                 F.lit(",".join(s.target_districts) if s.target_districts is not None else "all").alias("target_districts"),
                 F.col(f"_t{i}").alias("_targeted"), F.col(f"_a{i}").alias("districts_affected"))
        for i, s in enumerate(scenarios)])
    long = one.select("_base", F.inline(rows))
    inc = F.col("_targeted").cast("double") * (F.col("enrollment_increase_pct") / 100.0)
    simulated = F.col("_base").cast("double") + inc
    return long.select(
        "scenario", "enrollment_increase_pct", "target_districts",
        F.col("_base").alias("baseline_enrollment"),
        simulated.cast("long").alias("simulated_enrollment"),
        (simulated - F.col("_base").cast("double")).cast("long").alias("absolute_increase"),
        F.coalesce(F.round(ratio(simulated - F.col("_base").cast("double"), "_base") * 100, 2), F.lit(0.0))
        .alias("percentage_increase"),
        F.ceil((simulated - F.col("_base").cast("double")) / params.enrollment_per_center).cast("long")
        .alias("additional_centers"),
        F.ceil((simulated - F.col("_base").cast("double")) / params.enrollment_per_staff).cast("long")
        .alias("additional_staff"),
        "districts_affected")


# --- P20-P22 --------------------------------------------------------------------

def tier_distribution(priority: DataFrame) -> DataFrame:
    """P20: districts per tier (districts without a tier are not counted)."""
    return priority.where(F.col("priority_tier").isNotNull()).groupBy("priority_tier").agg(
        F.count(F.lit(1)).alias("num_districts"))


def strategic_recommendations(totals: DataFrame, iv: DataFrame) -> DataFrame:
    """Rule texts over resource totals and critical interventions."""
    crit_iv = iv.select(F.count_if(F.col("urgency") == "Critical")).scalar()
    t = totals.withColumn("immediate_action_required", crit_iv)
    c, centers, imm = F.col("critical_districts"), F.col("total_required_centers"), F.col("immediate_action_required")
    urgent, large, critical, always = POLICY_TEXTS
    rules = [
        (c > 0, F.format_string(urgent, c)),
        (centers > 1000, F.format_string(large, centers)),
        (imm > 0, F.format_string(critical, imm)),
        (F.lit(True), F.lit(always)),
    ]
    return t.select(F.inline(rule_rows(rules)))
