"""Descriptive analytics.

Scalar thresholds (medians, maxima) enter as scalar subqueries
(``DataFrame.scalar()``): Spark computes them once and inlines the value, so no
cross join and no driver round trip is needed.  Windows only ever run over
aggregates (one row per month / state / district), never over the raw fact,
and are partitioned by the series keys when there are several series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiolens.functions.exprs import pct_change, percentiles, ratio, rule_rows, sum0
from regiolens.functions.ranks import exact_percentiles
from regiolens.params import DEFAULT_PARAMS, INEQUITY_FINE, INEQUITY_TEXTS, Params
from regiolens.plans import marts
from regiolens.schema import DEFAULT_SCHEMA, FactSchema


# --- D1-D5: monthly trends ---------------------------------------------------

def full_window_avg(c: str, w, n: int):
    """Rolling mean over ``n`` rows that is NULL until the window is full."""
    return F.when(F.count(F.lit(1)).over(w) == n, F.avg(F.col(c).cast("double")).over(w))


def monthly_trends(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, keys: Sequence[str] = (),
                   calendar: bool = False) -> DataFrame:
    """Monthly sums of M, month-over-month and 12-rows-back change, 3/6-month MA.

    By default "12 rows back" follows the reference (ruling R4); with
    ``calendar=True`` missing months are added and interpolated first (F2/F3),
    so the lag is 12 calendar months.
    """
    cols = schema.present_all(fact)
    if calendar:
        from regiolens.operators.series import DS, prepare_series

        monthly = prepare_series(fact, "M", keys, cols, schema).drop("observed").withColumnRenamed(
            DS, schema.year_month)
    else:
        monthly = marts.monthly_totals(fact, schema, keys)
    w = Window.partitionBy(*keys).orderBy(schema.year_month)
    out = monthly.select(
        *keys, schema.year_month, *cols,
        *[pct_change(c, F.lag(c, 1).over(w)).alias(f"{c}_mom_change") for c in cols],
        *[pct_change(c, F.lag(c, 12).over(w)).alias(f"{c}_yoy_change") for c in cols],
        full_window_avg(schema.total, w.rowsBetween(-2, 0), 3).alias("total_ma_3m"),
        full_window_avg(schema.total, w.rowsBetween(-5, 0), 6).alias("total_ma_6m"),
    )
    return out


def last_months(trends: DataFrame, n: int = 12, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """The last ``n`` months of the trend table."""
    return trends.orderBy(F.col(schema.year_month).desc()).limit(n)


# --- D6-D10: geography ---------------------------------------------------------

def top_states(fact: DataFrame, n: int | None = None, schema: FactSchema = DEFAULT_SCHEMA,
               params: Params = DEFAULT_PARAMS) -> DataFrame:
    n = params.top_n_states if n is None else n
    return marts.state_totals(fact, schema).orderBy(F.col(schema.total).desc(), schema.state).limit(n)


def top_districts(fact: DataFrame, n: int | None = None, schema: FactSchema = DEFAULT_SCHEMA,
                  params: Params = DEFAULT_PARAMS) -> DataFrame:
    n = params.top_n_districts if n is None else n
    return marts.district_totals(fact, schema).orderBy(
        F.col(schema.total).desc(), schema.state, schema.district).limit(n)


SPLITS = 1000  # ranges that one cut makes of one


def _split_ranges(placed: DataFrame, by: Sequence[str], per_range: int) -> DataFrame:
    """``placed`` with every range of more than ``per_range`` values cut at
    approximate quantiles of its values."""
    size = F.count(F.lit(1))
    pieces = F.least(F.lit(SPLITS), F.ceil(2 * size / F.lit(per_range))).cast("int")
    grid = [i / SPLITS for i in range(1, SPLITS)]
    big = placed.groupBy(*by, "_r").agg(size.alias("_n"), pieces.alias("_k"), F.percentile_approx("_x", grid, 10_000).alias("_q")).where(
        F.col("_n") > per_range)
    step = F.greatest(F.lit(1), F.floor(F.lit(SPLITS) / F.col("_k"))).cast("int")
    cuts = big.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_r").alias("_k_r"),
                      F.array_distinct(F.filter("_q", lambda v, i: (i + 1) % step == 0)).alias("_b"))
    same = F.col("_r") == F.col("_k_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    finer = F.array_append("_r", F.size(F.filter("_b", lambda v: v < F.col("_x"))))
    return placed.join(cuts, same, "left").select(*by, "_x", "_c", F.when(F.col("_b").isNull(), F.col("_r")).otherwise(finer).alias("_r"))


def gini(df: DataFrame, value: str, by: Sequence[str] = (), per_range: int = 20_000) -> DataFrame:
    """Gini coefficient ``2*sum(i*x_(i)) / (n*sum x) - (n+1)/n`` per ``by`` group.

    Ties are collapsed first (``groupBy(by, value).count()``); equal values get
    consecutive ranks, whose contribution is ``x * (c*before + c*(c+1)/2)``.
    Distinct values are cut into ranges at approximate quantiles, and ranges that
    still hold more than ``per_range`` of them are cut again, so no window sees
    more, whatever the number of values.  The counts of the ranges before (a
    prefix sum over the table of ranges) plus the counts before a value inside
    its range give its rank.
    """
    x = F.col("_x")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).cast("double").alias("_c"))
    placed = counts.withColumn("_r", F.expr("cast(array() as array<int>)"))  # the cuts that led to a value's range
    for _ in range(64):
        most = placed.groupBy(*by, "_r").count().agg(F.max("count")).first()[0] or 0
        if most <= per_range:
            break
        placed = _split_ranges(placed, by, per_range)
    sizes = placed.groupBy(*by, "_r").agg(F.sum("_c").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col("_r").alias("_s_r"),
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0.0)).alias("_start"))
    inside = Window.partitionBy(*by, "_r").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("_r") == F.col("_s_r")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    ranked = placed.withColumn("_before", F.coalesce(F.sum("_c").over(inside), F.lit(0.0))).join(starts, match)
    before, c = F.col("_start") + F.col("_before"), F.col("_c")
    agg = ranked.groupBy(*by).agg(F.sum(x * (c * before + c * (c + 1) / 2)).alias("_s"), F.sum("_c").alias("_n"),
                                  F.sum(x * c).alias("_t"))
    g = F.try_divide(2 * F.col("_s"), F.col("_n") * F.col("_t")) - (F.col("_n") + 1) / F.col("_n")
    return agg.select(*by, g.alias("gini"))


def interpret_gini(g) -> F.Column:
    g = F.col(g) if isinstance(g, str) else g
    return (F.when(g < 0.3, "Low inequality - relatively uniform distribution")
            .when(g < 0.5, "Moderate inequality - some concentration")
            .otherwise("High inequality - significant concentration"))


def gini_states(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    g = gini(marts.state_totals(fact, schema), schema.total)
    return g.select(F.round("gini", 3).alias("gini_coefficient"),
                    interpret_gini("gini").alias("interpretation"))


def coverage(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, approx: bool = False) -> DataFrame:
    """Distinct states, district names and PINs (NULLs not counted).

    Spark plans the three distinct counts with one Expand; partial aggregation
    then removes duplicate (column, value) pairs in every task, so only the
    distinct values of each partition reach the shuffle.
    """
    cd = F.approx_count_distinct if approx else F.count_distinct
    return fact.agg(cd(schema.state).alias("num_states"), cd(schema.district).alias("num_districts"),
                    cd(schema.unit).alias("num_pincodes"))


# --- D11-D15: age mix ----------------------------------------------------------

def age_mix_overall(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Total and share (2 decimals) of each age column, plus the grand total."""
    ms = schema.present_measures(fact)
    sums = fact.agg(*[sum0(m).alias(m) for m in ms])
    grand = sum(F.col(m) for m in ms)
    stacked = sums.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("age_group"), F.col(m).alias("total")) for m in ms])),
        grand.alias("grand_total"))
    return stacked.select("age_group", "total",
                          F.round(ratio("total", "grand_total") * 100, 2).alias("proportion"), "grand_total")


def age_mix_by_state(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Per-state sums of the age columns and their shares (2 decimals)."""
    ms = schema.present_measures(fact)
    st = marts.group_totals(fact, [schema.state], ms, schema)
    st = st.withColumn("total", sum(F.col(m) for m in ms))
    return st.select(schema.state, *ms, "total",
                     *[F.round(ratio(m, "total") * 100, 2).alias(f"pct_{m}") for m in ms])


def child_heavy_states(fact: DataFrame, n: int = 5, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """States with the largest sum of the rounded child shares."""
    st = age_mix_by_state(fact, schema)
    child = sum(F.col(f"pct_{m}") for m in schema.children)
    return st.select(schema.state, child.alias("child_pct")).orderBy(
        F.col("child_pct").desc(), schema.state).limit(n)


def adult_heavy_states(fact: DataFrame, n: int = 5, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    st = age_mix_by_state(fact, schema)
    a = f"pct_{schema.adults[0]}"
    return st.select(schema.state, F.col(a)).orderBy(F.col(a).desc(), schema.state).limit(n)


def child_adult_ratio(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Children / adults (2 decimals; 0 without adults) and the gap class."""
    kids = sum(sum0(m) for m in schema.children)
    adults = sum(sum0(m) for m in schema.adults)
    t = fact.agg(kids.alias("children"), adults.alias("adults"))
    r = F.coalesce(F.round(ratio("children", "adults"), 2), F.lit(0.0))
    t = t.withColumn("child_adult_ratio", r)
    gap = (F.when(F.col("child_adult_ratio") > 1.5, "Critical - High Child/Adult Skew")
           .when(F.col("child_adult_ratio") > 1.0, "Moderate").otherwise("Low"))
    return t.withColumn("adult_inclusion_gap", gap)


# --- D16-D20: inequity ------------------------------------------------------------

def district_inequity(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """District totals, children and child/adult ratio (NULL without adults)."""
    d = marts.district_totals(fact, schema)
    kids = sum(F.col(m) for m in schema.children)
    adults = sum(F.col(m) for m in schema.adults)
    return d.withColumn("children", kids).withColumn("child_adult_ratio", ratio(kids, adults))


def high_ratio_districts(fact: DataFrame, n: int | None = None, schema: FactSchema = DEFAULT_SCHEMA,
                         params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Districts with child/adult ratio above the threshold, largest first."""
    n = params.top_n_districts if n is None else n
    d = district_inequity(fact, schema)
    return d.where(F.col("child_adult_ratio") > params.child_adult_ratio_threshold).orderBy(
        F.col("child_adult_ratio").desc(), schema.state, schema.district).limit(n)


def _median_total(d: DataFrame, schema: FactSchema):
    return F.lit(exact_percentiles(d, {schema.total: [0.5]})[schema.total][0]).cast("double")


def underserved_districts(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA,
                          params: Params = DEFAULT_PARAMS, limit: int | None = None) -> DataFrame:
    """Districts below ``fraction * median`` district total, smallest first.

    The whole list is returned; ``limit`` reproduces the reference's capped list.
    """
    d = district_inequity(fact, schema)
    thr = _median_total(marts.district_totals(fact, schema), schema) * F.lit(params.underserved_fraction)
    out = d.where(F.col(schema.total).cast("double") < thr).orderBy(schema.total, schema.state, schema.district)
    return out.limit(limit) if limit else out


def inequity_facts(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """One row: district count, median district total (truncated), unrounded CV,
    and the uncapped number of underserved districts."""
    d = marts.district_totals(fact, schema)
    t = F.col(schema.total).cast("double")
    s = d.agg(F.count(F.lit(1)).alias("total_districts"),
              _median_total(d, schema).alias("_median"),
              F.try_divide(F.stddev_samp(t), F.avg(t)).alias("cv"))
    n_under = underserved_districts(fact, schema, params).select(F.count(F.lit(1))).scalar()
    return s.select("total_districts", F.col("_median").cast("long").alias("median_enrollment"), "cv",
                    n_under.alias("underserved_count"))


def inequity_summary(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA,
                     params: Params = DEFAULT_PARAMS) -> DataFrame:
    """The inequity row with the CV rounded to 3 decimals."""
    return rounded_inequity(inequity_facts(fact, schema, params))


def rounded_inequity(facts: DataFrame) -> DataFrame:
    return facts.select("total_districts", "median_enrollment", F.round("cv", 3).alias("coefficient_of_variation"),
                        "underserved_count")


def inequity_recommendations(facts: DataFrame) -> DataFrame:
    """Rule texts over :func:`inequity_facts`; the CV rule takes the
    unrounded value."""
    n, cv = F.col("underserved_count"), F.col("cv")
    few, some, cv_text = INEQUITY_TEXTS
    rules = [
        (n > 100, F.format_string(few, n)),
        ((n > 50) & (n <= 100), F.format_string(some, n)),
        (cv > 1.0, F.format_string(cv_text, cv)),
    ]
    return facts.select(F.inline(rule_rows(rules, fallback=INEQUITY_FINE)))


# --- D26: summary statistics ------------------------------------------------------

SUMMARY_FRACTIONS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def summary_statistics(fact: DataFrame, schema: FactSchema = DEFAULT_SCHEMA,
                       params: Params = DEFAULT_PARAMS) -> DataFrame:
    """One row per M column: count, sum, mean, median, std, min, max, percentiles."""
    cols = schema.present_all(fact)
    exact = None if params.approx_percentiles else exact_percentiles(fact, {c: SUMMARY_FRACTIONS for c in cols})
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        q = marts.known_percentiles(exact[c]) if exact else percentiles(c, SUMMARY_FRACTIONS, True, params.approx_accuracy)
        aggs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.count(c).alias("count"),
            sum0(c).alias("sum"),
            F.round(F.avg(x), 2).alias("mean"),
            F.round(F.stddev_samp(x), 2).alias("std"),
            F.min(c).cast("long").alias("min"),
            F.max(c).cast("long").alias("max"),
            q.alias("q"),
        ).alias(c))
    one = fact.agg(*aggs)
    long = one.select(F.inline(F.array(*[F.col(c) for c in cols])))
    qcols = [F.round(F.col("q")[i], 2).alias(f"p{int(round(f * 100))}") for i, f in enumerate(SUMMARY_FRACTIONS)]
    median = F.round(F.col("q")[SUMMARY_FRACTIONS.index(0.5)], 2).alias("median")
    return long.select("column_name", "count", "sum", "mean", median, "std", "min", "max", *qcols)
