"""Registered queries: clustering, isolation forest and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolens.operators import anomaly as A
from regiolens.operators import cluster as C
from regiolens.operators import describe as D
from regiolens.operators import iforest as IF
from regiolens.operators import report as R
from regiolens.params import DEFAULT_PARAMS as P
from regiolens.plans.fact_store import stored
from regiolens.plans.oracle_sql import DIRTY, FACT, MS, r6
from regiolens.plans.q_anomaly import SEV_COLS
from regiolens.plans.q_describe import dirty, fact
from regiolens.plans.registry import register
from regiolens.schema import DEFAULT_SCHEMA as S


@register("pincode_totals", f"{FACT} SELECT pincode, {', '.join(f'CAST(COALESCE(SUM({m}), 0) AS BIGINT) AS {m}' for m in MS)} "
                            f"FROM fact WHERE pincode IS NOT NULL GROUP BY pincode "
                            f"HAVING {' + '.join(f'COALESCE(SUM({m}), 0)' for m in MS)} > 0")
def q_pincode_totals(spark, sf_dir):
    """Age sums per PIN code with a positive sum."""
    return C.pincode_totals(fact(spark, sf_dir))


@register("pincode_clusters")
def q_pincode_clusters(spark, sf_dir):
    """K-Means (k=5, 10 seeds, lowest cost) on standardised PIN totals."""
    return clusters_table(spark, sf_dir)


def clusters_table(spark, sf_dir):
    """PIN cluster labels, fitted once per session."""
    return stored(spark, "pincode_clusters", (sf_dir,), lambda: C.pincode_clusters(fact(spark, sf_dir)))


def forest_table(spark, sf_dir):
    """Forest score and flag per row, fitted once per session."""
    return stored(spark, "isolation_forest", (sf_dir,), lambda: IF.isolation_forest(fact(spark, sf_dir)))


@register("cluster_summary")
def q_cluster_summary(spark, sf_dir):
    """Size, means, totals and label per cluster."""
    return C.cluster_summary(clusters_table(spark, sf_dir))


RULE_LIMITS = (300, 600, 1200, 3000)  # totals that bound the labels of cluster_summary_by_rule


def _rule_summary_sql() -> str:
    total = " + ".join(MS)
    label = "CASE " + " ".join(f"WHEN {total} < {x} THEN {i}" for i, x in enumerate(RULE_LIMITS)) + f" ELSE {len(RULE_LIMITS)} END"
    names = {m: m.replace("age_", "").replace("_", "-") for m in MS}
    best = f"GREATEST({', '.join(f'SUM({m})' for m in MS)})"
    dominant = "CASE " + " ".join(f"WHEN SUM({m}) = {best} THEN '{n}'" for m, n in names.items()) + " END"
    size = (f"CASE WHEN AVG({total}) > 10000 THEN 'High-enrollment' WHEN AVG({total}) > 1000 THEN 'Medium-enrollment' "
            f"ELSE 'Low-enrollment' END")
    return f"""{FACT},
p AS (SELECT pincode, {', '.join(f'CAST(COALESCE(SUM({m}), 0) AS BIGINT) AS {m}' for m in MS)} FROM fact WHERE pincode IS NOT NULL GROUP BY pincode),
l AS (SELECT *, {label} AS cluster FROM p WHERE {total} > 0)
SELECT CAST(cluster AS BIGINT) AS cluster, COUNT(*) AS size, {', '.join(f'CAST(TRUNC(AVG({m})) AS BIGINT) AS avg_{m}' for m in MS)},
       {', '.join(f'CAST(SUM({m}) AS BIGINT) AS total_{m}' for m in MS)}, {size} || ', ' || {dominant} || '-dominant' AS characteristics
FROM l GROUP BY cluster"""


@register("cluster_summary_by_rule", _rule_summary_sql())
def q_cluster_summary_rule(spark, sf_dir):
    """D24-D25 on labels that a rule gives (bounds of a PIN's total), which SQL can follow."""
    pins = C.pincode_totals(fact(spark, sf_dir))
    total = sum(F.col(m) for m in MS)
    label = F.lit(len(RULE_LIMITS))
    for i, x in reversed(list(enumerate(RULE_LIMITS))):
        label = F.when(total < x, i).otherwise(label)
    return C.cluster_summary(pins.withColumn("cluster", label))


@register("isolation_forest")
def q_isolation_forest(spark, sf_dir):
    """Forest score and flag for every row (300 trees, 256 samples, 4%)."""
    return forest_table(spark, sf_dir).select(S.record_id, "ml_anomaly_score", "ml_is_anomaly")


@register("forest_row_check", f"""{DIRTY} SELECT COUNT(*) AS rows_in, COUNT(*) AS rows_out, TRUE AS share_within FROM dirty""")
def q_forest_row_check(spark, sf_dir):
    """A11/A12 on the dirty fact (repeated rows): no row is lost or multiplied,
    and the flagged share stays within the contamination."""
    d = dirty(spark, sf_dir)
    scored = A.anomaly_scored(IF.isolation_forest(d))
    return d.agg(F.count(F.lit(1)).alias("rows_in")).select("rows_in", *[scored.agg(x).scalar().alias(n) for n, x in (
        ("rows_out", F.count(F.lit(1))),
        ("share_within", F.count_if("ml_is_anomaly") <= F.lit(P.contamination) * F.count(F.lit(1)) + 1))])


REPEATED = (40, 40, 40)  # measures of the rows planted as equal


@register("forest_repeat_check", f"""{FACT} SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE record_id % 3 = 0 OR ({' AND '.join(
    f"{m} = {v}" for m, v in zip(MS, REPEATED))})) AS equal_rows, FALSE AS commonest_is_worst, FALSE AS commonest_flagged,
    TRUE AS some_flagged, TRUE AS share_within FROM fact""")
def q_forest_repeat_check(spark, sf_dir):
    """A11 without row ids on a fact whose every third row holds the same measures:
    the commonest row is neither the most abnormal nor flagged, others are."""
    f = fact(spark, sf_dir)
    planted = f.select(*[F.when(F.col(S.record_id) % 3 == 0, v).otherwise(F.col(m)).cast("long").alias(m) for m, v in zip(MS, REPEATED, strict=True)])
    planted = planted.withColumn(S.total, sum(F.col(m) for m in MS))
    scored = IF.isolation_forest(planted)
    hot = F.lit(True)
    for m, v in zip(MS, REPEATED, strict=True):
        hot = hot & (F.col(m) == v)
    score = F.col("ml_anomaly_score")
    return scored.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(hot).alias("equal_rows"),
        (F.max(F.when(hot, score)) <= F.percentile(score, 0.5)).alias("commonest_is_worst"),
        F.coalesce(F.bool_or(F.when(hot, F.col("ml_is_anomaly"))), F.lit(False)).alias("commonest_flagged"),
        (F.count_if("ml_is_anomaly") > 0).alias("some_flagged"),
        (F.count_if("ml_is_anomaly") <= F.lit(P.contamination) * F.count(F.lit(1)) + 1).alias("share_within"))


@register("anomaly_severity_with_forest")
def q_severity_forest(spark, sf_dir):
    """A12-A16 with the forest flag counted among the flags."""
    return A.anomaly_scored(forest_table(spark, sf_dir)).select(*SEV_COLS, "ml_anomaly_score", "ml_is_anomaly")


@register("chart_daily_ma30", f"""{FACT},
d AS (SELECT date, CAST(COALESCE(SUM(total_enrollment), 0) AS BIGINT) AS total_enrollment FROM fact
      WHERE date IS NOT NULL GROUP BY date)
SELECT date, total_enrollment,
       {r6("CASE WHEN COUNT(*) OVER w = 30 THEN AVG(CAST(total_enrollment AS DOUBLE)) OVER w END")} AS ma_30
FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def q_chart_daily(spark, sf_dir):
    """Daily total with its 30-day moving average."""
    return R.daily_ma30(fact(spark, sf_dir))


@register("chart_age_totals", f"{FACT}, s AS (SELECT {', '.join(f'CAST(COALESCE(SUM({m}), 0) AS BIGINT) AS {m}' for m in MS)} FROM fact) "
                              + " UNION ALL ".join(f"SELECT '{m}' AS age_group, {m} AS total FROM s" for m in MS))
def q_chart_age(spark, sf_dir):
    """Totals by age column."""
    return R.age_totals(fact(spark, sf_dir))


_KIDS = " + ".join(f"COALESCE(SUM({m}), 0)" for m in S.children)
_ADULTS = " + ".join(f"COALESCE(SUM({m}), 0)" for m in S.adults)


@register("chart_child_adult", f"""{FACT},
t AS (SELECT CAST({_KIDS} AS BIGINT) AS children, CAST({_ADULTS} AS BIGINT) AS adults FROM fact),
u AS (SELECT *, COALESCE(CAST(ROUND(CAST(CAST(CAST(children AS DOUBLE) / CAST(NULLIF(adults, 0) AS DOUBLE) AS VARCHAR)
      AS DECIMAL(38,18)), 2) AS DOUBLE), 0.0) AS child_adult_ratio FROM t)
SELECT *, CASE WHEN child_adult_ratio > 1.5 THEN 'Critical - High Child/Adult Skew'
               WHEN child_adult_ratio > 1.0 THEN 'Moderate' ELSE 'Low' END AS adult_inclusion_gap FROM u""")
def q_chart_child_adult(spark, sf_dir):
    """Children vs adults totals and ratio."""
    return D.child_adult_ratio(fact(spark, sf_dir))
