"""Registered query: key figures of the whole report."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolens.operators import anomaly as A
from regiolens.operators import describe as D
from regiolens.operators import forecast as FO
from regiolens.operators import policy as P
from regiolens.operators import quality as V
from regiolens.operators import report as R
from regiolens.params import DEFAULT_PARAMS as PR
from regiolens.plans.q_anomaly import scored_table
from regiolens.plans.q_describe import fact
from regiolens.plans.q_forecast import _NAT_SIMPLE, simple_ensemble
from regiolens.plans.q_policy import interventions_table, priority_table
from regiolens.plans.q_quality import dirty_fact
from regiolens.plans.registry import ORACLES, register
from regiolens.schema import DEFAULT_SCHEMA as S

# (column, oracle text it comes from)
_PARTS = [
    ("dri_score", "dri_overall"), ("assessment", "dri_overall"), ("completeness", "dri_overall"),
    ("consistency", "dri_overall"), ("validity", "dri_overall"),
    ("num_states", "coverage"), ("num_districts", "coverage"), ("num_pincodes", "coverage"),
    ("underserved_count", "inequity_summary"),
    ("total_records", "anomaly_report"), ("statistical_anomalies", "anomaly_report"),
    ("geographic_anomalies", "anomaly_report"), ("temporal_anomalies", "anomaly_report"),
    ("surge_detected", "national_surge"), ("num_surge_periods", "national_surge"),
    ("total_required_centers", "resource_allocation"), ("total_required_staff", "resource_allocation"),
    ("critical_districts", "resource_allocation"),
]


def _sql() -> str:
    src = dict(ORACLES)
    src["national_surge"] = f"{_NAT_SIMPLE} SELECT * FROM ss"
    cols = [f"(SELECT {c} FROM ({src[q]})) AS {c}" for c, q in _PARTS]
    cols.append(f"CAST({PR.horizon_long} AS BIGINT) AS forecast_horizon")
    cols.append(f"(SELECT COUNT(*) FILTER (WHERE urgency = 'Critical') FROM ({src['interventions']})) "
                f"AS immediate_interventions")
    return "SELECT " + ",\n       ".join(cols)


def key_figures_table(spark, sf_dir):
    f = fact(spark, sf_dir)
    s, ef, _ = simple_ensemble(spark, sf_dir, [])
    iv = interventions_table(spark, sf_dir)
    return R.key_figures({
        "dri": V.dri(dirty_fact(spark, sf_dir)).select("dri_score", "assessment", "completeness", "consistency",
                                                       "validity"),
        "coverage": D.coverage(f),
        "inequity": D.inequity_summary(f).select("underserved_count"),
        "anomaly": A.anomaly_summary(f, scored=scored_table(spark, sf_dir)).select("total_records", "statistical_anomalies", "geographic_anomalies",
                                               "temporal_anomalies"),
        "surge": FO.surge_summary(ef, s, S.total).select(
            F.lit(PR.horizon_long).cast("long").alias("forecast_horizon"), "surge_detected", "num_surge_periods"),
        "policy": P.resource_totals(priority_table(spark, sf_dir)),
        "interventions": iv.select(F.count_if(F.col("urgency") == "Critical").alias("immediate_interventions")),
    })


register("key_figures", _sql())(lambda spark, sf_dir: key_figures_table(spark, sf_dir))
