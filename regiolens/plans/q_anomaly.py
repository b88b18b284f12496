"""Registered queries: anomaly detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolens.operators import anomaly as A
from regiolens.params import DEFAULT_PARAMS as P
from regiolens.params import SEVERITY_LABELS
from regiolens.plans.oracle_sql import FACT, M, PLANTED, PLANTED_EVERY, PLANTED_TIMES, div, r6, rnd, sums
from regiolens.plans.fact_store import stored
from regiolens.plans.q_describe import fact
from regiolens.plans.registry import register
from regiolens.plans import marts
from regiolens.schema import DEFAULT_SCHEMA as S
from regiolens.schema import FactSchema
from regiolens.sources.loader import derive_columns
from regiolens.sources.tpch import enrollment_from_tpch

ROW_KEYS = ["record_id", "date", "state", "district", "pincode"]


def scored_table(spark, sf_dir):
    """Row table with all flags and severity, written once per session."""
    return stored(spark, "anomaly_scored", (sf_dir,), lambda: A.anomaly_scored(fact(spark, sf_dir)))
STAT_COLS = [f"{c}_{k}" for c in M for k in ("zscore", "zscore_anomaly", "iqr_anomaly", "quantile_anomaly",
                                                "is_anomaly")]


def _stat_ctes(head: str = FACT) -> str:
    fr = f"[{P.quantile_lower}, 0.25, 0.75, {P.quantile_upper}]"
    stats = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {fr}) AS {c}_q, AVG(CAST({c} AS DOUBLE)) AS {c}_mean, "
                      f"stddev_samp(CAST({c} AS DOUBLE)) AS {c}_std" for c in M)
    sel = []
    for c in M:
        x = f"CAST(f.{c} AS DOUBLE)"
        z = f"CASE WHEN s.{c}_std > 0 THEN ({x} - s.{c}_mean) / s.{c}_std END"
        iqr = f"(s.{c}_q[3] - s.{c}_q[2])"
        fz = f"COALESCE(ABS({z}) > {P.z_threshold}, FALSE)"
        fi = f"COALESCE({x} < s.{c}_q[2] - {P.iqr_multiplier} * {iqr} OR {x} > s.{c}_q[3] + {P.iqr_multiplier} * {iqr}, FALSE)"
        fq = f"COALESCE({x} < s.{c}_q[1] OR {x} > s.{c}_q[4], FALSE)"
        sel += [f"{z} AS {c}_zscore", f"{fz} AS {c}_zscore_anomaly", f"{fi} AS {c}_iqr_anomaly",
                f"{fq} AS {c}_quantile_anomaly",
                f"(CAST({fz} AS INT) + CAST({fi} AS INT) + CAST({fq} AS INT)) >= 2 AS {c}_is_anomaly"]
    return f"""{head},
st AS (SELECT {stats} FROM fact),
sa0 AS (SELECT f.*, {', '.join(sel)} FROM fact f, st s),
sa AS (SELECT *, {' OR '.join(f'{c}_is_anomaly' for c in M)} AS has_statistical_anomaly FROM sa0)"""


def _stat_out(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join([p + c for c in ROW_KEYS + M]
                     + [f"{r6(p + c)} AS {c}" if c.endswith("_zscore") else p + c for c in STAT_COLS]
                     + [p + "has_statistical_anomaly"])


@register("statistical_anomalies", f"{_stat_ctes()} SELECT {_stat_out()} FROM sa")
def q_statistical(spark, sf_dir):
    return A.statistical_anomalies(fact(spark, sf_dir)).select(*ROW_KEYS, *M, *STAT_COLS, "has_statistical_anomaly")


TEMP_COLS = [f"{c}_{k}" for c in M for k in ("pct_change", "sudden_change", "ma7", "ma30", "ma_deviation",
                                                "temporal_anomaly")]


def _temporal_ctes(src: str = "fact") -> str:
    t1 = []
    t2 = []
    for c in M:
        t1 += [f"LAG({c}, 1) OVER w AS {c}_prev",
               f"AVG(CAST({c} AS DOUBLE)) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS {c}_ma7",
               f"AVG(CAST({c} AS DOUBLE)) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS {c}_ma30"]
        pc = div(f"{c} - {c}_prev", f"{c}_prev") + " * 100"
        sudden = (f"(COALESCE(ABS({pc}) > {P.change_threshold * 100}, FALSE) OR "
                  f"COALESCE({c}_prev = 0 AND {c} <> 0, FALSE))")
        dev = f"COALESCE(ABS(CAST({c} AS DOUBLE) - {c}_ma30) / ({c}_ma30 + 1e-8) > 0.5, FALSE)"
        t2 += [f"{pc} AS {c}_pct_change", f"{sudden} AS {c}_sudden_change", f"{c}_ma7", f"{c}_ma30",
               f"{dev} AS {c}_ma_deviation", f"({sudden} OR {dev}) AS {c}_temporal_anomaly"]
    return f"""dd AS (SELECT date, {sums()} FROM {src} WHERE date IS NOT NULL GROUP BY date),
t1 AS (SELECT *, {', '.join(t1)} FROM dd WINDOW w AS (ORDER BY date)),
t2 AS (SELECT date, {', '.join(M)}, {', '.join(t2)} FROM t1),
ta AS (SELECT *, {' OR '.join(f'{c}_temporal_anomaly' for c in M)} AS has_temporal_anomaly FROM t2)"""


def _temp_out() -> str:
    return ", ".join(["date", *M] + [f"{r6(c)} AS {c}" if c.endswith(("pct_change", "ma7", "ma30")) else c
                                      for c in TEMP_COLS] + ["has_temporal_anomaly"])


@register("temporal_anomalies", f"{FACT},\n{_temporal_ctes()} SELECT {_temp_out()} FROM ta")
def q_temporal(spark, sf_dir):
    return A.temporal_anomalies(fact(spark, sf_dir)).select("date", *M, *TEMP_COLS, "has_temporal_anomaly")


GEO_COLS = [f"{c}_{k}" for c in M for k in ("state_zscore", "geo_anomaly")]


def _geo_ctes(basis: str) -> str:
    if basis == "rows":
        st = (f"gst AS (SELECT state, {', '.join(f'AVG(CAST({c} AS DOUBLE)) AS {c}_mean, stddev_samp(CAST({c} AS DOUBLE)) AS {c}_std' for c in M)} "
              f"FROM fact WHERE state IS NOT NULL GROUP BY state)")
    else:
        st = (f"gst AS (SELECT state, {', '.join(f'AVG(CAST({c} AS DOUBLE)) AS {c}_mean, stddev_samp(CAST({c} AS DOUBLE)) AS {c}_std' for c in M)} "
              f"FROM dist GROUP BY state)")
    z = {c: f"(CAST(d.{c} AS DOUBLE) - s.{c}_mean) / (s.{c}_std + 1e-8)" for c in M}
    sel = ", ".join(f"{z[c]} AS {c}_state_zscore, COALESCE(ABS({z[c]}) > {P.z_threshold}, FALSE) AS {c}_geo_anomaly"
                    for c in M)
    return f"""dist AS (SELECT state, district, {sums()} FROM fact WHERE state IS NOT NULL AND district IS NOT NULL
         GROUP BY state, district),
{st},
ga0 AS (SELECT d.*, {sel} FROM dist d LEFT JOIN gst s ON d.state = s.state),
ga AS (SELECT *, {' OR '.join(f'{c}_geo_anomaly' for c in M)} AS has_geographic_anomaly FROM ga0)"""


def _geo_out() -> str:
    return ", ".join(["state", "district", *M] + [f"{r6(c)} AS {c}" if c.endswith("zscore") else c for c in GEO_COLS]
                     + ["has_geographic_anomaly"])


@register("geographic_anomalies", f"{FACT},\n{_geo_ctes('rows')} SELECT {_geo_out()} FROM ga")
def q_geo_rows(spark, sf_dir):
    return A.geographic_anomalies(fact(spark, sf_dir)).select("state", "district", *M, *GEO_COLS,
                                                              "has_geographic_anomaly")


@register("geographic_anomalies_districts", f"{FACT},\n{_geo_ctes('districts')} SELECT {_geo_out()} FROM ga")
def q_geo_districts(spark, sf_dir):
    return A.geographic_anomalies(fact(spark, sf_dir), basis="districts").select(
        "state", "district", *M, *GEO_COLS, "has_geographic_anomaly")


# --- severity ------------------------------------------------------------------------

def _severity_ctes(head: str = FACT) -> str:
    flags = A.statistical_flag_columns(M) + ["has_temporal_anomaly", "has_geographic_anomaly"]
    cnt = " + ".join(f"CAST({f} AS INT)" for f in flags)
    maxz = f"COALESCE(GREATEST({', '.join(f'ABS({c}_zscore)' for c in M)}), 0.0)"
    lo, me, hi, cr = P.severity_levels
    labels = ", ".join(f"'{x}'" for x in SEVERITY_LABELS)
    return f"""{_stat_ctes(head)},
{_temporal_ctes()},
{_geo_ctes('rows')},
sj AS (SELECT sa.*, COALESCE(ta.has_temporal_anomaly, FALSE) AS has_temporal_anomaly,
             COALESCE(ga.has_geographic_anomaly, FALSE) AS has_geographic_anomaly
      FROM sa LEFT JOIN ta ON sa.date = ta.date LEFT JOIN ga ON sa.state = ga.state AND sa.district = ga.district),
sk AS (SELECT *, {cnt} AS anomaly_count, CAST({maxz} AS DOUBLE) AS max_zscore FROM sj),
sv0 AS (SELECT *, CASE WHEN anomaly_count = 0 THEN 0
                     WHEN anomaly_count <= 2 AND max_zscore < 4 THEN {lo}
                     WHEN anomaly_count <= 4 AND max_zscore < 6 THEN {me}
                     WHEN anomaly_count <= 6 OR max_zscore < 8 THEN {hi} ELSE {cr} END AS severity_score FROM sk),
sv AS (SELECT *, CASE WHEN severity_score = 0 THEN 'Normal'
                      WHEN max_zscore > 4 THEN 'Potential Data Quality Error'
                      WHEN has_temporal_anomaly THEN 'Operational Batch Delay'
                      WHEN has_geographic_anomaly THEN 'Regional Policy Variance'
                      ELSE 'Unclassified Anomaly' END AS anomaly_reason,
              [{labels}][severity_score + 1] AS severity_label FROM sv0)"""


SEV_COLS = [*ROW_KEYS, "total_enrollment", "has_statistical_anomaly", "has_temporal_anomaly", "has_geographic_anomaly",
            "anomaly_count", "max_zscore", "severity_score", "anomaly_reason", "severity_label"]


def _sev_out() -> str:
    return ", ".join(f"{r6(c)} AS {c}" if c == "max_zscore" else c for c in SEV_COLS)


@register("anomaly_severity", f"{_severity_ctes()} SELECT {_sev_out()} FROM sv")
def q_severity(spark, sf_dir):
    return scored_table(spark, sf_dir).select(*SEV_COLS)


@register("severity_distribution",
          f"{_severity_ctes()} SELECT severity_label, COUNT(*) AS records FROM sv GROUP BY severity_label")
def q_severity_dist(spark, sf_dir):
    return A.severity_distribution(scored_table(spark, sf_dir))


@register("chart_severity",
          f"{_severity_ctes()} SELECT severity_label, COUNT(*) AS records FROM sv "
          f"WHERE severity_label <> 'NORMAL' GROUP BY severity_label")
def q_chart_severity(spark, sf_dir):
    """Severity distribution without NORMAL."""
    return A.severity_distribution(scored_table(spark, sf_dir)).where(F.col("severity_label") != "NORMAL")


@register("critical_anomalies",
          f"{_severity_ctes()} SELECT {_sev_out()} FROM sv WHERE severity_score = 4 "
          f"ORDER BY max_zscore DESC, record_id LIMIT 50")
def q_critical(spark, sf_dir):
    return A.critical_anomalies(scored_table(spark, sf_dir)).select(*SEV_COLS)


def planted(spark, sf_dir):
    """Derived fact with planted extreme rows (see ``oracle_sql.PLANTED``)."""
    raw = enrollment_from_tpch(spark, sf_dir)
    far = F.col(S.record_id) % PLANTED_EVERY == 0
    raised = {m: F.when(far, F.col(m) * PLANTED_TIMES).otherwise(F.col(m)) for m in S.measures}
    return stored(spark, "planted_fact", (sf_dir,), lambda: derive_columns(raw.withColumns(raised)))


@register("critical_anomalies_planted",
          f"{_severity_ctes(PLANTED)} SELECT {_sev_out()} FROM sv WHERE severity_score = 4 "
          f"ORDER BY max_zscore DESC, record_id LIMIT 50")
def q_critical_planted(spark, sf_dir):
    """A18 on a fact that has critical rows."""
    return A.critical_anomalies(A.anomaly_scored(planted(spark, sf_dir))).select(*SEV_COLS)


@register("flagged_days",
          f"{FACT},\n{_temporal_ctes()} SELECT {_temp_out()} FROM ta WHERE has_temporal_anomaly ORDER BY date LIMIT 20")
def q_flagged_days(spark, sf_dir):
    t = A.temporal_anomalies(fact(spark, sf_dir)).select("date", *M, *TEMP_COLS, "has_temporal_anomaly")
    return t.where("has_temporal_anomaly").orderBy("date").limit(20)


@register("flagged_districts",
          f"{FACT},\n{_geo_ctes('rows')} SELECT state, district, total_enrollment FROM ga "
          f"WHERE has_geographic_anomaly ORDER BY state, district LIMIT 20")
def q_flagged_districts(spark, sf_dir):
    g = A.geographic_anomalies(fact(spark, sf_dir))
    return g.where("has_geographic_anomaly").select("state", "district", S.total).orderBy(
        "state", "district").limit(20)


_SUMMARY_CTE = f"""{_severity_ctes()},
summ AS (SELECT COUNT(*) AS total_records,
                COUNT(*) FILTER (WHERE has_statistical_anomaly) AS statistical_anomalies,
                CAST(NULL AS BIGINT) AS ml_anomalies,
                COUNT(*) FILTER (WHERE severity_score = 4) AS critical_anomalies,
                COUNT(*) FILTER (WHERE severity_score = 3) AS high_anomalies,
                (SELECT COUNT(*) FILTER (WHERE has_temporal_anomaly) FROM ta) AS temporal_anomalies,
                (SELECT COUNT(*) FROM ta) AS days,
                (SELECT COUNT(*) FILTER (WHERE has_geographic_anomaly) FROM ga) AS geographic_anomalies,
                (SELECT COUNT(*) FROM ga) AS districts
         FROM sv)"""


@register("anomaly_report", f"{_SUMMARY_CTE} SELECT * FROM summ")
def q_anomaly_report(spark, sf_dir):
    """A18 summary (without the forest flag)."""
    return A.anomaly_summary(fact(spark, sf_dir), scored=scored_table(spark, sf_dir))


@register("anomaly_recommendations", f"""{_SUMMARY_CTE},
r AS (
  SELECT 1 AS rank, printf('URGENT: %d critical anomalies detected. Immediate investigation required.', critical_anomalies) AS recommendation FROM summ WHERE critical_anomalies > 0
  UNION ALL SELECT 2, printf('ATTENTION: %d high-severity anomalies. Review data quality and enrollment processes.', high_anomalies) FROM summ WHERE high_anomalies > 10
  UNION ALL SELECT 3, printf('Frequent temporal anomalies detected (%d days). Investigate enrollment system stability.', temporal_anomalies) FROM summ WHERE temporal_anomalies > days * 0.1
  UNION ALL SELECT 4, printf('Widespread geographic anomalies (%d districts). Review regional data collection processes.', geographic_anomalies) FROM summ WHERE geographic_anomalies > districts * 0.2)
SELECT * FROM r UNION ALL SELECT 5, 'No significant anomalies detected. Data quality is acceptable.' WHERE NOT EXISTS (SELECT 1 FROM r)""")
def q_anomaly_recs(spark, sf_dir):
    return A.anomaly_recommendations(A.anomaly_summary(fact(spark, sf_dir), scored=scored_table(spark, sf_dir)))


@register("anomaly_shares", f"""{_SUMMARY_CTE}
SELECT 'statistical' AS method, statistical_anomalies AS anomalies, {rnd(div('statistical_anomalies', 'total_records') + ' * 100', 2)} AS percent FROM summ
UNION ALL SELECT 'ml', ml_anomalies, {rnd(div('ml_anomalies', 'total_records') + ' * 100', 2)} FROM summ
UNION ALL SELECT 'temporal', temporal_anomalies, {rnd(div('temporal_anomalies', 'days') + ' * 100', 2)} FROM summ
UNION ALL SELECT 'geographic', geographic_anomalies, {rnd(div('geographic_anomalies', 'districts') + ' * 100', 2)} FROM summ""")
def q_anomaly_shares(spark, sf_dir):
    """Anomaly share per method."""
    return A.anomaly_shares(A.anomaly_summary(fact(spark, sf_dir), scored=scored_table(spark, sf_dir)))


# --- events: temporal checks per event type (many daily series) ---------------------

EVENT_SCHEMA = FactSchema(measures=(), children=(), adults=(), total="value")
EV_COLS = [f"value_{k}" for k in ("pct_change", "sudden_change", "ma7", "ma30", "ma_deviation", "temporal_anomaly")]


def _event_sql() -> str:
    pc = div("value - prev", "prev") + " * 100"
    sudden = f"(COALESCE(ABS({pc}) > {P.change_threshold * 100}, FALSE) OR COALESCE(prev = 0 AND value <> 0, FALSE))"
    dev = "COALESCE(ABS(value - ma30) / (ma30 + 1e-8) > 0.5, FALSE)"
    return f"""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS date, COALESCE(SUM(value), 0) AS value FROM events
           WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
t1 AS (SELECT *, LAG(value, 1) OVER w AS prev,
              AVG(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7,
              AVG(value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ma30
       FROM d WINDOW w AS (PARTITION BY event_type ORDER BY date))
SELECT event_type, date, {r6('value')} AS value, {r6(pc)} AS value_pct_change, {sudden} AS value_sudden_change,
       {r6('ma7')} AS value_ma7, {r6('ma30')} AS value_ma30, {dev} AS value_ma_deviation,
       ({sudden} OR {dev}) AS value_temporal_anomaly, ({sudden} OR {dev}) AS has_temporal_anomaly FROM t1"""


@register("event_temporal_anomalies", _event_sql())
def q_event_temporal(spark, sf_dir):
    """A5-A8 on the events table: daily value per event type, one series per type."""
    from regiolens.sources.tpch import events_as_daily_fact

    ev = events_as_daily_fact(spark, sf_dir)
    daily = marts.group_totals(ev, ["event_type", "date"], ["value"], EVENT_SCHEMA)
    out = A.temporal_anomalies(ev, EVENT_SCHEMA, keys=["event_type"], daily=daily)
    return out.select("event_type", "date", "value", *EV_COLS, "has_temporal_anomaly")
