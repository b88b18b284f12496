"""End-to-end pipeline over one fact table.

``run_pipeline`` returns every report section as a lazy tidy DataFrame.
Tables that several sections reuse (the derived fact, the scored anomaly
rows, the per-district series) are written once to the shared checkpoint
folder and read back, so each section plans against small parquet scans and
a lost executor re-reads files instead of recomputing the lineage.

The chains of jobs that sections wait for (forest, model fits, clusters) run
side by side while the report is built, and ``collect_report`` runs the
sections' jobs concurrently from a thread pool: Spark schedules them side by
side, so small jobs fill cores that a sequential run leaves idle.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor, as_completed
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolens.operators import anomaly as A
from regiolens.operators import cluster as C
from regiolens.operators import describe as D
from regiolens.operators import forecast as FO
from regiolens.operators import iforest as IF
from regiolens.operators import models as MO
from regiolens.operators import policy as P
from regiolens.operators import quality as V
from regiolens.operators import report as R
from regiolens.operators import series as SE
from regiolens.params import DEFAULT_PARAMS, Params
from regiolens.plans import marts
from regiolens.schema import DEFAULT_SCHEMA, FactSchema
from regiolens.session import delete_path, ship_package
from regiolens.session import write_table as store_table
from regiolens.sources.loader import derive_columns


@dataclass
class Report:
    """Sections by name, and the stored tables they read."""

    sections: dict[str, DataFrame] = field(default_factory=dict)
    engine_of: dict[str, str] = field(default_factory=dict)
    prepare_seconds: dict[str, float] = field(default_factory=dict)
    background: ThreadPoolExecutor | None = None
    tables: list[str] = field(default_factory=list)

    def add(self, engine: str, name: str, df):
        self.sections[name] = df
        self.engine_of[name] = engine
        return df

    def release(self, spark: SparkSession) -> None:
        """Delete the tables this report has stored; its sections end with it."""
        if self.background is not None:
            self.background.shutdown(wait=True)
        for p in self.tables:
            delete_path(spark, p)
        self.tables.clear()

    def frame(self, name: str) -> DataFrame:
        return self.sections[name]


def run_pipeline(spark: SparkSession, raw_fact: DataFrame, params: Params = DEFAULT_PARAMS,
                 schema: FactSchema = DEFAULT_SCHEMA, gbt_max_iter: int | None = None,
                 with_gbt: bool = True) -> Report:
    ship_package(spark)
    rep = Report()

    def write_table(df: DataFrame, name: str) -> DataFrame:
        return store_table(df, name, rep.tables)

    H = params.horizon_long
    T = schema.total
    rep.background = ThreadPoolExecutor(max_workers=4)
    t0 = time.time()
    # dates parsed, total recomputed and shares derived whatever columns arrive
    fact = write_table(derive_columns(raw_fact, schema), "fact")
    rep.prepare_seconds["load"] = time.time() - t0
    t0 = time.time()
    sums = write_table(marts.day_district_totals(fact, schema), "day_district_totals")  # sections of sums read this
    nat = write_table(SE.prepare_series(sums, "M", [], [T], schema), "national_series")
    rep.prepare_seconds["marts"] = time.time() - t0
    geo = list(schema.geo)

    # chains of jobs that do not need one another run side by side
    def timed(name: str, make: Callable):
        def run():
            t = time.time()
            out = make()
            rep.prepare_seconds[name] = time.time() - t
            return out

        return rep.background.submit(run)

    def families(series: DataFrame, keys: list[str], name: str):
        """Forecasts and metrics of all model families, each fitted once, and importances."""
        fits = [MO.holt_winters(series, T, keys, H, params.seasonal_period, materialize_fit=True),
                MO.sarima(series, T, keys, H, params, materialize_fit=True)]
        importance = None
        if with_gbt:
            fc_, met_, importance = MO.gbt_forecast(series, T, keys, H, params, max_iter=gbt_max_iter)
            fits.append((fc_, met_))
        return ([write_table(FO._union([f for f, _ in fits]), f"{name}_forecasts")],
                [write_table(FO._union([m for _, m in fits]), f"{name}_metrics")], importance)

    def district_models():
        series = write_table(SE.prepare_series(sums, "M", geo, [T], schema), "district_series")
        fc_, met_, _ = families(series, geo, "district")
        return series, write_table(FO.ensemble(fc_, met_, geo)[0], "district_forecast")

    def national_models():
        fc_, met_, importance = families(nat, [], "national")
        efc_, emet_ = FO.ensemble(fc_, met_)
        return fc_[0], met_[0], importance, write_table(efc_, "ensemble_forecast"), write_table(emet_, "ensemble_metrics")

    def anomalies():
        flagged = IF.isolation_forest(fact, schema, params, paths=rep.tables)
        temporal = write_table(A.temporal_anomalies(sums, schema, params), "temporal")
        districts = write_table(A.geographic_anomalies(fact, schema, params), "geographic")
        return write_table(A.anomaly_scored(flagged, schema, params, temporal, districts), "anomaly_scored"), temporal, districts

    by_district = timed("district_forecasts", district_models)
    anomaly_tables = timed("anomaly_tables", anomalies)
    national = timed("national_models", national_models)
    clusters = timed("pincode_clusters", lambda: write_table(C.pincode_clusters(fact, schema, params, paths=rep.tables), "pincode_clusters"))

    # --- 1 governance ---------------------------------------------------------
    qr = rep.add("governance", "quality_report", V.quality_report(fact, schema, params))
    rep.add("governance", "quality_recommendations", V.quality_recommendations(qr, params))
    rep.add("governance", "validation_report", V.validation_report(fact, schema, params))
    dri_d = V.dri(fact, schema, params, by=geo)

    # --- 2 descriptive --------------------------------------------------------
    rep.add("descriptive", "monthly_trends_last12", D.last_months(D.monthly_trends(sums, schema), 12, schema))
    rep.add("descriptive", "top_states", D.top_states(sums, None, schema, params))
    rep.add("descriptive", "top_districts", D.top_districts(sums, None, schema, params))
    rep.add("descriptive", "gini_states", D.gini_states(sums, schema))
    cov = rep.add("descriptive", "coverage", D.coverage(fact, schema))
    rep.add("descriptive", "age_mix_overall", D.age_mix_overall(sums, schema))
    rep.add("descriptive", "age_mix_by_state", D.age_mix_by_state(sums, schema))
    rep.add("descriptive", "child_heavy_states", D.child_heavy_states(sums, 5, schema))
    rep.add("descriptive", "adult_heavy_states", D.adult_heavy_states(sums, 5, schema))
    rep.add("descriptive", "child_adult_ratio", D.child_adult_ratio(sums, schema))
    ineq_facts = write_table(D.inequity_facts(sums, schema, params), "inequity")
    ineq = rep.add("descriptive", "inequity_summary", D.rounded_inequity(ineq_facts))
    rep.add("descriptive", "inequity_recommendations", D.inequity_recommendations(ineq_facts))
    rep.add("descriptive", "underserved_districts", D.underserved_districts(sums, schema, params))
    rep.add("descriptive", "high_ratio_districts", D.high_ratio_districts(sums, None, schema, params))
    rep.add("descriptive", "summary_statistics", D.summary_statistics(fact, schema, params))
    rep.add("descriptive", "pincode_cluster_summary", C.cluster_summary(clusters.result(), schema))

    # --- 3 anomalies ----------------------------------------------------------
    scored, temporal, districts = anomaly_tables.result()
    summ = rep.add("anomaly", "anomaly_summary", A.anomaly_summary(fact, schema, params, scored, temporal, districts))
    rep.add("anomaly", "severity_distribution", A.severity_distribution(scored))
    rep.add("anomaly", "critical_anomalies", A.critical_anomalies(scored, 50, schema).select(
        *schema.present_id(scored), *schema.keys, T, "anomaly_count", "max_zscore", "severity_label", "anomaly_reason"))
    rep.add("anomaly", "flagged_days", temporal.where("has_temporal_anomaly").orderBy(schema.date).limit(20))
    rep.add("anomaly", "flagged_districts", districts
            .where("has_geographic_anomaly").select(*geo, T).orderBy(*geo).limit(20))
    rep.add("anomaly", "anomaly_recommendations", A.anomaly_recommendations(summ))
    rep.add("report", "anomaly_shares", A.anomaly_shares(summ))

    # --- 4 forecasting --------------------------------------------------------
    nat_fc, nat_met, importance, efc, emet = national.result()
    if importance is not None:
        rep.add("forecast", "gbt_feature_importance", importance)
    rep.add("forecast", "model_forecasts", nat_fc)
    rep.add("forecast", "model_metrics", nat_met)
    rep.add("forecast", "ensemble_forecast", FO.forecast_band(efc))
    rep.add("forecast", "ensemble_metrics", emet)
    surge = rep.add("forecast", "surge_summary", FO.surge_summary(efc, nat, T, (), params))
    rep.add("forecast", "surge_periods", FO.surges(efc, nat, T, (), params))
    hist = rep.add("forecast", "history_summary", FO.history_summary(nat, T))
    rep.add("forecast", "forecast_recommendations", FO.forecast_recommendations(surge, emet, hist))
    # many-series form: one forecast per district feeds the policy engine
    dser, defc = by_district.result()
    demand = defc.groupBy(*geo).agg(F.sum("yhat").alias("forecasted_enrollment"))
    dsurge = rep.add("forecast", "district_surges", FO.surges(defc, dser, T, geo, params))

    # --- 5 policy ---------------------------------------------------------------
    t0 = time.time()
    dist = write_table(P.district_data(sums, schema), "district_data")
    pr = write_table(P.priority_scores(dist, inequity=dist, forecast=demand, dri_scores=dri_d, schema=schema,
                                       params=params), "priority")
    iv = write_table(P.interventions(dist, anomalies=scored, surges=dsurge, schema=schema, params=params),
                     "interventions")
    rep.prepare_seconds["policy_tables"] = time.time() - t0
    rep.add("policy", "priority_top20", P.top_priority(pr, 20, schema))
    ts = rep.add("policy", "tier_summary", P.tier_summary(pr))
    rep.add("policy", "tier_distribution", P.tier_distribution(pr))
    tot = rep.add("policy", "resource_totals", P.resource_totals(pr))
    rep.add("policy", "top_priority_districts", P.top_priority(pr, 50, schema))
    rep.add("policy", "allocation_strategy", P.allocation_strategy(ts))
    rep.add("policy", "intervention_counts", P.intervention_counts(iv))
    rep.add("policy", "first_interventions", P.first_interventions(iv, 100))
    rep.add("policy", "policy_simulation", P.policy_simulation(dist, None, schema, params))
    rep.add("policy", "strategic_recommendations", P.strategic_recommendations(tot, iv))

    # --- 6 key figures ------------------------------------------------------------
    imm = iv.select(F.count_if(F.col("urgency") == "Critical").alias("immediate_interventions"))
    rep.add("report", "key_figures", R.key_figures({
        "dri": qr.select("total_records", "dri_score", "assessment", "completeness", "consistency", "validity"),
        "coverage": cov,
        "inequity": ineq.select("underserved_count"),
        "anomaly": summ.select("statistical_anomalies", "geographic_anomalies", "temporal_anomalies"),
        "surge": surge.select(
            F.lit(H).alias("forecast_horizon"), "surge_detected", "num_surge_periods"),
        "policy": tot,
        "interventions": imm,
    }))
    rep.add("report", "daily_ma30", R.daily_ma30(sums, schema))
    rep.add("report", "age_totals", R.age_totals(sums, schema))
    return rep


def collect_report(rep: Report, threads: int = 8) -> tuple[dict[str, list], dict[str, float]]:
    """Collect every section (concurrently); returns rows and seconds per section."""
    rows: dict[str, list] = {}
    secs: dict[str, float] = {}

    def run(name: str):
        t = time.time()
        out = rep.frame(name).collect()
        return name, out, time.time() - t

    with ThreadPoolExecutor(max_workers=threads) as pool:
        futs = [pool.submit(run, n) for n in rep.sections]
        for f in as_completed(futs):
            name, out, s = f.result()
            rows[name] = out
            secs[name] = s
    if rep.background is not None:
        rep.background.shutdown(wait=True)
    return rows, secs
