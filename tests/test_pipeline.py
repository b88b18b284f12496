"""End-to-end pipeline (T10) and report sink round trip."""

from __future__ import annotations

import tempfile

from regiolens.params import Params
from regiolens.plans.pipeline import collect_report, run_pipeline
from regiolens.sources.sinks import load_latest, save_report
from regiolens.sources.tpch import enrollment_from_tpch
from tests.conftest import SF_SMALL


def test_pipeline_sections_and_key_figures(spark):
    rep = run_pipeline(spark, enrollment_from_tpch(spark, SF_SMALL), gbt_max_iter=3)
    rows, secs = collect_report(rep, threads=4)
    assert set(rows) == set(rep.sections) and len(rows) >= 45
    kf = rows["key_figures"][0]
    assert kf.total_records == rows["quality_report"][0].total_records > 0
    assert kf.num_states == 25 and kf.forecast_horizon == 6
    tiers = {r.priority_tier: r for r in rows["tier_summary"]}
    assert set(tiers) == {"Low", "Medium", "High", "Critical"}
    assert sum(r.num_districts for r in rows["tier_distribution"]) == sum(t.num_districts for t in tiers.values())
    models = {r.model for r in rows["model_metrics"]}
    assert {"holt_winters", "sarima", "gbt"} <= models
    assert len(rows["ensemble_forecast"]) == 6
    assert rows["anomaly_summary"][0].ml_anomalies > 0  # forest flag feeds the summary and severity
    assert len(rows["pincode_cluster_summary"]) == 5
    assert all(s >= 0 for s in secs.values())


def test_report_sections_round_trip(spark):
    rep = run_pipeline(spark, enrollment_from_tpch(spark, SF_SMALL), with_gbt=False)
    base = tempfile.mkdtemp(prefix="regiolens-pipeline-", dir="/tmp")
    names = ["key_figures", "tier_summary", "summary_statistics"]
    save_report({n: rep.frame(n) for n in names}, base, "20260101_000000")
    got = load_latest(spark, base, "tier_summary").collect()
    assert len(got) == 4
    rep.background.shutdown(wait=True)


def test_csv_files_to_report(spark, tmp_path):
    """The 8 documented columns (two header orders, no record id) through the whole report."""
    raw = enrollment_from_tpch(spark, SF_SMALL)
    from pyspark.sql import functions as F

    cols = ["date", "state", "district", "pincode", "age_0_5", "age_5_17", "age_18_greater", "total_enrollment"]
    out = raw.withColumn("date", F.date_format("date", "dd-MM-yyyy")).withColumn("total_enrollment", F.lit(0).cast("long"))
    out.where("record_id % 2 = 0").select(*cols).coalesce(1).write.option("header", True).csv(str(tmp_path / "a"))
    out.where("record_id % 2 = 1").select(*cols[::-1]).coalesce(1).write.option("header", True).csv(str(tmp_path / "b"))
    both = tmp_path / "in"
    both.mkdir()
    for i, f in enumerate([*(tmp_path / "a").glob("*.csv"), *(tmp_path / "b").glob("*.csv")]):
        (both / f"part {i}.csv").write_bytes(f.read_bytes())
    from regiolens.sources.loader import load_directory, load_file

    loaded = load_directory(spark, str(both), derive=False)
    assert "record_id" not in loaded.columns and loaded.count() == raw.count()
    assert load_file(spark, str(both / "part 0.csv")).count() == raw.where("record_id % 2 = 0").count()
    rows, _ = collect_report(run_pipeline(spark, loaded, gbt_max_iter=2), threads=4)
    assert len(rows) >= 45 and rows["key_figures"][0].total_records == raw.count()
    assert rows["quality_report"][0].dri_score > 0.9  # the total is computed again on load


def test_short_histories_give_error_rows_and_a_report(spark):
    from pyspark.sql import functions as F

    raw = enrollment_from_tpch(spark, SF_SMALL)
    first = raw.agg(F.min("date")).first()[0]
    for months in (3, 10, 35):
        part = raw.where(F.col("date") < F.add_months(F.lit(first), months))
        rows, _ = collect_report(run_pipeline(spark, part, Params(forest_trees=20), gbt_max_iter=2), threads=4)
        assert len(rows) >= 45
        status = {r.model: r.status for r in rows["model_metrics"]}
        assert status["gbt"].startswith("error") == (months < 36)
