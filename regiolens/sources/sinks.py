"""Report sinks.

Sections are written as JSON (or parquet) directories partitioned by the run
time stamp, so many runs can share one location.  A run's manifest (its sections
with format and schema) is written last, under ``_runs/run_ts=<stamp>/``: a run
without one is unfinished and is never returned.  ``load_latest`` lists the
manifests' folders and reads one manifest and the files of that one run.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from regiolens.session import delete_path

MANIFESTS = "_runs"


def run_stamp(now: dt.datetime | None = None) -> str:
    """Sortable run time stamp (the only place a wall clock enters)."""
    return (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d_%H%M%S")


def save_report(sections: dict[str, DataFrame], base_path: str, run_ts: str | None = None,
                fmt: str = "json") -> str:
    """Write each section under ``base/<section>/run_ts=<stamp>/``, the
    manifest last."""
    run_ts = run_ts or run_stamp()
    if not sections:
        return run_ts
    base = base_path.rstrip("/")
    spark = next(iter(sections.values())).sparkSession
    manifest = f"{base}/{MANIFESTS}/run_ts={run_ts}"
    delete_path(spark, manifest)  # a stamp that is written again is unfinished until its manifest is back
    rows = []
    for name, df in sections.items():
        df.write.mode("overwrite").format(fmt).save(f"{base}/{name}/run_ts={run_ts}")
        rows.append((name, fmt, df.schema.json()))
    spark.createDataFrame(rows, "section string, format string, columns string").coalesce(1).write.mode("overwrite").json(manifest)
    return run_ts


def _stamps(spark: SparkSession, path: str) -> list[str]:
    """Stamps of the folders under ``path`` whose write was committed, newest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    done = [n for n in names if n.startswith("run_ts=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted((n[len("run_ts="):] for n in done), reverse=True)


def load_latest(spark: SparkSession, base_path: str, section: str) -> DataFrame:
    """The newest finished run of one section, with its ``run_ts``."""
    from pyspark.sql import functions as F

    base = base_path.rstrip("/")
    for stamp in _stamps(spark, f"{base}/{MANIFESTS}"):
        runs = spark.read.schema("section string, format string, columns string").json(f"{base}/{MANIFESTS}/run_ts={stamp}")
        row = runs.where(F.col("section") == section).first()
        if row is not None:
            schema = T.StructType.fromJson(json.loads(row["columns"]))
            df = spark.read.format(row["format"]).schema(schema).load(f"{base}/{section}/run_ts={stamp}")
            return df.withColumn("run_ts", F.lit(stamp))
    raise FileNotFoundError(f"No finished run with section {section} in {base_path}")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line (one directory of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)
