"""Sums by file, day and district that follow a changing directory.

Sums are additive, so the table of a directory is the sum of its files' tables.
``refresh`` lists the files with their change time and size (no content is
read), sums only the files that are new or changed since the last refresh, and
writes them as a new generation; a manifest (which generation holds each present
file) is written last, so a broken refresh leaves the one before in force.  The
current totals read the generations through the manifest: files that are gone or
replaced no longer count.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolens.plans import marts
from regiolens.schema import DEFAULT_SCHEMA, FactSchema
from regiolens.sources.loader import CSV_GLOB, load_directory

FILE = "source_file"
_STATE = "file string, modified timestamp, size long, gen long"


def _generations(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed manifests, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(
        spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{n}/_SUCCESS")))


def list_files(spark: SparkSession, source: str) -> DataFrame:
    m = F.col("_metadata")
    return spark.read.format("binaryFile").option("pathGlobFilter", CSV_GLOB).load(source).select(
        m["file_path"].alias("file"), m["file_modification_time"].alias("modified"), m["file_size"].alias("size"))


def refresh(spark: SparkSession, source: str, root: str, schema: FactSchema = DEFAULT_SCHEMA) -> list[str]:
    """Bring the sums under ``root`` up to the files of ``source``; returns the
    files that were read."""
    root = root.rstrip("/")
    done = _generations(spark, root)
    gen = (done[-1] if done else 0) + 1
    old = spark.read.schema(_STATE).json(f"{root}/manifest/gen={done[-1]}") if done else spark.createDataFrame([], _STATE)
    now = list_files(spark, source)
    state = now.join(old, ["file", "modified", "size"], "left").select("file", "modified", "size", F.coalesce("gen", F.lit(gen)).alias("gen"))
    new = [unquote(r["file"]) for r in state.where(F.col("gen") == gen).select("file").collect()]
    if new:
        fact = load_directory(spark, new, schema, file_column=FILE)
        sums = fact.groupBy(FILE, schema.date, *schema.geo).agg(
            F.count(F.lit(1)).alias("records"), *[marts._sum_of(fact, m).alias(m) for m in schema.present_all(fact)])
        sums.write.mode("overwrite").parquet(f"{root}/sums/gen={gen}")
    state.write.mode("overwrite").json(f"{root}/manifest/gen={gen}")
    return sorted(new)


def current_totals(spark: SparkSession, root: str, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """The day x district sums of the files present at the last refresh, as
    ``marts.day_district_totals`` gives them, with ``records``."""
    root = root.rstrip("/")
    done = _generations(spark, root)
    if not done:
        raise FileNotFoundError(f"No finished refresh in {root}")
    state = spark.read.schema(_STATE).json(f"{root}/manifest/gen={done[-1]}")
    held = [r["gen"] for r in state.select("gen").distinct().collect()]
    if not held:
        raise FileNotFoundError(f"No files at the last refresh of {root}")
    parts = [spark.read.parquet(f"{root}/sums/gen={g}").withColumn("gen", F.lit(g).cast("long")) for g in sorted(held)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows = rows.join(state.select(F.col("file").alias(FILE), "gen"), [FILE, "gen"], "left_semi")
    cols = ["records", *[c for c in schema.all_measures if c in rows.columns]]
    return rows.groupBy(schema.date, *schema.geo).agg(*[marts._sum_of(rows, c).alias(c) for c in cols]).withColumn(
        schema.year_month, F.trunc(F.col(schema.date), "MM"))
