"""Incremental ingestion of arriving CSV files (S1 in Structured Streaming form).

The reference loads a directory of CSV files in one batch.  When files keep
arriving, the same load runs as a file-source stream: each new file is read
once (the checkpoint records processed files), typed and derived like the
batch loader, and appended to a parquet table that the batch operators read.
A streaming file source needs one fixed column layout; directories with mixed
header layouts go through the batch loader (``sources.loader.load_directory``),
which matches columns by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from regiolens.schema import DEFAULT_SCHEMA, FactSchema
from regiolens.sources.loader import _typed, derive_columns


def csv_layout(schema: FactSchema = DEFAULT_SCHEMA, columns: list[str] | None = None) -> T.StructType:
    """String schema of the incoming files (required columns in file order)."""
    cols = columns or list(schema.required)
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def csv_stream(spark: SparkSession, src_dir: str, schema: FactSchema = DEFAULT_SCHEMA,
               columns: list[str] | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of the derived fact rows of newly arriving files."""
    reader = spark.readStream.schema(csv_layout(schema, columns)).option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(src_dir).withColumn("source_file", F.col("_metadata.file_path"))
    return derive_columns(_typed(raw, schema), schema)


def ingest(spark: SparkSession, src_dir: str, out_path: str, checkpoint: str,
           schema: FactSchema = DEFAULT_SCHEMA, columns: list[str] | None = None,
           available_now: bool = True) -> StreamingQuery:
    """Append new files' rows to a parquet table; ``available_now`` processes
    what is there and stops (scheduled batch), otherwise runs continuously."""
    q = (csv_stream(spark, src_dir, schema, columns).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def daily_totals_stream(stream: DataFrame, schema: FactSchema = DEFAULT_SCHEMA,
                        lateness: str = "3 days") -> DataFrame:
    """Running daily totals with a watermark: a day is final (emitted in append
    mode) once events ``lateness`` after it have arrived; state is bounded."""
    ts = F.col(schema.date).cast("timestamp")
    s = stream.where(F.col(schema.date).isNotNull()).withColumn("_ts", ts).withWatermark("_ts", lateness)
    cols = schema.present_all(stream)
    return s.groupBy(F.window("_ts", "1 day")).agg(*[F.sum(c).cast("long").alias(c) for c in cols]).select(
        F.to_date(F.col("window.start")).alias(schema.date), *cols)


