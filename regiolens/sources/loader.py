"""CSV sources and derived columns.

``load_directory`` concatenates files **by column name** like the reference.
Spark's multi-file CSV reader is positional, so files are grouped by their
header line and each group is one ``spark.read.csv`` with that header's string
schema; groups are combined with ``unionByName(allowMissingColumns=True)``.  The
headers come from fetching each file's first buffer, so the bytes of a file are
read once.  In the usual case (one header) the data is a single distributed scan
of the directory.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiolens.functions.exprs import ratio, row_sum
from regiolens.schema import DEFAULT_SCHEMA, FactSchema

DATE_FORMAT = "dd-MM-yyyy"  # fixed input date format


def normalize_header(name: str) -> str:
    """Lower-case, trim, spaces and '-' to '_' (S5)."""
    return re.sub(r"[\s\-]+", "_", name.strip().lower())


def header_mapping(columns: Sequence[str], schema: FactSchema = DEFAULT_SCHEMA) -> dict[str, str]:
    """Map raw header names to required names where the normalised form matches."""
    wanted = set(schema.required) | {schema.total}
    out = {}
    for c in columns:
        n = normalize_header(c)
        if n in wanted and n != c:
            out[c] = n
    return out


def looks_compatible(columns: Sequence[str], schema: FactSchema = DEFAULT_SCHEMA) -> bool:
    """The reference's quick check: date, state and district appear in the header."""
    norm = [normalize_header(c) for c in columns]
    return all(any(key in c for c in norm) for key in (schema.date, schema.state, schema.district))


CSV_GLOB = "*.[cC][sS][vV]"


def _first_line(spark: SparkSession, file: str) -> str:
    """The first line of a file in any file system Spark reads (one buffer is fetched)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def header_groups(spark: SparkSession, path: str | Sequence[str], threads: int = 16) -> dict[str, list[str] | None]:
    """Files of each header line (None where all files have the same).

    Only first lines are fetched: the planner lists the files anyway, and a job
    would read them to the end (no DataFrame operation stops a partition early)."""
    files = [unquote(f) for f in spark.read.option("pathGlobFilter", CSV_GLOB).text(path).inputFiles()]
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(max_workers=threads) as pool:
        for f, line in zip(files, pool.map(lambda f: _first_line(spark, f), files), strict=True):
            groups.setdefault(line.lstrip("\ufeff").rstrip("\r"), []).append(f)
    return {h: sorted(groups[h]) if len(groups) > 1 else None for h in sorted(groups)}


def _renamed(df: DataFrame, schema: FactSchema) -> DataFrame:
    """Normalised names; where several headers normalise to one required name,
    the first non-null of them."""
    names = header_mapping(df.columns, schema)
    target = [names.get(c, c) for c in df.columns]
    by: dict[str, list[str]] = {}
    for c, t in zip(df.columns, target, strict=True):
        by.setdefault(t, []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(t) for t, cs in by.items()])


def _typed(df: DataFrame, schema: FactSchema) -> DataFrame:
    exprs = []
    for c in df.columns:
        if c in (schema.unit, *schema.measures, schema.total):
            exprs.append(F.expr(f"try_cast(`{c}` AS BIGINT)").alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def load_directory(spark: SparkSession, path: str | Sequence[str], schema: FactSchema = DEFAULT_SCHEMA,
                   derive: bool = True, normalize: bool = True, file_column: str | None = None) -> DataFrame:
    """Every CSV of a directory (or one file, or a list), by column
    name; ``file_column`` names a column that holds each row's file."""
    try:
        groups = header_groups(spark, path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if not groups:
        raise FileNotFoundError(f"No CSV files found in {path}")
    parts = []
    if any(groups):  # files without a line hold no rows
        groups.pop("", None)
    for header, paths in groups.items():
        cols = next(csv.reader([header]))
        string_schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        df = spark.read.csv(path if paths is None else paths, header=True, schema=string_schema, mode="PERMISSIVE", pathGlobFilter=CSV_GLOB)
        if file_column:
            df = df.withColumn(file_column, F.col("_metadata.file_path"))
        if normalize:
            df = _renamed(df, schema)
        parts.append(_typed(df, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return derive_columns(out, schema) if derive else out


def load_file(spark: SparkSession, path: str, schema: FactSchema = DEFAULT_SCHEMA, derive: bool = True) -> DataFrame:
    """One CSV file; error when absent."""
    return load_directory(spark, path, schema, derive)


def parse_date(c: Column | str, fmt: str = DATE_FORMAT) -> Column:
    """String date in ``fmt``; unparseable -> NULL (dates pass through)."""
    return F.try_to_date(F.col(c) if isinstance(c, str) else c, fmt)


def derive_columns(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Typed date, calendar features, row total and row shares."""
    d = F.col(schema.date)
    if isinstance(df.schema[schema.date].dataType, T.StringType):
        d = parse_date(d)
    else:
        d = d.cast("date")
    df = df.withColumn(schema.date, d)
    measures = schema.present_measures(df)
    total = row_sum(measures).cast("long")  # NULL propagates, like a + b + c
    d = F.col(schema.date)
    return df.withColumns({
        "year": F.year(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        schema.year_month: F.trunc(d, "MM"),
        "day_of_week": F.weekday(d),  # Monday = 0
        "week_of_year": F.weekofyear(d),  # ISO week
        schema.total: total,
    }).withColumns({
        f"pct_{m}": F.coalesce(F.round(ratio(m, schema.total) * F.lit(100.0), 2), F.lit(0.0))
        for m in measures
    })


def cached(df: DataFrame) -> DataFrame:
    """Keep the loaded table for repeated use (recomputed from lineage on loss)."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)
