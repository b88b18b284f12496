"""Registered queries (Spark) and their independent SQL oracles (DuckDB).

Each query is ``(spark, sf_dir) -> DataFrame`` over the driver tables; the
oracle is a standalone SQL text over the same tables.  ``tidy`` makes the
Spark output comparable: integral columns as BIGINT, floating columns rounded
to 6 decimals (the oracle texts round the same way).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiolens.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, oracle: str | None = None):
    """Decorator: add a query (and its oracle SQL, when SQL can express it)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)  # workers must import regiolens for the pandas UDFs
            return tidy(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco
