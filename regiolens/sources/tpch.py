"""Adapter: driver TPC-H tables -> enrollment-shaped fact table.

One row per order: the order date is the observation day, the customer's
nation the state, nation + market segment the district, the customer key the
PIN code, and the quantities of the three return flags the three age groups.

Plan: lineitem is pre-aggregated on ``l_orderkey`` (map-side partial
aggregation, only three columns read), which leaves it hash-partitioned on the
key the orders join needs; customer joins on its key (AQE picks broadcast from
runtime statistics when it is small); nation is 25 rows by the TPC-H spec and
is broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolens.schema import DEFAULT_SCHEMA, FactSchema

# Return flag that feeds each age group, in measure order (fixed mapping).
RETURNFLAG_OF_MEASURE = ("A", "N", "R")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def enrollment_from_tpch(spark: SparkSession, sf_dir: str, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Raw fact: record_id, date, state, district, pincode and the measures."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    per_order = li.groupBy("l_orderkey").agg(*[
        F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(F.lit(0.0)))
        .cast("long").alias(m)
        for m, flag in zip(schema.measures, RETURNFLAG_OF_MEASURE)
    ])
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.col("o_orderkey").alias(schema.record_id),
        F.to_date("o_orderdate").alias(schema.date),
        F.col("n_name").alias(schema.state),
        F.concat(F.col("n_name"), F.lit("-"), F.col("c_mktsegment")).alias(schema.district),
        (F.lit(100000) + F.col("c_custkey")).cast("long").alias(schema.unit),
        *[F.col(m) for m in schema.measures],
    )


# Defect injection (fixed strides over the record key): null, negative, bad PIN,
# unparseable date and duplicated rows, so the quality operators have work to do
# on the otherwise clean driver data.  Every row of the table is kept.
DEFECT_NULL_EVERY = 97
DEFECT_NEGATIVE_EVERY = 101
DEFECT_BAD_PIN_EVERY = 89
DEFECT_NO_DATE_EVERY = 103
DEFECT_DUPLICATE_EVERY = 50
DEFECT_BAD_PIN = 99999
DEFECT_TOTAL_EVERY = 107  # the derived total of these rows is one too high


def inject_defects(raw: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    rid = F.col(schema.record_id)
    m_null, m_neg = schema.measures[0], schema.measures[1]
    out = raw.select(
        rid,
        F.when(rid % DEFECT_NO_DATE_EVERY == 0, F.lit(None).cast("date")).otherwise(F.col(schema.date)).alias(schema.date),
        F.col(schema.state),
        F.col(schema.district),
        F.when(rid % DEFECT_BAD_PIN_EVERY == 0, F.lit(DEFECT_BAD_PIN).cast("long")).otherwise(F.col(schema.unit)).alias(schema.unit),
        *[
            (F.when(rid % DEFECT_NULL_EVERY == 0, F.lit(None).cast("long")).otherwise(F.col(m)) if m == m_null
             else F.when(rid % DEFECT_NEGATIVE_EVERY == 0, -F.col(m)).otherwise(F.col(m)) if m == m_neg
             else F.col(m)).alias(m)
            for m in schema.measures
        ],
    )
    return out.unionByName(out.where(rid % DEFECT_DUPLICATE_EVERY == 0))


def dirty_enrollment_from_tpch(spark: SparkSession, sf_dir: str, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    return inject_defects(enrollment_from_tpch(spark, sf_dir, schema), schema)


def break_totals(derived: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Totals that disagree with the measures, planted after the derive step."""
    wrong = F.col(schema.record_id) % DEFECT_TOTAL_EVERY == 0
    return derived.withColumn(schema.total, F.when(wrong, F.col(schema.total) + 1).otherwise(F.col(schema.total)))


def events_as_daily_fact(spark: SparkSession, sf_dir: str, measure: str = "value") -> DataFrame:
    """``events`` as a one-measure daily table (date, event_type, value)."""
    ev = read_table(spark, sf_dir, "events").select("ts", "event_type", measure)
    return ev.select(F.to_date("ts").alias("date"), "event_type", F.col(measure).alias("value"))
