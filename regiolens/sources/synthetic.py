"""Synthetic enrollment rows (S6), generated on the executors.

``spark.range`` spreads the row ids over partitions; every column is a seeded
expression of the id, so the output does not depend on partitioning.  Used
for demos and tests; registered queries read the given tables instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolens.params import VALID_STATES
from regiolens.schema import DEFAULT_SCHEMA, FactSchema


def _u(seed: int, salt: int):
    """Uniform [0, 1) from a hash of the row id (partition independent)."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0


def generate_sample(spark: SparkSession, n: int, seed: int = 42, n_states: int = 10, n_districts: int = 50,
                    start: str = "2025-01-01", days: int = 365, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """n rows over ``n_states`` states, ``n_districts`` districts and one year (CSV-shaped, date as text)."""
    states = F.array(*[F.lit(s) for s in VALID_STATES[:n_states]])
    st_idx = (_u(seed, 1) * n_states).cast("int")
    dist_idx = (_u(seed, 2) * n_districts).cast("int")
    day = F.date_add(F.to_date(F.lit(start)), (_u(seed, 3) * days).cast("int"))
    return spark.range(n).select(
        F.col("id").alias(schema.record_id),
        F.date_format(day, "dd-MM-yyyy").alias(schema.date),
        F.element_at(states, st_idx + 1).alias(schema.state),
        F.concat(F.lit("District_"), dist_idx.cast("string")).alias(schema.district),
        (F.lit(100000) + (_u(seed, 4) * 899999).cast("long")).alias(schema.unit),
        (_u(seed, 5) * 500).cast("long").alias(schema.measures[0]),
        (_u(seed, 6) * 400).cast("long").alias(schema.measures[1]),
        (_u(seed, 7) * 100).cast("long").alias(schema.measures[2]),
    )
