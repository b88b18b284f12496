"""Building blocks for the DuckDB oracle texts.

The oracle recomputes every registered query from the driver tables with plain
SQL, independently of the Spark code.  Rounding to ``n`` decimals goes through
the shortest decimal text of the double, so that half-way cases round like
Spark's ``round`` (half up on the decimal form of the double).
"""

from __future__ import annotations

from regiolens.schema import DEFAULT_SCHEMA as S
from regiolens.sources import tpch

MS = list(S.measures)
M = MS + [S.total]
FLAGS = dict(zip(MS, tpch.RETURNFLAG_OF_MEASURE))


def rnd(expr: str, n: int) -> str:
    """Spark-compatible ROUND(expr, n) as DOUBLE."""
    return f"CAST(ROUND(CAST(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {n}) AS DOUBLE)"


def r6(expr: str) -> str:
    return f"ROUND(CAST(({expr}) AS DOUBLE), 6)"


def div(a: str, b: str) -> str:
    """a / b as DOUBLE, NULL when b is 0 or NULL (Spark ``try_divide``)."""
    return f"(CAST(({a}) AS DOUBLE) / CAST(NULLIF(({b}), 0) AS DOUBLE))"


RAW_CTE = f"""raw AS (
  SELECT o_orderkey AS record_id, CAST(o_orderdate AS DATE) AS date, n_name AS state,
         n_name || '-' || c_mktsegment AS district, CAST(100000 + c_custkey AS BIGINT) AS pincode,
         {', '.join(f"CAST(SUM(CASE WHEN l_returnflag = '{FLAGS[m]}' THEN l_quantity ELSE 0 END) AS BIGINT) AS {m}" for m in MS)}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  GROUP BY o_orderkey, o_orderdate, n_name, c_mktsegment, c_custkey
)"""

DIRTY_RAW_CTE = RAW_CTE + f""",
dirty0 AS (
  SELECT record_id,
         CASE WHEN record_id % {tpch.DEFECT_NO_DATE_EVERY} = 0 THEN NULL ELSE date END AS date,
         state, district,
         CASE WHEN record_id % {tpch.DEFECT_BAD_PIN_EVERY} = 0 THEN {tpch.DEFECT_BAD_PIN} ELSE pincode END AS pincode,
         CASE WHEN record_id % {tpch.DEFECT_NULL_EVERY} = 0 THEN NULL ELSE {MS[0]} END AS {MS[0]},
         CASE WHEN record_id % {tpch.DEFECT_NEGATIVE_EVERY} = 0 THEN -{MS[1]} ELSE {MS[1]} END AS {MS[1]},
         {MS[2]}
  FROM raw
),
draw AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE record_id % {tpch.DEFECT_DUPLICATE_EVERY} = 0)"""


def _derived(src: str, name: str, columns: str = "*") -> str:
    total = " + ".join(MS)
    pcts = ", ".join(
        f"COALESCE({rnd(div(m, 'total_enrollment') + ' * 100', 2)}, 0.0) AS pct_{m}" for m in MS)
    return f"""{name}_base AS (
  SELECT *, year(date) AS year, month(date) AS month, quarter(date) AS quarter,
         CAST(date_trunc('month', date) AS DATE) AS year_month, isodow(date) - 1 AS day_of_week,
         weekofyear(date) AS week_of_year, {total} AS total_enrollment
  FROM {src}
),
{name} AS (SELECT {columns}, {pcts} FROM {name}_base)"""


# totals of the dirty fact that disagree with the measures
_BROKEN = (f"* REPLACE (CASE WHEN record_id % {tpch.DEFECT_TOTAL_EVERY} = 0 THEN total_enrollment + 1 "
           "ELSE total_enrollment END AS total_enrollment)")


# ``fact``: clean derived fact; ``dirty``: the same with injected defects.
FACT = "WITH " + RAW_CTE + ",\n" + _derived("raw", "fact")
DIRTY = "WITH " + DIRTY_RAW_CTE + ",\n" + _derived("draw", "dirty", _BROKEN)
BOTH = "WITH " + DIRTY_RAW_CTE + ",\n" + _derived("raw", "fact") + ",\n" + _derived("draw", "dirty", _BROKEN)


# ``fact`` with every measure of each PLANTED_EVERY-th record raised PLANTED_TIMES times
PLANTED_EVERY, PLANTED_TIMES = 1009, 60
PLANTED = "WITH " + RAW_CTE + f""",
planted AS (SELECT * REPLACE ({", ".join(f"CASE WHEN record_id % {PLANTED_EVERY} = 0 THEN {m} * {PLANTED_TIMES} ELSE {m} END AS {m}" for m in MS)})
            FROM raw),\n""" + _derived("planted", "fact")


def sums(cols=None, src_alias: str = "") -> str:
    cols = cols or M
    p = f"{src_alias}." if src_alias else ""
    return ", ".join(f"CAST(COALESCE(SUM({p}{c}), 0) AS BIGINT) AS {c}" for c in cols)
