"""Registered queries: validation and data quality."""

from __future__ import annotations

from regiolens.operators import quality as V
from regiolens.params import DEFAULT_PARAMS as P
from regiolens.params import VALID_STATES
from regiolens.plans.oracle_sql import DIRTY, FACT, MS, rnd
from regiolens.plans.q_describe import FACT_COLS, dirty, fact
from regiolens.plans.registry import register
from regiolens.schema import DEFAULT_SCHEMA as S


def dirty_fact(spark, sf_dir):
    return dirty(spark, sf_dir).select(*FACT_COLS)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- V1 -------------------------------------------------------------------------

_SCHEMA_CHECKS_SQL = DIRTY + "\n" + " UNION ALL ".join(
    [f"SELECT 'required_column' AS check_name, {_q(c)} AS column_name, CAST(0 AS BIGINT) AS violations, TRUE AS passed"
     for c in S.required]
    + ["SELECT 'date_type', 'date', 0, TRUE"]
    + [f"SELECT 'non_negative', '{m}', COUNT(*) FILTER (WHERE {m} < 0), COUNT(*) FILTER (WHERE {m} < 0) = 0 FROM dirty"
       for m in MS])


@register("schema_checks", _SCHEMA_CHECKS_SQL)
def q_schema_checks(spark, sf_dir):
    return V.schema_checks(dirty_fact(spark, sf_dir))


def _declared_rows() -> list[str]:
    rows = []
    for c, nullable, lo, hi in V.declared_schema():
        rows.append(f"SELECT 'missing' AS check_name, '{c}' AS column_name, CAST(0 AS BIGINT) AS violations, TRUE AS passed")
        if not nullable:
            rows.append(f"SELECT 'not_null', '{c}', COUNT(*) FILTER (WHERE {c} IS NULL), "
                        f"COUNT(*) FILTER (WHERE {c} IS NULL) = 0 FROM dirty")
        if lo is not None:
            rows.append(f"SELECT 'min', '{c}', COUNT(*) FILTER (WHERE {c} < {lo}), COUNT(*) FILTER (WHERE {c} < {lo}) = 0 FROM dirty")
        if hi is not None:
            rows.append(f"SELECT 'max', '{c}', COUNT(*) FILTER (WHERE {c} > {hi}), COUNT(*) FILTER (WHERE {c} > {hi}) = 0 FROM dirty")
    return rows


@register("declared_schema_checks", DIRTY + "\n" + " UNION ALL ".join(_declared_rows()))
def q_declared(spark, sf_dir):
    return V.declared_schema_checks(dirty_fact(spark, sf_dir))


def _without_rows(gone: str) -> list[str]:
    rows = [r for r in _declared_rows() if f"'{gone}'" not in r]
    return [*rows, f"SELECT 'missing', '{gone}', CAST(1 AS BIGINT), FALSE"]


@register("declared_schema_column_missing", DIRTY + "\n" + " UNION ALL ".join(_without_rows(MS[1])))
def q_declared_missing(spark, sf_dir):
    """V2 on a table that lacks a declared column."""
    return V.declared_schema_checks(dirty_fact(spark, sf_dir).drop(MS[1]))


# --- V5-V8 ----------------------------------------------------------------------

_KEYS = ", ".join(S.keys)


def _rule_sql(rule: str, col: str, cond: str) -> str:
    return (f"SELECT '{rule}' AS rule, '{col}' AS column_name, "
            f"(SELECT COUNT(*) FROM dirty WHERE {cond}) AS violations, "
            f"(SELECT COUNT(*) FROM dirty WHERE {cond}) = 0 AS passed, "
            f"(SELECT string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY record_id) FROM "
            f"(SELECT record_id FROM dirty WHERE {cond} ORDER BY record_id LIMIT 5)) AS sample_ids")


_RULES_CTE = f"""{DIRTY},
dg AS (SELECT {_KEYS}, COUNT(*) AS n, MIN(record_id) AS first_id FROM dirty GROUP BY {_KEYS} HAVING COUNT(*) > 1),
rules AS (
{" UNION ALL ".join([_rule_sql("no_negative_enrollments", m, f"{m} < 0") for m in MS]
                    + [_rule_sql("total_equals_sum", S.total, f"{S.total} <> {' + '.join(MS)}")])}
UNION ALL
SELECT 'no_duplicates', '{",".join(S.keys)}', CAST(COALESCE(SUM(n), 0) AS BIGINT), COALESCE(SUM(n), 0) = 0,
       (SELECT string_agg(CAST(first_id AS VARCHAR), ',' ORDER BY first_id) FROM
          (SELECT first_id FROM dg ORDER BY first_id LIMIT 5))
FROM dg)"""


@register("quality_rules", f"{_RULES_CTE} SELECT * FROM rules")
def q_quality_rules(spark, sf_dir):
    return V.quality_rules(dirty_fact(spark, sf_dir))


@register("duplicate_key_groups",
          f"{DIRTY} SELECT {_KEYS}, COUNT(*) AS group_size FROM dirty GROUP BY {_KEYS} HAVING COUNT(*) > 1")
def q_dup_groups(spark, sf_dir):
    return V.duplicate_key_groups(dirty_fact(spark, sf_dir))


_VALID_LIST = ", ".join(_q(s) for s in VALID_STATES)
_INVALID_SQL = f"SELECT DISTINCT state FROM dirty WHERE state IS NOT NULL AND state NOT IN ({_VALID_LIST})"


@register("invalid_states", f"{DIRTY} {_INVALID_SQL}")
def q_invalid_states(spark, sf_dir):
    return V.invalid_states(dirty_fact(spark, sf_dir))


@register("validation_report", f"""{_RULES_CTE},
decl AS ({" UNION ALL ".join(_declared_rows())}),
allrows AS (
  SELECT 'schema' AS section, check_name, column_name, violations, passed FROM decl
  UNION ALL SELECT 'quality_rules', rule, column_name, violations, passed FROM rules
  UNION ALL SELECT 'states', 'valid_states', 'state', COUNT(*), COUNT(*) = 0 FROM ({_INVALID_SQL}))
SELECT *, bool_and(passed) OVER () AS overall_status FROM allrows""")
def q_validation_report(spark, sf_dir):
    return V.validation_report(dirty_fact(spark, sf_dir))


# --- V10 ------------------------------------------------------------------------

def _classes(src: str, rule: str, b) -> str:
    lo, hi, ext = b
    return (f"SELECT '{rule}' AS rule, CASE WHEN v < {lo} THEN 'below_typical_min' WHEN v <= {hi} THEN 'typical' "
            f"WHEN v <= {ext} THEN 'above_typical_max' ELSE 'above_extreme_max' END AS range_class, "
            f"COUNT(*) AS groups FROM {src} GROUP BY 2")


@register("declared_ranges", f"""{DIRTY},
pd AS (SELECT CAST(COALESCE(SUM(total_enrollment), 0) AS BIGINT) AS v FROM dirty
       WHERE pincode IS NOT NULL AND date IS NOT NULL GROUP BY pincode, date),
dm AS (SELECT CAST(COALESCE(SUM(total_enrollment), 0) AS BIGINT) AS v FROM dirty
       WHERE state IS NOT NULL AND district IS NOT NULL AND year_month IS NOT NULL GROUP BY state, district, year_month),
gs AS (SELECT COUNT(*) AS n FROM dirty
       WHERE state IS NOT NULL AND district IS NOT NULL AND year_month IS NOT NULL GROUP BY state, district, year_month)
SELECT 'valid_date_range' AS rule, 'outside' AS range_class,
       COUNT(*) FILTER (WHERE date < DATE '{P.min_valid_date}' OR date > current_date) AS groups FROM dirty
UNION ALL {_classes('pd', 'daily_per_pincode', P.pin_daily_typical)}
UNION ALL {_classes('dm', 'monthly_per_district', P.district_monthly_typical)}
UNION ALL SELECT 'min_group_size', 'below', COUNT(*) FILTER (WHERE n < {P.min_group_size}) FROM gs""")
def q_declared_ranges(spark, sf_dir):
    return V.declared_ranges(dirty_fact(spark, sf_dir))


# --- V11-V14 ----------------------------------------------------------------------

def _dri_select(by: list[str]) -> str:
    n = "CAST(COUNT(*) AS DOUBLE)"
    nn = " + ".join(f"COUNT({c})" for c in FACT_COLS)
    comp = f"CAST(({nn}) AS DOUBLE) / ({n} * {float(len(FACT_COLS))})"
    calc = " + ".join(f"COALESCE({m}, 0)" for m in MS)
    cons = (f"AVG(CASE WHEN ABS(CAST(total_enrollment AS DOUBLE) - CAST(({calc}) AS DOUBLE)) <= "
            f"1e-8 + 1e-5 * ABS(CAST(({calc}) AS DOUBLE)) THEN 1.0 ELSE 0.0 END)")
    checks = [f"CAST(COUNT(*) FILTER (WHERE {m} >= 0) AS DOUBLE) / {n}" for m in MS]
    checks.append(f"CAST(COUNT(date) AS DOUBLE) / {n}")
    checks.append(f"CAST(COUNT(*) FILTER (WHERE pincode BETWEEN {P.pincode_min} AND {P.pincode_max}) AS DOUBLE) / {n}")
    val = f"(0.0 + {' + '.join(checks)}) / {float(len(checks))}"
    keys = "".join(f"{k}, " for k in by)
    where = (" WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in by)) if by else ""
    group = (" GROUP BY " + ", ".join(by)) if by else ""
    wc, ws, wv = P.dri_weights
    return f"""{DIRTY},
c AS (SELECT {keys}{comp} AS completeness, {cons} AS consistency, {val} AS validity FROM dirty{where}{group})
SELECT {keys}{rnd(f'{wc} * completeness + {ws} * consistency + {wv} * validity', 3)} AS dri_score,
       CASE WHEN {wc} * completeness + {ws} * consistency + {wv} * validity >= {P.min_acceptable_dri}
            THEN 'PASS' ELSE 'FAIL' END AS assessment,
       {rnd('completeness', 3)} AS completeness, {rnd('consistency', 3)} AS consistency,
       {rnd('validity', 3)} AS validity
FROM c"""


@register("dri_overall", _dri_select([]))
def q_dri_overall(spark, sf_dir):
    return V.dri(dirty_fact(spark, sf_dir))


@register("dri_by_district", _dri_select(list(S.geo)))
def q_dri_by_district(spark, sf_dir):
    return V.dri(dirty_fact(spark, sf_dir), by=list(S.geo))


# --- V15-V18 ----------------------------------------------------------------------

_EXT_FLAGS = [f"{m}_{k}" for m in MS for k in ("extreme_pct", "extreme_iqr", "extreme_zscore", "is_extreme")]
_ROW_KEYS = ["record_id", "date", "state", "district", "pincode", *MS]


def _extreme_sql() -> str:
    p = P.extreme_percentile / 100.0
    stats = ", ".join(
        f"quantile_cont(CAST({m} AS DOUBLE), [0.25, 0.75, {p}]) AS {m}_q, AVG(CAST({m} AS DOUBLE)) AS {m}_mean, "
        f"stddev_samp(CAST({m} AS DOUBLE)) AS {m}_std" for m in MS)
    sel = []
    for m in MS:
        x = f"CAST(d.{m} AS DOUBLE)"
        fp = f"COALESCE({x} > s.{m}_q[3], FALSE)"
        fi = f"COALESCE({x} > s.{m}_q[2] + {P.governance_iqr_multiplier} * (s.{m}_q[2] - s.{m}_q[1]), FALSE)"
        fz = f"COALESCE(s.{m}_std > 0 AND ABS(({x} - s.{m}_mean) / s.{m}_std) > {P.governance_z_threshold}, FALSE)"
        sel += [f"{fp} AS {m}_extreme_pct", f"{fi} AS {m}_extreme_iqr", f"{fz} AS {m}_extreme_zscore",
                f"(CAST({fp} AS INT) + CAST({fi} AS INT) + CAST({fz} AS INT)) >= 2 AS {m}_is_extreme"]
    return f"""{DIRTY},
s AS (SELECT {stats} FROM dirty),
e AS (SELECT {', '.join('d.' + c for c in _ROW_KEYS)}, {', '.join(sel)} FROM dirty d, s)
SELECT *, {' OR '.join(f'{m}_is_extreme' for m in MS)} AS has_extreme_values FROM e"""


@register("extreme_values", _extreme_sql())
def q_extreme_values(spark, sf_dir):
    out = V.extreme_values(dirty_fact(spark, sf_dir))
    return out.select(*_ROW_KEYS, *_EXT_FLAGS, "has_extreme_values")


_KANON_KEYS = [S.state, S.district, S.year_month]


@register("k_anonymity", f"""{FACT},
g AS (SELECT state, district, year_month FROM fact
      WHERE state IS NOT NULL AND district IS NOT NULL AND year_month IS NOT NULL
      GROUP BY ALL HAVING COUNT(*) >= {P.k_anonymity})
SELECT {', '.join('f.' + c for c in _ROW_KEYS)}, f.year_month FROM fact f JOIN g USING (state, district, year_month)""")
def q_k_anonymity(spark, sf_dir):
    """V16 on (state, district, month) groups, where small groups exist."""
    return V.k_anonymity(fact(spark, sf_dir), _KANON_KEYS).select(*_ROW_KEYS, S.year_month)


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing FROM dirty" for c in FACT_COLS)


@register("missing_by_column", f"{DIRTY} SELECT * FROM ({_MISSING_SQL}) WHERE missing > 0")
def q_missing(spark, sf_dir):
    return V.missing_by_column(dirty_fact(spark, sf_dir))


_DUP_SQL = (f"SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_records FROM "
            f"(SELECT COUNT(*) AS n FROM dirty GROUP BY {', '.join(FACT_COLS)})")


@register("duplicate_rows", f"{DIRTY} {_DUP_SQL}")
def q_duplicate_rows(spark, sf_dir):
    return V.duplicate_rows(dirty_fact(spark, sf_dir))


# --- V19-V20 --------------------------------------------------------------------

def _report_sql() -> str:
    # Assemble from standalone pieces to keep each part identical to its own oracle.
    dri_body = _dri_select([])[len(DIRTY) + 2:]  # "c AS (...) SELECT ..." after the shared WITH block
    c_cte, dri_final = dri_body.split("\nSELECT ", 1)
    ext_body = _extreme_sql()[len(DIRTY) + 2:]
    ext_ctes, ext_final = ext_body.split("\nSELECT ", 1)
    nulls = " + ".join(f"(COUNT(*) - COUNT({c}))" for c in FACT_COLS)
    neg = " + ".join(f"CASE WHEN COUNT(*) FILTER (WHERE {m} < 0) > 0 THEN 1 ELSE 0 END" for m in MS)
    return f"""{DIRTY},
{c_cte},
r AS (SELECT {dri_final}),
{ext_ctes},
ex AS (SELECT {ext_final}),
m AS (SELECT COUNT(*) AS total_records, CAST({nulls} AS BIGINT) AS missing_total FROM dirty),
sc AS (SELECT ({neg}) = 0 AS schema_valid, CAST({neg} AS BIGINT) AS schema_issues FROM dirty),
dup AS ({_DUP_SQL}),
exc AS (SELECT COUNT(*) FILTER (WHERE has_extreme_values) AS extreme_values FROM ex)
SELECT m.total_records, m.missing_total,
       {rnd('m.missing_total * 100.0 / (m.total_records * ' + str(float(len(FACT_COLS))) + ')', 2)} AS missing_pct,
       sc.schema_valid, sc.schema_issues, r.dri_score, r.assessment, r.completeness, r.consistency, r.validity,
       dup.duplicate_records, exc.extreme_values
FROM m, sc, r, dup, exc"""


@register("quality_report", _report_sql())
def q_quality_report(spark, sf_dir):
    return V.quality_report(dirty_fact(spark, sf_dir))


@register("quality_recommendations", f"""WITH q AS ({_report_sql()}),
r AS (
  SELECT 1 AS rank, 'CRITICAL: Fix schema validation issues before analysis' AS recommendation FROM q WHERE NOT schema_valid
  UNION ALL SELECT 2, 'DRI score (' || CAST(dri_score AS VARCHAR) || ') below threshold ({P.min_acceptable_dri})' FROM q WHERE assessment = 'FAIL'
  UNION ALL SELECT 3, 'Improve data completeness: investigate missing values' FROM q WHERE assessment = 'FAIL' AND completeness < 0.95
  UNION ALL SELECT 4, 'Fix data consistency: verify total enrollment calculations' FROM q WHERE assessment = 'FAIL' AND consistency < 0.95
  UNION ALL SELECT 5, 'Validate data ranges: check for invalid values' FROM q WHERE assessment = 'FAIL' AND validity < 0.95)
SELECT * FROM r UNION ALL SELECT 6, 'Data quality is satisfactory for analysis' WHERE NOT EXISTS (SELECT 1 FROM r)""")
def q_quality_recs(spark, sf_dir):
    return V.quality_recommendations(V.quality_report(dirty_fact(spark, sf_dir)))
