"""Validation and data quality.

All counts of one kind come from one aggregate (one scan); checks become rows
of a tidy table ``(check/rule, column_name, violations, passed)``.  Sample
violators are the five smallest record ids per rule, taken with an ordered
``limit`` (a bounded top-k in every task), never by collecting a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiolens.functions.exprs import flag, is_close, row_sum, row_sum_skipna, rule_rows
from regiolens.functions.ranks import exact_percentiles
from regiolens.params import DEFAULT_PARAMS, QUALITY_FINE, QUALITY_TEXTS, VALID_STATES, Params
from regiolens.plans import marts
from regiolens.schema import DEFAULT_SCHEMA, FactSchema

CHECK_COLS = ("check_name", "column_name", "violations", "passed")


def _rows(items: Sequence[tuple[Column, Column, Column]]) -> Column:
    """inline-able array of (check_name, column_name, violations, passed)."""
    return F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.lit(col).alias("column_name"),
                 v.cast("long").alias("violations"), (v.cast("long") == 0).alias("passed"))
        for name, col, v in items
    ])


# --- V1 ---------------------------------------------------------------------------

def schema_checks(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """V1: required columns present, date typed as a date, no negative ages."""
    return df.agg(_rows(_schema_items(df, schema)).alias("r")).select(F.inline("r"))


def _schema_items(df: DataFrame, schema: FactSchema) -> list[tuple[str, str, Column]]:
    items = [("required_column", c, F.lit(0 if c in df.columns else 1)) for c in schema.required]
    if schema.date in df.columns:
        is_date = isinstance(df.schema[schema.date].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        items.append(("date_type", schema.date, F.lit(0 if is_date else 1)))
    items += [("non_negative", m, F.count_if(F.col(m) < 0)) for m in schema.present_measures(df)]
    return items


# --- V2-V4 ------------------------------------------------------------------------

def declared_schema(schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS) -> list[tuple]:
    """(column, nullable, min, max) of the declared schema."""
    rows = [(schema.date, False, None, None), (schema.state, False, None, None),
            (schema.district, False, None, None), (schema.unit, False, params.pincode_min, params.pincode_max)]
    rows += [(m, False, params.measure_min, params.measure_max) for m in schema.measures]
    return rows


def declared_schema_checks(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA,
                           params: Params = DEFAULT_PARAMS) -> DataFrame:
    """V2-V4: missing columns, non-null and min/max constraints, one scan."""
    return df.agg(_rows(_declared_items(df, schema, params)).alias("r")).select(F.inline("r"))


def _declared_items(df: DataFrame, schema: FactSchema, params: Params) -> list[tuple[str, str, Column]]:
    items = []
    for c, nullable, lo, hi in declared_schema(schema, params):
        if c not in df.columns:
            items.append(("missing", c, F.lit(1)))
            continue
        items.append(("missing", c, F.lit(0)))
        if not nullable:
            items.append(("not_null", c, F.count_if(F.col(c).isNull())))
        if lo is not None:
            items.append(("min", c, F.count_if(F.col(c) < lo)))
        if hi is not None:
            items.append(("max", c, F.count_if(F.col(c) > hi)))
    return items


# --- V5-V7 ------------------------------------------------------------------------

def _rule_conditions(df: DataFrame, schema: FactSchema) -> list[tuple[str, str, Column]]:
    ms = schema.present_measures(df)
    rules = [("no_negative_enrollments", m, F.col(m) < 0) for m in ms]
    if schema.total in df.columns:
        rules.append(("total_equals_sum", schema.total, F.col(schema.total) != row_sum(ms)))
    return rules


def row_label(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> Column:
    """What names a row in a sample: its record id, or without one its keys and
    measures as text."""
    cols = schema.row_order(df)
    if cols == [schema.record_id]:
        return F.col(schema.record_id)
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def quality_rules(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """V5-V7: no negative ages, total = sum of ages, no duplicate keys.

    Duplicates count every row of a duplicated key group (``keep=False``);
    NULL keys compare equal, as in pandas.  Samples: the five smallest row labels
    of each rule.  One pass takes the violating rows with the rules they break
    (counts and samples come from them), one groups the keys.
    """
    rules = _rule_conditions(df, schema)
    keys = list(schema.keys)
    names = [(r, c) for r, c, _ in rules] + [("no_duplicates", ",".join(keys))]
    label = row_label(df, schema)
    broken = F.filter(F.array(*[F.when(flag(cond), F.lit(i)) for i, (_, _, cond) in enumerate(rules)]),
                      lambda i: i.isNotNull())
    hits = df.select(F.explode(broken).alias("i"), label.alias("_id"), F.lit(1).cast("long").alias("_n"))
    groups = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(label).alias("_id")).where(F.col("_n") > 1)
              .select(F.lit(len(rules)).alias("i"), "_id", "_n"))
    every = hits.unionByName(groups)
    # partial sums and a bounded list of the smallest labels; ties collapse to one label per row
    place = F.row_number().over(Window.partitionBy("i").orderBy("_id"))
    per = every.groupBy("i", "_id").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    first = (per.withColumn("_p", place).where(F.col("_p") <= 5)
             .groupBy("i").agg(F.sort_array(F.collect_list(F.struct("_id", "_rows"))).alias("s")))
    ids = F.slice(F.flatten(F.transform("s", lambda x: F.array_repeat(x["_id"].cast("string"), x["_rows"].cast("int")))), 1, 5)
    counts = every.groupBy("i").agg(F.sum("_n").alias("violations"))
    listed = df.sparkSession.range(1).select(F.posexplode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column_name")) for r, c in names])).alias("i", "x")).select("i", "x.*")
    return (listed.join(counts, "i", "left").join(first.select("i", F.array_join(ids, ",").alias("sample_ids")), "i", "left")
            .select("rule", "column_name", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
                    (F.coalesce("violations", F.lit(0)) == 0).alias("passed"), "sample_ids"))


def duplicate_key_groups(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """All duplicated key groups with their sizes (the reference prints five)."""
    keys = list(schema.keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1)


# --- V8 ---------------------------------------------------------------------------

def invalid_states(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA,
                   valid: Sequence[str] = VALID_STATES) -> DataFrame:
    """V8: distinct state names not in the reference list (list has fixed size)."""
    spark = df.sparkSession
    ref = spark.createDataFrame([(s,) for s in valid], f"{schema.state} string")
    states = df.where(F.col(schema.state).isNotNull()).select(schema.state).distinct()
    return states.join(F.broadcast(ref), schema.state, "left_anti")


# --- V9 ---------------------------------------------------------------------------

def validation_report(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """V9: all validator checks as rows plus ``overall_status`` (AND of all).
    Three passes: all counts in one aggregate, key groups, state names."""
    items = [("schema", *x) for x in _declared_items(df, schema, params)]
    items += [("quality_rules", r, c, F.count_if(flag(cond))) for r, c, cond in _rule_conditions(df, schema)]
    counted = df.agg(F.array(*[
        F.struct(F.lit(sec).alias("section"), F.lit(n).alias("check_name"), F.lit(c).alias("column_name"),
                 v.cast("long").alias("violations")) for sec, n, c, v in items]).alias("r")).select(F.inline("r"))
    dups = duplicate_key_groups(df, schema).agg(F.coalesce(F.sum("group_size"), F.lit(0)).cast("long").alias("violations")).select(
        F.lit("quality_rules").alias("section"), F.lit("no_duplicates").alias("check_name"),
        F.lit(",".join(schema.keys)).alias("column_name"), "violations")
    bad = invalid_states(df, schema, VALID_STATES).agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("states").alias("section"), F.lit("valid_states").alias("check_name"),
        F.lit(schema.state).alias("column_name"), "violations")
    allrows = counted.unionByName(dups).unionByName(bad).withColumn("passed", F.col("violations") == 0)
    return allrows.withColumn("overall_status", F.bool_and("passed").over(Window.partitionBy()))


# --- V10 --------------------------------------------------------------------------

def _range_classes(totals: DataFrame, value: str, bounds: tuple[int, int, int], rule: str) -> DataFrame:
    lo, hi, ext = bounds
    v = F.col(value)
    cls = (F.when(v < lo, "below_typical_min").when(v <= hi, "typical")
           .when(v <= ext, "above_typical_max").otherwise("above_extreme_max"))
    return totals.groupBy(cls.alias("range_class")).agg(F.count(F.lit(1)).alias("groups")).select(
        F.lit(rule).alias("rule"), "range_class", "groups")


def declared_ranges(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS,
                    as_of: Column | None = None) -> DataFrame:
    """Declared but unused rules of the reference, applied.

    Dates outside [min_valid_date, as_of]; daily total per PIN and monthly total
    per district in typical / extreme classes; district-month groups smaller
    than the minimum reporting size.
    """
    as_of = F.current_date() if as_of is None else as_of
    d = F.col(schema.date)
    dates = df.agg(F.count_if((d < F.to_date(F.lit(params.min_valid_date))) | (d > as_of)).alias("groups")).select(
        F.lit("valid_date_range").alias("rule"), F.lit("outside").alias("range_class"), "groups")
    pin_day = marts.group_totals(df, [schema.unit, schema.date], [schema.total], schema)
    dist_month = marts.group_totals(df, [*schema.geo, schema.year_month], [schema.total], schema)
    small = marts.not_null_keys(df, [*schema.geo, schema.year_month]).groupBy(*schema.geo, schema.year_month) \
        .agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") < params.min_group_size).alias("groups")) \
        .select(F.lit("min_group_size").alias("rule"), F.lit("below").alias("range_class"), "groups")
    return (dates.unionByName(_range_classes(pin_day, schema.total, params.pin_daily_typical, "daily_per_pincode"))
            .unionByName(_range_classes(dist_month, schema.total, params.district_monthly_typical,
                                        "monthly_per_district"))
            .unionByName(small))


# --- V11-V14 ----------------------------------------------------------------------

def _dri_aggs(df: DataFrame, schema: FactSchema, params: Params) -> dict[str, Column]:
    ms = schema.present_measures(df)
    n = F.count(F.lit(1)).cast("double")
    non_null = sum((F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0)).cast("double")
    completeness = F.try_divide(non_null, n * F.lit(float(len(df.columns))))
    if schema.total in df.columns:
        consistency = F.avg(is_close(schema.total, row_sum_skipna(ms)).cast("double"))
    else:
        consistency = F.lit(1.0)
    checks = [F.try_divide(F.count_if(F.col(m) >= 0), n) for m in ms]
    if schema.date in df.columns:
        checks.append(F.try_divide(F.count(schema.date), n))
    if schema.unit in df.columns:
        checks.append(F.try_divide(F.count_if(F.col(schema.unit).between(params.pincode_min, params.pincode_max)), n))
    validity = (sum(checks, F.lit(0.0)) / F.lit(float(len(checks)))) if checks else F.lit(1.0)
    return {"completeness": completeness, "consistency": consistency, "validity": validity}


def dri_components(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS,
                   by: Sequence[str] = ()) -> DataFrame:
    """V11-V13 per ``by`` group: completeness, consistency, validity (unrounded)."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(*[c.alias(n) for n, c in _dri_aggs(df, schema, params).items()])


def _dri_columns(params: Params) -> list[Column]:
    wc, ws, wv = params.dri_weights
    score = wc * F.col("completeness") + ws * F.col("consistency") + wv * F.col("validity")
    return [F.round(score, 3).alias("dri_score"),
            F.when(score >= params.min_acceptable_dri, "PASS").otherwise("FAIL").alias("assessment"),
            *[F.round(c, 3).alias(c) for c in ("completeness", "consistency", "validity")]]


def dri(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS,
        by: Sequence[str] = ()) -> DataFrame:
    """DRI = weighted components; PASS if the unrounded DRI >= threshold.

    ``by=[state, district]`` gives the per-district DRI the policy engine uses.
    """
    comp = dri_components(df, schema, params, by)
    if by:
        comp = marts.not_null_keys(comp, by)
    return comp.select(*by, *_dri_columns(params))


# --- V15 --------------------------------------------------------------------------

def _extreme_fractions(params: Params) -> tuple[float, float, float]:
    return 0.25, 0.75, params.extreme_percentile / 100.0


def extreme_values(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS,
                   stats: Column | None = None) -> DataFrame:
    """Per age column, above P99 / above Q3+1.5*IQR / |z|>3; 2-of-3 vote.

    The column statistics are one aggregate used as a scalar subquery
    (``stats``, where the caller has them already).
    """
    ms = schema.present_measures(df)
    st = stats
    if st is None:
        table = marts.column_stats(df, ms, _extreme_fractions(params), params)
        st = table.select(F.struct(*table.columns).alias("s")).scalar()
    out = df
    flags = {}
    for m in ms:
        x = F.col(m).cast("double")
        q = st[f"{m}_q"]
        mean, std = st[f"{m}_mean"], st[f"{m}_std"]
        q1, q3, pthr = q[0], q[1], q[2]
        f_pct = flag(x > pthr)
        f_iqr = flag(x > q3 + params.governance_iqr_multiplier * (q3 - q1))
        f_z = flag((std > 0) & (F.abs((x - mean) / std) > params.governance_z_threshold))
        flags[f"{m}_extreme_pct"] = f_pct
        flags[f"{m}_extreme_iqr"] = f_iqr
        flags[f"{m}_extreme_zscore"] = f_z
        flags[f"{m}_is_extreme"] = (f_pct.cast("int") + f_iqr.cast("int") + f_z.cast("int")) >= 2
    out = out.withColumns(flags)
    any_ext = F.lit(False)
    for m in ms:
        any_ext = any_ext | F.col(f"{m}_is_extreme")
    return out.withColumn("has_extreme_values", any_ext)


# --- V16 --------------------------------------------------------------------------

def k_anonymity(df: DataFrame, group_cols: Sequence[str], k: int | None = None,
                params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Keep rows of groups with at least ``k`` rows; NULL keys drop.

    Group sizes come from a partially aggregated ``groupBy`` and the kept keys
    are applied with a LEFT SEMI join (AQE splits a skewed key), so a group
    holding a third of the rows never has to fit in one task.
    """
    k = params.k_anonymity if k is None else k
    base = marts.not_null_keys(df, group_cols)
    keep = base.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(*group_cols)
    return base.join(keep, list(group_cols), "left_semi")


# --- V17-V20 ----------------------------------------------------------------------

def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing cells per column, columns with at least one."""
    items = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(f"`{c}`").isNull()).alias("missing"))
             for c in df.columns]
    return df.agg(F.array(*items).alias("r")).select(F.inline("r")).where(F.col("missing") > 0)


def duplicate_rows(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Exact duplicate rows (all but the first of each), NULLs equal.

    Columns derived from the date or the measures cannot differ where those
    agree, so they are not shuffled."""
    derived = {"year", "month", "quarter", schema.year_month, "day_of_week", "week_of_year",
               *(f"pct_{m}" for m in schema.measures)} if schema.date in df.columns else set()
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns if c not in derived]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_records"))


def quality_report(df: DataFrame, schema: FactSchema = DEFAULT_SCHEMA, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """One row: schema validity, DRI and parts, missing, duplicates, extremes.

    Three passes: every count and statistic in one aggregate (a reused scalar
    subquery), the duplicates' grouping, and the extreme rows; two small
    aggregates before them find the exact percentiles."""
    cells = float(len(df.columns))
    checks = [v.cast("long") for _, _, v in _schema_items(df, schema)]
    issues = sum((F.when(v == 0, 0).otherwise(1) for v in checks), F.lit(0)).cast("long")
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0)).cast("long")
    ms = schema.present_measures(df)
    fr = _extreme_fractions(params)
    known = None if params.approx_percentiles else exact_percentiles(df, {m: fr for m in ms})
    base = df.agg(F.count(F.lit(1)).alias("total_records"), missing.alias("missing_total"), issues.alias("schema_issues"),
                  *[c.alias(n) for n, c in _dri_aggs(df, schema, params).items()],
                  *marts.stat_columns(ms, fr, params, known))
    st = base.select(F.struct(*base.columns).alias("s")).scalar()
    ext = extreme_values(df, schema, params, st).agg(F.count_if("has_extreme_values").alias("extreme_values"))
    names = ["total_records", "missing_total", "schema_issues", "completeness", "consistency", "validity"]
    out = ext.select("extreme_values", duplicate_rows(df, schema).scalar().alias("duplicate_records"), *[st[c].alias(c) for c in names])
    return out.select(
        "total_records", "missing_total",
        F.round(F.try_divide(F.col("missing_total") * 100.0, F.col("total_records") * cells), 2).alias("missing_pct"),
        (F.col("schema_issues") == 0).alias("schema_valid"), "schema_issues", *_dri_columns(params),
        "duplicate_records", "extreme_values")


def quality_recommendations(report: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Rule texts over the quality report row."""
    fail = F.col("assessment") == "FAIL"
    broken, *parts = QUALITY_TEXTS
    rules = [
        (~F.col("schema_valid"), F.lit(broken)),
        (fail, F.format_string(f"DRI score (%s) below threshold ({params.min_acceptable_dri})",
                               F.col("dri_score").cast("string"))),
        *[(fail & (F.col(c) < 0.95), F.lit(text)) for c, text in zip(("completeness", "consistency", "validity"), parts, strict=True)],
    ]
    return report.select(F.inline(rule_rows(rules, fallback=QUALITY_FINE)))
