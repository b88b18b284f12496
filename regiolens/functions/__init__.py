from regiolens.functions.exprs import (  # noqa: F401
    any_true,
    count_true,
    flag,
    is_close,
    pct_change,
    percentiles,
    ratio,
    row_sum,
    row_sum_skipna,
    rule_rows,
    sum0,
)
