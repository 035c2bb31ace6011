"""Scalar Column helpers (P1 coercion, hash draws, quantile rank, tier pick, packed keys)."""

from .columns import (  # noqa: F401
    dlit,
    double_array,
    first_matching_tier,
    hours_between,
    left_rank,
    linear,
    linear_sql,
    logistic,
    pair_id,
    pair_key,
    pair_ts,
    percentile_from_rank,
    safe_div,
    to_number,
    uniform_draw,
)
