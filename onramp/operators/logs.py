"""Prediction log: flatten (P8), exploration sample (P9), rollup (A12), append sink (K1)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def flatten_for_log(responses: DataFrame, ts_col: str | None = None) -> DataFrame:
    """One flat log row per served response.

    trigger_scores -> JSON text, NULL when empty; pltv fields NULL-safe; tier_avg_ltv is
    not logged. ``timestamp`` is the log time (current_timestamp, UTC session) unless
    ``ts_col`` names a column to use instead (replays).
    """
    ts = F.current_timestamp() if ts_col is None else F.col(ts_col)
    scores = F.when(F.size("trigger_scores") > 0, F.to_json("trigger_scores"))
    return responses.select(
        ts.alias("timestamp"), "app_id", F.col("airbridge_uuid").alias("user_id"), "best_trigger",
        "is_random", scores.alias("trigger_scores"), "d3_purchase_prob", "d3_churn_prob",
        "pltv_tier", "pltv_percentile")


def exploration_sample(log_rows: DataFrame) -> DataFrame:
    """Rows usable for causal learning (randomly assigned)."""
    return log_rows.where(F.col("is_random"))


def log_rollup(log_rows: DataFrame, day_col: str = "timestamp") -> DataFrame:
    """Requests per app, day, is_random and tier."""
    day = F.to_date(day_col).alias("log_date")
    g = log_rows.groupBy("app_id", day, "is_random", "pltv_tier").agg(F.count(F.lit(1)).alias("requests"))
    return g


def append_prediction_log(log_rows: DataFrame, path: str, batch_id: int | None = None) -> bool:
    """K1: append to a parquet table partitioned by app and day; with ``batch_id``, replace
    the rows of that streaming batch (safe to replay).

    A logging failure must never fail scoring: errors are reported and swallowed.
    Spark's file commit protocol makes each append all-or-nothing, so a lost executor
    causes a task retry, not duplicated rows.
    """
    try:
        rows = log_rows.withColumn("log_date", F.to_date("timestamp"))
        if batch_id is None:
            rows.write.mode("append").partitionBy("app_id", "log_date").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
        return True
    except Exception as e:  # noqa: BLE001
        log.warning("prediction log append failed: %s", e)
        return False
