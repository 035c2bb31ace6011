"""Message policy: argmax (W2), deterministic epsilon-greedy (M3), user x trigger grid
(J4), sticky decisions with a TTL (W4), repeat statistics (W6), coupon rules (P10).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schema as S
from ..functions.columns import US_PER_SECOND, uniform_draw
from ..session import materialize


def best_trigger_col(triggers=S.TREATMENT_TRIGGERS) -> Column:
    """Argmax over the (already rounded) ``score_<t>`` columns; ties -> the earliest
    trigger in artifact order. Row-local: no window, no shuffle."""
    scores = [F.col(f"score_{t}") for t in triggers]
    top = F.greatest(*scores)
    out = None
    for t, s in zip(triggers, scores):
        out = F.when(s == top, F.lit(t)) if out is None else out.when(s == top, F.lit(t))
    return out


def assign_trigger(df: DataFrame, has_model: Column, seed: str, epsilon: float = S.EXPLORATION_SHARE,
                   draw_key: list | None = None, triggers=S.TREATMENT_TRIGGERS,
                   random_pool=S.TREATMENT_TRIGGERS) -> DataFrame:
    """M3: adds best_trigger and is_random.

    No trigger model -> uniform choice over ``random_pool``, is_random = true. Otherwise
    explore with probability ``epsilon`` (uniform choice, is_random = true, may equal the
    argmax) else the argmax (is_random = false). Draws are hashes of ``draw_key``
    (default app, user), so retries and repartitioning never change an arm.
    """
    key = draw_key or [F.col("app_id"), F.col("airbridge_uuid")]
    explore = uniform_draw(seed, F.lit("explore"), *key)
    choice = uniform_draw(seed, F.lit("choice"), *key)
    pool = F.array(*[F.lit(t) for t in random_pool])
    pick = F.element_at(pool, (F.floor(choice * len(random_pool)) + 1).cast("int"))
    is_random = (~has_model) | (explore < F.lit(float(epsilon)))
    return df.withColumns({"is_random": is_random,
                           "best_trigger": F.when(is_random, pick).otherwise(best_trigger_col(triggers))})


def trigger_dim(spark, triggers=S.TREATMENT_TRIGGERS) -> DataFrame:
    """The trigger dimension (ordinal carries the tie-break order)."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(triggers)], "ordinal int, trigger string")


def users_x_triggers(df: DataFrame, triggers=S.TREATMENT_TRIGGERS) -> DataFrame:
    """One row per (user, trigger) plus one-hot columns in artifact order.

    The trigger side is a fixed 4-row dimension (proven size), so the broadcast nested
    loop is the right plan: rows x 4, no shuffle."""
    dim = trigger_dim(df.sparkSession, triggers)
    out = df.crossJoin(F.broadcast(dim))
    for t in triggers:
        out = out.withColumn(f"is_{t}", (F.col("trigger") == t).cast("int"))
    return out


# --------------------------------------------------------------------------- W4

def _anchor_stream(ttl_us: int, out_cols: list[str]):
    """Rows sorted by (island, time) in; the anchor of each added. Inside a batch an island
    is walked from anchor to anchor by binary search; only the open island's anchor is
    carried to the next batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, anchor = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf["_island"].to_numpy()
            ts = pdf["_ts"].to_numpy(dtype=np.int64)
            out = np.empty(len(pdf), dtype=np.int64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if keys[a] != last:
                    last, anchor = keys[a], int(ts[a])
                while a < b:
                    if ts[a] - anchor >= ttl_us:
                        anchor = int(ts[a])
                    end = a + int(np.searchsorted(ts[a:b], anchor + ttl_us, side="left"))
                    out[a:end] = anchor
                    a = end
            pdf["anchor_us"] = out
            yield pdf[out_cols]
    return run


def sticky_decisions(requests: DataFrame, ttl_s: float = S.DECISION_TTL_SECONDS,
                     key=("app_id", "airbridge_uuid", "model_version"), ts: str = "request_ts",
                     order_tiebreak: str = "request_id") -> DataFrame:
    """For each request, the time of the decision it is served from (``anchor_ts``).

    A decision made at a is reused while ts - a < ttl (strict) and is never extended by a
    hit; the first request at or after a + ttl makes a new one. Keyed by app, user and
    model_version, so a model change starts fresh decisions.

    A request with no request of its key in the TTL before it always decides anew, so each
    key falls into independent islands:
      1. time is cut into TTL-wide buckets; only the first request of a bucket can start an
         island, and does so unless the bucket before has one less than a TTL earlier. One
         aggregate row per (key, bucket) is enough to number the islands of a key;
      2. requests take their island by an equi-join on (key, bucket), which spreads a hot
         key over its buckets;
      3. an island shorter than the TTL has one decision, its first request: no Python;
      4. only longer islands are walked in time order, one island per task stretch, from
         anchor to anchor.
    """
    if order_tiebreak not in requests.columns:
        raise ValueError(f"sticky_decisions needs a unique request id column {order_tiebreak!r}")
    ttl_us = int(round(ttl_s * US_PER_SECOND))
    # NULL key parts are folded into one string key; the separator cannot occur in ids.
    key_str = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in key])
    base = (requests.withColumn("_key", key_str).withColumn("_ts", F.unix_micros(ts))
            .withColumn("_bucket", F.floor(F.col("_ts") / F.lit(ttl_us)).cast("bigint")))
    buckets = base.groupBy("_key", "_bucket").agg(F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"))
    # one row per active TTL of a key
    w = Window.partitionBy("_key").orderBy("_bucket")
    apart = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) >= ttl_us, F.lit(True))
    numbered = buckets.withColumn("_no", F.sum(apart.cast("bigint")).over(w))
    whole = Window.partitionBy("_key", "_no")
    islands = materialize(numbered.select(
        F.col("_key").alias("_k"), F.col("_bucket").alias("_b"), "_no", F.min("_lo").over(whole).alias("_first"),
        (F.max("_hi").over(whole) - F.min("_lo").over(whole) >= ttl_us).alias("_long")), "islands")
    placed = base.join(islands, (F.col("_key") == F.col("_k")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    out_cols = list(requests.columns) + ["anchor_us"]
    short = placed.where(~F.col("_long") | F.col("_long").isNull()).select(*requests.columns, F.col("_first").alias("anchor_us"))
    schema = T.StructType(list(requests.schema.fields) + [T.StructField("anchor_us", T.LongType())])
    walked = (placed.where("_long").withColumn("_island", F.concat_ws("\u0001", "_key", F.col("_no").cast("string")))
              .select(*requests.columns, "_island", "_ts")
              # never ``rebalance``: splitting an island would break its anchor chain
              .repartition("_island").sortWithinPartitions("_island", "_ts", order_tiebreak)
              .mapInPandas(_anchor_stream(ttl_us, out_cols), schema))
    return short.unionByName(walked).withColumn("anchor_ts", F.timestamp_micros("anchor_us"))


def repeat_request_stats(decisions: DataFrame, ts: str = "request_ts") -> DataFrame:
    """Per app, requests, new decisions, requests served from a sticky decision, share."""
    reused = F.unix_micros(ts) != F.col("anchor_us")
    return (decisions.groupBy("app_id").agg(
        F.count("*").alias("requests"),
        F.count_if(~reused).alias("decisions"),
        F.count_if(reused).alias("reused"),
    ).withColumn("reused_share", F.round(F.col("reused") / F.col("requests"), 6)))


# --------------------------------------------------------------------------- P10

# Default rule table (README examples; cut-offs are parameters). Ordered, first match wins.
DEFAULT_COUPON_RULES = [
    ("vip_coupon", "best_trigger = 'price_appeal' AND pltv_tier = 'high'"),
    ("retention_offer", "pltv_tier = 'medium' AND d3_churn_prob >= 0.5"),
    ("save_budget", "pltv_tier = 'low'"),
]


def coupon_action(df: DataFrame, rules=DEFAULT_COUPON_RULES, default: str = "none") -> DataFrame:
    """P10: first matching rule's action (chained CASE, evaluated in rule order)."""
    out = None
    for action, cond in rules:
        c = F.expr(cond)
        out = F.when(c, F.lit(action)) if out is None else out.when(c, F.lit(action))
    return df.withColumn("coupon_action", out.otherwise(F.lit(default)) if out is not None else F.lit(default))
