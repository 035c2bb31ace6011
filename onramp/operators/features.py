"""Journey features: installs, ad-touch features (A4, J7, W5), in-app features.

Plan shape: installs are one pre-aggregated row per user. Journey rows are joined to
them once on (app_id, user_id) — a shuffle join, never a broadcast, because installs
grow with the user base; a hot user is split by AQE's skew-join handling. Everything
after the join is aggregation on the same key, so the join's partitioning is reused
and each aggregate is partially combined map-side before any exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import US_PER_SECOND, hours_between, pair_id, pair_key, pair_ts, safe_div, to_number

KEY = ["app_id", "user_id"]


def installs(events: DataFrame) -> DataFrame:
    """First install row per (app_id, user_id): t0 and its event_id (ties on event_id).

    min over the packed (ts, event_id) key: same row as min(struct(ts, event_id)), but a
    hash aggregate combined map-side rather than a sort of the install rows."""
    return (events.where(F.col("is_install"))
            .groupBy(*KEY).agg(F.min(pair_key("ts", "event_id")).alias("_i"))
            .select(*KEY, pair_ts("_i").alias("t0"), pair_id("_i").alias("install_event_id")))


def attach_install(events: DataFrame, inst: DataFrame) -> DataFrame:
    """J7/J8 base: every journey row of an installed user, with the user's t0 and the
    offset ``dt_us`` = ts - t0 in microseconds. Equi-join on the user key; all interval
    conditions are evaluated on ``dt_us`` by the aggregates that follow."""
    return (events.join(inst, KEY, "inner")
            .withColumn("dt_us", F.unix_micros("ts") - F.unix_micros("t0")))


def touches_before_install(joined: DataFrame) -> DataFrame:
    """Ad touches strictly before install."""
    return joined.where(F.col("touch_type").isNotNull() & (F.col("dt_us") < 0))


def events_in_window(joined: DataFrame, start_s: float, end_s: float,
                     exclude_install: bool = True) -> DataFrame:
    """In-app rows with t0 + start <= ts < t0 + end (the install row itself left out)."""
    cond = (F.col("event_type").isNotNull()
            & (F.col("dt_us") >= F.lit(int(start_s * US_PER_SECOND)))
            & (F.col("dt_us") < F.lit(int(end_s * US_PER_SECOND))))
    if exclude_install:
        cond = cond & (F.col("event_id") != F.col("install_event_id"))
    return joined.where(cond)


def click_branch(joined: DataFrame, last1h_anchor: str = "last_click") -> DataFrame:
    """Per user, from the click rows before install: the last-hour click count and the DA
    flag of the last click (W5).

    The last click time comes from the same rows (identical subtree, so its exchange is
    reused); among clicks at that time the largest event_id decides the DA flag (exact
    tie-break). All aggregate buffers are fixed-width, so Spark keeps hash aggregation.
    """
    if last1h_anchor not in ("last_click", "install"):
        raise ValueError(f"last1h_anchor must be 'last_click' or 'install', got {last1h_anchor!r}")
    us = US_PER_SECOND
    clicks_rows = (touches_before_install(joined).where(F.col("touch_type") == "click")
                   .select(*KEY, "ts", "dt_us", "event_id",
                           (F.col("channel_class") == "DA").cast("int").alias("is_da")))
    anchor = clicks_rows.groupBy(*KEY).agg(F.max("ts").alias("anchor"))
    in_hour = ("unix_micros(ts) > unix_micros(anchor) - " + str(3600 * us)) if last1h_anchor == "last_click" \
        else f"dt_us >= {-3600 * us}"
    return clicks_rows.join(anchor, KEY).groupBy(*KEY).agg(
        F.expr(f"CAST(count_if({in_hour}) AS DOUBLE)").alias("last1h_touch_count"),
        F.expr("max_by(is_da, CASE WHEN ts = anchor THEN event_id END)").alias("last_da"))


def ad_journey_features(joined: DataFrame, last1h_anchor: str = "last_click",
                        entropy_base: float = 2.0) -> DataFrame:
    """A4: the 15 ad-touch features per installed user (users without touches get no row;
    ``user_features`` outer-joins and fills 0).

    Two-level aggregate: (user, channel) first — it yields per-channel click counts for
    the entropy and the distinct-channel count without a DISTINCT aggregate — then user.
    """
    t = touches_before_install(joined)
    is_click = F.col("touch_type") == "click"
    per_channel = (t.groupBy(*KEY, "t0", "channel").agg(
        F.count_if(is_click).alias("n_click"),
        F.count_if(F.col("touch_type") == "impression").alias("n_imp"),
        F.count_if(is_click & (F.col("channel_class") == "DA")).alias("n_da"),
        F.count_if(is_click & (F.col("channel_class") == "SA")).alias("n_sa"),
        F.count_if(is_click & (F.col("dt_us") >= F.lit(-24 * 3600 * US_PER_SECOND))).alias("n_24h"),
        F.min(F.when(is_click, F.col("ts"))).alias("first_click"),
        F.max(F.when(is_click, F.col("ts"))).alias("last_click"),
    ))
    log_n = F.log(float(entropy_base), F.col("n_click").cast("double"))
    per_user = (per_channel.groupBy(*KEY, "t0").agg(
        F.sum("n_click").alias("clicks"),
        F.sum("n_imp").alias("imps"),
        F.sum("n_da").alias("da"),
        F.sum("n_sa").alias("sa"),
        F.sum("n_24h").alias("c24"),
        F.count_if(F.col("n_click") > 0).alias("channels"),
        F.sum(F.when(F.col("n_click") > 0, F.col("n_click") * log_n)).alias("nlogn"),
        F.min("first_click").alias("first_click"),
        F.max("last_click").alias("last_click"),
    ))
    clicks = F.col("clicks").cast("double")
    latency = hours_between("t0", "first_click")
    recency = hours_between("t0", "last_click")
    entropy = F.when(F.col("clicks") > 0,
                     F.log(float(entropy_base), clicks) - F.col("nlogn") / clicks)
    ua = per_user.join(click_branch(joined, last1h_anchor), KEY, "left").select(
        *KEY,
        clicks.alias("trackinglink_count"),
        F.col("da").cast("double").alias("DA_count"),
        F.col("sa").cast("double").alias("SA_count"),
        F.col("channels").cast("double").alias("unique_channel_count"),
        entropy.alias("channel_entropy"),
        F.col("last_da").cast("double").alias("last_touch_is_da"),
        latency.alias("latency"),
        recency.alias("recency"),
        safe_div(clicks, F.lit(1.0) + F.coalesce(recency, F.lit(0.0))).alias("recent_touch_pressure"),
        safe_div(clicks, F.lit(1.0) + F.coalesce(latency, F.lit(0.0))).alias("touch_per_latency_hour"),
        "last1h_touch_count",
        safe_div(F.col("c24").cast("double"), clicks).alias("recent_24h_ratio"),
        safe_div(clicks, clicks + F.col("imps").cast("double")).alias("click_ratio"),
        F.col("imps").cast("double").alias("impression_count"),
        (F.col("clicks") == 1).cast("double").alias("is_single_touch_install"),
    )
    return ua.select(*KEY, *[F.col(c) for c in S.UA_FEATURES])


def inapp_features(joined: DataFrame, window_s: float = 300.0, as_flag: bool = False) -> DataFrame:
    """A5: the 10 in-app features over [t0, t0 + window) per user with any such event."""
    w = events_in_window(joined, 0.0, window_s)
    aggs = []
    for feat in S.INAPP_FEATURES:
        ev = S.INAPP_EVENT_OF.get(feat)
        if ev is None:
            continue
        c = F.count_if(F.col("event_type") == ev)
        if as_flag and feat in ("user_signin", "deeplink_open", "onboarding", "user_signup"):
            c = F.max(F.when(F.col("event_type") == ev, 1).otherwise(0))
        aggs.append(c.cast("double").alias(feat))
    aggs.append(F.count("*").cast("double").alias("total_events"))
    aggs.append(F.count_distinct("event_type").cast("double").alias("n_event_types"))
    return w.groupBy(*KEY).agg(*aggs).select(*KEY, *S.INAPP_FEATURES)


def inapp_and_label_parts(joined: DataFrame, window_s: float, purchase_h_s: float, churn_from_s: float,
                          churn_to_s: float, ltv_h_s: float) -> DataFrame:
    """A5 + A6 in one aggregate: both read the in-app rows after install, so one pass over
    the journey join serves the first-session counts and every label horizon."""
    us = US_PER_SECOND
    dt = F.col("dt_us")
    rows = joined.where(F.col("event_type").isNotNull() & (dt >= 0)
                        & (F.col("event_id") != F.col("install_event_id")))
    in_win = dt < F.lit(int(window_s * us))
    aggs = []
    for feat in S.INAPP_FEATURES:
        ev = S.INAPP_EVENT_OF.get(feat)
        if ev is not None:
            aggs.append(F.count_if(in_win & (F.col("event_type") == ev)).cast("double").alias(feat))
    aggs += [
        F.count_if(in_win).cast("double").alias("total_events"),
        F.count_distinct(F.when(in_win, F.col("event_type"))).cast("double").alias("n_event_types"),
        F.count_if((F.col("event_type") == S.EV_ORDER_COMPLETED) & (dt < F.lit(int(purchase_h_s * us))))
         .alias("_np"),
        F.count_if((dt >= F.lit(int(churn_from_s * us))) & (dt < F.lit(int(churn_to_s * us)))).alias("_nc"),
        F.sum(F.when(dt < F.lit(int(ltv_h_s * us)), F.coalesce("revenue", F.lit(0.0)))).alias("_ltv"),
    ]
    return rows.groupBy(*KEY).agg(*aggs)


def _num(x: str) -> str:
    """SQL form of P1 (NULL / NaN / text -> 0.0)."""
    return f"coalesce(nanvl(try_cast({x} AS DOUBLE), CAST(0 AS DOUBLE)), CAST(0 AS DOUBLE))"


def user_table(events: DataFrame, window_s: float, purchase_h_s: float, churn_from_s: float,
               churn_to_s: float, ltv_h_s: float, last1h_anchor: str = "last_click",
               inst: DataFrame | None = None) -> DataFrame:
    """Features (25) and labels of every installed user from ONE shuffle of the events.

    Plan: events join installs on the user key (the only exchange of event rows). Right
    after the join, a pre-aggregate keyed by (user, channel, event_type) computes every
    conditional count, sum, first / last click and label part; it needs no new exchange
    (the join already clusters by user) and is combined map-side. Per-user features then
    come from these few rows: a window over (user, channel) gives per-channel click
    totals for the entropy, distinct channels / event types are small DISTINCTs. Only
    the "last hour before the last click" count reads the click rows again.
    Columns: app_id, airbridge_uuid, row_no, 25 features, d3_purchase, d3_churn, ltv
    (labels NULL where not mature).

    The expression lists are SQL text: a few calls to the JVM instead of hundreds.
    """
    inst = installs(events) if inst is None else inst
    joined = attach_install(events, inst)
    us = US_PER_SECOND
    touch = "(touch_type IS NOT NULL AND dt_us < 0)"
    click = f"({touch} AND touch_type = 'click')"
    inapp = "(event_type IS NOT NULL AND dt_us >= 0 AND event_id <> install_event_id)"
    l1_aggs = {
        "n_click": f"count_if({click})",
        "n_imp": f"count_if({touch} AND touch_type = 'impression')",
        "n_da": f"count_if({click} AND channel_class = 'DA')",
        "n_sa": f"count_if({click} AND channel_class = 'SA')",
        "n_24h": f"count_if({click} AND dt_us >= {-24 * 3600 * us})",
        # fixed-width buffers only (no struct): the aggregate stays a hash aggregate that
        # runs in the join's partitions without re-sorting the event rows
        "first_click": f"min(CASE WHEN {click} THEN ts END)",
        "last_click": f"max(CASE WHEN {click} THEN ts END)",
        "n_win": f"count_if({inapp} AND dt_us < {int(window_s * us)})",
        "n_buy": f"count_if({inapp} AND event_type = '{S.EV_ORDER_COMPLETED}' AND dt_us < {int(purchase_h_s * us)})",
        "n_active": f"count_if({inapp} AND dt_us >= {int(churn_from_s * us)} AND dt_us < {int(churn_to_s * us)})",
        "rev": f"sum(CASE WHEN {inapp} AND dt_us < {int(ltv_h_s * us)} THEN coalesce(revenue, CAST(0 AS DOUBLE)) END)",
    }
    l1 = (joined.groupBy("app_id", "user_id", "t0", "channel", "event_type")
          .agg(*[F.expr(e).alias(n) for n, e in l1_aggs.items()])
          .selectExpr("*", "sum(n_click) OVER (PARTITION BY app_id, user_id, channel) AS n_c"))
    inapp_counts = {feat: f"CAST(sum(CASE WHEN event_type = '{ev}' THEN n_win ELSE 0 END) AS DOUBLE)"
                    for feat, ev in S.INAPP_EVENT_OF.items()}
    l2_aggs = {
        "clicks": "sum(n_click)", "imps": "sum(n_imp)", "da": "sum(n_da)", "sa": "sum(n_sa)", "c24": "sum(n_24h)",
        "channels": "count(DISTINCT CASE WHEN n_c > 0 THEN channel END)",
        "nlogn": "sum(CASE WHEN n_click > 0 THEN n_click * log(2.0D, CAST(n_c AS DOUBLE)) END)",
        "first_click": "min(first_click)", "last_click": "max(last_click)",
        **inapp_counts,
        "total_events": "CAST(sum(n_win) AS DOUBLE)",
        "n_event_types": "CAST(count(DISTINCT CASE WHEN n_win > 0 THEN event_type END) AS DOUBLE)",
        "_np": "sum(n_buy)", "_nc": "sum(n_active)", "_ltv": "sum(rev)",
    }
    per_user = l1.groupBy("app_id", "user_id").agg(*[F.expr(e).alias(n) for n, e in l2_aggs.items()])
    h = f"CAST({3600 * us} AS DOUBLE)"
    latency = f"((unix_micros(t0) - unix_micros(first_click)) / {h})"
    recency = f"((unix_micros(t0) - unix_micros(last_click)) / {h})"
    clicks = "CAST(clicks AS DOUBLE)"
    feats = {
        "trackinglink_count": clicks,
        "DA_count": "CAST(da AS DOUBLE)",
        "SA_count": "CAST(sa AS DOUBLE)",
        "unique_channel_count": "CAST(channels AS DOUBLE)",
        "channel_entropy": f"CASE WHEN clicks > 0 THEN log(2.0D, {clicks}) - nlogn / {clicks} END",
        "last_touch_is_da": "CAST(last_da AS DOUBLE)",
        "latency": latency,
        "recency": recency,
        "recent_touch_pressure": f"CASE WHEN 1.0D + coalesce({recency}, 0.0D) <> 0 "
                                 f"THEN {clicks} / (1.0D + coalesce({recency}, 0.0D)) END",
        "touch_per_latency_hour": f"CASE WHEN 1.0D + coalesce({latency}, 0.0D) <> 0 "
                                  f"THEN {clicks} / (1.0D + coalesce({latency}, 0.0D)) END",
        "recent_24h_ratio": f"CASE WHEN {clicks} <> 0 THEN CAST(c24 AS DOUBLE) / {clicks} END",
        "click_ratio": f"CASE WHEN {clicks} + CAST(imps AS DOUBLE) <> 0 "
                       f"THEN {clicks} / ({clicks} + CAST(imps AS DOUBLE)) END",
        "last1h_touch_count": "last1h_touch_count",
        "impression_count": "CAST(imps AS DOUBLE)",
        "is_single_touch_install": "CAST(clicks = 1 AS DOUBLE)",
        **{c: c for c in S.INAPP_FEATURES},
    }
    last1h = click_branch(joined, last1h_anchor)
    # the data's end: one global max -> a single-row frame, broadcast (size is 1 row)
    last = events.agg(F.max(F.unix_micros("ts")).alias("_last_us"))

    def mature(h_s):
        return f"unix_micros(t0) + {int(h_s * us)} <= _last_us"

    out = inst.join(per_user, KEY, "left").join(last1h, KEY, "left").crossJoin(F.broadcast(last))
    return out.selectExpr(
        "app_id", "user_id AS airbridge_uuid", "install_event_id AS row_no",
        *[f"{_num(feats[c])} AS {c}" for c in S.ALL_FEATURES],
        f"CASE WHEN {mature(purchase_h_s)} THEN CAST(coalesce(_np, 0) > 0 AS INT) END AS d3_purchase",
        f"CASE WHEN {mature(churn_to_s)} THEN CAST(coalesce(_nc, 0) = 0 AS INT) END AS d3_churn",
        f"CASE WHEN {mature(ltv_h_s)} THEN coalesce(_ltv, 0.0D) END AS ltv",
        "t0",
    )


def user_features(events: DataFrame, window_s: float = 300.0, last1h_anchor: str = "last_click",
                  inst: DataFrame | None = None) -> DataFrame:
    """The 25-feature table, one row per installed user, key (app_id, airbridge_uuid).

    Organic users (no touch) and users with no early in-app event are kept by left
    joins from installs and filled with 0 (P1), as the service expects.
    """
    inst = installs(events) if inst is None else inst
    joined = attach_install(events, inst)
    ua = ad_journey_features(joined, last1h_anchor=last1h_anchor)
    ia = inapp_features(joined, window_s=window_s)
    out = (inst.select(*KEY).join(ua, KEY, "left").join(ia, KEY, "left")
           .select(F.col("app_id"), F.col("user_id").alias("airbridge_uuid"),
                   *[to_number(c).alias(c) for c in S.ALL_FEATURES]))
    return out
