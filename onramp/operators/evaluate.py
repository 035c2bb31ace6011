"""Read-outs: deciles (W3, A10), top fraction (L2), tier table (A9), feature moments (A11),
factor scores from data moments (M7), drift (M13), as-of response attribution (J9),
randomised-trigger rates (A7) and off-policy value (A8).

Per-app rank questions use exact ranks from range partitions (``ranks``) instead of a
window over the whole app, which would put an app holding a third of all users into one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions.columns import US_PER_SECOND, safe_div
from .ranks import ntile, ranked


def score_deciles(df: DataFrame, score: str, group: str = "app_id", key: str = "airbridge_uuid") -> DataFrame:
    """Decile 1 (top) .. 10 (bottom) within the group: ntile(10) by score, highest
    first (NULL last), ties by key."""
    r = ranked(df, group, F.col(score).desc(), F.col(key).asc())
    return r.withColumn("decile", ntile(F.col("_rank"), F.col("_n"), 10)).drop("_rank", "_n")


def decile_table(deciled: DataFrame, label: str, score: str, group: str = "app_id") -> DataFrame:
    """A10: per group and decile: users, actual label rate, mean score."""
    return (deciled.where(F.col(label).isNotNull())
            .groupBy(group, "decile").agg(
                F.count(F.lit(1)).alias("users"),
                F.avg(F.col(label).cast("double")).alias("label_rate"),
                F.avg(score).alias("mean_score")))


def decile_lift(table: DataFrame, group: str = "app_id") -> DataFrame:
    """A10 summary: top-decile rate, bottom-decile rate and their ratio per group."""
    return table.groupBy(group).agg(
        F.max(F.when(F.col("decile") == 1, F.col("label_rate"))).alias("top_rate"),
        F.max(F.when(F.col("decile") == 10, F.col("label_rate"))).alias("bottom_rate"),
    ).withColumn("lift", safe_div(F.col("top_rate"), F.col("bottom_rate")))


def top_fraction(df: DataFrame, score: str, frac: float = 0.1, group: str = "app_id", key: str = "airbridge_uuid") -> DataFrame:
    """L2: the ceil(frac n) rows of each group with the highest scores, ties by key
    (targeting list)."""
    r = ranked(df, group, F.col(score).desc(), F.col(key).asc())
    return r.where(F.col("_rank") <= F.ceil(F.round(F.lit(float(frac)) * F.col("_n"), 9))).drop("_rank", "_n")


def tier_table(tiered: DataFrame, actual: str = "ltv", group: str = "app_id") -> DataFrame:
    """Per group and tier: users, mean actual value, ratio to the low tier's mean."""
    t = (tiered.where(F.col("pltv_tier").isNotNull() & F.col(actual).isNotNull())
         .groupBy(group, "pltv_tier").agg(F.count(F.lit(1)).alias("users"), F.avg(actual).alias("mean_actual")))
    low = t.where(F.col("pltv_tier") == "low").select(group, F.col("mean_actual").alias("_low"))
    return t.join(low, group, "left").withColumn("ratio_to_low", safe_div(F.col("mean_actual"), F.col("_low"))) \
            .drop("_low")


def feature_moments(df: DataFrame, cols=S.ALL_FEATURES, group: str = "app_id") -> DataFrame:
    """Per app, mean, population and sample standard deviation per feature (one pass)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__sp"), F.stddev_samp(c).alias(f"{c}__ss")]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(f"{c}__m").alias("mean"),
                              F.col(f"{c}__sp").alias("std_pop"), F.col(f"{c}__ss").alias("std_samp"))
                     for i, c in enumerate(cols)])
    return df.groupBy(group).agg(*aggs).select(group, F.explode(rows).alias("r")).select(group, "r.*")


# ---------------------------------------------------------------------------
# fixed values: our factor structure over the 15 ad-touch features (0/1 loadings)
# ---------------------------------------------------------------------------
FACTOR_GROUPS = {
    "touch_volume": ["trackinglink_count", "impression_count", "DA_count", "SA_count"],
    "channel_mix": ["unique_channel_count", "channel_entropy", "last_touch_is_da"],
    "timing": ["latency", "recency", "recent_24h_ratio"],
    "intensity": ["recent_touch_pressure", "touch_per_latency_hour", "last1h_touch_count",
                  "click_ratio", "is_single_touch_install"],
}
# ---------------------------------------------------------------------------


def loading_matrix(features=S.UA_FEATURES, groups=FACTOR_GROUPS) -> list[list[float]]:
    return [[1.0 if f in members else 0.0 for members in groups.values()] for f in features]


def factor_documents(moments: DataFrame, factors: F.Column, features=S.UA_FEATURES, groups=FACTOR_GROUPS, std: str = "std_pop") -> DataFrame:
    """One factor-parameter document per app in the artifact's shape (mean, std,
    loading_matrix, feature_names, factor_names) from its moments. ``factors`` is the
    number of factors the app has (an expression on app_id): documents may differ in k."""
    L = loading_matrix(features, groups)
    doc = moments.where(F.col("feature").isin(*features)).groupBy("app_id").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.max(F.when(F.col("feature") == f, F.col(std))).alias(f"s{i}") for i, f in enumerate(features)])
    n = range(len(features))
    return doc.select(
        "app_id", F.array(*[F.col(f"m{i}") for i in n]).alias("mean"), F.array(*[F.col(f"s{i}") for i in n]).alias("std"),
        F.array(*[F.slice(F.array(*[F.lit(x) for x in L[i]]), F.lit(1), factors) for i in n]).alias("loading_matrix"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        F.slice(F.array(*[F.lit(g) for g in groups]), F.lit(1), factors).alias("factor_names"))


def feature_drift(current: DataFrame, reference: DataFrame, cols=S.ALL_FEATURES) -> DataFrame:
    """Per app and feature, (current mean - reference mean) / reference std (pop)."""
    cur = feature_moments(current, cols).select("app_id", "pos", "feature", F.col("mean").alias("cur_mean"))
    ref = feature_moments(reference, cols).select("app_id", "pos", "feature", F.col("mean").alias("ref_mean"),
                                                  F.col("std_pop").alias("ref_std"))
    return (ref.join(cur, ["app_id", "pos", "feature"])
            .withColumn("drift", safe_div(F.col("cur_mean") - F.col("ref_mean"), F.col("ref_std"))))


# --------------------------------------------------------------------------- J9, A7, A8

def attribute_response(assignments: DataFrame, modal: DataFrame, click_horizon_s: float = 86400,
                       max_age_s: float = S.DECISION_TTL_SECONDS) -> DataFrame:
    """Each modal-shown event gets the latest decision at or before it for the same
    user and trigger, if that is less than ``max_age_s`` old (an expired decision was not
    what the user saw), and clicked = a modal click with that trigger in
    [shown, shown + horizon).

    No range join (no pair explosion) and no window over a user's whole history. Both
    look-ups reach a bounded distance, so a timeline cut into buckets of that length needs
    the row's own bucket and one neighbour: decisions are listed in their bucket and the
    next, clicks in theirs and the one before. Each look-up is then one window over
    narrow rows inside (app, user, trigger, bucket) groups.
    """
    k = ["app_id", "airbridge_uuid", "trig"]
    shown = modal.where(F.col("event_type") == S.EV_MODAL_SHOWN).select(
        "app_id", "airbridge_uuid", F.col("trigger_type").alias("trig"), F.unix_micros("ts").alias("us"), F.col("event_id").alias("id"))
    clicks = modal.where(F.col("event_type") != S.EV_MODAL_SHOWN).select(
        "app_id", "airbridge_uuid", F.col("trigger_type").alias("trig"), F.unix_micros("ts").alias("us"), F.col("event_id").alias("id"))
    decided = assignments.select("app_id", "airbridge_uuid", F.col("best_trigger").alias("trig"), F.unix_micros("request_ts").alias("us"),
                                 F.col("request_id").alias("id"), F.struct(F.unix_micros("request_ts").alias("at"), "request_id", "is_random", "anchor_us").alias("dec"))

    def near(rows: DataFrame, others: DataFrame, other: str, reach_s: float, step: int) -> DataFrame:
        """``rows`` and ``others`` (column ``other``) together, in buckets of ``reach_s``."""
        us = int(reach_s * US_PER_SECOND)
        b = F.floor(F.col("us") / F.lit(us)).cast("bigint")
        mine = rows.withColumns({"b": b, "row": F.lit(True), other: F.lit(None).cast(others.schema[other].dataType)})
        theirs = others.withColumns({"b": F.explode(F.array(b, b + step)), "row": F.lit(False)})
        return mine.unionByName(theirs, allowMissingColumns=True)

    max_us, horizon_us = int(max_age_s * US_PER_SECOND), int(click_horizon_s * US_PER_SECOND)
    # a decision of the same instant comes before the shown row, a click after it
    back = Window.partitionBy(*k, "b").orderBy("us", "row", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = (near(shown, decided, "dec", max_age_s, 1).withColumn("dec", F.last("dec", ignorenulls=True).over(back)).where("row")
            .select(*k, "us", "id", F.when(F.col("us") - F.col("dec.at") < max_us, F.col("dec")).alias("dec")))
    ahead = Window.partitionBy(*k, "b").orderBy("us", F.col("row").desc(), "id").rowsBetween(0, Window.unboundedFollowing)
    out = (near(seen, clicks.withColumn("click", F.col("us")), "click", click_horizon_s, -1)
           .withColumn("click", F.first("click", ignorenulls=True).over(ahead)).where("row"))
    return out.select(
        F.col("id").alias("event_id"), "app_id", "airbridge_uuid", F.col("trig").alias("trigger_type"), F.timestamp_micros("us").alias("ts"),
        F.col("dec.request_id").alias("request_id"), F.col("dec.is_random").alias("is_random"), F.col("dec.anchor_us").alias("anchor_us"),
        F.coalesce(F.col("click") - F.col("us") < horizon_us, F.lit(False)).cast("int").alias("clicked"))


def decision_outcomes(attributed: DataFrame) -> DataFrame:
    """One row per decision (app, user, anchor, trigger): clicked if any of its shown
    events led to a click. Repeated (cached) serves of one decision count once."""
    return (attributed.where(F.col("request_id").isNotNull())
            .groupBy("app_id", "airbridge_uuid", "anchor_us", "trigger_type")
            .agg(F.max("clicked").alias("clicked"), F.bool_or("is_random").alias("is_random"),
                 F.min("request_id").alias("request_id")))


def rct_trigger_rates(outcomes: DataFrame) -> DataFrame:
    """Randomised decisions only; per app and trigger: n, clicks, rate, the pooled rate
    of the app, uplift vs pooled (or vs 'control' when the app has it) and a
    two-proportion z of the trigger against the rest of the app."""
    r = outcomes.where(F.col("is_random"))
    per = r.groupBy("app_id", "trigger_type").agg(F.count(F.lit(1)).alias("n"),
                                                   F.sum("clicked").cast("bigint").alias("clicks"))
    tot = per.groupBy("app_id").agg(F.sum("n").alias("_N"), F.sum("clicks").alias("_C"),
                                    F.max(F.when(F.col("trigger_type") == S.CONTROL_TRIGGER,
                                                 F.col("clicks") / F.col("n"))).alias("_ctrl"))
    x = per.join(tot, "app_id")
    rate = F.col("clicks") / F.col("n")
    pooled = F.col("_C") / F.col("_N")
    base = F.coalesce(F.col("_ctrl"), pooled)
    n_rest = F.col("_N") - F.col("n")
    p_rest = safe_div(F.col("_C") - F.col("clicks"), n_rest)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / F.col("n") + F.lit(1.0) / n_rest))
    return x.select("app_id", "trigger_type", "n", "clicks", rate.alias("rate"), pooled.alias("pooled_rate"),
                    (rate - base).alias("uplift"),
                    F.when(n_rest > 0, safe_div(rate - p_rest, se)).alias("z"))


def policy_value(outcomes_scored: DataFrame, epsilon: float = S.EXPLORATION_SHARE,
                 n_arms: int = len(S.TREATMENT_TRIGGERS)) -> DataFrame:
    """Off-policy click rate of the greedy model policy vs uniform random, from logged
    decisions, by self-normalised inverse-propensity weighting.

    Logging propensity of the served trigger: optimized mode 0.8 * [served = argmax] + 0.2 / 4,
    exploration mode 1 / 4. Input: one row per decision with clicked, trigger_type,
    model_best (argmax, NULL in exploration)."""
    served_is_best = F.coalesce(F.col("trigger_type") == F.col("model_best"), F.lit(False))
    prop = F.when(F.col("model_best").isNull(), F.lit(1.0 / n_arms)).otherwise(
        F.lit(1.0 - epsilon) * served_is_best.cast("double") + F.lit(epsilon / n_arms))
    w_model = F.when(served_is_best, F.lit(1.0) / prop).otherwise(F.lit(0.0))
    w_rand = F.lit(1.0 / n_arms) / prop
    y = F.col("clicked").cast("double")
    return outcomes_scored.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.avg(y).alias("logged_rate"),
        safe_div(F.sum(w_model * y), F.sum(w_model)).alias("model_value"),
        safe_div(F.sum(w_rand * y), F.sum(w_rand)).alias("random_value"),
    )


def touch_rollup(events: DataFrame, unit: str = "hour") -> DataFrame:
    """T6 batch form: ad touches per app, channel and tumbling hour."""
    t = events.where(F.col("touch_type").isNotNull())
    return t.groupBy("app_id", "channel", F.date_trunc(unit, "ts").alias("window_start")).agg(
        F.count_if(F.col("touch_type") == "click").alias("clicks"),
        F.count_if(F.col("touch_type") == "impression").alias("impressions"))
