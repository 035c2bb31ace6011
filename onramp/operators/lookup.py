"""Feature-table access: last-row-wins dedupe (W1), lookup / anti joins (J1-J3), counts
(A1, A2), app readiness (A3), first users (L1), null profile (P2), app filter (P5),
coercion (P1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import to_number
from ..session import materialize, small_side


def coerce_features(df: DataFrame, cols=S.ALL_FEATURES) -> DataFrame:
    """Every feature column to double; NULL / NaN / non-numeric text -> 0.0."""
    have = set(cols)
    return df.select(*[to_number(c).alias(c) if c in have else F.col(c) for c in df.columns])


def null_profile(df: DataFrame, cols=S.ALL_FEATURES) -> DataFrame:
    """Per column, how many values are NULL or NaN (or not numeric, for text input);
    only columns with a count > 0. One pass: all counts in a single aggregate, then
    unpivot the one-row result."""
    def bad(c):
        x = F.col(c).try_cast("double")
        return x.isNull() | F.isnan(x)
    counts = df.agg(*[F.count_if(bad(c)).alias(c) for c in cols])
    long = counts.unpivot([], list(cols), "column", "null_count")
    return long.where(F.col("null_count") > 0)


def latest_per_key(df: DataFrame, key=S.KEY, order: str = "row_no") -> DataFrame:
    """Last row wins per key (highest ``order``).

    ``max_by`` as an aggregate, not a row_number window: it is combined map-side, so a
    key with millions of duplicate rows is reduced in every task before the shuffle.
    """
    others = [c for c in df.columns if c not in key]
    packed = F.struct(*[F.col(c) for c in others])
    # a NULL order comes before every other: such a row wins only where it is alone
    rank = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order"))
    return (df.groupBy(*key).agg(F.max_by(packed, rank).alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]))


def lookup_features(requests: DataFrame, features: DataFrame, key=S.KEY, order: str = "row_no") -> DataFrame:
    """Requests with their (deduplicated) feature row; NULL keys never match.

    Equi-join on the two key columns (never on a concatenated string, which can collide).
    The feature table grows with the user base, so there is no broadcast hint; AQE picks
    broadcast only if the deduplicated side turns out small at run time.
    """
    if order in features.columns:
        f = latest_per_key(features, key, order)
    else:  # no order to go by: still one row per key, the largest
        f = latest_per_key(features.withColumn(order, F.struct(*[c for c in features.columns if c not in key])), key, order).drop(order)
    return requests.join(f, list(key), "inner")


def unknown_users(requests: DataFrame, features: DataFrame, key=S.KEY) -> DataFrame:
    """Requests with no feature row (the service's 'User not found')."""
    return requests.join(features.select(*key), list(key), "left_anti")


def app_readiness(inventory: DataFrame) -> DataFrame:
    """A3: per app, from (app_id, file, length, valid) and, where known, modified:

    available = purchase model present; ready = purchase and churn models;
    mode = optimized (ready and trigger model) / exploration (ready) / not ready;
    missing = required files absent (contract order); has_pltv = all three pLTV files;
    model_version = hash of the valid (file, length, modification time) set, so any upload
    bumps it, also one of the same size.
    """
    valid = F.col("valid") & F.col("file").isNotNull()
    state = [F.col("file"), F.col("length").cast("string")]
    if "modified" in inventory.columns:
        state.append(F.unix_micros("modified").cast("string"))

    def has(f):
        return F.bool_or(valid & (F.col("file") == f))

    agg = inventory.groupBy("app_id").agg(
        has("d3_purchase_model.pkl").alias("available"),
        has("d3_churn_model.pkl").alias("_churn"),
        has(S.TRIGGER_MODEL_FILE).alias("_trig"),
        # at most the 7 whitelisted names per app: a bounded set
        F.collect_set(F.when(valid, F.col("file"))).alias("_files"),
        F.array_sort(F.collect_list(F.when(valid, F.concat_ws(":", *state))))
         .alias("_sig"),
    )
    ready = F.col("available") & F.col("_churn")
    req = F.array(*[F.lit(f) for f in S.REQUIRED_MODEL_FILES])
    pltv = F.forall(F.array(*[F.lit(f) for f in S.PLTV_MODEL_FILES]),
                    lambda f: F.array_contains(F.col("_files"), f))
    return agg.select(
        "app_id",
        F.col("available"),
        ready.alias("ready"),
        F.when(ready & F.col("_trig"), "optimized").when(ready, "exploration").otherwise("not ready").alias("mode"),
        F.array_except(req, F.col("_files")).alias("missing"),
        pltv.alias("has_pltv"),
        F.substring(F.md5(F.array_join("_sig", ",")), 1, 12).alias("model_version"),
    )


def requests_of_ready_apps(requests: DataFrame, readiness: DataFrame, *cols: str) -> DataFrame:
    """Requests of ready apps, with the readiness columns ``cols`` (default
    ``model_version``).

    Readiness (a row an app) is written and counted, so that the requests stay the streamed
    side in all their partitions; left alone, AQE may hand the requests around and keep the
    plan in the few tasks of the app table, or deal them by app."""
    ready = materialize(readiness.where(F.col("ready")).select("app_id", *(cols or ("model_version",))), "ready-apps")
    return requests.join(small_side(ready), "app_id")


def unscorable_requests(requests: DataFrame, readiness: DataFrame, features: DataFrame,
                        key=S.KEY) -> DataFrame:
    """J3 then J2: requests the service would refuse, with the reason it gives first
    ('app not found' before 'user not found')."""
    ready = readiness.where(F.col("ready")).select("app_id", F.lit(True).alias("_ready"))
    known = features.select(*key).distinct().withColumn("_known", F.lit(True))
    r = requests.join(ready, "app_id", "left").join(known, list(key), "left")
    reason = F.when(F.col("_ready").isNull(), F.lit("app_not_found")) \
              .when(F.col("_known").isNull(), F.lit("user_not_found"))
    return r.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_ready", "_known")


def user_count(df: DataFrame) -> DataFrame:
    """A1: all rows, duplicates and NULL keys included."""
    return df.agg(F.count(F.lit(1)).alias("user_count"))


def users_per_app(df: DataFrame) -> DataFrame:
    """A2: rows per app (the service's count and total are the same number)."""
    return df.groupBy("app_id").agg(F.count(F.lit(1)).alias("count")).withColumn("total", F.col("count"))


def users_of_app(df: DataFrame, app_id: str) -> DataFrame:
    """P5: the app's rows, duplicates kept (filter pushed to the scan)."""
    return df.where(F.col("app_id") == F.lit(app_id))


def first_users(df: DataFrame, n: int = 20, order: str = "row_no") -> DataFrame:
    """L1: first n rows per app in table order (explicit order column).

    ``row_number() <= n`` is planned with a partial window-group-limit before the
    shuffle, so each task forwards at most n rows per app."""
    from pyspark.sql.window import Window
    w = Window.partitionBy("app_id").orderBy(F.col(order), F.col("airbridge_uuid"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
