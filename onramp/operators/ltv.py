"""Value tiers: tier assignment (M5, J5, J6), score percentile (M6), tier-config build.

The tier config is one row per app: ``tiers`` (ordered name/threshold structs),
``tier_avg_ltv`` map and ``score_percentiles`` (ascending quantiles). It is counted and
broadcast to the scored rows when it has few rows (a few KB per app); else the rows are
joined by shuffle. Pass a written table: an unwritten one is computed for the count too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import first_matching_tier, left_rank, percentile_from_rank
from ..session import materialize, small_side
from .ranks import quantiles


def quantile_points(n: int) -> list[float]:
    """n evenly spaced probabilities from 0 to 1 inclusive (n = 1000 -> 0, 1/999, ..., 1)."""
    if n <= 1:
        return [0.5]
    return [i / (n - 1) for i in range(n)]


def assign_tier(df: DataFrame, cfg: DataFrame, score: str = "pltv_score") -> DataFrame:
    """M5 + M6 + J6: adds pltv_tier, pltv_percentile, tier_avg_ltv.

    Tiers in listed order, first ``score >= threshold``; none -> 'low' (also NaN).
    Percentile = int(#(q < score) / n * 100) clamped to 0..99, 50 when no quantiles,
    NaN -> 99. NULL score or no config for the app -> all three NULL.
    """
    c = cfg.select("app_id", F.col("tiers").alias("_tiers"), F.col("tier_avg_ltv").alias("_avg"),
                   F.col("score_percentiles").alias("_q"))
    out = df.join(small_side(c), "app_id", "left")
    ok = F.col(score).isNotNull() & F.col("_tiers").isNotNull()
    tier = F.when(ok, first_matching_tier(F.col("_tiers"), F.col(score), S.DEFAULT_TIER))
    q = F.coalesce(F.col("_q"), F.array().cast("array<double>"))
    rank = left_rank(q, F.col(score))
    pct = F.when(ok, F.when(F.isnan(F.col(score)) & (F.size(q) > 0), F.lit(99))
                  .otherwise(percentile_from_rank(rank, F.size(q))))
    avg = F.when(ok, F.coalesce(F.try_element_at(F.col("_avg"), tier), F.lit(0.0)))
    return (out.withColumns({"pltv_tier": tier, "pltv_percentile": pct, "tier_avg_ltv": avg})
               .drop("_tiers", "_avg", "_q"))


def build_tier_config(scored: DataFrame, score: str = "pltv_score", actual: str | None = "ltv",
                      n_quantiles: int = 1000, high: float = 0.8, medium: float = 0.5) -> DataFrame:
    """Per app, thresholds at the ``high`` / ``medium`` quantiles of the score and 0,
    ``n_quantiles`` ascending score quantiles, and mean actual LTV per assigned tier.

    Quantiles are exact at every size (the value of rank ceil(p n)): scores are ranked in
    range partitions, so an app holding a third of all users is spread over many tasks.
    """
    s = scored.where(F.col(score).isNotNull())
    pts = quantile_points(n_quantiles)
    # one ranking answers both the thresholds and the quantile list
    n = len(pts)
    base = (quantiles(s, "app_id", score, pts + [float(high), float(medium)]).select(
        "app_id",
        F.slice("_q", n + 1, 2).alias("_thr"),
        F.slice("_q", 1, n).alias("score_percentiles"),
    ).select(
        "app_id",
        F.array(
            F.struct(F.lit("high").alias("name"), F.col("_thr")[0].cast("double").alias("threshold")),
            F.struct(F.lit("medium").alias("name"), F.col("_thr")[1].cast("double").alias("threshold")),
            F.struct(F.lit("low").alias("name"), F.lit(0.0).alias("threshold")),
        ).alias("tiers"),
        "score_percentiles",
    ))
    if actual is None:
        return base.withColumn("tier_avg_ltv", F.create_map().cast("map<string,double>")) \
                   .select("app_id", "tiers", "tier_avg_ltv", "score_percentiles")
    base = materialize(base, "tier-thresholds")
    tiered = assign_tier(s.select("app_id", score, actual),
                         base.withColumn("tier_avg_ltv", F.create_map().cast("map<string,double>")),
                         score=score)
    means = (tiered.groupBy("app_id", "pltv_tier").agg(F.avg(actual).alias("_m"))
             .groupBy("app_id").agg(F.map_from_entries(F.collect_list(F.struct("pltv_tier", "_m")))
                                   .alias("tier_avg_ltv")))
    return (base.join(means, "app_id", "left")
            .select("app_id", "tiers",
                    F.coalesce("tier_avg_ltv", F.create_map().cast("map<string,double>")).alias("tier_avg_ltv"),
                    "score_percentiles"))


def tier_config_long(cfg: DataFrame) -> DataFrame:
    """S3 exploded form: one row per (app, tier) with its listed position."""
    return (cfg.select("app_id", F.posexplode("tiers").alias("pos", "t"), "tier_avg_ltv")
            .select("app_id", "pos", F.col("t.name").alias("tier"), F.col("t.threshold").alias("threshold"),
                    F.coalesce(F.try_element_at("tier_avg_ltv", F.col("t.name")), F.lit(0.0))
                     .alias("tier_avg_ltv")))
