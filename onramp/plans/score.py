"""The scoring pipeline, batch (every user in the feature table) and per request.

Shuffles: the feature pipeline (one journey join + aggregates on the user key), the
request lookup (requests x deduplicated features, same key), and the sticky-decision
scan (key = app, user, model version). Readiness, tier config and coefficient models are
small per-app tables or literals: projection and broadcast-sized joins, no other shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from .. import schema as S
from ..operators import lookup as LK
from ..operators import ltv as LT
from ..operators import policy as PO
from ..operators import scoring as SC
from ..session import materialize, small_side
from ..sources import models as BM


def score_rows(df: DataFrame, readiness: DataFrame, seed: str = P.POLICY_SEED,
               draw_extra: list | None = None, trigger_model=P.TRIGGER,
               purchase=P.D3_PURCHASE, churn=P.D3_CHURN, pltv_p=P.PLTV_PURCHASE,
               pltv_amount=P.PLTV_AMOUNT, models: DataFrame | None = None) -> DataFrame:
    """Feature rows of ready apps -> trigger scores, policy, D3 probabilities, pLTV score.

    ``models``: per-app bundles (``sources.models``); each row is then scored with its own
    app's coefficients and rows of apps without a bundle are refused.
    ``draw_extra``: extra columns for the policy draw (the decision anchor for requests).
    """
    r = materialize(readiness.where(F.col("ready")).select("app_id", "mode", "has_pltv", "model_version"), "ready-apps")
    out = df.join(small_side(r), "app_id", "inner")  # a row an app, counted
    if models is not None:
        out = BM.with_models(out, models)
        trigger_model = BM.app_trigger_model(trigger_model)
        purchase, churn, pltv_p, pltv_amount = map(BM.app_model, (purchase, churn, pltv_p, pltv_amount))
    optimized = F.col("mode") == F.lit("optimized")
    out = SC.score_triggers(out, trigger_model, enabled=optimized)
    key = [F.col("app_id"), F.col("airbridge_uuid"), F.col("model_version")] + list(draw_extra or [])
    out = PO.assign_trigger(out, has_model=optimized, seed=seed, draw_key=key)
    out = SC.score_binary(out, purchase, churn)
    out = SC.hurdle_ltv(out, pltv_p, pltv_amount, enabled=F.col("has_pltv"))
    return out.drop(BM.MODELS)


def tier_config_from(scored: DataFrame, labels: DataFrame, n_quantiles: int = 1000) -> DataFrame:
    """M11 on scored users joined to their actual LTV (same user key)."""
    s = scored.select("app_id", "airbridge_uuid", "pltv_score").join(
        labels.select("app_id", "airbridge_uuid", "ltv"), S.KEY, "left")
    return LT.build_tier_config(s, score="pltv_score", actual="ltv", n_quantiles=n_quantiles)


def score_users(features: DataFrame, readiness: DataFrame, labels: DataFrame,
                cfg: DataFrame | None = None, seed: str = P.POLICY_SEED, models: DataFrame | None = None) -> DataFrame:
    """Batch form: every feature row of a ready app, tiered with a config built from the
    same population (or the given ``cfg``)."""
    feats = features.select("app_id", "airbridge_uuid", *S.ALL_FEATURES)
    # written once: the tier config, the ranks behind it and the result all read the scores
    scored = materialize(score_rows(feats, readiness, seed=seed, models=models).drop("trigger_scores", *S.ALL_FEATURES), "scored-users")
    cfg = materialize(tier_config_from(scored, labels) if cfg is None else cfg, "tier-config")
    tiered = LT.assign_tier(scored, cfg)
    return tiered.select(
        "app_id", "airbridge_uuid", "mode", "best_trigger", "is_random",
        *[f"score_{t}" for t in S.TREATMENT_TRIGGERS],
        "d3_purchase_prob", "d3_churn_prob",
        F.round("pltv_score", 4).alias("pltv_score"),
        "pltv_tier", "pltv_percentile",
        F.round("tier_avg_ltv", 4).alias("tier_avg_ltv"),
    )


def score_requests(requests: DataFrame, features: DataFrame, readiness: DataFrame, cfg: DataFrame,
                   ttl_s: float = S.DECISION_TTL_SECONDS, seed: str = P.POLICY_SEED,
                   models: DataFrame | None = None) -> DataFrame:
    """Per-request form (the service's predict path): J3 -> J1 -> W4 -> M2/M3 -> M1 -> M4-M6.

    Refused requests (unknown app / user) are not in the output; ``unscorable_requests``
    lists them. Every served request carries its decision anchor; requests served from
    a sticky decision repeat the decision's trigger (the draw is keyed by the anchor).
    """
    req = LK.requests_of_ready_apps(requests, readiness)
    feats = features.select("app_id", "airbridge_uuid", "row_no", *S.ALL_FEATURES)
    hit = LK.lookup_features(req, feats)
    sticky = PO.sticky_decisions(hit, ttl_s=ttl_s)
    scored = score_rows(sticky.drop("model_version"), readiness, seed=seed,
                        draw_extra=[F.col("anchor_us")], models=models)
    tiered = LT.assign_tier(scored, cfg)
    return tiered.select(
        "request_id", "app_id", "airbridge_uuid", "request_ts", "anchor_ts", "anchor_us", "mode",
        "best_trigger", "is_random", "trigger_scores",
        *[f"score_{t}" for t in S.TREATMENT_TRIGGERS],
        "d3_purchase_prob", "d3_churn_prob",
        F.round("pltv_score", 4).alias("pltv_score"),
        "pltv_tier", "pltv_percentile",
        F.round("tier_avg_ltv", 4).alias("tier_avg_ltv"),
    )


def to_response(df: DataFrame, keep=("app_id", "airbridge_uuid")) -> DataFrame:
    """K2: the service's response shape as JSON text (field order as the service; a
    missing pLTV stays ``null``; exploration mode gives ``"trigger_scores":{}``)."""
    pltv = F.when(F.col("pltv_tier").isNotNull(), F.struct(
        F.col("pltv_tier").alias("tier"), F.col("pltv_percentile").alias("percentile"),
        F.col("tier_avg_ltv").alias("tier_avg_ltv")))
    body = F.struct(
        F.col("airbridge_uuid").alias("user_id"), "best_trigger", "trigger_scores", "is_random",
        "d3_purchase_prob", "d3_churn_prob", pltv.alias("pltv"))
    return df.select(*keep, F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))
