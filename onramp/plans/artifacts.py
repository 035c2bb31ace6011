"""Queries that score with artifacts as they lie on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import ltv as LT
from ..session import ensure_checkpoint_dir, materialize
from ..sources.config import read_tier_config
from . import catalog as C
from . import oracle as O
from .catalog import KEYF, fixture, register

# fixed values of the stand-in: whose tier config was not shipped, and whose was cut off
ABSENT_APP, BROKEN_APP = "app_2", "app_1"


def ship_tier_configs(cfg: DataFrame, root: str) -> None:
    """``<root>/app_id=<app>/*`` with one JSON document per app; one app has none, one app's
    document ends halfway."""
    document = F.to_json(F.struct("tiers", "tier_avg_ltv", "score_percentiles"))
    cut = F.when(F.col("app_id") == BROKEN_APP, F.substring(document, 1, F.floor(F.length(document) / 2).cast("int"))).otherwise(document)
    (cfg.where(F.col("app_id") != ABSENT_APP).select("app_id", cut.alias("value")).repartition("app_id")
     .write.partitionBy("app_id").option("lineSep", "\n").text(root))


@register("score_users_shipped", C._users_sql() + f"""
SELECT {KEYF}, round(pltv_score, 4) AS pltv_score, CASE WHEN app_id NOT IN ('{ABSENT_APP}', '{BROKEN_APP}') THEN pltv_tier END AS pltv_tier,
       CASE WHEN app_id NOT IN ('{ABSENT_APP}', '{BROKEN_APP}') THEN pltv_percentile END AS pltv_percentile,
       CASE WHEN app_id NOT IN ('{ABSENT_APP}', '{BROKEN_APP}') THEN round(tier_avg_ltv, 4) END AS tier_avg_ltv
FROM tiered""")
def q_score_users_shipped(spark, sf_dir):
    """M12 with shipped tier configs: read from the folder, joined by app; an app without a
    readable document keeps its score and has no tier."""
    fx = fixture(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/onramp-tables/tier-configs-{uuid.uuid4().hex[:12]}"
    ship_tier_configs(C._tier_cfg(fx), root)
    shipped = materialize(read_tier_config(spark, root, file="*"), "shipped-tiers")
    scored = LT.assign_tier(C._scored_users(fx).select(*S.KEY, "pltv_score"), shipped)
    return scored.select(*S.KEY, F.round("pltv_score", 4).alias("pltv_score"), "pltv_tier", "pltv_percentile", F.round("tier_avg_ltv", 4).alias("tier_avg_ltv"))
