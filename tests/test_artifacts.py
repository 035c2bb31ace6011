"""Tier configs as they lie on disk."""

import os

from conftest import SF_CHECK
from onramp.operators import ltv as LT
from onramp.plans import artifacts as AR
from onramp.sources.config import read_tier_config

DOC = '{"tiers": [{"name": "high", "threshold": 5.0}, {"name": "low", "threshold": 0.0}],\n "tier_avg_ltv": {"high": 9.5}, "score_percentiles": [1.0, 6.0]}'


def test_unreadable_documents_give_no_tier(spark, tmp_path):
    for app, text in (("fine", DOC), ("cut", DOC[:len(DOC) // 2]), ("tail", DOC[:-1]), ("empty", ""), ("list", "[1, 2"), ("text", "not json")):
        os.makedirs(tmp_path / app)
        (tmp_path / app / "pltv_tier_config.json").write_text(text)
    cfg = read_tier_config(spark, str(tmp_path))
    assert [r.app_id for r in cfg.where("tiers IS NOT NULL").collect()] == ["fine"]
    users = spark.createDataFrame([(a, 7.0) for a in ("fine", "cut", "tail", "empty", "list", "text", "absent")], "app_id string, pltv_score double")
    out = {r.app_id: (r.pltv_tier, r.pltv_percentile, r.tier_avg_ltv) for r in LT.assign_tier(users, cfg).collect()}
    assert out.pop("fine") == ("high", 99, 9.5) and set(out.values()) == {(None, None, None)} and len(out) == 6


def test_shipped_configs_score_like_the_built_ones(spark):
    out = AR.q_score_users_shipped(spark, SF_CHECK).collect()
    assert {r.app_id for r in out if r.pltv_tier is not None} == {"app_0"}
    assert all(r.pltv_score is not None for r in out if r.app_id == AR.BROKEN_APP)
