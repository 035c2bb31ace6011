"""Edge table (FIXTURES.md part C): tiers, percentiles, triggers, keys, text, TTL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from onramp import params as P
from onramp import schema as S
from onramp.functions.columns import first_matching_tier, left_rank, percentile_from_rank, to_number
from onramp.operators import lookup as LK
from onramp.operators import ltv as LT
from onramp.operators import policy as PO
from onramp.operators import scoring as SC
from onramp.sources.feature_table import check_columns

TIERS = [("high", 100.0), ("medium", 50.0), ("low", 0.0)]


def cfg_df(spark, tiers=TIERS, q=None, avg=None):
    q = list(q) if q is not None else [float(i) for i in range(1000)]
    avg = avg if avg is not None else {"high": 10.0, "medium": 5.0, "low": 1.0}
    return spark.createDataFrame([("a", [{"name": n, "threshold": t} for n, t in tiers], avg, q)],
                                 S.TIER_CONFIG_SCHEMA)


def assign(spark, scores, **kw):
    df = spark.createDataFrame([("a", str(i), float(s)) for i, s in enumerate(scores)],
                               "app_id string, airbridge_uuid string, pltv_score double")
    out = LT.assign_tier(df, cfg_df(spark, **kw)).orderBy(F.col("airbridge_uuid").cast("int")).collect()
    return [(r.pltv_tier, r.pltv_percentile, r.tier_avg_ltv) for r in out]


def test_tier_thresholds(spark):
    just_under = float(np.nextafter(100.0, 0))
    r = assign(spark, [100.0, just_under, -1.0, float("nan"), float("inf")])
    assert [x[0] for x in r] == ["high", "medium", "low", "low", "high"]
    # NaN -> percentile 99, +inf -> 99
    assert r[3][1] == 99 and r[4][1] == 99


def test_percentile_left_side_and_truncation(spark):
    q = [float(i) for i in range(1000)]
    r = assign(spark, [0.0, 289.5, 569.5, 579.5], q=q)
    # idx = #(q < score): 0, 290, 570, 580 -> 0, 28, 56, 57
    assert [x[1] for x in r] == [0, 28, 56, 57]


def test_duplicate_and_empty_quantiles(spark):
    assert assign(spark, [1.0], q=[1.0, 1.0, 2.0])[0][1] == 0
    assert assign(spark, [7.0], q=[])[0][1] == 50


def test_tiers_listed_low_first(spark):
    r = assign(spark, [20.0], tiers=[("low", 0.0), ("high", 10.0)])
    assert r[0][0] == "low"


def test_unknown_tier_average(spark):
    r = assign(spark, [200.0], avg={"medium": 5.0})
    assert r[0][2] == 0.0


def test_negative_log_amount_gives_zero(spark):
    m = P.LinearModel("amt", -0.3, {}, link="identity")
    p = P.LinearModel("p", 5.0, {})
    df = spark.createDataFrame([(1,)], "x int").select(*[F.lit(0.0).alias(c) for c in S.ALL_FEATURES])
    assert SC.hurdle_ltv(df, p, m).first().pltv_score == 0.0


def test_left_rank_matches_numpy(spark):
    rng = np.random.default_rng(3)
    q = np.sort(rng.integers(0, 20, 37).astype(float)).tolist()
    xs = [float(x) for x in rng.integers(-2, 22, 60)] + [float("nan"), float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("q", F.array(*[F.lit(v) for v in q]))
    got = [r.i for r in df.select(left_rank("q", "x").alias("i")).collect()]
    want = [int(np.searchsorted(q, x, side="left")) if not math.isnan(x) else len(q) for x in xs]
    assert got == want


def test_trigger_tie_and_rounding(spark):
    df = spark.createDataFrame([(0.25, 0.25, 0.1, 0.1), (0.25001, 0.25003, 0.1, 0.1)],
                               "a double, b double, c double, d double")
    r = df.select(*[F.round(F.col(c), 4).alias(f"score_{t}") for c, t in zip("abcd", S.TREATMENT_TRIGGERS)]) \
          .select(PO.best_trigger_col().alias("b")).collect()
    assert [x.b for x in r] == ["price_appeal", "price_appeal"]


def test_no_trigger_model_means_exploration(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(200)], "app_id string, airbridge_uuid string")
    df = SC.score_triggers(df, None)
    out = PO.assign_trigger(df, has_model=F.lit(False), seed="s")
    rows = out.collect()
    assert all(r.is_random for r in rows)
    assert all(len(r.trigger_scores) == 0 for r in rows)
    assert {r.best_trigger for r in rows} == set(S.TREATMENT_TRIGGERS)


def test_duplicate_key_last_row_wins_and_null_key(spark):
    df = spark.createDataFrame([("a", "u", 1, 1.0), ("a", "u", 2, 2.0), ("a", None, 3, 3.0)],
                               "app_id string, airbridge_uuid string, row_no long, latency double")
    latest = LK.latest_per_key(df)
    assert latest.where("airbridge_uuid = 'u'").first().latency == 2.0
    req = spark.createDataFrame([("a", "u"), ("a", None)], "app_id string, airbridge_uuid string")
    assert LK.lookup_features(req, df).count() == 1   # NULL key never matches
    assert LK.user_count(df).first().user_count == 3  # ... but is counted


def test_feature_text(spark):
    df = spark.createDataFrame([("abc",), ("",), ("NaN",), (" 3 ",), ("inf",), (None,)], "x string")
    got = [r.v for r in df.select(to_number("x").alias("v")).collect()]
    assert got[:4] == [0.0, 0.0, 0.0, 3.0] and math.isinf(got[4]) and got[5] == 0.0


def test_missing_feature_column_and_order(spark):
    df = spark.createDataFrame([("a", "u", 1.0)], "app_id string, airbridge_uuid string, latency double")
    with pytest.raises(ValueError, match="trackinglink_count"):
        check_columns(df)
    with pytest.raises(ValueError, match="Feature mismatch"):
        SC.check_feature_order(list(reversed(S.ALL_FEATURES)))


def _anchors(spark, secs, versions=None, ttl=3600):
    rows = [(i, "a", "u", versions[i] if versions else "v1", float(s)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "request_id long, app_id string, airbridge_uuid string, model_version string, t double") \
              .withColumn("request_ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    out = PO.sticky_decisions(df, ttl_s=ttl).orderBy("request_id").collect()
    want, last = {}, {}
    for i, _, _, v, t in sorted(rows, key=lambda r: (r[4], r[0])):
        us = int(t * 1e6)
        if v not in last or us - last[v] >= ttl * 10**6:
            last[v] = us
        want[i] = last[v]
    assert {r.request_id: r.anchor_us for r in out} == want
    return [r.anchor_us / 1e6 for r in out]


def test_hot_key_long_island(spark):
    import random
    rnd = random.Random(5)
    secs = sorted(rnd.uniform(0, 50 * 3600) for _ in range(3000))   # one user, dense requests
    secs += [s + 7.0 for s in secs[:40]]                               # plus near-duplicates
    _anchors(spark, secs)


def test_ttl_rules(spark):
    assert _anchors(spark, [0, 3599.999]) == [0, 0]
    assert _anchors(spark, [0, 3600]) == [0, 3600]
    assert _anchors(spark, [0, 3000, 3700]) == [0, 0, 3700]
    assert _anchors(spark, [0, 1000, 3599, 3600, 5000, 7200]) == [0, 0, 0, 3600, 3600, 7200]
    # a model reload (new version) starts a new decision inside the TTL
    assert _anchors(spark, [0, 10], versions=["v1", "v2"]) == [0, 10]


def test_percentile_formula_column(spark):
    df = spark.createDataFrame([(290, 1000), (570, 1000), (580, 1000), (0, 0)], "i int, n int")
    assert [r.p for r in df.select(percentile_from_rank("i", "n").alias("p")).collect()] == [28, 56, 57, 50]


def test_first_matching_tier_nan(spark):
    df = spark.createDataFrame([(float("nan"),)], "s double").withColumn(
        "t", F.array(F.struct(F.lit("high").alias("name"), F.lit(1.0).alias("threshold"))))
    assert df.select(first_matching_tier("t", "s").alias("x")).first().x == "low"


def test_sticky_islands(spark):
    import random
    rnd = random.Random(2)
    for ttl in (60, 600):
        _anchors(spark, [rnd.choice([0, 5, 30, 59, 60, 61, 400]) * k for k in range(300)], versions=[rnd.choice("ab") for _ in range(300)], ttl=ttl)


def test_sticky_short_islands_need_no_python(spark):
    """A key's islands are joined in by (key, bucket): only long ones reach Python."""
    df = spark.createDataFrame([(i, "a", "hot", "v", i * 7200) for i in range(50)],
                               "request_id long, app_id string, airbridge_uuid string, model_version string, t long") \
              .withColumn("request_ts", F.timestamp_seconds("t"))
    out = PO.sticky_decisions(df, ttl_s=3600)
    assert all(r.anchor_us == r.t * 10**6 for r in out.collect()) and out.count() == 50


def test_latest_row_with_null_order_is_kept(spark):
    df = spark.createDataFrame([("a", "u", None, 1.0), ("a", "v", None, 2.0), ("a", "v", 1, 3.0)],
                               "app_id string, airbridge_uuid string, row_no long, latency double")
    assert {r.airbridge_uuid: r.latency for r in LK.latest_per_key(df).collect()} == {"u": 1.0, "v": 3.0}


def test_install_row_packed_key_equals_struct_min(spark):
    import random
    from onramp.operators import features as FT
    rnd = random.Random(9)
    rows = []
    for u in range(60):
        for _ in range(rnd.randint(1, 6)):
            t = rnd.choice([-10 ** 12, -5, 0, 7, 7, 10 ** 15])          # repeats force ties
            rows.append(("a", "u%d" % u, rnd.randint(-10 ** 18, 10 ** 18), t))
    df = spark.createDataFrame(rows, "app_id string, user_id string, event_id long, t long") \
              .withColumn("ts", F.timestamp_micros("t")).withColumn("is_install", F.lit(True))
    got = {(r.user_id, r.install_event_id, r.t0) for r in FT.installs(df).collect()}
    want = {(r.user_id, r.m.event_id, r.m.ts) for r in
            df.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).collect()}
    assert got == want
