"""Sources and sinks: CSV feature table, tier config / factor JSON, inventory, log sink."""

import json

import pytest
from pyspark.sql import functions as F

from onramp.operators import lookup as LK
from onramp import schema as S
from onramp.operators import logs as LG
from onramp.sources import config as CF
from onramp.sources.feature_table import read_feature_table


def test_missing_csv_gives_empty_table(spark, tmp_path):
    df = read_feature_table(spark, str(tmp_path / "nope.csv"))
    assert df.count() == 0 and df.columns[:2] == ["app_id", "airbridge_uuid"]


def test_csv_by_name_with_bad_text(spark, tmp_path):
    p = tmp_path / "f.csv"
    cols = list(reversed(S.ALL_FEATURES)) + ["airbridge_uuid", "extra", "app_id"]
    vals = {c: "1" for c in S.ALL_FEATURES}
    vals.update({"latency": "abc", "recency": "", "click_ratio": "NaN", "DA_count": " 3 "})
    row = [vals.get(c, {"airbridge_uuid": "u1", "extra": "x", "app_id": "a"}.get(c)) for c in cols]
    p.write_text(",".join(cols) + "\n" + ",".join(row) + "\n")
    r = read_feature_table(spark, str(p)).first()
    assert (r.app_id, r.airbridge_uuid) == ("a", "u1")
    assert r.latency == 0.0 and r.recency == 0.0 and r.click_ratio == 0.0 and r.DA_count == 3.0
    assert r.trackinglink_count == 1.0


def test_csv_missing_column_errors(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("app_id,airbridge_uuid,latency\na,u,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        read_feature_table(spark, str(p))


def test_tier_config_and_factor_json(spark, tmp_path):
    root = tmp_path / "models"
    (root / "app_a").mkdir(parents=True)
    (root / "app_b").mkdir(parents=True)
    cfg = {"tiers": [{"name": "high", "threshold": 10.0}, {"name": "medium", "threshold": 5.0},
                     {"name": "low", "threshold": 0.0}],
           "tier_avg_ltv": {"high": 100, "medium": 50, "low": 1}, "score_percentiles": [1.0, 2.0, 3.0]}
    (root / "app_a" / "pltv_tier_config.json").write_text(json.dumps(cfg))
    fa = {"mean": [1.0, 2.0], "std": [1.0, 0.0], "loading_matrix": [[0.5, 0.1], [0.2, 0.3]],
          "factor_names": ["f1", "f2"]}
    (root / "app_b" / "fa_params.json").write_text(json.dumps(fa))
    c = CF.read_tier_config(spark, str(root)).collect()
    assert len(c) == 1 and c[0].app_id == "app_a" and c[0].tiers[0].name == "high"
    long = CF.read_factor_params(spark, str(root)).orderBy("pos", "fpos").collect()
    assert len(long) == 4 and long[0].feature == S.UA_FEATURES[0] and long[1].factor == "f2"
    inv = CF.artifact_inventory(spark, str(root)).orderBy("app_id").collect()
    assert [(r.app_id, r.file) for r in inv] == [("app_a", "pltv_tier_config.json"), ("app_b", "fa_params.json")]
    ready = LK.app_readiness(CF.artifact_inventory(spark, str(root))).collect()
    assert all(not r.ready and r.mode == "not ready" for r in ready)


def test_prediction_log_append(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "u", "scarcity", True, {}, 0.1, 0.2, None, None),
         ("a", "v", "novelty", False, {"novelty": 0.3}, 0.1, 0.2, "high", 90)],
        "app_id string, airbridge_uuid string, best_trigger string, is_random boolean, "
        "trigger_scores map<string,double>, d3_purchase_prob double, d3_churn_prob double, "
        "pltv_tier string, pltv_percentile int")
    flat = LG.flatten_for_log(rows)
    path = str(tmp_path / "log")
    assert LG.append_prediction_log(flat, path)
    assert LG.append_prediction_log(flat, path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert back.where("user_id = 'u'").select("trigger_scores").first()[0] is None
    assert json.loads(back.where("user_id = 'v'").select("trigger_scores").first()[0]) == {"novelty": 0.3}
    # a failing sink reports instead of raising
    assert LG.append_prediction_log(flat.withColumn("timestamp", F.lit("x")), "/proc/forbidden/log") is False


def test_parquet_feature_table_by_name(spark, tmp_path):
    cols = ["extra", *reversed(S.ALL_FEATURES), "airbridge_uuid", "app_id"]
    row = ["x", *[str(i) for i in range(25)], "u9", "a"]
    p = str(tmp_path / "f.parquet")
    spark.createDataFrame([row], cols).write.parquet(p)
    r = read_feature_table(spark, p, fmt="parquet").first()
    assert (r.app_id, r.airbridge_uuid) == ("a", "u9")
    # reversed order on disk, read back by name
    assert [r[c] for c in S.ALL_FEATURES] == [float(24 - i) for i in range(25)]


def test_booleans_and_file_order(spark, tmp_path):
    from onramp import schema as S
    from onramp.operators.lookup import lookup_features
    head = ["app_id", "airbridge_uuid", *S.ALL_FEATURES]
    a, b = S.ALL_FEATURES[0], S.ALL_FEATURES[1]
    def line(user, flag, mixed, i):
        return ",".join(["app", user, *[flag if c == a else mixed if c == b else str(i) for c in S.ALL_FEATURES]])
    rows = [line("u", "True", "True", 1), line("v", "False", "2", 2), line("u", "False", "x", 3)]
    (tmp_path / "f.csv").write_text("\n".join([",".join(head), *rows]) + "\n")
    f = read_feature_table(spark, str(tmp_path / "f.csv"))
    req = spark.createDataFrame([(1, "app", "u"), (2, "app", "v")], "request_id long, app_id string, airbridge_uuid string")
    out = {r.request_id: r for r in lookup_features(req, f).collect()}
    assert len(out) == 2 and lookup_features(req, f).count() == 2
    assert out[1][a] == 0.0 and out[1][b] == 0.0 and out[1][S.ALL_FEATURES[2]] == 3.0   # last row of the file
    assert out[2][a] == 0.0 and out[2][b] == 2.0
    first = read_feature_table(spark, str(tmp_path / "f.csv")).where("airbridge_uuid = 'u'").select(a).collect()
    assert sorted(r[0] for r in first) == [0.0, 1.0]
    # no order at all: one row per user
    assert lookup_features(req, f.drop("row_no")).count() == 2


def test_same_size_upload_bumps_the_version(spark, tmp_path):
    import os
    from onramp import schema as S
    from onramp.operators.lookup import app_readiness
    from onramp.sources.config import artifact_inventory
    os.makedirs(tmp_path / "a")
    for f in S.REQUIRED_MODEL_FILES:
        (tmp_path / "a" / f).write_text("one")
    one = app_readiness(artifact_inventory(spark, str(tmp_path))).first()
    f = tmp_path / "a" / S.REQUIRED_MODEL_FILES[0]
    f.write_text("two")
    os.utime(f, (1_900_000_000, 1_900_000_000))
    two = app_readiness(artifact_inventory(spark, str(tmp_path))).first()
    assert one.ready and two.ready and one.model_version != two.model_version
    f.write_text("")   # an empty file does not load
    assert not app_readiness(artifact_inventory(spark, str(tmp_path))).first().ready
