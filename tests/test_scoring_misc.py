"""P3 feature vector, P4 select by name, M7 factor scores from artifact parameters."""

import json

import pytest

from onramp import schema as S
from onramp.operators import scoring as SC
from onramp.sources import config as CF


def _one_user(spark, base=1.0):
    return spark.createDataFrame([("app_a", "u1", *[base + i for i in range(len(S.ALL_FEATURES))])],
                                 ["app_id", "airbridge_uuid", *S.ALL_FEATURES])


def test_feature_vector_order(spark):
    v = SC.feature_vector(_one_user(spark)).first().features
    assert v == [1.0 + i for i in range(25)]
    with pytest.raises(ValueError):
        SC.feature_vector(_one_user(spark).drop("latency"))


def test_select_by_name_defaults(spark):
    df = _one_user(spark).select("app_id", "latency")
    r = df.select(*SC.select_by_name(df, ["latency", "not_there"])).first()
    assert r.latency == 7.0 and r.not_there == 0.0


def test_factor_scores_dict_and_long_agree(spark, tmp_path):
    feats = S.UA_FEATURES
    mean = [0.5 * i for i in range(15)]
    std = [1.0 + (i % 3) for i in range(14)] + [0.0]          # last feature: std 0 -> z 0
    L = [[(i + j) % 3 - 1.0 for j in range(3)] for i in range(15)]
    params = {"mean": mean, "std": std, "loading_matrix": L, "factor_names": ["f0", "f1", "f2"]}
    df = _one_user(spark)
    wide = SC.factor_scores(df, dict(params, feature_names=feats)).first()
    root = tmp_path / "models" / "app_a"
    root.mkdir(parents=True)
    (root / "fa_params.json").write_text(json.dumps(params))   # no feature list: default names
    long = SC.factor_scores_long(df, CF.read_factor_params(spark, str(tmp_path / "models")))
    got = {r.factor: r.score for r in long.collect()}
    x = [1.0 + i for i in range(15)]
    for j, name in enumerate(["f0", "f1", "f2"]):
        want = sum(((x[i] - mean[i]) / std[i] if std[i] else 0.0) * L[i][j] for i in range(15))
        assert abs(wide[name] - want) < 1e-9 and abs(got[name] - want) < 1e-9
