"""Tree node tables against the estimators they come from, and against a plain descent."""

import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from onramp import schema as S
from onramp.operators import trees as TR
from onramp.plans import training as TN

NAMES = ["a", "b", "c"]


def data(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = (x[:, 0] * x[:, 1] + rng.normal(scale=0.3, size=n) > 0).astype(float)
    rows = [("app", str(i), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "app_id string, airbridge_uuid string, a double, b double, c double, label double")


@pytest.mark.parametrize("estimator", [lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=1), lambda: RandomForestClassifier(numTrees=4, maxDepth=4, seed=1),
                                       lambda: GBTRegressor(maxIter=3, maxDepth=2, seed=1), lambda: RandomForestRegressor(numTrees=3, maxDepth=5, seed=1)])
def test_export_scores_like_the_estimator(spark, tmp_path, estimator):
    d = VectorAssembler(inputCols=NAMES, outputCol="features").transform(data(spark))
    m = estimator().fit(d)
    saved = str(tmp_path / "model")
    m.write().overwrite().save(saved)
    TR.write_trees(TR.export_trees(spark, saved, "app", "m"), str(tmp_path / "nodes"))
    nodes = TR.read_trees(spark, str(tmp_path / "nodes"))
    out = TR.score_trees(m.transform(d), nodes, {"got": "m"}, features=NAMES)
    want = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    assert out.where(F.abs(F.col("got") - want) > 1e-9).count() == 0 and out.where("got IS NULL").count() == 0


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, "app_id string, " + TR.NODE_SCHEMA)


def test_uneven_trees_nan_and_missing(spark):
    nan = float("nan")
    rows = [("x", "m", 0, 10, 0, 0.5, 20, 30, 0.0, 2.0, "identity"), ("x", "m", 0, 20, -1, None, -1, -1, 1.0, 2.0, "identity"),
            ("x", "m", 0, 30, 1, 1.5, 40, 50, 0.0, 2.0, "identity"), ("x", "m", 0, 40, -1, None, -1, -1, 10.0, 2.0, "identity"),
            ("x", "m", 0, 50, 2, 0.0, 60, 70, 0.0, 2.0, "identity"), ("x", "m", 0, 60, -1, None, -1, -1, 100.0, 2.0, "identity"),
            ("x", "m", 0, 70, -1, None, -1, -1, 1000.0, 2.0, "identity"), ("x", "m", 1, 0, -1, None, -1, -1, 0.5, 1.0, "identity")]
    nodes = nodes_of(spark, rows)
    assert TR.with_depth(TR.packed(nodes)).first().trees.steps == 3
    users = spark.createDataFrame([("x", 0.5, 9.0, 9.0), ("x", 0.6, 1.5, 9.0), ("x", 0.6, 1.6, 0.0), ("x", nan, nan, nan), ("x", None, None, None), ("y", 0.0, 0.0, 0.0)],
                                  "app_id string, a double, b double, c double")
    out = TR.score_trees(users, nodes, {"p": "m", "other": "absent"}, features=NAMES)
    assert [(r.p, r.other) for r in out.collect()] == [(2.5, None), (20.5, None), (200.5, None), (2000.5, None), (2.5, None), (None, None)]
    assert TR.score_trees(users, nodes_of(spark, []), {"p": "m"}, features=NAMES).where("p IS NOT NULL").count() == 0


def test_no_python_in_the_plan(spark):
    plan = TN.q_score_d3_trees(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|BatchEval", plan)


def test_fit_per_app(spark):
    """Two apps with opposite signal and one with one class: each is scored by its own trees."""
    rng = np.random.default_rng(3)
    rows = []
    for app, sign in (("up", 1), ("down", -1), ("flat", 0)):
        for i in range(200):
            x = float(rng.normal())
            rows.append((app, f"{app}{i}", x, 1 if sign == 0 else int(sign * x > 0)))
    d = spark.createDataFrame(rows, "app_id string, airbridge_uuid string, trackinglink_count double, d3_purchase int")
    d = d.withColumns({c: F.lit(0.0) for c in S.ALL_FEATURES if c != "trackinglink_count"})
    out = TN._gbt_scores(spark, d)
    assert out.count() == 600 and out.where("app_id = 'flat' AND d3_purchase_prob IS NULL").count() == 200
    assert out.where("app_id <> 'flat' AND (d3_purchase_prob > 0.5) <> (d3_purchase = 1)").count() <= 4
