"""Fits from sufficient statistics against numpy on the collected rows; point-in-time join
against brute force; the S-learner on planted uplift."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from onramp import schema as S
from onramp.operators import asof as AS
from onramp.operators import fit as FI
from onramp.operators import policy as PO
from onramp.operators import scoring as SC
from onramp.params import TriggerModel

NAMES = ["a", "b", "c"]


def scaled(x):
    std = x.std(axis=0)
    fine = std > FI.CONSTANT * (np.abs(x.mean(axis=0)) + 1)
    z = np.where(fine, (x - x.mean(axis=0)) / np.where(fine, std, 1), 0)
    return np.column_stack([np.ones(len(x)), z]), np.where(fine, std, np.inf)


def newton(x, y, steps=FI.STEPS, ridge=FI.RIDGE):
    z, std = scaled(x)
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (y - p) - ridge * b)
    w = b[1:] / std
    return b[0] - w @ x.mean(axis=0), w


def frame(spark, groups):
    rows = [(g, *map(float, r), None if t is None else float(t)) for g, (x, y) in groups.items() for r, t in zip(x, y)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "app_id string, a double, b double, c double, y double").repartition(5)


def test_logistic_per_group(spark):
    rng = np.random.default_rng(2)
    groups = {}
    for g, n, sign in (("hot", 900, 1), ("cold", 60, -1), ("one class", 20, 0)):
        x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 1000, 0]
        x[:, 2] = x[:, 2] if g != "cold" else 3.0  # constant there
        groups[g] = (x, np.ones(n) if sign == 0 else (sign * x[:, 0] + rng.normal(size=n) > 0).astype(float))
    d = frame(spark, groups).unionByName(spark.createDataFrame([("hot", 1.0, 1.0, 1.0, None)], "app_id string, a double, b double, c double, y double"))
    got = {r.app_id: r for r in FI.fit_logistic(d, "y", NAMES).collect()}
    for g, (x, y) in groups.items():
        b0, w = newton(x, y)
        assert got[g].n == len(y) and got[g].intercept == pytest.approx(b0, rel=1e-6, abs=1e-8)
        assert got[g].weights == pytest.approx(w.tolist(), rel=1e-6, abs=1e-9)
    assert got["cold"].weights[2] == 0 and got["hot"].weights[0] > 0 > got["cold"].weights[0]
    assert FI.fit_logistic(d.limit(0), "y", NAMES).count() == 0


def test_linear_and_rank(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3))
    twin = x.copy()
    twin[:, 2] = 2 * twin[:, 0] - 1
    groups = {"full": (x, x @ [1, -2, 3] + 4), "twin": (twin, twin[:, 0]), "few": (x[:2], np.array([1.0, 2.0]))}
    got = {r.app_id: r for r in FI.fit_linear(frame(spark, groups), "y", NAMES, ridge=1e-9).collect()}
    assert got["full"].rank == 4 and got["full"].intercept == pytest.approx(4, abs=1e-6) and got["full"].weights == pytest.approx([1, -2, 3], abs=1e-6)
    assert got["twin"].rank == 3 and got["few"].rank == 2


def test_hurdle_on_planted_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 3))
    pays = rng.random(3000) < 1 / (1 + np.exp(-(x[:, 0] - 0.5)))
    ltv = np.where(pays, np.expm1(3 + 0.5 * x[:, 1] + rng.normal(scale=0.05, size=3000)), 0.0)
    d = frame(spark, {"shop": (x, ltv), "free": (x[:30], np.zeros(30))})
    got = {r.app_id: r for r in FI.fit_hurdle(d, "y", NAMES).collect()}
    assert got["shop"].payer.intercept == pytest.approx(-0.5, abs=0.15) and got["shop"].payer.weights[0] == pytest.approx(1, abs=0.15)
    assert got["shop"].amount.intercept == pytest.approx(3, abs=0.02) and got["shop"].amount.weights == pytest.approx([0, 0.5, 0], abs=0.02)
    assert got["shop"].amount.n == int((ltv > 0).sum()) and got["free"].amount is None


def test_s_learner_recovers_planted_uplift(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(8000):
        seg, trig = int(rng.integers(0, 2)), int(rng.integers(0, 4))
        z = -1.0 + 1.2 * (seg == 1 and trig == 2) + 1.2 * (seg == 0 and trig == 0)
        rows.append(("x", float(seg), S.TREATMENT_TRIGGERS[trig], int(rng.random() < 1 / (1 + np.exp(-z)))))
    d = spark.createDataFrame(rows, "app_id string, user_signin double, trigger_type string, clicked int")
    fit, names = FI.fit_s_learner(d, features=["user_signin"], interact_with=["user_signin"])
    w = {r.term: r.weight for r in FI.coefficient_rows(fit, names, "app_id").collect()}
    m = TriggerModel("cate_model", w["(intercept)"], {"user_signin": w["user_signin"]}, {t: w[f"trigger={t}"] for t in S.TREATMENT_TRIGGERS},
                     {t: {"user_signin": w[f"{t}|user_signin"]} for t in S.TREATMENT_TRIGGERS})
    users = spark.createDataFrame([(0.0,), (1.0,)], "user_signin double")
    best = [r.b for r in SC.score_triggers(users, m).withColumn("b", PO.best_trigger_col()).orderBy("user_signin").collect()]
    assert best == [S.TREATMENT_TRIGGERS[0], S.TREATMENT_TRIGGERS[2]]
    p = {k: 1 / (1 + np.exp(-(w["(intercept)"] + w["user_signin"] * s + w[f"trigger={t}"] + w[f"{t}|user_signin"] * s)))
         for k, (s, t) in {"hit": (1, S.TREATMENT_TRIGGERS[2]), "miss": (1, S.TREATMENT_TRIGGERS[0])}.items()}
    assert p["hit"] - p["miss"] == pytest.approx(1 / (1 + np.exp(-0.2)) - 1 / (1 + np.exp(1.0)), abs=0.06)


def test_features_asof(spark):
    rng = random.Random(9)
    hour = 3_600_000_000
    snaps = [("x", str(rng.randrange(6)), v, rng.randrange(0, 400) * hour, float(v)) for v in range(200)]
    snaps += [("x", "0", 500, 100 * hour, 1.0), ("x", "0", 501, 100 * hour, 2.0)]  # one instant: the higher version
    dec = [("x", str(rng.randrange(8)), i, rng.randrange(0, 450) * hour) for i in range(300)] + [("x", "0", 900, 100 * hour), ("y", "0", 901, hour)]
    s = spark.createDataFrame(snaps, "app_id string, airbridge_uuid string, version long, us long, f double").withColumn("valid_from", F.timestamp_micros("us"))
    d = spark.createDataFrame(dec, "app_id string, airbridge_uuid string, request_id long, decided_us long")
    for age_h in (24, 10_000):
        got = {r.request_id: (r.version, r.f) for r in AS.features_asof(d, s, age_h * 3600, features=["f"]).collect()}
        want = {}
        for a, u, i, us in dec:
            fits = [(t, v, f) for b, w, v, t, f in snaps if (b, w) == (a, u) and us - age_h * hour < t <= us]
            if fits:
                want[i] = max(fits)[1:]
        assert got == want and len(want) > 50
