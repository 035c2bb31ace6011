"""Queries of fitted and tree models (M1, M8, M9, M10) and their SQL.

The SQL fits the same systems with lists: cross-products summed by (row, column), solved by
Gauss-Jordan elimination in a recursive CTE, one chain of CTEs per Newton step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from .. import schema as S
from ..operators import asof as AS
from ..operators import fit as FI
from ..operators import scoring as SC
from ..operators import trees as TR
from ..session import ensure_checkpoint_dir, materialize
from ..sources import models as BM
from . import catalog as C
from . import oracle as O
from .catalog import ORACLE, QUERIES, fixture, r6, register  # noqa: F401

# ------------------------------------------------------------------ SQL of the fits


def _standardised_sql(p: str, src: str, features: list[str], y: str) -> list[str]:
    cols = ", ".join(f"coalesce({f}, 0)::DOUBLE" for f in features)
    return [
        f"{p}src AS (SELECT app_id, ({y})::DOUBLE AS y, [{cols}] AS x FROM {src} WHERE ({y}) IS NOT NULL)",
        f"{p}mom AS (SELECT app_id, i, avg(x[i]) AS mu, stddev_pop(x[i]) AS sd, count(*) AS n FROM {p}src, range(1, {len(features) + 1}) r(i) GROUP BY app_id, i)",
        f"""{p}s AS (SELECT app_id, any_value(n) AS n, list(mu ORDER BY i) AS mu,
  list(CASE WHEN sd > {FI.CONSTANT!r} * (abs(mu) + 1) THEN sd END ORDER BY i) AS sd FROM {p}mom GROUP BY app_id)""",
        f"""{p}z AS (SELECT a.app_id, y, list_concat([1.0::DOUBLE], list_transform(x, lambda v, i: coalesce((v - mu[i]) / sd[i], 0.0::DOUBLE))) AS z
  FROM {p}src a JOIN {p}s s ON a.app_id = s.app_id)""",
    ]


def _solve_sql(p: str, k: int, size: int, e: str, w: str, r: str, beta: str | None, ridge: float) -> list[str]:
    """CTEs {p}a{k} (matrix with right-hand side), {p}g{k} (eliminated) and {p}b{k + 1} (solution)."""
    start = "b.beta[i]" if beta else "0"
    join = f"JOIN {beta} b ON x.app_id = b.app_id" if beta else ""
    return [
        f"""{p}h{k} AS (SELECT app_id, i, j, sum(CASE WHEN j <= {size} THEN {w} * z[least(j, {size})] * z[i] ELSE {r} * z[i] END) AS v
  FROM {e}, range(1, {size + 1}) ri(i), range(1, {size + 2}) rj(j) GROUP BY app_id, i, j)""",
        f"""{p}a{k} AS (SELECT app_id, list(own ORDER BY i) AS m FROM (
  SELECT x.app_id, i, list(CASE WHEN j = i THEN v + {ridge!r} WHEN j > {size} THEN v - {ridge!r} * {start} ELSE v END ORDER BY j) AS own
  FROM {p}h{k} x {join} GROUP BY x.app_id, i) GROUP BY app_id)""",
        f"""{p}g{k} AS (SELECT app_id, 0 AS step, m FROM {p}a{k} UNION ALL
  SELECT app_id, step + 1, list_transform(m, lambda row, i: CASE WHEN i = step + 1 THEN list_transform(row, lambda v: v / m[step + 1][step + 1])
    ELSE list_transform(row, lambda v, c: v - row[step + 1] * m[step + 1][c] / m[step + 1][step + 1]) END) FROM {p}g{k} WHERE step < {size})""",
        f"""{p}b{k + 1} AS (SELECT g.app_id, list_transform(m, lambda row, i: row[{size + 1}]{f' + b.beta[i]' if beta else ''}) AS beta
  FROM {p}g{k} g {f'JOIN {beta} b ON g.app_id = b.app_id' if beta else ''} WHERE step = {size})""",
    ]


def _unscaled_sql(p: str, beta: str) -> str:
    return f"""{p}fit AS (SELECT s.app_id, n, w AS weights, beta[1] - list_sum(list_transform(w, lambda v, i: v * mu[i])) AS intercept
  FROM (SELECT s.app_id, n, mu, beta, list_transform(sd, lambda v, i: coalesce(beta[i + 1] / v, 0.0::DOUBLE)) AS w FROM {p}s s JOIN {beta} b ON s.app_id = b.app_id) s)"""


def logistic_ctes(p: str, src: str, features: list[str], y: str, steps: int = FI.STEPS, ridge: float = FI.RIDGE) -> list[str]:
    size = len(features) + 1
    out = _standardised_sql(p, src, features, y)
    out.append(f"{p}b0 AS (SELECT app_id, list_transform(range({size}), lambda v: 0.0::DOUBLE) AS beta FROM {p}s)")
    for k in range(steps):
        out.append(f"{p}e{k} AS (SELECT z.app_id, z, y, 1 / (1 + exp(-list_dot_product(z, beta))) AS p FROM {p}z z JOIN {p}b{k} b ON z.app_id = b.app_id)")
        out += _solve_sql(p, k, size, f"{p}e{k}", "p * (1 - p)", "(y - p)", f"{p}b{k}", ridge)
    return [*out, _unscaled_sql(p, f"{p}b{steps}")]


def linear_ctes(p: str, src: str, features: list[str], y: str, ridge: float = FI.RIDGE) -> list[str]:
    size = len(features) + 1
    out = [*_standardised_sql(p, src, features, y), *_solve_sql(p, 0, size, f"{p}z", "1", "y", None, ridge), _unscaled_sql(p, f"{p}b1")]
    # the rank: the plain matrix swept column by column
    out.append(f"""{p}plain AS (SELECT app_id, list(own ORDER BY i) AS m FROM (
  SELECT app_id, i, list(v ORDER BY j) AS own FROM {p}h0 WHERE j <= {size} GROUP BY app_id, i) GROUP BY app_id)""")
    out.append(f"""{p}sweep AS (SELECT app_id, 0 AS step, 0 AS rank, m[1][1] AS n, m FROM {p}plain UNION ALL
  SELECT app_id, step + 1, rank + (m[step + 1][step + 1] > {FI.PIVOT!r} * n)::INTEGER, n,
    CASE WHEN m[step + 1][step + 1] > {FI.PIVOT!r} * n THEN list_transform(m, lambda row: list_transform(row, lambda v, c:
      v - row[step + 1] * m[step + 1][c] / m[step + 1][step + 1])) ELSE m END FROM {p}sweep WHERE step < {size})""")
    out.append(f"{p}rank AS (SELECT app_id, rank FROM {p}sweep WHERE step = {size})")
    return out


def _terms_sql(names: list[str]) -> str:
    return "list_concat(['(intercept)'], [" + ", ".join(O.s(n) for n in names) + "])"


# ------------------------------------------------------------------ M8

D3_MODELS = {"d3_purchase_model": "d3_purchase", "d3_churn_model": "d3_churn"}
_LABELLED = "labelled AS (SELECT f.*, l.d3_purchase, l.d3_churn, l.ltv FROM feat f JOIN lab l ON f.app_id = l.app_id AND f.airbridge_uuid = l.airbridge_uuid)"


def _labelled_sql(*more: str) -> str:
    return O.with_(*O.base_ctes(), *O.feat_ctes(), *O.labels_cte(), _LABELLED, *more, recursive=True)


@register("train_d3_coefficients", _labelled_sql(*logistic_ctes("p_", "labelled", S.ALL_FEATURES, "d3_purchase"), *logistic_ctes("c_", "labelled", S.ALL_FEATURES, "d3_churn")) + " UNION ALL ".join(
    f"SELECT app_id, '{m}' AS model, n, unnest({_terms_sql(S.ALL_FEATURES)}) AS term, round(unnest(list_concat([intercept], weights)), 6) AS weight FROM {p}fit"
    for m, p in (("d3_purchase_model", "p_"), ("d3_churn_model", "c_"))))
def q_train(spark, sf_dir):
    """M8 per app: Newton steps on summed cross-products, exported as coefficients."""
    users = fixture(spark, sf_dir).user_table
    out = None
    for model, label in D3_MODELS.items():
        rows = FI.coefficient_rows(FI.fit_logistic(users, label), S.ALL_FEATURES, "app_id", "n").withColumn("model", F.lit(model))
        out = rows if out is None else out.unionByName(rows)
    return out.select("app_id", "model", "n", "term", r6("weight"))


# ------------------------------------------------------------------ M10, M4

_HURDLE = [*logistic_ctes("q_", "labelled", S.ALL_FEATURES, "CASE WHEN ltv IS NOT NULL THEN (ltv > 0)::INTEGER END"),
           *linear_ctes("a_", "labelled", S.ALL_FEATURES, "CASE WHEN ltv > 0 THEN ln(1 + ltv) END")]


@register("train_hurdle", _labelled_sql(*_HURDLE) + f"""
SELECT app_id, 'payer' AS part, n, NULL::INTEGER AS rank, unnest({_terms_sql(S.ALL_FEATURES)}) AS term, round(unnest(list_concat([intercept], weights)), 6) AS weight FROM q_fit
UNION ALL SELECT f.app_id, 'amount', n, rank, unnest({_terms_sql(S.ALL_FEATURES)}), round(unnest(list_concat([intercept], weights)), 6) FROM a_fit f JOIN a_rank r ON f.app_id = r.app_id""")
def q_train_hurdle(spark, sf_dir):
    """M10 per app: both parts of the two-part model, with the rank of the payers' matrix."""
    fit = FI.fit_hurdle(fixture(spark, sf_dir).user_table)
    out = None
    for part in ("payer", "amount"):
        own = fit.where(F.col(part).isNotNull()).select("app_id", f"{part}.*").withColumn("rank", F.col("rank") if part == "amount" else F.lit(None).cast("int"))
        rows = FI.coefficient_rows(own, S.ALL_FEATURES, "app_id", "n", "rank").withColumn("part", F.lit(part))
        out = rows if out is None else out.unionByName(rows)
    return out.select("app_id", "part", "n", "rank", "term", r6("weight"))


@register("hurdle_fit_scores", _labelled_sql(*_HURDLE) + f"""
SELECT f.app_id, f.airbridge_uuid, round(1 / (1 + exp(-(q.intercept + list_dot_product(q.weights, x)))) * (exp(greatest(a.intercept + list_dot_product(a.weights, x), 0)) - 1), 4) AS pltv_score
FROM (SELECT app_id, airbridge_uuid, [{', '.join(f'{c}::DOUBLE' for c in S.ALL_FEATURES)}] AS x FROM feat) f
JOIN q_fit q ON f.app_id = q.app_id JOIN a_fit a ON f.app_id = a.app_id""")
def q_hurdle_fit_scores(spark, sf_dir):
    """M10 -> M4: the fitted pair scores every user of its app."""
    fx = fixture(spark, sf_dir)
    fit = FI.fit_hurdle(fx.user_table).where(F.col("amount").isNotNull())
    bundles = materialize(fit.select("app_id", F.struct(F.col("payer").alias(P.PLTV_PURCHASE.name), F.col("amount").alias(P.PLTV_AMOUNT.name)).alias(BM.MODELS)), "hurdle-fit")
    scored = SC.hurdle_ltv(BM.with_models(fx.features, bundles), BM.app_model(P.PLTV_PURCHASE), BM.app_model(P.PLTV_AMOUNT))
    return scored.select("app_id", "airbridge_uuid", F.round("pltv_score", 4).alias("pltv_score"))


# ------------------------------------------------------------------ M9

# fixed values of the stand-in: a user's features are written anew every day, with these
# features raised by the version's number times the step
VERSIONS, VERSION_STEP_S = 4, 86400
VERSION_RISE = {"total_events": 1.0, "recency": 24.0, "product_viewed_count": 0.5}
SNAPSHOT_AGE_S = 7 * 86400
S_FEATURES = list(P.TRIGGER.weights)
S_CROSSED = ["product_addedtocart", "recency"]


def feature_versions(fx) -> DataFrame:
    """Stand-in for a feature table with history: (S.KEY, version, valid_from, features)."""
    inst = fx.installs.select("app_id", F.col("user_id").alias("airbridge_uuid"), "t0")
    v = fx.features.join(inst, S.KEY).withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(VERSIONS - 1))))
    valid = F.timestamp_micros(F.unix_micros("t0") + F.col("version").cast("bigint") * (VERSION_STEP_S * 1_000_000))
    return v.select(*S.KEY, F.col("version").cast("bigint").alias("version"), valid.alias("valid_from"),
                    *[(F.col(c) + F.col("version") * VERSION_RISE.get(c, 0.0)).alias(c) for c in S.ALL_FEATURES])


def _asof_rows(spark, sf_dir) -> DataFrame:
    from ..operators.evaluate import decision_outcomes
    dec = decision_outcomes(C._attributed(spark, sf_dir)).where(F.col("is_random")).withColumnRenamed("anchor_us", "decided_us")
    return AS.features_asof(dec, feature_versions(fixture(spark, sf_dir)), SNAPSHOT_AGE_S)


_ASOF_CTES = [
    f"""ver AS (SELECT f.* REPLACE ({', '.join(f'{c} + v * {O.d(x)} AS {c}' for c, x in VERSION_RISE.items())}), v AS version,
  make_timestamp(epoch_us(t0) + v * {VERSION_STEP_S * 1_000_000}) AS valid_from
  FROM feat f JOIN inst i ON f.app_id = i.app_id AND f.airbridge_uuid = i.user_id, range(0, {VERSIONS}) r(v))""",
    f"""pit AS (SELECT d.request_id, d.trigger_type, d.clicked, d.anchor_us, v.* EXCLUDE (row_no)
  FROM (SELECT *, make_timestamp(anchor_us) AS decided FROM dec WHERE is_random) d
  ASOF JOIN ver v ON d.app_id = v.app_id AND d.airbridge_uuid = v.airbridge_uuid AND d.decided >= v.valid_from
  WHERE d.anchor_us - epoch_us(v.valid_from) < {SNAPSHOT_AGE_S * 1_000_000})""",
]


@register("log_features_asof", C._requests_sql(*O.attribution_ctes(86400), *_ASOF_CTES) + f"""
SELECT app_id, airbridge_uuid, request_id, trigger_type, clicked, version, {C.sql_r6(S.ALL_FEATURES)} FROM pit""")
def q_log_features_asof(spark, sf_dir):
    """M9 input: one row per randomised decision with the features valid when it was taken."""
    return _asof_rows(spark, sf_dir).select(*S.KEY, "request_id", "trigger_type", "clicked", "version", *[r6(c) for c in S.ALL_FEATURES])


_S_TERMS = {f"trigger={t}": f"(trigger_type = '{t}')::INTEGER" for t in S.TREATMENT_TRIGGERS} | {
    f"{t}|{f}": f"(trigger_type = '{t}')::INTEGER * {f}" for t in S.TREATMENT_TRIGGERS for f in S_CROSSED}


@register("train_s_learner", C._requests_sql(*O.attribution_ctes(86400), *_ASOF_CTES, *logistic_ctes("s_", "pit", [*S_FEATURES, *_S_TERMS.values()], "clicked")) + f"""
SELECT app_id, n, unnest({_terms_sql([*S_FEATURES, *_S_TERMS])}) AS term, round(unnest(list_concat([intercept], weights)), 6) AS weight FROM s_fit""")
def q_train_s_learner(spark, sf_dir):
    """M9 per app: click model over features, triggers and crossed terms on the as-of rows."""
    rows = materialize(_asof_rows(spark, sf_dir).select(*S.KEY, "trigger_type", "clicked", *S_FEATURES,
                                                        *[c for c in S_CROSSED if c not in S_FEATURES]), "s-learner-rows")
    fit, names = FI.fit_s_learner(rows, features=S_FEATURES, interact_with=S_CROSSED)
    return FI.coefficient_rows(fit, names, "app_id", "n").select("app_id", "n", "term", r6("weight"))


# ------------------------------------------------------------------ M1, M8: trees

# fixed values: the default ensembles are complete trees given by these rules (t tree, i node
# in heap order, from 0)
TREE_COUNT, TREE_DEPTH = 12, 3
_INNER, _NODES = 2**TREE_DEPTH - 1, 2 ** (TREE_DEPTH + 1) - 1
TREE_RULES = {  # feature position, threshold, leaf value (times the app's scale), tree weight
    "d3_purchase_trees": ("(7 * t + 3 * i) % 25", "((5 * t + 3 * i) % 11) / 2e0", "((13 * t + 17 * i) % 23 - 11) / 20e0", "1e0 / (1 + t)"),
    "d3_churn_trees": ("(11 * t + 5 * i + 2) % 25", "((3 * t + 7 * i) % 13) / 3e0", "((19 * t + 11 * i) % 17 - 8) / 15e0", "25e-2"),
}


def _rule_sql(model: str) -> str:
    feature, threshold, value, weight = TREE_RULES[model]
    return (f"'{model}' AS model, CAST(t AS INT) AS tree, CAST(i AS INT) AS node, CAST(CASE WHEN i < {_INNER} THEN {feature} ELSE -1 END AS INT) AS feature, "
            f"CAST(CASE WHEN i < {_INNER} THEN {threshold} END AS DOUBLE) AS threshold, CAST(CASE WHEN i < {_INNER} THEN 2 * i + 1 ELSE -1 END AS INT) AS {{left}}, "
            f"CAST(CASE WHEN i < {_INNER} THEN 2 * i + 2 ELSE -1 END AS INT) AS {{right}}, CAST({value} AS DOUBLE) * scale AS value, CAST({weight} AS DOUBLE) AS weight, 'logistic' AS link")


def default_tree_nodes(apps: DataFrame) -> DataFrame:
    """Node rows of the default ensembles for every app (app_id)."""
    scale = F.lit(1.0)
    for app, x in P.APP_SCALE.items():
        scale = F.when(F.col("app_id") == app, F.lit(x)).otherwise(scale)
    grid = apps.select("app_id", scale.alias("scale"), F.explode(F.sequence(F.lit(0), F.lit(TREE_COUNT - 1))).alias("t")).select(
        "app_id", "scale", "t", F.explode(F.sequence(F.lit(0), F.lit(_NODES - 1))).alias("i"))
    out = None
    for model in TREE_RULES:
        rows = grid.selectExpr("app_id", *_split_exprs(_rule_sql(model).format(left="left", right="right")))
        out = rows if out is None else out.unionByName(rows)
    return out


def _split_exprs(sql: str) -> list[str]:
    """Top-level comma-separated expressions."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(sql[at:i].strip())
            at = i + 1
    return [*out, sql[at:].strip()]


def _trees_on_disk(spark, nodes: DataFrame) -> DataFrame:
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/onramp-tables/trees-{uuid.uuid4().hex[:12]}"
    TR.write_trees(nodes, root)
    return TR.read_trees(spark, root)


_TREE_NODES = " UNION ALL ".join(
    "SELECT app_id, " + _rule_sql(m).format(left="l", right="r")
    + f" FROM (SELECT DISTINCT app_id, {O.app_scale()} AS scale FROM inst) a, range(0, {TREE_COUNT}) rt(t), range(0, {_NODES}) ri(i)" for m in TREE_RULES)


@register("score_d3_trees", O.with_(*O.base_ctes(), *O.feat_ctes(), f"nodes AS ({_TREE_NODES})", f"""walk AS (
  SELECT f.app_id, f.airbridge_uuid, x, n.model, n.tree, n.node, n.feature, n.threshold, n.l, n.r, n.value, n.weight
  FROM (SELECT app_id, airbridge_uuid, [{', '.join(f'{c}::DOUBLE' for c in S.ALL_FEATURES)}] AS x FROM feat) f JOIN nodes n ON f.app_id = n.app_id AND n.node = 0
  UNION ALL
  SELECT w.app_id, w.airbridge_uuid, x, n.model, n.tree, n.node, n.feature, n.threshold, n.l, n.r, n.value, n.weight
  FROM walk w JOIN nodes n ON w.app_id = n.app_id AND w.model = n.model AND w.tree = n.tree
    AND n.node = CASE WHEN w.x[w.feature + 1] <= w.threshold THEN w.l ELSE w.r END WHERE w.l >= 0)""", recursive=True) + """
SELECT app_id, airbridge_uuid, round(max(CASE WHEN model = 'd3_purchase_trees' THEN p END), 6) AS d3_purchase_prob,
       round(max(CASE WHEN model = 'd3_churn_trees' THEN p END), 6) AS d3_churn_prob
FROM (SELECT app_id, airbridge_uuid, model, 1 / (1 + exp(-sum(weight * value))) AS p FROM walk WHERE l < 0 GROUP BY app_id, airbridge_uuid, model) GROUP BY app_id, airbridge_uuid""")
def q_score_d3_trees(spark, sf_dir):
    """M1 with tree models: node tables written per app, read back, descended by array functions."""
    fx = fixture(spark, sf_dir)
    nodes = _trees_on_disk(spark, default_tree_nodes(fx.installs.select("app_id").distinct()))
    scored = TR.score_trees(fx.features, nodes, {"d3_purchase_prob": "d3_purchase_trees", "d3_churn_prob": "d3_churn_trees"})
    return scored.select("app_id", "airbridge_uuid", r6("d3_purchase_prob"), r6("d3_churn_prob"))


GBT_TREES, GBT_DEPTH = 5, 3


@register("train_d3_trees")
def q_train_d3_trees(spark, sf_dir):
    """M8 with trees: one GBTClassifier per app on the mature purchase labels, its saved node
    table exported, written per app, read back and descended. Rows of apps whose labels hold
    one class only have no model (NULL). No SQL form: a test holds the scores against the
    estimator's own."""
    fx = fixture(spark, sf_dir)
    return _gbt_scores(spark, fx.user_table).select("app_id", "airbridge_uuid", r6("d3_purchase_prob"))


def _gbt_scores(spark, users: DataFrame) -> DataFrame:
    from ..operators.train import fit_gbt
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/onramp-tables/gbt-{uuid.uuid4().hex[:12]}"
    exported = None
    for app, saved in fit_gbt(users, "d3_purchase", base, GBT_TREES, GBT_DEPTH).items():
        own = TR.export_trees(spark, saved, app, "d3_purchase_gbt")
        exported = own if exported is None else exported.unionByName(own)
    if exported is None:
        return users.withColumn("d3_purchase_prob", F.lit(None).cast("double"))
    return TR.score_trees(users, _trees_on_disk(spark, exported), {"d3_purchase_prob": "d3_purchase_gbt"})
