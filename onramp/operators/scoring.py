"""Model scoring as Column expressions: D3 probabilities (M1), trigger scores (M2),
two-part LTV (M4), factor scores (M7), and the model checks (P3, P4, P6).

A coefficient model compiles to ``1 / (1 + exp(-(b + w1*x1 + ...)))`` — no UDF, no
shuffle, evaluated inside whole-stage codegen next to the scan that feeds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import dlit, linear_sql, logistic
from ..params import LinearModel, TriggerModel
from ..sources.feature_table import check_columns


def check_feature_order(model_features, expected=S.ALL_FEATURES, model_name: str = "model") -> None:
    """A model must expect exactly the contract order; mismatch is a hard error."""
    if list(model_features) != list(expected):
        raise ValueError(f"Feature mismatch in {model_name}: model expects {list(model_features)}, "
                         f"table has {list(expected)}")


def feature_vector(df: DataFrame, out: str = "features") -> DataFrame:
    """The 25 features as one array column in contract order."""
    check_columns(df)
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in S.ALL_FEATURES]))


def select_by_name(df: DataFrame, names, default: float = 0.0) -> list[Column]:
    """Columns by name; names the table lacks become a constant default."""
    have = set(df.columns)
    return [(F.col(n) if n in have else F.lit(float(default))).alias(n) for n in names]


def model_output(model: LinearModel) -> Column:
    z = linear_sql(model.weights, model.intercept)
    return logistic(z) if model.link == "logistic" else F.expr(z)


def score_binary(df: DataFrame, purchase: LinearModel, churn: LinearModel,
                 keep_raw: bool = False) -> DataFrame:
    """M1: d3_purchase_prob / d3_churn_prob, rounded to 4 places (unrounded kept on request)."""
    check_feature_order(purchase.feature_names, model_name=purchase.name)
    check_feature_order(churn.feature_names, model_name=churn.name)
    p, c = model_output(purchase), model_output(churn)
    cols = {"d3_purchase_prob": F.round(p, 4), "d3_churn_prob": F.round(c, 4)}
    if keep_raw:
        cols.update({"d3_purchase_raw": p, "d3_churn_raw": c})
    # one projection (one analysis); repeated sub-expressions are evaluated once per row
    return df.withColumns(cols)


def trigger_score_columns(model: TriggerModel, present: set[str] | None = None) -> dict[str, Column]:
    """M2: one P(click) per trigger in artifact order. The shared linear part is written
    once per trigger expression; Catalyst's common-subexpression elimination evaluates it
    once per row."""
    out = {}
    for t in model.triggers:
        z = linear_sql(model.weights, model.intercept, present)[1:-1]
        z = f"{z} + {dlit(model.trigger_weights.get(t, 0.0))}"
        for f, w in model.interactions.get(t, {}).items():
            if present is None or f in present:
                z = f"{z} + {dlit(w)} * `{f}`"
        out[t] = F.round(logistic(f"({z})"), 4)
    return out


def score_triggers(df: DataFrame, model: TriggerModel | None, enabled: Column | None = None) -> DataFrame:
    """M2: adds ``score_<trigger>`` columns and the ``trigger_scores`` map.

    ``enabled`` (boolean column, e.g. the app has a trigger model) turns scores off per
    row: NULL score columns and an empty map, as in exploration mode.
    """
    if model is None:
        cols = {t: F.lit(None).cast("double") for t in S.TREATMENT_TRIGGERS}
        trig = list(S.TREATMENT_TRIGGERS)
    else:
        cols = trigger_score_columns(model, set(df.columns))
        trig = list(model.triggers)
        if enabled is not None:
            cols = {t: F.when(enabled, c) for t, c in cols.items()}
    has = F.lit(model is not None) if enabled is None or model is None else enabled
    out = df.withColumns({f"score_{t}": cols[t] for t in trig})
    scores_map = F.when(has, F.map_from_arrays(F.array(*[F.lit(t) for t in trig]),
                                                F.array(*[F.col(f"score_{t}") for t in trig]))) \
                  .otherwise(F.create_map().cast("map<string,double>"))
    return out.withColumn("trigger_scores", scores_map)


def hurdle_ltv(df: DataFrame, p_model: LinearModel, amount_model: LinearModel,
               enabled: Column | None = None) -> DataFrame:
    """M4: pltv_score = P(buy in 30 d) * expm1(max(predicted log amount, 0)).

    NULL where ``enabled`` is false (any pLTV artifact missing)."""
    p30 = model_output(p_model)
    amount = F.expm1(F.greatest(model_output(amount_model), F.lit(0.0)))
    score = p30 * amount
    if enabled is not None:
        score = F.when(enabled, score)
    return df.withColumn("pltv_score", score)


def factor_scores(df: DataFrame, params: dict, std_floor: float = 0.0) -> DataFrame:
    """M7: z = (x - mean) / std, factor_j = sum_i z_i * L[i][j]; std 0 -> z 0.

    ``params``: {feature_names, mean, std, loading_matrix, factor_names}. k column
    expressions, each a sum over the listed features; no shuffle.
    """
    feats = params.get("feature_names") or S.UA_FEATURES
    mean, std, L = params["mean"], params["std"], params["loading_matrix"]
    names = params.get("factor_names") or [f"factor_{j}" for j in range(len(L[0]))]
    z = {}
    for i, f in enumerate(feats):
        s = float(std[i])
        z[f] = F.lit(0.0) if abs(s) <= std_floor else (F.col(f) - F.lit(float(mean[i]))) / F.lit(s)
    out = df
    for j, name in enumerate(names):
        acc = F.lit(0.0)
        for i, f in enumerate(feats):
            acc = acc + z[f] * F.lit(float(L[i][j]))
        out = out.withColumn(name, acc)
    return out


def factor_scores_long(df: DataFrame, params_long: DataFrame, features=None) -> DataFrame:
    """M7 for per-app parameter tables (``sources.config.read_factor_params``: app_id, pos,
    feature, mean, std, factor, fpos, loading), any number of factors per app.

    Unpivot the features to (user, feature, x), equi-join the app's parameters on
    (app_id, feature) — a small table, broadcast by AQE when it is — and sum
    z * loading per (user, factor). Output: app_id, airbridge_uuid, fpos, factor, score.
    """
    feats = list(features or S.UA_FEATURES)
    long = df.select("app_id", "airbridge_uuid",
                     F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
                                         for f in feats])).alias("_v")) \
             .select("app_id", "airbridge_uuid", "_v.feature", "_v.x")
    z = F.when(F.coalesce(F.col("std"), F.lit(0.0)) != 0, (F.col("x") - F.col("mean")) / F.col("std")) \
         .otherwise(F.lit(0.0))
    return (long.join(params_long, ["app_id", "feature"])
            .groupBy("app_id", "airbridge_uuid", "fpos", "factor")
            .agg(F.sum(z * F.col("loading")).alias("score")))
