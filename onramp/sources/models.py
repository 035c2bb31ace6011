"""Per-app model bundles (M1, M2, M4): one JSON document per app with the coefficients of its
five models, read by Spark into one row per app and joined to the scored rows, so that one
plan scores every app with its own weights.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from .. import schema as S
from ..params import LinearModel, TriggerModel
from .config import _app_from_path

MODELS = "_m"                  # the joined struct column
BROADCAST_APPS = 10_000        # bundles of about 2 KB; beyond, the join shuffles
LINEAR = (P.D3_PURCHASE, P.D3_CHURN, P.PLTV_PURCHASE, P.PLTV_AMOUNT)
_SCHEMA = ", ".join(f"{m.name} struct<intercept:double, weights:map<string,double>>" for m in LINEAR) + (
    f", {P.TRIGGER.name} struct<intercept:double, weights:map<string,double>, trigger_weights:map<string,double>, "
    "interactions:map<string,double>>")


def bundle_documents(apps: DataFrame, scale: Column) -> DataFrame:
    """One document per app of ``apps`` (app_id): the default models, weights times ``scale``."""
    def scaled(named: dict) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(k) for k in named]),
                                 F.transform(F.array(*[F.lit(float(v)) for v in named.values()]), lambda w: w * F.col("_scale")))

    def doc(m) -> list[Column]:
        return [(F.lit(float(m.intercept)) * F.col("_scale")).alias("intercept"), scaled(m.weights).alias("weights")]

    t = P.TRIGGER
    crossed = {f"{trig}|{f}": w for trig, own in t.interactions.items() for f, w in own.items()}
    return apps.select("app_id", scale.alias("_scale")).select(
        "app_id", *[F.struct(*doc(m)).alias(m.name) for m in LINEAR],
        F.struct(*doc(t), scaled(t.trigger_weights).alias("trigger_weights"), scaled(crossed).alias("interactions")).alias(t.name))


def write_model_bundles(documents: DataFrame, root: str) -> None:
    """``<root>/app_id=<app>/*.json``"""
    documents.repartition("app_id").write.partitionBy("app_id").json(root)


def read_model_bundles(spark: SparkSession, root: str) -> DataFrame:
    """(app_id, _m): each model's weights as an array in contract order (a feature the
    document does not list weighs 0). Apps without a document have no row."""
    raw = spark.read.schema(_SCHEMA).json(f"{root.rstrip('/')}/*/*.json").withColumn("_path", F.input_file_name())
    names = F.array(*[F.lit(f) for f in S.ALL_FEATURES])

    def model(name: str) -> list[Column]:
        return [F.col(f"{name}.intercept").alias("intercept"),
                F.transform(names, lambda f: F.coalesce(F.try_element_at(F.col(f"{name}.weights"), f), F.lit(0.0))).alias("weights")]

    t = P.TRIGGER.name
    return raw.select(_app_from_path().alias("app_id"), F.struct(
        *[F.struct(*model(m.name)).alias(m.name) for m in LINEAR],
        F.struct(*model(t), F.col(f"{t}.trigger_weights").alias("trigger_weights"), F.col(f"{t}.interactions").alias("interactions")).alias(t),
    ).alias(MODELS))


def with_models(df: DataFrame, bundles: DataFrame) -> DataFrame:
    """Rows of apps with a bundle, with its struct. Broadcast only a counted, small table."""
    small = bundles.limit(BROADCAST_APPS + 1).count() <= BROADCAST_APPS
    return df.join(F.broadcast(bundles) if small else bundles, "app_id")


def app_model(model: LinearModel) -> LinearModel:
    """``model`` with the joined row's coefficients in place of numbers."""
    at = f"{MODELS}.{model.name}"
    return replace(model, intercept=f"{at}.intercept", weights={f: f"{at}.weights[{i}]" for i, f in enumerate(S.ALL_FEATURES)})


def app_trigger_model(model: TriggerModel = P.TRIGGER) -> TriggerModel:
    at = f"{MODELS}.{model.name}"
    return replace(model, intercept=f"{at}.intercept", weights={f: f"{at}.weights[{i}]" for i, f in enumerate(S.ALL_FEATURES)},
                   trigger_weights={t: f"coalesce(try_element_at({at}.trigger_weights, '{t}'), 0.0D)" for t in model.triggers},
                   interactions={t: {f: f"coalesce(try_element_at({at}.interactions, '{t}|{f}'), 0.0D)" for f in own}
                                 for t, own in model.interactions.items()})
