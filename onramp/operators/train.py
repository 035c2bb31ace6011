"""Training: D3 classifiers (M8), S-learner for message response (M9), two-part LTV.

Spark ML estimators do the distributed fitting; the fitted linear models are exported
as coefficient models (``params.LinearModel`` / ``TriggerModel``) so scoring stays a
plain Column expression (M1/M2/M4). Train / test split is a hash of the user key, not
rand(): the same user always lands on the same side, across retries and reruns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..params import LinearModel, TriggerModel


def hash_split(df: DataFrame, test_fraction: float = 0.2, key=("app_id", "airbridge_uuid"),
               seed: str = "split") -> tuple[DataFrame, DataFrame]:
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key])), 1, 8),
               16, 10).cast("bigint") / F.lit(4294967296.0)
    tagged = df.withColumn("_u", h)
    return (tagged.where(F.col("_u") >= test_fraction).drop("_u"),
            tagged.where(F.col("_u") < test_fraction).drop("_u"))


@dataclass
class Fitted:
    model: LinearModel
    auc: float | None
    n_train: int | None = None


def _export(lr_model, names, name, link) -> LinearModel:
    coefs = lr_model.coefficients.toArray().tolist()
    return LinearModel(name=name, intercept=float(lr_model.intercept),
                       weights={n: float(w) for n, w in zip(names, coefs)}, link=link,
                       feature_names=tuple(S.ALL_FEATURES))


def train_d3(features: DataFrame, labels: DataFrame, target: str, name: str | None = None,
             reg: float = 0.01, max_iter: int = 50, test_fraction: float = 0.2) -> Fitted:
    """M8: logistic regression of a 0/1 label (d3_purchase / d3_churn) on the 25 features.
    Returns the exported coefficient model and the hold-out AUC."""
    data = (features.join(labels.select("app_id", "airbridge_uuid", target), S.KEY)
            .where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double")))
    train, test = hash_split(data, test_fraction)
    va = VectorAssembler(inputCols=list(S.ALL_FEATURES), outputCol="features", handleInvalid="error")
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=max_iter,
                            standardization=True)
    m = lr.fit(va.transform(train))
    pred = m.transform(va.transform(test))
    auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label").evaluate(pred)
    return Fitted(_export(m, S.ALL_FEATURES, name or f"{target}_model", "logistic"), float(auc))


def train_hurdle(features: DataFrame, labels: DataFrame, ltv: str = "ltv", reg: float = 0.01,
                 max_iter: int = 50) -> tuple[LinearModel, LinearModel]:
    """P(ltv > 0) by logistic regression, log1p(ltv) of payers by linear regression
    (the scorer applies expm1(max(., 0)))."""
    data = features.join(labels.select("app_id", "airbridge_uuid", ltv), S.KEY).where(F.col(ltv).isNotNull())
    va = VectorAssembler(inputCols=list(S.ALL_FEATURES), outputCol="features")
    x = va.transform(data.withColumn("payer", (F.col(ltv) > 0).cast("double"))
                         .withColumn("log_amount", F.log1p(F.col(ltv))))
    clf = LogisticRegression(featuresCol="features", labelCol="payer", regParam=reg, maxIter=max_iter).fit(x)
    reg_m = LinearRegression(featuresCol="features", labelCol="log_amount", regParam=reg,
                             maxIter=max_iter).fit(x.where(F.col("payer") > 0))
    return (_export(clf, S.ALL_FEATURES, "pltv_purchase_model", "logistic"),
            _export(reg_m, S.ALL_FEATURES, "pltv_amount_model", "identity"))


def train_s_learner(outcomes: DataFrame, base_features=S.ALL_FEATURES, interact_with=(),
                    triggers=S.TREATMENT_TRIGGERS, reg: float = 0.01, max_iter: int = 50) -> TriggerModel:
    """M9: one click model with the trigger as one-hot input (artifact order) and optional
    trigger x feature interaction terms (without them every user gets the same ranking).

    ``outcomes``: one row per randomised decision with the features valid at decision
    time, ``trigger_type`` and ``clicked``."""
    x = outcomes.where(F.col("is_random")) if "is_random" in outcomes.columns else outcomes
    names = list(base_features)
    for t in triggers:
        x = x.withColumn(f"_t_{t}", (F.col("trigger_type") == t).cast("double"))
        names.append(f"_t_{t}")
    for t in triggers:
        for f in interact_with:
            x = x.withColumn(f"_x_{t}_{f}", F.col(f"_t_{t}") * F.col(f))
            names.append(f"_x_{t}_{f}")
    va = VectorAssembler(inputCols=names, outputCol="features")
    m = LogisticRegression(featuresCol="features", labelCol="y", regParam=reg, maxIter=max_iter) \
        .fit(va.transform(x.withColumn("y", F.col("clicked").cast("double"))))
    w = dict(zip(names, m.coefficients.toArray().tolist()))
    return TriggerModel(
        name="cate_model", intercept=float(m.intercept),
        weights={f: w[f] for f in base_features},
        trigger_weights={t: w[f"_t_{t}"] for t in triggers},
        interactions={t: {f: w[f"_x_{t}_{f}"] for f in interact_with} for t in triggers},
        triggers=tuple(triggers))


def fit_gbt(data: DataFrame, target: str, base: str, trees: int = 20, depth: int = 5, seed: int = 1) -> dict[str, str]:
    """M8 with trees: one GBTClassifier per app on its labelled rows, saved under ``base``;
    returns {app_id: folder}. Apps with one class only are left out. Apps are fitted one after
    the other, each fit over all executors (models are per app, so their number is that of
    the service's customers, not of users)."""
    labelled = data.where(F.col(target).isNotNull())
    both = labelled.groupBy("app_id").agg(F.countDistinct(target).alias("classes")).where("classes = 2").select("app_id")
    va = VectorAssembler(inputCols=list(S.ALL_FEATURES), outputCol="features")
    out = {}
    for i, (app,) in enumerate(sorted(both.collect())):
        own = va.transform(labelled.where(F.col("app_id") == app)).select("features", F.col(target).cast("double").alias("label"))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(own)
        out[app] = f"{base}/{i}"
        model.write().overwrite().save(out[app])
    return out


def coefficient_table(spark, model: LinearModel) -> DataFrame:
    """A fitted model as rows (name, term, weight) — the exportable artifact form."""
    rows = [(model.name, "(intercept)", float(model.intercept))] + \
           [(model.name, f, float(w)) for f, w in model.weights.items()]
    return spark.createDataFrame(rows, "model string, term string, weight double")

