"""Fits from sufficient statistics, one model per group.

A group (an app) is fitted from weighted cross-products of its standardised features. Every
task adds up those of its own rows in numpy (a few hundred numbers a group), Spark adds the
tasks' sums, and each group's small system is solved where its sums are. Rows are never
brought together, so a group with a third of all rows is spread like any other; nothing
comes to the driver.

Logistic fits take a fixed number of Newton steps with a ridge of ``RIDGE`` on the
standardised coefficients (the intercept included, so that a group with one class has a
solution); the linear fit needs one pass. Features that are constant in a group get weight 0.
Labels are 0 / 1 (logistic) or numbers; rows with a null label are left out; a null feature
counts as 0, like a coerced one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import materialize

STEPS = 6
RIDGE = 1.0
CONSTANT = 1e-9      # a deviation under this share of (|mean| + 1) is none
PIVOT = 1e-7         # a pivot under this share of the number of rows is a dependent column
BROADCAST_GROUPS = 10_000
OPEN_GROUPS = 500    # groups whose sums a task holds at once


def standardised(data: DataFrame, by: Sequence[str], features: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_g, z, y) with z = (1, standardised features), and one row per group with its
    key, means and deviations. Both are written once."""
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    rows = data.where(F.col(label).isNotNull()).select(*by, F.to_json(F.struct(*by)).alias("_g"), F.col(label).cast("double").alias("y"),
                                                       *[c.alias(f"x{i}") for i, c in enumerate(x)])
    k = range(len(x))
    groups = materialize(rows.groupBy("_g", *by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f"x{i}") for i in k]).alias("mean"), F.array(*[F.stddev_pop(f"x{i}") for i in k]).alias("std")), "fit-groups")
    scale = groups.select(F.col("_g").alias("g"), "mean", F.transform(F.arrays_zip("mean", "std"), lambda s: F.when(
        s["std"] > CONSTANT * (F.abs(s["mean"]) + 1), s["std"])).alias("std"))
    z = F.array(F.lit(1.0), *[F.coalesce((F.col(f"x{i}") - F.get("mean", F.lit(i))) / F.get("std", F.lit(i)), F.lit(0.0)) for i in k])
    joined = rows.join(_hinted(scale), F.col("_g") == F.col("g"))
    return materialize(joined.select("_g", z.alias("z"), "y"), "fit-rows"), groups


def _hinted(per_group: DataFrame) -> DataFrame:
    """Broadcast only a counted, small table."""
    return F.broadcast(per_group) if per_group.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else per_group


def cross_products(rows: DataFrame) -> DataFrame:
    """(_g, sums) from (_g, z, w, r): the upper triangle of the sum of w z z' by rows, then the sum of r z."""
    def run(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["_g", "part"])

        for b in batches:
            if not b.num_rows:
                continue
            z = b.column("z").flatten().to_numpy().reshape(b.num_rows, -1)
            w, r = b.column("w").to_numpy(), b.column("r").to_numpy()
            names = b.column("_g").dictionary_encode()
            place, upper = names.indices.to_numpy(), np.triu_indices(z.shape[1])
            for i, name in enumerate(names.dictionary.to_pylist()):
                own = place == i
                zz = (z[own] * w[own, None]).T @ z[own]
                part = np.concatenate((zz[upper], z[own].T @ r[own]))
                held[name] = held[name] + part if name in held else part
            if len(held) > OPEN_GROUPS:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = rows.select("_g", "z", "w", "r").mapInArrow(run, "_g string, part array<double>")
    added = parts.select("_g", F.posexplode("part").alias("i", "v")).groupBy("_g", "i").agg(F.sum("v").alias("v"))
    return added.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))


def swept_rank(a: np.ndarray, n: float) -> int:
    """Columns of a cross-product that do not depend on those before them."""
    a, rank = a.copy(), 0
    for k in range(len(a)):
        if a[k, k] > PIVOT * n:
            rank += 1
            a = a - np.outer(a[:, k], a[k]) / a[k, k]
    return rank


def solved(sums: DataFrame, k: int, ridge: float) -> DataFrame:
    """(_g, beta, rank) from (_g, sums, start): start + (A + ridge I)^-1 (b - ridge start)."""
    def run(batches):
        upper = np.triu_indices(k)
        for b in batches:
            betas, ranks = [], []
            for s, start in zip(b.column("sums").to_pylist(), b.column("start").to_pylist()):
                a = np.zeros((k, k))
                a[upper] = s[:len(upper[0])]
                a = a + a.T - np.diag(np.diag(a))
                start = np.array(start)
                betas.append((start + np.linalg.solve(a + ridge * np.eye(k), np.array(s[len(upper[0]):]) - ridge * start)).tolist())
                ranks.append(swept_rank(a, a[0, 0]))
            yield pa.RecordBatch.from_arrays([b.column("_g"), pa.array(betas, pa.list_(pa.float64())), pa.array(ranks, pa.int32())], names=["_g", "beta", "rank"])

    return sums.select("_g", "sums", "start").mapInArrow(run, "_g string, beta array<double>, rank int")


def _unscaled(groups: DataFrame, beta: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coefficients of the raw features: (by..., n, rank, intercept, weights)."""
    j = groups.join(beta, "_g")
    weights = F.transform(F.arrays_zip("mean", "std", F.expr("slice(beta, 2, size(beta) - 1)").alias("b")), lambda s: F.when(
        s["std"] > CONSTANT * (F.abs(s["mean"]) + 1), s["b"] / s["std"]).otherwise(F.lit(0.0)))
    j = j.withColumn("weights", weights)
    shift = F.aggregate(F.zip_with("weights", "mean", lambda w, m: w * m), F.lit(0.0), lambda a, v: a + v)
    return j.select(*by, "n", "rank", (F.get("beta", F.lit(0)) - shift).alias("intercept"), "weights")


def fit_logistic(data: DataFrame, label: str, features: Sequence[str] = S.ALL_FEATURES, by: Sequence[str] = ("app_id",), steps: int = STEPS,
                 ridge: float = RIDGE) -> DataFrame:
    """M8: (by..., n, rank, intercept, weights in the order of ``features``) per group."""
    rows, groups = standardised(data, by, features, label)
    k = len(features) + 1
    beta = groups.select("_g", F.array_repeat(F.lit(0.0), k).alias("beta"))
    for _ in range(steps):
        known = rows.join(_hinted(beta.select(F.col("_g").alias("g"), "beta")), F.col("_g") == F.col("g"))
        eta = F.aggregate(F.zip_with("z", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        p = known.select("_g", "z", "y", (F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))).alias("p"))
        sums = cross_products(p.select("_g", "z", (F.col("p") * (1 - F.col("p"))).alias("w"), (F.col("y") - F.col("p")).alias("r")))
        beta = materialize(solved(sums.join(beta.withColumnRenamed("beta", "start"), "_g"), k, ridge), "fit-step")
    return _unscaled(groups, beta, by)


def fit_linear(data: DataFrame, label: str, features: Sequence[str] = S.ALL_FEATURES, by: Sequence[str] = ("app_id",), ridge: float = RIDGE) -> DataFrame:
    """Least squares with a ridge, one pass of normal equations. ``rank`` counts the
    columns (intercept first) that do not depend on earlier ones: where it is below their
    number, only the ridge decides between equally good solutions."""
    rows, groups = standardised(data, by, features, label)
    k = len(features) + 1
    sums = cross_products(rows.select("_g", "z", F.lit(1.0).alias("w"), F.col("y").alias("r")))
    beta = solved(sums.withColumn("start", F.array_repeat(F.lit(0.0), k)), k, ridge)
    return _unscaled(groups, beta, by)


def fit_hurdle(data: DataFrame, ltv: str = "ltv", features: Sequence[str] = S.ALL_FEATURES, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """P(ltv > 0) by Newton steps over all rows, log1p(ltv) by normal equations over
    payers. One row per group with the parts ``payer`` and ``amount`` (null without payers)."""
    known = data.where(F.col(ltv).isNotNull())
    payer = fit_logistic(known.withColumn("_payer", (F.col(ltv) > 0).cast("double")), "_payer", features, by)
    amount = fit_linear(known.where(F.col(ltv) > 0).withColumn("_log", F.log1p(F.col(ltv))), "_log", features, by)

    def part(d: DataFrame, name: str) -> DataFrame:
        return d.select(*by, F.struct("n", "rank", "intercept", "weights").alias(name))

    return part(payer, "payer").join(part(amount, "amount"), list(by), "left")


def fit_s_learner(decisions: DataFrame, label: str = "clicked", features: Sequence[str] = S.ALL_FEATURES, interact_with: Sequence[str] = (),
                  triggers: Sequence[str] = S.TREATMENT_TRIGGERS, by: Sequence[str] = ("app_id",)) -> tuple[DataFrame, list[str]]:
    """M9: one click model per group over features, triggers and trigger x feature terms, from
    one row per randomised decision (``trigger_type``, features as of the decision). Returns
    the fit and its term names."""
    is_t = {t: (F.col("trigger_type") == t).cast("double") for t in triggers}
    terms = {f"trigger={t}": c for t, c in is_t.items()} | {f"{t}|{f}": c * F.coalesce(F.col(f), F.lit(0.0)) for t, c in is_t.items() for f in interact_with}
    names = [*features, *terms]
    d = decisions.select(*by, label, *features, *[c.alias(f"_term{i}") for i, c in enumerate(terms.values())])
    return fit_logistic(d, label, [*features, *[f"_term{i}" for i in range(len(terms))]], by), names


def coefficient_rows(fit: DataFrame, names: Sequence[str], *keys: str) -> DataFrame:
    """(keys..., term, weight): the exportable form of a fit."""
    all_names = F.array(F.lit("(intercept)"), *[F.lit(n) for n in names])
    pairs = F.arrays_zip(all_names.alias("term"), F.concat(F.array("intercept"), F.col("weights")).alias("weight"))
    return fit.select(*keys, F.explode(pairs).alias("_c")).select(*keys, "_c.term", "_c.weight")
