"""Tree ensembles (M1 with any tree model, M8): a flat node table per app and model, and the
descent of it by array functions, so that one plan scores every app with its own trees and
no Python runs.

Node rows: app_id, model, tree, node, feature (position in the feature order, -1 for a
leaf), threshold, left, right (nodes of the same tree, -1 for a leaf), value, weight (of the
tree, on every node) and link (``logistic``: probability of the weighted sum; ``identity``:
the weighted sum itself). A row goes left where ``x <= threshold``; NaN goes right.

The nodes of a model become arrays of one row per app (a model's size, not the data's);
these few rows are counted before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.config import _app_from_path

NODE_SCHEMA = ("model string, tree int, node int, feature int, threshold double, left int, right int, "
               "value double, weight double, link string")
BROADCAST_NODES = 1_000_000   # about 60 bytes each; beyond, the join shuffles


def export_trees(spark: SparkSession, saved: str, app_id: str, model: str) -> DataFrame:
    """Node rows of a saved Spark ML tree ensemble (GBTClassifier, RandomForestClassifier or
    -Regressor, GBTRegressor): its own node table, read as data.

    The probability of gradient-boosted classes is the logistic of twice the weighted sum; a
    forest's is the mean of the leaves' shares of class 1."""
    kind = spark.read.text(f"{saved}/metadata").select(F.get_json_object("value", "$.class").alias("c")).first().c.rsplit(".", 1)[-1]
    nodes = spark.read.parquet(f"{saved}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{saved}/treesMetadata").toDF("treeID", "metadata", "w").select("treeID", "w")
    n_trees = weights.count()
    if kind == "GBTClassificationModel":
        value, weight, link = F.col("prediction"), F.col("w") * 2.0, "logistic"
    elif kind == "GBTRegressionModel":
        value, weight, link = F.col("prediction"), F.col("w"), "identity"
    elif kind == "RandomForestRegressionModel":
        value, weight, link = F.col("prediction"), F.lit(1.0 / n_trees), "identity"
    elif kind == "RandomForestClassificationModel":
        total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
        value, weight, link = F.coalesce(F.get("impurityStats", F.lit(1)) / total, F.lit(0.0)), F.lit(1.0 / n_trees), "identity"
    else:
        raise ValueError(f"not a tree ensemble: {kind}")
    if nodes.where((F.col("leftChild") >= 0) & (F.col("split.numCategories") >= 0)).limit(1).count():
        raise ValueError("categorical splits have no threshold form")
    return nodes.join(F.broadcast(weights), "treeID").select(  # a row a tree
        F.lit(app_id).alias("app_id"), F.lit(model).alias("model"), F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), value.alias("value"), weight.alias("weight"), F.lit(link).alias("link"))


def write_trees(nodes: DataFrame, root: str) -> None:
    """``<root>/app_id=<app>/*.json``, one line per node."""
    nodes.repartition("app_id").write.partitionBy("app_id").json(root)


def read_trees(spark: SparkSession, root: str) -> DataFrame:
    return (spark.read.schema(NODE_SCHEMA).json(f"{root.rstrip('/')}/*/*.json")
            .withColumn("_path", F.input_file_name()).withColumn("app_id", _app_from_path())
            .select("app_id", *[c.split()[0] for c in NODE_SCHEMA.split(", ")]))


def packed(nodes: DataFrame) -> DataFrame:
    """(app_id, model, trees): arrays over all nodes of the model in (tree, node) order; a child
    is a place in the arrays, from 0. ``roots`` are the places of the trees' first nodes,
    ``steps`` bounds their depth."""
    own = nodes.groupBy("app_id", "model", "tree").agg(
        F.count(F.lit(1)).alias("_n"), F.first("weight").alias("weight"), F.first("link").alias("link"),
        F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "left", "right", "value"))).alias("own"))
    trees = own.groupBy("app_id", "model").agg(F.array_sort(F.collect_list(F.struct("tree", "own", "weight"))).alias("t"), F.first("link").alias("link"))
    # places of the trees' roots: running sums of their sizes
    start = F.aggregate("t", F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")),
                        lambda a, x: F.struct(F.concat(a["at"], F.array(a["n"])).alias("at"), (a["n"] + F.size(x["own"])).alias("n")))["at"]
    x = trees.withColumn("roots", start)

    def every(value) -> Column:
        return F.flatten(F.transform("t", lambda t, i: F.transform(t["own"], lambda n: value(n, i))))

    def child(side: str):
        # nodes of a tree are numbered; a child's place is its position among them
        return lambda n, i: F.when(n[side] < 0, F.lit(-1)).otherwise(
            F.get("roots", i) + F.array_position(F.transform(F.get("t", i)["own"], lambda o: o["node"]), n[side]).cast("int") - 1)

    x = x.select("app_id", "model", "link", "roots", F.transform("t", lambda t: t["weight"]).alias("weights"),
                 every(lambda n, i: n["feature"]).alias("feature"), every(lambda n, i: n["threshold"]).alias("threshold"),
                 every(child("left")).alias("left"), every(child("right")).alias("right"), every(lambda n, i: n["value"]).alias("value"),
                 F.array_max(F.transform("t", lambda t: F.size(t["own"]))).alias("most"))
    # a path of a tree of n nodes, two children each, has (n - 1) / 2 steps at most
    return x.select("app_id", "model", F.struct("link", "roots", "weights", "feature", "threshold", "left", "right", "value",
                                                F.floor((F.col("most") - 1) / 2).cast("int").alias("steps")).alias("trees"))


def with_depth(model_rows: DataFrame) -> DataFrame:
    """``steps`` lowered to the real depth: places are pushed down level by level until only
    leaves are left."""
    t = F.col("trees")

    def below(level: Column) -> Column:
        return F.filter(F.flatten(F.transform(level, lambda p: F.array(F.get(t["left"], p), F.get(t["right"], p)))), lambda p: p >= 0)

    depth = F.aggregate(F.array_repeat(F.lit(0), t["steps"]), F.struct(t["roots"].alias("level"), F.lit(-1).alias("depth")),
                        lambda a, _: F.when(F.size(a["level"]) > 0, F.struct(below(a["level"]).alias("level"), (a["depth"] + 1).alias("depth"))).otherwise(a))
    last = F.when(F.size(depth["level"]) > 0, depth["depth"] + 1).otherwise(depth["depth"])
    return model_rows.withColumn("trees", t.withField("steps", F.greatest(last, F.lit(0))))


def tree_output(trees: Column, x: Column) -> Column:
    """The ensemble's output for the feature array ``x``; null without a model."""
    def leaf(root: Column) -> Column:
        return F.aggregate(F.array_repeat(F.lit(0), trees["steps"]), root, lambda at, _: F.when(F.get(trees["left"], at) < 0, at).when(
            F.get(x, F.get(trees["feature"], at)) <= F.get(trees["threshold"], at), F.get(trees["left"], at)).otherwise(F.get(trees["right"], at)))

    each = F.transform(trees["roots"], lambda root, i: F.get(trees["weights"], i) * F.get(trees["value"], leaf(root)))
    total = F.aggregate(each, F.lit(0.0), lambda a, v: a + v)
    return F.when(trees["link"] == "logistic", F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).otherwise(total)


def score_trees(df: DataFrame, nodes: DataFrame, models: dict[str, str], features=S.ALL_FEATURES) -> DataFrame:
    """Adds a column for every entry output name -> model name. Rows of apps without that model
    get NULL. ``nodes``: node rows of all apps and models."""
    small = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    arrays = with_depth(packed(nodes.where(F.col("model").isin(*models.values()))))
    per_app = arrays.groupBy("app_id").agg(*[F.first(F.when(F.col("model") == m, F.col("trees")), ignorenulls=True).alias(f"_trees_{m}") for m in models.values()])
    out = df.join(F.broadcast(per_app) if small else per_app, "app_id", "left")
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    out = out.withColumn("_x", x)
    out = out.withColumns({name: tree_output(F.col(f"_trees_{m}"), F.col("_x")) for name, m in models.items()})
    return out.drop("_x", *[f"_trees_{m}" for m in models.values()])
