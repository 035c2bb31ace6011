"""S3 tier config, S4 factor parameters, S6 artifact inventory: readers for the per-app
model bundle files. Configs are small per-app JSON documents read by Spark, never by the
driver, and joined to scored rows on app_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

# fixed value: when a factor file has no feature list it describes the 15 ad-touch features
DEFAULT_FACTOR_FEATURES = list(S.UA_FEATURES)


def _app_from_path(col: str = "_path") -> F.Column:
    # .../<app_id>/<file>, or .../app_id=<app_id>/<file> as Spark's own writer lays it out
    return F.regexp_replace(F.element_at(F.split(F.col(col), "/"), -2), "^app_id=", "")


def read_tier_config(spark: SparkSession, root: str, file: str = "pltv_tier_config.json") -> DataFrame:
    """S3: one row per app from ``<root>/<app_id>/pltv_tier_config.json``.

    Apps without the file simply have no row (their pLTV stays NULL downstream), and a
    document that cannot be parsed to its end gives none either: it never fails the job and
    never counts in part."""
    raw = (spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(
        "tiers array<struct<name:string,threshold:double>>, tier_avg_ltv map<string,double>, "
        "score_percentiles array<double>, _corrupt string")
        .json(f"{root.rstrip('/')}/*/{file}")
        .withColumn("_path", F.input_file_name())
           # Spark refuses plans that read the corrupt-record column alone (a count)
           .where(F.col("_corrupt").isNull() & (F.coalesce(F.size("tiers"), F.lit(-1)) >= -1)))
    return raw.select(_app_from_path().alias("app_id"), "tiers",
                      F.coalesce("tier_avg_ltv", F.create_map().cast("map<string,double>")).alias("tier_avg_ltv"),
                      F.coalesce("score_percentiles", F.array().cast("array<double>")).alias("score_percentiles"))


def read_factor_params(spark: SparkSession, root: str, file: str = "fa_params.json") -> DataFrame:
    """Long table (app_id, pos, feature, mean, std, factor, loading).

    The feature list may be absent: the 15 ad-touch names are the default."""
    raw = (spark.read.option("multiLine", "true").schema(
        "mean array<double>, std array<double>, loading_matrix array<array<double>>, "
        "feature_names array<string>, factor_names array<string>")
        .json(f"{root.rstrip('/')}/*/{file}")
        .withColumn("_path", F.input_file_name()))
    feats = F.coalesce("feature_names", F.array(*[F.lit(f) for f in DEFAULT_FACTOR_FEATURES]))
    rows = raw.select(_app_from_path().alias("app_id"), "factor_names",
                      F.posexplode(F.arrays_zip(feats.alias("feature"), F.col("mean"), F.col("std"),
                                                F.col("loading_matrix").alias("loadings"))).alias("pos", "r"))
    per_factor = rows.select("app_id", "pos", F.col("r.feature").alias("feature"), F.col("r.mean").alias("mean"),
                             F.col("r.std").alias("std"), "factor_names",
                             F.posexplode("r.loadings").alias("fpos", "loading"))
    return per_factor.select(
        "app_id", "pos", "feature", "mean", "std",
        F.coalesce(F.get("factor_names", F.col("fpos")), F.concat(F.lit("factor_"), F.col("fpos").cast("string")))
         .alias("factor"),
        "fpos", "loading")


def artifact_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files per app directory with their size and modification time (``binaryFile``
    listing; file contents are never read). An empty file cannot be a model: not valid."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length", "modificationTime"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("app_id"), name.alias("file"),
                        F.col("length"), F.col("modificationTime").alias("modified"), (F.col("length") > 0).alias("valid"))


def inventory_listing(inventory: DataFrame) -> DataFrame:
    """S6 listing as the service reports it: files sorted by name, size in KB (1 decimal)."""
    return (inventory.select("app_id", "file", F.round(F.col("length") / F.lit(1024.0), 1).alias("size_kb"))
            .orderBy("app_id", "file"))
