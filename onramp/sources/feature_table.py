"""S1 read_feature_table / S2 check_columns: the per-user feature table from CSV or parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schema as S
from ..functions.columns import to_number


def empty_feature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.FEATURE_SCHEMA)


def check_columns(df: DataFrame, required=S.ALL_FEATURES) -> None:
    """Error listing every missing feature column (contract order), before any job."""
    have = set(df.columns)
    missing = [c for c in required if c not in have]
    if missing:
        raise ValueError(f"feature table missing columns: {missing}")


def boolean_columns(df: DataFrame, cols=S.ALL_FEATURES) -> set[str]:
    """Text columns that hold ``True`` / ``False`` in every row: a service that infers column
    types reads those as booleans, that is 1 and 0. One pass, one row to the driver."""
    text = [f.name for f in df.schema.fields if f.name in set(cols) and f.dataType.simpleString() == "string"]
    if not text:
        return set()
    known = ("True", "TRUE", "true", "False", "FALSE", "false")
    r = df.agg(*[F.bool_and(F.coalesce(F.col(c).isin(*known), F.lit(False))).alias(c) for c in text]).first()
    return {c for c in text if r[c]}


def features_from_text(df: DataFrame, keep=("row_no",)) -> DataFrame:
    """Columns taken by name (extra and reordered columns allowed), features coerced."""
    check_columns(df)
    extra = [c for c in keep if c in df.columns]
    flags = boolean_columns(df)
    kinds = dict(df.dtypes)

    def number(c: str):
        return F.col(c).cast("boolean").cast("double") if c in flags or kinds[c] == "boolean" else to_number(c)

    return df.select(F.col("app_id").cast("string").alias("app_id"),
                     F.col("airbridge_uuid").cast("string").alias("airbridge_uuid"),
                     *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in S.ALL_FEATURES], *extra)


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``row_no``, the place of a row in the files: path, start of the split, then the
    running number inside the task's read (which follows the split). A struct that orders
    like the files, so that the last row of a key wins (W1)."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                  F.monotonically_increasing_id().alias("row"))
    return df.select("*", at.alias("row_no"))


def read_feature_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read the feature table; a missing path gives an empty table, not an error.

    CSV is read with every column as text (no positional schema: binding by position
    would silently turn bad text into NULL and misplace reordered columns), then columns
    are picked by name and coerced. Without a ``row_no`` column the place in the file is
    the order, so that the lookups' last row wins as in the file.
    """
    try:
        if fmt == "csv":
            raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
        else:
            raw = spark.read.format(fmt).load(path)
        if "row_no" not in raw.columns:
            raw = with_file_order(raw)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return empty_feature_table(spark)
        raise
    return features_from_text(raw)
