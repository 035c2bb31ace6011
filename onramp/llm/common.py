"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onramp.session import apply_conf, ensure_checkpoint_dir

# rows a Python worker holds at once (a batch of texts), not a limit on the data
ARROW_ROWS = "500"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; the shared folder comes from spark.checkpoint.dir."""
    apply_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    ensure_checkpoint_dir(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """``new=old`` columns of ``df``, found by exact name and position: other columns, also
    ones whose names differ only in case or repeat, cannot make the reference ambiguous
    (of repeated names the first is taken)."""
    raw = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return raw.select(*[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in wanted.items()])


def packed(df: DataFrame, **wanted: str) -> DataFrame:
    """Like ``pick``, plus one struct column ``row`` with every column of ``df`` under a
    positional name, so that added columns cannot clash. ``unpacked`` undoes it."""
    raw = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    row = F.struct(*[F.col(f"c{i}") for i in range(len(df.columns))]).alias("row")
    return raw.select(row, *[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in wanted.items()])


def unpacked(df: DataFrame, like: DataFrame, **replaced) -> DataFrame:
    """The columns of ``like`` from the struct ``row``; ``replaced`` gives new values by name
    (first column of that name)."""
    cols = []
    seen = set()
    for i, name in enumerate(like.columns):
        value = replaced[name] if name in replaced and name not in seen else F.col(f"row.c{i}")
        seen.add(name)
        cols.append(value.cast(like.schema[i].dataType).alias(name))
    return df.select(*cols)


def in_fold(doc_id, parts: int, part: int):
    """crc32 of the id as text, modulo ``parts``, equals ``part`` (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def raw_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column, row by row."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return [None if b is None else b.decode("utf-8", "replace") for b in raw_bytes(batch, name)]
