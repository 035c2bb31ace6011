"""Replay of a table through a streaming query in arrival order: every slice of rows is
written to a folder of files and taken up by one ``availableNow`` run from the same
checkpoint, as a scheduled job does with what has arrived since. State and watermark live
on in the checkpoint between the runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/onramp-streams/{name}-{uuid.uuid4().hex[:12]}"


def slice_of(at: Column, low: int, high: int, slices: int) -> Column:
    """Equal stretches of time, from 0: the slice a time (microseconds) falls into."""
    return F.floor((at - F.lit(low)) * slices / F.lit(high - low + 1)).cast("int")


def bounds(rows: DataFrame, at: Column) -> tuple[int, int]:
    r = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    return (r.low, r.high) if r.low is not None else (0, 0)


def run_slices(rows: DataFrame, number: str, slices: int, folder: str, run: Callable[[DataFrame, int], None], last: DataFrame | None = None) -> None:
    """Write the slices of ``rows`` (column ``number``) one after the other and call
    ``run(stream of the folder, slice)`` after each; ``last`` is one more arrival."""
    spark, schema = rows.sparkSession, rows.drop(number).schema
    for i in range(slices + (last is not None)):
        (rows.where(F.col(number) == i).drop(number) if i < slices else last).write.mode("append").parquet(folder)
        run(spark.readStream.schema(schema).parquet(folder), i)


def files_per_batch(rows: DataFrame, batches: int) -> int:
    """So many files a micro-batch that a written table is taken up in ``batches`` of them at
    most. What a batch reads besides its rows is then read that often, however many files
    the table's writer (a file a task) has left."""
    return max(1, -(-len(rows.inputFiles()) // batches))


def run_now(query: DataFrame, checkpoint: str, out: str, mode: str = "append") -> dict | None:
    """One ``availableNow`` run into a parquet sink; returns the last progress."""
    q = query.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress
