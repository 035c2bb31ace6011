"""Session helpers: one place for the settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_WRITTEN: list[str] = []  # tables of this process, for drop_tables

# Settings the operators assume. UTC is required: event times are stored without a
# zone and every time difference / day bucket is taken in UTC.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot user may hold a large share of all events. Let AQE split the skewed join
    # partition even when that costs one extra (small, pre-aggregated) exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "onramp") -> SparkSession:
    """Build (or reuse) a session with the settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of BASE_CONF to an existing session."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.ui."):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave as the cluster set it
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only when the setting is absent (local tests) do we pick our own folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local[") and sc.master != "local":
        # executors of a cluster do not see the driver's disk
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="onramp-ckpt-", dir=os.environ.get("ONRAMP_SCRATCH", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def materialize(df, name: str = "table"):
    """Cut lineage: write ``df`` once as a parquet table in the shared checkpoint folder
    (spark.checkpoint.dir) and return a DataFrame reading it back.

    Used where one derived table feeds several branches of a plan, so the raw tables are
    scanned once. A written table (rather than RDD checkpoint, which computes the plan a
    second time for the checkpoint write) costs one execution, survives executor loss,
    and keeps parquet column pruning and filter pushdown for every reader. ``drop_tables`` removes the
    tables of this process.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/onramp-tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def small_side(df, most: int = 10_000):
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is. It is
    counted, so it should be cheap to read (a written table)."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def drop_tables() -> None:
    """Remove the tables ``materialize`` has written (results must have been used)."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
