"""Point-in-time join of decisions with versioned feature snapshots (M9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S

US_PER_SECOND = 1_000_000


def features_asof(decisions: DataFrame, snapshots: DataFrame, max_age_s: float, features=S.ALL_FEATURES, decided: str = "decided_us") -> DataFrame:
    """``decisions`` (S.KEY, ``request_id``, ``decided`` in microseconds, ...) with ``version`` and
    the features of the snapshot (S.KEY, ``version``, ``valid_from``, features) that was valid at
    the decision: the latest one at or before it (of one instant the highest version), at
    most ``max_age_s`` old. Decisions without one are left out.

    Only (key, time, version) rows are sorted: a snapshot is listed in its time bucket of
    ``max_age_s`` and in the next, so a window sees one bucket of a user, not the whole history.
    The wide rows meet by an equi-join on (key, version). Users without decisions are
    dropped before the join by its semi-join with the versions found."""
    us = int(max_age_s * US_PER_SECOND)
    at = F.unix_micros("valid_from")
    asked = decisions.select(*S.KEY, F.col(decided).alias("us"), F.col("request_id").alias("id"), F.lit(True).alias("asks"),
                             F.lit(None).cast("struct<at:bigint,version:bigint>").alias("found"))
    bucket = F.floor(F.col("us") / F.lit(us)).cast("bigint")
    known = snapshots.select(*S.KEY, at.alias("us"), F.lit(None).cast(asked.schema["id"].dataType).alias("id"), F.lit(False).alias("asks"),
                             F.struct(at.alias("at"), F.col("version").cast("bigint").alias("version")).alias("found"))
    both = asked.withColumn("b", bucket).unionByName(known.withColumn("b", F.explode(F.array(bucket, bucket + 1))))
    before = Window.partitionBy(*S.KEY, "b").orderBy("us", "asks", "found.version", "id").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("found", F.last("found", ignorenulls=True).over(before)).where(F.col("asks") & (F.col("us") - F.col("found.at") < us))
    versions = hit.select(*S.KEY, F.col("id").alias("request_id"), F.col("found.version").alias("version"))
    wide = snapshots.select(*S.KEY, F.col("version").cast("bigint").alias("version"), *features)
    return decisions.join(versions, [*S.KEY, "request_id"]).join(wide, [*S.KEY, "version"])
