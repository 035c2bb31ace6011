"""Exact ranks and order statistics per group without a window over a whole group.

Rows are range-partitioned by (group, order): each partition holds one stretch of a
group's order, numbers its rows on its own, and the partitions' counts give the offset of
each stretch. A group holding a third of all rows is spread over as many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def ranked(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """Add ``_rank`` (1-based, in ``order`` within the group) and ``_n`` (rows of the group).

    ``order`` should end with a key, so that the ranks of equal scores are defined."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, F.col(group), *order).withColumn("_part", F.spark_partition_id())
    stretch = Window.partitionBy(group, "_part").orderBy(*order)
    # written: a second evaluation could draw other range bounds
    local = materialize(dealt.withColumn("_local", F.row_number().over(stretch)), "ranked")
    sizes = local.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_size"))
    # one row per stretch: groups + partitions rows at most
    ahead = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_g", "_p", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"),
                           F.sum("_size").over(Window.partitionBy("_g")).alias("_n"))
    joined = local.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_ahead") + F.col("_local")).alias("_rank"), "_n")


def ntile(rank: Column, n: Column, tiles: int) -> Column:
    """SQL's ntile from a 1-based rank and the group's size: the first n mod tiles tiles
    hold one row more."""
    small, more = F.floor(n / tiles), n % tiles
    edge = more * (small + 1)
    return F.when(rank <= edge, F.floor((rank - 1) / (small + 1)) + 1).otherwise(
        more + F.floor((rank - 1 - edge) / F.greatest(small, F.lit(1))) + 1).cast("int")


def quantiles(df: DataFrame, group: str, value: str, points: list[float]) -> DataFrame:
    """(group, _q): the values of ascending rank max(1, ceil(p n)) for each point, as an
    array in the order of ``points``. Only the wanted ranks leave the ranked table."""
    r = ranked(df.select(group, value), group, F.col(value))
    at = F.posexplode(F.array(*[F.lit(float(p)) for p in points])).alias("_i", "_p")
    wanted = r.groupBy(F.col(group).alias("_g")).agg(F.max("_n").alias("_gn")).select("_g", "_gn", at).select(
        "_g", "_i", F.greatest(F.lit(1), F.ceil(F.col("_p") * F.col("_gn"))).cast("long").alias("_want"))
    hit = r.join(wanted, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_rank") == F.col("_want")))
    # one entry per point and group: a bounded array
    return hit.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("_v")))).alias("_s")).select(
        group, F.transform("_s", lambda x: x["_v"]).alias("_q"))
