"""Short-horizon labels per installed user from the same journey join as the features.

purchase: any order.completed in [t0, t0 + purchase_h)
churn:    no in-app event in [t0 + churn_from, t0 + churn_to)   (product: end of the
          first session .. 3 days; fixture: 24 h .. 48 h)
ltv:      revenue in [t0, t0 + ltv_h)
A label is NULL when the user is not mature for it (t0 + horizon > last event time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import US_PER_SECOND
from . import features as FT


def user_labels(events: DataFrame, purchase_h_s: float = 3 * 86400, churn_from_s: float = 300,
                churn_to_s: float = 3 * 86400, ltv_h_s: float = 30 * 86400,
                inst: DataFrame | None = None) -> DataFrame:
    inst = FT.installs(events) if inst is None else inst
    j = FT.attach_install(events, inst)
    us = US_PER_SECOND
    inapp = F.col("event_type").isNotNull() & (F.col("event_id") != F.col("install_event_id"))
    dt = F.col("dt_us")
    agg = (j.where(inapp & (dt >= 0)).groupBy(*FT.KEY).agg(
        F.count_if((F.col("event_type") == S.EV_ORDER_COMPLETED) & (dt < F.lit(int(purchase_h_s * us))))
         .alias("_np"),
        F.count_if((dt >= F.lit(int(churn_from_s * us))) & (dt < F.lit(int(churn_to_s * us)))).alias("_nc"),
        F.sum(F.when(dt < F.lit(int(ltv_h_s * us)), F.coalesce("revenue", F.lit(0.0)))).alias("_ltv"),
    ))
    # the data's end: one global max -> a single-row frame, broadcast (size is 1 row)
    last = events.agg(F.max(F.unix_micros("ts")).alias("_last_us"))
    t0 = F.unix_micros("t0")

    def mature(h):
        return t0 + F.lit(int(h * us)) <= F.col("_last_us")

    out = (inst.join(agg, FT.KEY, "left").crossJoin(F.broadcast(last))
           .select(
               "app_id", F.col("user_id").alias("airbridge_uuid"),
               F.when(mature(purchase_h_s), (F.coalesce("_np", F.lit(0)) > 0).cast("int")).alias("d3_purchase"),
               F.when(mature(churn_to_s), (F.coalesce("_nc", F.lit(0)) == 0).cast("int")).alias("d3_churn"),
               F.when(mature(ltv_h_s), F.coalesce("_ltv", F.lit(0.0))).alias("ltv"),
           ))
    return out
