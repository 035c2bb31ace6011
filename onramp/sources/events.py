"""S5 read_events: normalise raw event rows to the journey schema.

The journey schema carries both views of an event: an ad-touch view (``touch_type``
click / impression, ``channel``, ``channel_class``) used before install, and an
in-app view (``event_type`` with the product's event names, ``revenue``) used after
install. ``is_install`` marks rows that may be the first open. Operators downstream
decide which view applies by comparing ``ts`` with the user's install time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .tables import load_table

# ---------------------------------------------------------------------------
# fixed values: mapping of the driver's event table onto the journey schema
# ---------------------------------------------------------------------------
APP_BUCKETS = 3                 # app_id = 'app_' || user_id % 3
CHANNELS = 5                    # channel = 'ch_' || k % 5
DA_CHANNELS = (0, 1)            # k % 5 in (0, 1) -> DA
SA_CHANNELS = (2, 3)            # k % 5 in (2, 3) -> SA, 4 -> other
INSTALL_KIND = "signup"
TOUCH_OF_KIND = {"click": "click", "view": "impression"}
INAPP_OF_KIND = {
    "view": S.EV_PRODUCT_VIEWED,
    "click": S.EV_ADDED_TO_CART,
    "signup": S.EV_USER_SIGNIN,
    "error": S.EV_HOME_VIEWED,
    "purchase": S.EV_ORDER_COMPLETED,
}
REVENUE_KIND = "purchase"
# ---------------------------------------------------------------------------


def _case(col: Column, mapping: dict) -> Column:
    out = None
    for src, dst in mapping.items():
        out = F.when(col == src, F.lit(dst)) if out is None else out.when(col == src, F.lit(dst))
    return out


def normalize_events(raw: DataFrame) -> DataFrame:
    """Driver ``events`` (event_id, ts NTZ, user_id, event_type, value, props) -> journey rows."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").try_cast("int")
    ch = F.pmod(k, F.lit(CHANNELS))
    return raw.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.concat(F.lit("app_"), F.pmod(F.col("user_id"), F.lit(APP_BUCKETS)).cast("string")).alias("app_id"),
        F.col("user_id").cast("string").alias("user_id"),
        # stored without zone; the session zone is UTC, so this keeps the wall-clock value
        F.col("ts").cast("timestamp").alias("ts"),
        _case(kind, INAPP_OF_KIND).alias("event_type"),
        _case(kind, TOUCH_OF_KIND).alias("touch_type"),
        F.concat(F.lit("ch_"), ch.cast("string")).alias("channel"),
        F.when(ch.isin(*DA_CHANNELS), "DA").when(ch.isin(*SA_CHANNELS), "SA")
         .when(ch.isNotNull(), "other").alias("channel_class"),
        F.when(kind == REVENUE_KIND, F.col("value")).alias("revenue"),
        (kind == INSTALL_KIND).alias("is_install"),
        k.alias("k"),
        # the source's own event kind: filters on it reach the parquet scan (PushedFilters)
        kind.alias("source_type"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan the driver events table and normalise it (lazy; pruning reaches parquet)."""
    return normalize_events(load_table(spark, sf_dir, "events"))
