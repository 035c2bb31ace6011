"""Names, orders and types that are part of the scoring contract.

Everything under "fixed values" must stay exactly as written: model inputs are
matched by position, responses by field name, and the message arms by list order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# fixed values (contract with the scoring service; order matters)
# ---------------------------------------------------------------------------
UA_FEATURES = [
    "trackinglink_count", "DA_count", "SA_count", "unique_channel_count",
    "channel_entropy", "last_touch_is_da", "latency", "recency",
    "recent_touch_pressure", "touch_per_latency_hour", "last1h_touch_count",
    "recent_24h_ratio", "click_ratio", "impression_count", "is_single_touch_install",
]
INAPP_FEATURES = [
    "product_viewed_count", "user_signin", "product_addedtocart",
    "deeplink_open", "home_viewed", "addtowishlist", "onboarding",
    "user_signup", "total_events", "n_event_types",
]
TREATMENT_TRIGGERS = ["price_appeal", "social_proof", "scarcity", "novelty"]
CONTROL_TRIGGER = "control"
MODEL_FILES = [
    "fa_params.json",
    "d3_purchase_model.pkl",
    "d3_churn_model.pkl",
    "cate_model.pkl",
    "pltv_purchase_model.pkl",
    "pltv_amount_model.pkl",
    "pltv_tier_config.json",
]
REQUIRED_MODEL_FILES = ["d3_purchase_model.pkl", "d3_churn_model.pkl"]
TRIGGER_MODEL_FILE = "cate_model.pkl"
PLTV_MODEL_FILES = ["pltv_purchase_model.pkl", "pltv_amount_model.pkl", "pltv_tier_config.json"]
DECISION_TTL_SECONDS = 3600
EXPLORATION_SHARE = 0.2
TIER_NAMES = ["high", "medium", "low"]
DEFAULT_TIER = "low"
# In-app event names of the product.
EV_PRODUCT_VIEWED = "product.viewed"
EV_USER_SIGNIN = "user.signin"
EV_ADDED_TO_CART = "product.addedtocart"
EV_ORDER_COMPLETED = "order.completed"
EV_HOME_VIEWED = "home.viewed"
EV_DEEPLINK_OPEN = "deeplink.open"
EV_ADD_TO_WISHLIST = "product.addedtowishlist"
EV_ONBOARDING = "onboarding"
EV_USER_SIGNUP = "user.signup"
EV_MODAL_SHOWN = "entry_modal_shown"
EV_MODAL_CLICKED = "entry_modal_clicked"
# ---------------------------------------------------------------------------

ALL_FEATURES = UA_FEATURES + INAPP_FEATURES
KEY = ["app_id", "airbridge_uuid"]

# In-app feature -> event name it counts (None: derived, not a single event count).
INAPP_EVENT_OF = {
    "product_viewed_count": EV_PRODUCT_VIEWED,
    "user_signin": EV_USER_SIGNIN,
    "product_addedtocart": EV_ADDED_TO_CART,
    "deeplink_open": EV_DEEPLINK_OPEN,
    "home_viewed": EV_HOME_VIEWED,
    "addtowishlist": EV_ADD_TO_WISHLIST,
    "onboarding": EV_ONBOARDING,
    "user_signup": EV_USER_SIGNUP,
}

FEATURE_SCHEMA = T.StructType(
    [T.StructField("app_id", T.StringType()), T.StructField("airbridge_uuid", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ALL_FEATURES]
)

# Journey rows (output of sources.events.normalize_events): one event, both views.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("app_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event_type", T.StringType()),      # in-app name (after install)
    T.StructField("touch_type", T.StringType()),      # click / impression (before install)
    T.StructField("channel", T.StringType()),
    T.StructField("channel_class", T.StringType()),   # DA / SA / other
    T.StructField("revenue", T.DoubleType()),
    T.StructField("is_install", T.BooleanType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("source_type", T.StringType()),
])

PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("app_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("best_trigger", T.StringType()),
    T.StructField("is_random", T.BooleanType()),
    T.StructField("trigger_scores", T.StringType()),
    T.StructField("d3_purchase_prob", T.DoubleType()),
    T.StructField("d3_churn_prob", T.DoubleType()),
    T.StructField("pltv_tier", T.StringType()),
    T.StructField("pltv_percentile", T.IntegerType()),
])

TIER_CONFIG_SCHEMA = T.StructType([
    T.StructField("app_id", T.StringType()),
    T.StructField("tiers", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("threshold", T.DoubleType())]))),
    T.StructField("tier_avg_ltv", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("score_percentiles", T.ArrayType(T.DoubleType())),
])
