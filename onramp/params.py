"""Default model parameters (our own numbers; the service's trained weights are not public).

A logistic / linear model is a coefficient table: intercept plus one weight per feature.
Scoring with it is a plain Column expression, so one plan scores every app inside
whole-stage codegen, and the same arithmetic is expressible in SQL. Trained models
(``operators.train``) export the same shape.

Weights are kept small so that probabilities are not saturated on the fixture data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from . import schema as S


@dataclass(frozen=True)
class LinearModel:
    """z = intercept + sum(weights[f] * x[f]); ``link`` 'logistic' gives P(class 1)."""
    name: str
    intercept: float
    weights: dict
    link: str = "logistic"
    feature_names: tuple = tuple(S.ALL_FEATURES)


@dataclass(frozen=True)
class TriggerModel:
    """S-learner: base features by name plus one-hot trigger in artifact order, with
    optional trigger x feature interaction weights."""
    name: str
    intercept: float
    weights: dict
    trigger_weights: dict
    interactions: dict = field(default_factory=dict)  # trigger -> {feature: weight}
    triggers: tuple = tuple(S.TREATMENT_TRIGGERS)


D3_PURCHASE = LinearModel(
    name="d3_purchase_model",
    intercept=-0.35,
    weights={
        "trackinglink_count": 0.020, "DA_count": 0.015, "SA_count": 0.025,
        "unique_channel_count": 0.040, "channel_entropy": 0.060, "last_touch_is_da": -0.050,
        "latency": -0.0015, "recency": -0.0030, "recent_touch_pressure": 0.030,
        "touch_per_latency_hour": 0.020, "last1h_touch_count": 0.035, "recent_24h_ratio": 0.150,
        "click_ratio": 0.200, "impression_count": 0.004, "is_single_touch_install": -0.080,
        "product_viewed_count": 0.090, "user_signin": 0.050, "product_addedtocart": 0.120,
        "deeplink_open": 0.060, "home_viewed": 0.020, "addtowishlist": 0.070,
        "onboarding": 0.030, "user_signup": 0.040, "total_events": 0.010, "n_event_types": 0.050,
    },
)

D3_CHURN = LinearModel(
    name="d3_churn_model",
    intercept=0.10,
    weights={
        "trackinglink_count": -0.010, "DA_count": 0.010, "SA_count": -0.020,
        "unique_channel_count": -0.030, "channel_entropy": -0.040, "last_touch_is_da": 0.060,
        "latency": 0.0020, "recency": 0.0040, "recent_touch_pressure": -0.020,
        "touch_per_latency_hour": -0.010, "last1h_touch_count": -0.015, "recent_24h_ratio": -0.100,
        "click_ratio": -0.150, "impression_count": 0.003, "is_single_touch_install": 0.090,
        "product_viewed_count": -0.070, "user_signin": -0.040, "product_addedtocart": -0.090,
        "deeplink_open": -0.050, "home_viewed": -0.010, "addtowishlist": -0.060,
        "onboarding": -0.020, "user_signup": -0.030, "total_events": -0.020, "n_event_types": -0.060,
    },
)

PLTV_PURCHASE = LinearModel(
    name="pltv_purchase_model",
    intercept=-0.20,
    weights={
        "trackinglink_count": 0.015, "DA_count": 0.010, "SA_count": 0.020,
        "unique_channel_count": 0.030, "channel_entropy": 0.050, "last_touch_is_da": -0.030,
        "latency": -0.0010, "recency": -0.0020, "recent_touch_pressure": 0.020,
        "touch_per_latency_hour": 0.015, "last1h_touch_count": 0.030, "recent_24h_ratio": 0.120,
        "click_ratio": 0.180, "impression_count": 0.003, "is_single_touch_install": -0.060,
        "product_viewed_count": 0.080, "user_signin": 0.040, "product_addedtocart": 0.110,
        "deeplink_open": 0.050, "home_viewed": 0.015, "addtowishlist": 0.060,
        "onboarding": 0.025, "user_signup": 0.035, "total_events": 0.012, "n_event_types": 0.045,
    },
)

# Regression on log1p(30-day revenue) of payers; the service applies expm1(max(., 0)).
PLTV_AMOUNT = LinearModel(
    name="pltv_amount_model",
    intercept=7.60,
    weights={
        "trackinglink_count": 0.030, "DA_count": 0.020, "SA_count": 0.025,
        "unique_channel_count": 0.050, "channel_entropy": 0.080, "last_touch_is_da": -0.040,
        "latency": -0.0020, "recency": -0.0030, "recent_touch_pressure": 0.040,
        "touch_per_latency_hour": 0.030, "last1h_touch_count": 0.045, "recent_24h_ratio": 0.200,
        "click_ratio": 0.250, "impression_count": 0.005, "is_single_touch_install": -0.100,
        "product_viewed_count": 0.110, "user_signin": 0.060, "product_addedtocart": 0.140,
        "deeplink_open": 0.070, "home_viewed": 0.025, "addtowishlist": 0.080,
        "onboarding": 0.035, "user_signup": 0.045, "total_events": 0.018, "n_event_types": 0.065,
    },
    link="identity",
)

TRIGGER = TriggerModel(
    name="cate_model",
    intercept=-1.10,
    weights={
        "trackinglink_count": 0.010, "unique_channel_count": 0.020, "channel_entropy": 0.030,
        "latency": -0.0010, "recency": -0.0015, "click_ratio": 0.100,
        "impression_count": 0.002, "product_viewed_count": 0.050, "product_addedtocart": 0.060,
        "total_events": 0.010, "n_event_types": 0.030,
    },
    trigger_weights={"price_appeal": 0.12, "social_proof": 0.08, "scarcity": 0.05, "novelty": 0.02},
    interactions={
        "price_appeal": {"product_addedtocart": 0.050, "recency": -0.0020},
        "social_proof": {"unique_channel_count": 0.060, "impression_count": 0.004},
        "scarcity": {"last1h_touch_count": 0.080, "recent_24h_ratio": 0.150},
        "novelty": {"home_viewed": 0.070, "latency": 0.0015},
    },
)

# fixed values: how the fixture apps' own bundles differ from the defaults (all weights of
# the app's models times this; other apps 1)
APP_SCALE = {"app_1": 1.25, "app_2": 0.8}

# Fixture horizons (the product defaults stay in the operator signatures):
FIXTURE_WINDOW_S = 24 * 3600          # first-session window (product: 5 minutes)
FIXTURE_CHURN_FROM_S = 24 * 3600      # silence window start (product: end of first session)
FIXTURE_CHURN_TO_S = 48 * 3600        # silence window end (product: 3 days)
FIXTURE_PURCHASE_H_S = 3 * 24 * 3600  # D3 purchase horizon
FIXTURE_LTV_H_S = 14 * 24 * 3600      # LTV horizon (product: 30 days)
POLICY_SEED = "onramp-policy-v1"
