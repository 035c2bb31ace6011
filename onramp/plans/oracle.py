"""DuckDB SQL for the correctness check: the same definitions written independently as
plain SQL over the raw driver tables. Builders return CTE fragments; ``with_(...)``
joins them into one statement.

Literals go through ``d()`` so DuckDB sees DOUBLE, not DECIMAL, and arithmetic runs in
the same order as the Spark expressions (left to right).
"""

from __future__ import annotations

from .. import params as P
from .. import schema as S
from ..operators.ltv import quantile_points
from ..sources import events as EV
from . import fixtures as FX

US = 1_000_000


def d(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def coerce(x: str) -> str:
    return f"COALESCE(CASE WHEN isnan({x}) THEN {d(0)} ELSE {x} END, {d(0)})"


# ---------------------------------------------------------------- base relations

def ev_cte() -> str:
    inapp = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in EV.INAPP_OF_KIND.items())
    touch = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in EV.TOUCH_OF_KIND.items())
    da = ", ".join(str(x) for x in EV.DA_CHANNELS)
    sa = ", ".join(str(x) for x in EV.SA_CHANNELS)
    return f"""ev AS (
  SELECT event_id, 'app_' || CAST(user_id % {EV.APP_BUCKETS} AS VARCHAR) AS app_id,
         CAST(user_id AS VARCHAR) AS user_id, ts,
         CASE event_type {inapp} END AS event_type,
         CASE event_type {touch} END AS touch_type,
         'ch_' || CAST(k % {EV.CHANNELS} AS VARCHAR) AS channel,
         CASE WHEN k % {EV.CHANNELS} IN ({da}) THEN 'DA' WHEN k % {EV.CHANNELS} IN ({sa}) THEN 'SA'
              WHEN k IS NOT NULL THEN 'other' END AS channel_class,
         CASE WHEN event_type = {s(EV.REVENUE_KIND)} THEN value END AS revenue,
         event_type = {s(EV.INSTALL_KIND)} AS is_install, k
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) r)"""


def inst_cte() -> str:
    return """inst AS (
  SELECT app_id, user_id, t0, install_event_id FROM (
    SELECT app_id, user_id, ts AS t0, event_id AS install_event_id,
           row_number() OVER (PARTITION BY app_id, user_id ORDER BY ts, event_id) AS rn
    FROM ev WHERE is_install) x WHERE rn = 1)"""


def j_cte() -> str:
    return """j AS (
  SELECT ev.*, inst.t0, inst.install_event_id, epoch_us(ev.ts) - epoch_us(inst.t0) AS dt_us
  FROM ev JOIN inst ON ev.app_id = inst.app_id AND ev.user_id = inst.user_id)"""


def base_ctes() -> list[str]:
    return [ev_cte(), inst_cte(), j_cte()]


# ---------------------------------------------------------------- features (A4, A5)

def ua_ctes() -> list[str]:
    h = d(3600 * US)
    return [
        "tch AS (SELECT * FROM j WHERE touch_type IS NOT NULL AND dt_us < 0)",
        f"""pc AS (
  SELECT app_id, user_id, t0, channel,
         count_if(touch_type = 'click') AS n_click,
         count_if(touch_type = 'impression') AS n_imp,
         count_if(touch_type = 'click' AND channel_class = 'DA') AS n_da,
         count_if(touch_type = 'click' AND channel_class = 'SA') AS n_sa,
         count_if(touch_type = 'click' AND dt_us >= {-24 * 3600 * US}) AS n_24h,
         min(CASE WHEN touch_type = 'click' THEN ts END) AS first_click
  FROM tch GROUP BY app_id, user_id, t0, channel)""",
        """lc AS (
  SELECT app_id, user_id, ts AS last_ts, channel_class = 'DA' AS last_da FROM (
    SELECT app_id, user_id, ts, channel_class,
           row_number() OVER (PARTITION BY app_id, user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM tch WHERE touch_type = 'click') x WHERE rn = 1)""",
        f"""pu AS (
  SELECT app_id, user_id, t0, sum(n_click) AS clicks, sum(n_imp) AS imps, sum(n_da) AS da,
         sum(n_sa) AS sa, sum(n_24h) AS c24, count_if(n_click > 0) AS channels,
         sum(CASE WHEN n_click > 0 THEN n_click * (ln(CAST(n_click AS DOUBLE)) / ln({d(2)})) END) AS nlogn,
         min(first_click) AS first_click
  FROM pc GROUP BY app_id, user_id, t0)""",
        f"""ua AS (
  SELECT pu.app_id, pu.user_id,
         CAST(clicks AS DOUBLE) AS trackinglink_count,
         CAST(da AS DOUBLE) AS DA_count,
         CAST(sa AS DOUBLE) AS SA_count,
         CAST(channels AS DOUBLE) AS unique_channel_count,
         CASE WHEN clicks > 0 THEN ln(CAST(clicks AS DOUBLE)) / ln({d(2)}) - nlogn / CAST(clicks AS DOUBLE) END
           AS channel_entropy,
         CAST(lc.last_da AS DOUBLE) AS last_touch_is_da,
         (epoch_us(pu.t0) - epoch_us(pu.first_click)) / {h} AS latency,
         (epoch_us(pu.t0) - epoch_us(lc.last_ts)) / {h} AS recency,
         CASE WHEN {d(1)} + coalesce((epoch_us(pu.t0) - epoch_us(lc.last_ts)) / {h}, {d(0)}) <> 0
              THEN CAST(clicks AS DOUBLE) / ({d(1)} + coalesce((epoch_us(pu.t0) - epoch_us(lc.last_ts)) / {h}, {d(0)})) END
           AS recent_touch_pressure,
         CASE WHEN {d(1)} + coalesce((epoch_us(pu.t0) - epoch_us(pu.first_click)) / {h}, {d(0)}) <> 0
              THEN CAST(clicks AS DOUBLE) / ({d(1)} + coalesce((epoch_us(pu.t0) - epoch_us(pu.first_click)) / {h}, {d(0)})) END
           AS touch_per_latency_hour,
         CASE WHEN clicks <> 0 THEN CAST(c24 AS DOUBLE) / CAST(clicks AS DOUBLE) END AS recent_24h_ratio,
         CASE WHEN CAST(clicks AS DOUBLE) + CAST(imps AS DOUBLE) <> 0
              THEN CAST(clicks AS DOUBLE) / (CAST(clicks AS DOUBLE) + CAST(imps AS DOUBLE)) END AS click_ratio,
         CAST(imps AS DOUBLE) AS impression_count,
         CAST(clicks = 1 AS DOUBLE) AS is_single_touch_install,
         l1.last1h_touch_count
  FROM pu
  LEFT JOIN lc ON pu.app_id = lc.app_id AND pu.user_id = lc.user_id
  LEFT JOIN (
    SELECT tch.app_id, tch.user_id, CAST(count(*) AS DOUBLE) AS last1h_touch_count
    FROM tch JOIN lc ON tch.app_id = lc.app_id AND tch.user_id = lc.user_id
    WHERE tch.touch_type = 'click' AND epoch_us(tch.ts) > epoch_us(lc.last_ts) - {3600 * US}
    GROUP BY tch.app_id, tch.user_id) l1 ON pu.app_id = l1.app_id AND pu.user_id = l1.user_id)""",
    ]


def ia_cte(window_s: float) -> str:
    cols = []
    for feat in S.INAPP_FEATURES:
        ev = S.INAPP_EVENT_OF.get(feat)
        if ev is not None:
            cols.append(f"CAST(count_if(event_type = {s(ev)}) AS DOUBLE) AS {feat}")
    cols.append("CAST(count(*) AS DOUBLE) AS total_events")
    cols.append("CAST(count(DISTINCT event_type) AS DOUBLE) AS n_event_types")
    return f"""ia AS (
  SELECT app_id, user_id, {', '.join(cols)}
  FROM j WHERE event_type IS NOT NULL AND dt_us >= 0 AND dt_us < {int(window_s * US)}
           AND event_id <> install_event_id
  GROUP BY app_id, user_id)"""


def feat_ctes(window_s: float = P.FIXTURE_WINDOW_S) -> list[str]:
    ua_cols = ", ".join(f"{coerce('ua.' + c)} AS {c}" for c in S.UA_FEATURES)
    ia_cols = ", ".join(f"{coerce('ia.' + c)} AS {c}" for c in S.INAPP_FEATURES)
    return ua_ctes() + [ia_cte(window_s), f"""feat AS (
  SELECT inst.app_id, inst.user_id AS airbridge_uuid, inst.install_event_id AS row_no, {ua_cols}, {ia_cols}
  FROM inst
  LEFT JOIN ua ON inst.app_id = ua.app_id AND inst.user_id = ua.user_id
  LEFT JOIN ia ON inst.app_id = ia.app_id AND inst.user_id = ia.user_id)"""]


# ---------------------------------------------------------------- labels

def labels_cte(purchase_h_s=P.FIXTURE_PURCHASE_H_S, churn_from_s=P.FIXTURE_CHURN_FROM_S,
               churn_to_s=P.FIXTURE_CHURN_TO_S, ltv_h_s=P.FIXTURE_LTV_H_S) -> list[str]:
    ph, cf, ct, lh = (int(x * US) for x in (purchase_h_s, churn_from_s, churn_to_s, ltv_h_s))
    return [f"""lagg AS (
  SELECT app_id, user_id,
         count_if(event_type = {s(S.EV_ORDER_COMPLETED)} AND dt_us < {ph}) AS np,
         count_if(dt_us >= {cf} AND dt_us < {ct}) AS nc,
         sum(CASE WHEN dt_us < {lh} THEN coalesce(revenue, {d(0)}) END) AS ltv
  FROM j WHERE event_type IS NOT NULL AND event_id <> install_event_id AND dt_us >= 0
  GROUP BY app_id, user_id)""",
            "lastts AS (SELECT max(epoch_us(ts)) AS last_us FROM ev)",
            f"""lab AS (
  SELECT inst.app_id, inst.user_id AS airbridge_uuid,
         CASE WHEN epoch_us(inst.t0) + {ph} <= last_us THEN CAST(coalesce(np, 0) > 0 AS INTEGER) END AS d3_purchase,
         CASE WHEN epoch_us(inst.t0) + {ct} <= last_us THEN CAST(coalesce(nc, 0) = 0 AS INTEGER) END AS d3_churn,
         CASE WHEN epoch_us(inst.t0) + {lh} <= last_us THEN coalesce(lagg.ltv, {d(0)}) END AS ltv
  FROM inst LEFT JOIN lagg ON inst.app_id = lagg.app_id AND inst.user_id = lagg.user_id CROSS JOIN lastts)"""]


# ---------------------------------------------------------------- requests, inventory, readiness

def req_cte() -> str:
    return f"""req AS (
  SELECT ev.event_id AS request_id,
         CASE WHEN CAST(ev.user_id AS BIGINT) % {FX.UNKNOWN_APP_EVERY} = 0 THEN {s(FX.UNKNOWN_APP)}
              ELSE ev.app_id END AS app_id,
         ev.user_id AS airbridge_uuid, ev.ts AS request_ts
  FROM ev JOIN inst ON ev.app_id = inst.app_id AND ev.user_id = inst.user_id
  WHERE ev.touch_type = 'click' AND ev.ts > inst.t0)"""


def inventory_ctes() -> list[str]:
    files = ", ".join(f"({i}, {s(f)})" for i, f in enumerate(S.MODEL_FILES))
    rule = ", ".join(f"({s(a)}, {s(f)})" for a, fs in FX.INVENTORY_RULE.items() for f in fs)
    return [
        f"files AS (SELECT * FROM (VALUES {files}) t(pos, file))",
        f"rule AS (SELECT * FROM (VALUES {rule}) t(app_id, file))",
        """inv AS (
  SELECT a.app_id, f.file, CAST((f.pos + 1) * 1024 AS BIGINT) AS length, TRUE AS valid
  FROM (SELECT DISTINCT app_id FROM req) a CROSS JOIN files f
  WHERE a.app_id NOT IN (SELECT app_id FROM rule)
     OR EXISTS (SELECT 1 FROM rule r WHERE r.app_id = a.app_id AND r.file = f.file))""",
    ]


def ready_cte() -> str:
    req = ", ".join(s(f) for f in S.REQUIRED_MODEL_FILES)
    pltv = " AND ".join(f"list_contains(files, {s(f)})" for f in S.PLTV_MODEL_FILES)
    return f"""ready AS (
  SELECT app_id, available, available AND churn AS ready,
         CASE WHEN available AND churn AND trig THEN 'optimized'
              WHEN available AND churn THEN 'exploration' ELSE 'not ready' END AS mode,
         list_filter([{req}], lambda f: NOT list_contains(files, f)) AS missing,
         ({pltv}) AS has_pltv,
         substr(md5(array_to_string(list_sort(sig), ',')), 1, 12) AS model_version
  FROM (
    SELECT app_id,
           coalesce(bool_or(valid AND file = 'd3_purchase_model.pkl'), FALSE) AS available,
           coalesce(bool_or(valid AND file = 'd3_churn_model.pkl'), FALSE) AS churn,
           coalesce(bool_or(valid AND file = {s(S.TRIGGER_MODEL_FILE)}), FALSE) AS trig,
           coalesce(list(file) FILTER (WHERE valid), []) AS files,
           coalesce(list(file || ':' || CAST(length AS VARCHAR)) FILTER (WHERE valid), []) AS sig
    FROM inv GROUP BY app_id) x)"""


# ---------------------------------------------------------------- scoring (M1-M4)

def app_scale(prefix: str = "") -> str:
    """The app's factor on all default weights (its bundle's numbers)."""
    return f"CASE {prefix}app_id " + " ".join(f"WHEN {s(a)} THEN {d(x)}" for a, x in P.APP_SCALE.items()) + f" ELSE {d(1)} END"


def linear_sql(weights: dict, intercept: float, prefix: str = "") -> str:
    sc = app_scale(prefix)
    z = f"{d(intercept)} * {sc}"
    for f, w in weights.items():
        z = f"{z} + ({d(w)} * {sc}) * {prefix}{f}"
    return f"({z})"


def logistic_sql(z: str) -> str:
    return f"({d(1)} / ({d(1)} + exp(-{z})))"


def trigger_sql(t: str, m=P.TRIGGER, prefix: str = "") -> str:
    z = linear_sql(m.weights, m.intercept, prefix)[1:-1]
    sc = app_scale(prefix)
    z = f"{z} + {d(m.trigger_weights.get(t, 0.0))} * {sc}"
    for f, w in m.interactions.get(t, {}).items():
        z = f"{z} + ({d(w)} * {sc}) * {prefix}{f}"
    return f"round({logistic_sql('(' + z + ')')}, 4)"


def draw_sql(seed: str, salt: str, parts: list[str]) -> str:
    key = ", ".join([s(seed), s(salt)] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5(concat_ws('|', {key})), 1, 8))::BIGINT / {d(4294967296.0)})"


def scored_cte(src: str = "feat", name: str = "sc", draw_extra: list[str] | None = None,
               seed: str = P.POLICY_SEED, src_cols: str = "f.*") -> str:
    trig = S.TREATMENT_TRIGGERS
    scores = ",\n         ".join(
        f"CASE WHEN r.mode = 'optimized' THEN {trigger_sql(t, prefix='f.')} END AS score_{t}" for t in trig)
    parts = ["f.app_id", "f.airbridge_uuid", "r.model_version"] + list(draw_extra or [])
    explore = draw_sql(seed, "explore", parts)
    choice = draw_sql(seed, "choice", parts)
    pool = "[" + ", ".join(s(t) for t in trig) + "]"
    amount = linear_sql(P.PLTV_AMOUNT.weights, P.PLTV_AMOUNT.intercept, "f.")
    pltv = (f"CASE WHEN r.has_pltv THEN "
            f"{logistic_sql(linear_sql(P.PLTV_PURCHASE.weights, P.PLTV_PURCHASE.intercept, 'f.'))}"
            f" * (exp(greatest({amount}, {d(0)})) - {d(1)}) END")
    inner = f"""SELECT {src_cols}, r.mode, r.has_pltv, r.model_version,
         {scores},
         (r.mode <> 'optimized') OR {explore} < {d(S.EXPLORATION_SHARE)} AS is_random,
         {pool}[CAST(floor({choice} * {len(trig)}) + 1 AS INTEGER)] AS random_pick,
         round({logistic_sql(linear_sql(P.D3_PURCHASE.weights, P.D3_PURCHASE.intercept, 'f.'))}, 4) AS d3_purchase_prob,
         round({logistic_sql(linear_sql(P.D3_CHURN.weights, P.D3_CHURN.intercept, 'f.'))}, 4) AS d3_churn_prob,
         {pltv} AS pltv_score
  FROM {src} f JOIN ready r ON f.app_id = r.app_id AND r.ready"""
    top = "greatest(" + ", ".join(f"score_{t}" for t in trig) + ")"
    argmax = "CASE " + " ".join(f"WHEN score_{t} = {top} THEN {s(t)}" for t in trig) + " END"
    return f"""{name} AS (
  SELECT *, CASE WHEN is_random THEN random_pick ELSE {argmax} END AS best_trigger
  FROM ({inner}) y)"""


# ---------------------------------------------------------------- tiers

def tier_expr(score: str, tiers: str) -> str:
    return (f"CASE WHEN {score} IS NULL OR {tiers} IS NULL THEN NULL WHEN isnan({score}) THEN 'low' "
            f"ELSE coalesce(list_filter({tiers}, lambda t: {score} >= t.threshold)[1].name, 'low') END")


def pct_expr(score: str, q: str, tiers: str) -> str:
    n = f"len(coalesce({q}, []::DOUBLE[]))"
    idx = f"len(list_filter(coalesce({q}, []::DOUBLE[]), lambda x: x < {score}))"
    return (f"CASE WHEN {score} IS NULL OR {tiers} IS NULL THEN NULL "
            f"WHEN isnan({score}) AND {n} > 0 THEN 99 WHEN {n} = 0 THEN 50 "
            f"ELSE CAST(least(greatest(floor(CAST({idx} AS DOUBLE) / CAST(greatest({n}, 1) AS DOUBLE) * {d(100)}), 0), 99) AS INTEGER) END")


def cfg_ctes(src: str = "sc", labels: str = "lab", n_quantiles: int = 1000) -> list[str]:
    pts = "[" + ", ".join(repr(p) for p in quantile_points(n_quantiles)) + "]::DOUBLE[]"
    return [
        f"""cfgq AS (
  SELECT app_id, quantile_disc(pltv_score, [0.8, 0.5]::DOUBLE[]) AS thr,
         quantile_disc(pltv_score, {pts}) AS q
  FROM {src} WHERE pltv_score IS NOT NULL GROUP BY app_id)""",
        """cfg AS (
  SELECT app_id, [{'name': 'high', 'threshold': thr[1]}, {'name': 'medium', 'threshold': thr[2]},
                  {'name': 'low', 'threshold': CAST(0.0 AS DOUBLE)}] AS tiers, q
  FROM cfgq)""",
        f"""cfgavg AS (
  SELECT app_id, tier, avg(ltv) AS m FROM (
    SELECT x.app_id, {tier_expr('x.pltv_score', 'cfg.tiers')} AS tier, l.ltv
    FROM {src} x JOIN cfg ON x.app_id = cfg.app_id
    LEFT JOIN {labels} l ON x.app_id = l.app_id AND x.airbridge_uuid = l.airbridge_uuid
    WHERE x.pltv_score IS NOT NULL) z
  GROUP BY app_id, tier)""",
    ]


def tiered_cte(src: str = "sc", name: str = "tiered") -> str:
    tier = tier_expr("x.pltv_score", "cfg.tiers")
    return f"""{name} AS (
  SELECT x.*, {tier} AS pltv_tier, {pct_expr('x.pltv_score', 'cfg.q', 'cfg.tiers')} AS pltv_percentile,
         CASE WHEN x.pltv_score IS NULL OR cfg.tiers IS NULL THEN NULL ELSE coalesce(ca.m, {d(0)}) END AS tier_avg_ltv
  FROM {src} x LEFT JOIN cfg ON x.app_id = cfg.app_id
  LEFT JOIN cfgavg ca ON x.app_id = ca.app_id AND ca.tier = {tier})"""


def score_users_ctes() -> list[str]:
    return (base_ctes() + feat_ctes() + labels_cte() + [req_cte()] + inventory_ctes()
            + [ready_cte(), scored_cte()] + cfg_ctes() + [tiered_cte()])


# ---------------------------------------------------------------- sticky decisions

def sticky_cte(src: str, ttl_s: float = S.DECISION_TTL_SECONDS, name: str = "sticky") -> list[str]:
    """Anchors by recursion over each key's requests in (ts, request_id) order."""
    ttl = int(round(ttl_s * US))
    return [
        f"""sq AS (
  SELECT *, epoch_us(request_ts) AS ts_us,
         row_number() OVER (PARTITION BY app_id, airbridge_uuid, model_version
                            ORDER BY request_ts, request_id) AS seq
  FROM {src})""",
        f"""rec(app_id, airbridge_uuid, model_version, seq, anchor_us) AS (
  SELECT app_id, airbridge_uuid, model_version, seq, ts_us FROM sq WHERE seq = 1
  UNION ALL
  SELECT sq.app_id, sq.airbridge_uuid, sq.model_version, sq.seq,
         CASE WHEN sq.ts_us - rec.anchor_us >= {ttl} THEN sq.ts_us ELSE rec.anchor_us END
  FROM rec JOIN sq ON sq.app_id = rec.app_id AND sq.airbridge_uuid = rec.airbridge_uuid
                  AND sq.model_version IS NOT DISTINCT FROM rec.model_version AND sq.seq = rec.seq + 1)""",
        f"""{name} AS (
  SELECT sq.*, rec.anchor_us FROM sq JOIN rec
    ON sq.app_id = rec.app_id AND sq.airbridge_uuid = rec.airbridge_uuid
   AND sq.model_version IS NOT DISTINCT FROM rec.model_version AND sq.seq = rec.seq)""",
    ]


# ---------------------------------------------------------------- fixture variants of the feature table

def featdup_cte() -> str:
    cols = []
    for c in S.ALL_FEATURES:
        cols.append(f"{c} + {d(1)} AS {c}" if c == "latency" else c)
    return f"""featdup AS (
  SELECT app_id, airbridge_uuid, row_no, {', '.join(S.ALL_FEATURES)} FROM feat
  UNION ALL
  SELECT app_id, airbridge_uuid, row_no + {1 << 40} AS row_no, {', '.join(cols)} FROM feat
  WHERE CAST(airbridge_uuid AS BIGINT) % {FX.DUP_EVERY} = 0)"""


def feattext_cte() -> str:
    cols = []
    for c in S.ALL_FEATURES:
        cases = " ".join(f"WHEN CAST(airbridge_uuid AS BIGINT) % {m} = 0 THEN {s(t)}" for m, t in FX.BAD_TEXT)
        cols.append(f"CASE {cases} ELSE CAST({c} AS VARCHAR) END AS {c}")
    return f"""feattext AS (SELECT app_id, airbridge_uuid, row_no, {', '.join(cols)} FROM feat)"""


def latest_cte(src: str = "featdup", name: str = "fl") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY app_id, airbridge_uuid ORDER BY row_no DESC) AS rn
    FROM {src} WHERE row_no IS NOT NULL) x WHERE rn = 1)"""


def modal_cte() -> str:
    pool = "[" + ", ".join(s(t) for t in S.TREATMENT_TRIGGERS) + "]"
    return f"""touch AS (
  SELECT ev.event_id, ev.app_id, ev.user_id AS airbridge_uuid, ev.ts, ev.k, ev.touch_type = 'impression' AS shown,
         {pool}[CAST(ev.k % 4 AS INTEGER) + 1] AS trigger_type
  FROM ev JOIN inst ON ev.app_id = inst.app_id AND ev.user_id = inst.user_id
  WHERE ev.touch_type IS NOT NULL AND ev.ts > inst.t0),
modal AS (
  SELECT event_id, app_id, airbridge_uuid, ts, trigger_type,
         CASE WHEN shown THEN {s(S.EV_MODAL_SHOWN)} ELSE {s(S.EV_MODAL_CLICKED)} END AS event_type FROM touch
  UNION ALL
  SELECT -event_id, app_id, airbridge_uuid, make_timestamp(epoch_us(ts) + CAST(k % {FX.ECHO_MINUTES} AS BIGINT) * 60000000), trigger_type,
         {s(S.EV_MODAL_SHOWN)} FROM touch WHERE NOT shown)"""


def requests_scored_ctes(ttl_s: float = S.DECISION_TTL_SECONDS) -> list[str]:
    """score_requests in SQL: ready apps, latest feature row, sticky anchors, scoring, tiers."""
    rq = """rq AS (
  SELECT req.request_id, req.app_id, req.airbridge_uuid, req.request_ts, ready.model_version, fl.* EXCLUDE (app_id, airbridge_uuid)
  FROM req JOIN ready ON req.app_id = ready.app_id AND ready.ready
  JOIN fl ON req.app_id = fl.app_id AND req.airbridge_uuid = fl.airbridge_uuid)"""
    return ([featdup_cte(), latest_cte(), rq] + sticky_cte("rq", ttl_s)
            + [scored_cte(src="sticky", name="scr", draw_extra=["f.anchor_us"],
                          src_cols="f.* EXCLUDE (model_version)"),
               tiered_cte(src="scr", name="rtiered")])


def score_requests_ctes(ttl_s: float = S.DECISION_TTL_SECONDS) -> list[str]:
    return score_users_ctes() + requests_scored_ctes(ttl_s)


def attribution_ctes(click_horizon_s: float = 86400, max_age_s: float = S.DECISION_TTL_SECONDS) -> list[str]:
    h, age = int(click_horizon_s * US), int(max_age_s * US)
    return [modal_cte(), """asg AS (
  SELECT request_id, app_id, airbridge_uuid, best_trigger, request_ts AS ts, is_random, anchor_us FROM rtiered)""",
            f"""att AS (
  SELECT s.event_id, s.app_id, s.airbridge_uuid, s.trigger_type, s.ts,
         CASE WHEN epoch_us(s.ts) - epoch_us(a.ts) < {age} THEN a.request_id END AS request_id,
         CASE WHEN epoch_us(s.ts) - epoch_us(a.ts) < {age} THEN a.is_random END AS is_random,
         CASE WHEN epoch_us(s.ts) - epoch_us(a.ts) < {age} THEN a.anchor_us END AS anchor_us,
         CAST(EXISTS (SELECT 1 FROM modal c
                      WHERE c.event_type = {s(S.EV_MODAL_CLICKED)} AND c.app_id = s.app_id
                        AND c.airbridge_uuid = s.airbridge_uuid AND c.trigger_type = s.trigger_type
                        AND c.ts >= s.ts AND epoch_us(c.ts) - epoch_us(s.ts) < {h}) AS INTEGER) AS clicked
  FROM (SELECT * FROM modal WHERE event_type = {s(S.EV_MODAL_SHOWN)}) s
  ASOF LEFT JOIN asg a ON s.app_id = a.app_id AND s.airbridge_uuid = a.airbridge_uuid
                      AND s.trigger_type = a.best_trigger AND s.ts >= a.ts)""",
            """dec AS (
  SELECT app_id, airbridge_uuid, anchor_us, trigger_type, max(clicked) AS clicked,
         bool_or(is_random) AS is_random, min(request_id) AS request_id
  FROM att WHERE request_id IS NOT NULL GROUP BY app_id, airbridge_uuid, anchor_us, trigger_type)"""]
