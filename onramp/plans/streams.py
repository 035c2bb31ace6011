"""Queries that run the stream forms (T1-T3, T5, T6): the fixture's rows arrive in slices of
time, every slice is one ``availableNow`` run, and the result is read from the sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import lookup as LK
from ..session import materialize
from ..sources.events import normalize_events
from ..sources.tables import load_table
from ..streaming import replay as RP
from ..streaming import stream_ops as ST
from . import catalog as C
from . import oracle as O
from .catalog import fixture, register, sql_ts, ts_text

SLICES = 4
HOUR_US = 3600 * 1_000_000
# fixed values of the stand-in: the heartbeat that ends a replay, and who is late in T6
END = dt.datetime(2090, 1, 1)
LATE_EVERY = 10          # every tenth event arrives one slice later


def _raw_events(spark, sf_dir) -> DataFrame:
    e = load_table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.col("value").cast("double").alias("value"), "props")


def _heartbeat(rows: DataFrame) -> DataFrame:
    """One view by nobody known, long after all rows: event time passes every timer."""
    row = {"event_id": -1, "ts": END, "user_id": -1, "event_type": "view", "value": 0.0, "props": '{"k": 1}'}
    return rows.sparkSession.range(1).select(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def _sliced_events(spark, sf_dir, late: bool) -> DataFrame:
    e = _raw_events(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = RP.bounds(e, at)
    n = RP.slice_of(at, low, high, SLICES)
    if late:
        n = F.least(F.lit(SLICES - 1), n + (F.pmod("event_id", F.lit(LATE_EVERY)) == 0).cast("int"))
    return e.withColumn("_slice", n)


# ------------------------------------------------------------------ T2

FIRST_SESSION_S = 300


@register("first_session_stream", O.with_(*O.base_ctes(), O.ia_cte(FIRST_SESSION_S)) + f"""
SELECT i.app_id, i.user_id, {sql_ts('i.t0', 't0')}, {', '.join(f'coalesce(ia.{c}, 0) AS {c}' for c in S.INAPP_FEATURES)}
FROM inst i LEFT JOIN ia ON i.app_id = ia.app_id AND i.user_id = ia.user_id""")
def q_first_session_stream(spark, sf_dir):
    """The five-minute trigger over arriving events."""
    rows = _sliced_events(spark, sf_dir, late=False)
    folder, out, state = (RP.scratch(spark, x) for x in ("events", "first-session", "state"))

    def run(stream: DataFrame, _: int) -> None:
        RP.run_now(ST.five_minute_trigger(normalize_events(stream), window_s=FIRST_SESSION_S, watermark="1 hour"), state, out)

    RP.run_slices(rows, "_slice", SLICES, folder, run, last=_heartbeat(rows.drop("_slice")))
    return spark.read.parquet(out).select("app_id", "user_id", ts_text("t0"), *S.INAPP_FEATURES)


# ------------------------------------------------------------------ T3

REQUEST_COLS = ["request_id", "app_id", "airbridge_uuid", "model_version", "request_ts"]


def _sticky_sink(spark, sf_dir, ttl_s: float) -> str:
    """The folder of T3's sink after all requests of the fixture that can be scored arrived."""
    fx = fixture(spark, sf_dir)

    def build():
        known = fx.features_with_duplicates.select("app_id", "airbridge_uuid").distinct()
        req = LK.requests_of_ready_apps(fx.requests, LK.app_readiness(fx.inventory)).join(known, S.KEY, "left_semi").select(*REQUEST_COLS)
        at = F.unix_micros("request_ts")
        low, high = RP.bounds(req, at)
        rows = req.withColumn("_slice", RP.slice_of(at, low, high, SLICES))
        end = {"request_id": -1, "app_id": "end", "airbridge_uuid": "end", "model_version": "end", "request_ts": END}
        last = spark.range(1).select(*[F.lit(end[f.name]).cast(f.dataType).alias(f.name) for f in req.schema.fields])
        folder, out, state = (RP.scratch(spark, x) for x in ("requests", "sticky", "state"))
        RP.run_slices(rows, "_slice", SLICES, folder, lambda stream, _: RP.run_now(
            ST.sticky_decisions_stream(stream, ttl_s=ttl_s, watermark="1 hour"), state, out), last=last)
        return out
    return fx._get(("sticky_sink", ttl_s), build)


@register("sticky_stream", C._sticky_sql(3600))
def q_sticky_stream(spark, sf_dir):
    """Anchored decisions over arriving requests."""
    s = spark.read.parquet(_sticky_sink(spark, sf_dir, 3600)).where("request_id >= 0")
    return s.select("request_id", "app_id", "airbridge_uuid", ts_text("request_ts"), F.date_format(F.timestamp_micros("anchor_us"), C.TS_FMT).alias("anchor_ts"))


# ------------------------------------------------------------------ T1, T5

def _score_run(spark, sf_dir) -> tuple[str, str]:
    """T1 over T3's sink, with its log (K1, T5); then one batch is handed over again, as after
    a driver failure: it must replace its own rows."""
    fx = fixture(spark, sf_dir)

    def build():
        sink = _sticky_sink(spark, sf_dir, S.DECISION_TTL_SECONDS)
        out, log, state = (RP.scratch(spark, x) for x in ("scores", "log", "state"))
        served = spark.read.parquet(sink)
        requests = spark.readStream.schema(served.schema).option("maxFilesPerTrigger", RP.files_per_batch(served, SLICES)).parquet(sink).where("request_id >= 0").drop("model_version")
        # read anew for each batch: kept as tables, not as plans over all requests
        readiness = materialize(LK.app_readiness(fx.inventory), "readiness")
        features, cfg, models = fx.features_with_duplicates, C._tier_cfg(fx), fx.models
        ST.score_stream(requests, lambda _: features, lambda _: readiness, lambda _: cfg, out, state, log_path=log,
                        trigger={"availableNow": True}, models=lambda _: models).awaitTermination()
        # the first batch again
        first = spark.read.parquet(out).where("batch_id = 0").select("request_id").distinct()
        again = spark.read.parquet(sink).where("request_id >= 0").drop("model_version").join(first, "request_id", "left_semi")
        ST.score_batch_fn(lambda _: features, lambda _: readiness, lambda _: cfg, out, log, lambda _: models)(again, 0)
        return out, log
    return fx._get("score_run", build)


@register("score_stream", C._requests_sql() + f"SELECT {C.REQ_COLS_SQL} FROM rtiered")
def q_score_stream(spark, sf_dir):
    """Every served request, scored in the micro-batch it arrived in."""
    r = spark.read.parquet(_score_run(spark, sf_dir)[0])
    return r.select("request_id", "app_id", "airbridge_uuid", ts_text("request_ts"),
                    F.date_format(F.timestamp_micros("anchor_us"), C.TS_FMT).alias("anchor_ts"), "best_trigger", "is_random",
                    *[f"score_{t}" for t in S.TREATMENT_TRIGGERS], "d3_purchase_prob", "d3_churn_prob",
                    F.round("pltv_score", 4).alias("pltv_score"), "pltv_tier", "pltv_percentile", F.round("tier_avg_ltv", 4).alias("tier_avg_ltv"))


@register("log_stream", C._requests_sql() + f"SELECT {C.LOG_SQL_COLS} FROM rtiered")
def q_log_stream(spark, sf_dir):
    """T5 / K1: the log of the same run, after a batch was handed over twice."""
    return C._log_view(spark.read.parquet(_score_run(spark, sf_dir)[1]))


# ------------------------------------------------------------------ T6

@register("touch_rollup_stream", O.with_(O.ev_cte(), f"""arr AS (
  SELECT app_id, channel, touch_type, ts, date_trunc('hour', ts) AS w,
         least({SLICES - 1}, CAST(floor((epoch_us(ts) - low) * {SLICES} / (high - low + 1)::DOUBLE) AS INTEGER) + (event_id % {LATE_EVERY} = 0)::INTEGER) AS n
  FROM ev, (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events) b WHERE touch_type IS NOT NULL)""",
    f"wm AS (SELECT n, max(max(epoch_us(ts))) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {HOUR_US} AS mark FROM arr GROUP BY n)") + f"""
SELECT app_id, channel, {sql_ts('w', 'window_start')}, count_if(NOT late AND touch_type = 'click')::BIGINT AS clicks,
       count_if(NOT late AND touch_type = 'impression')::BIGINT AS impressions, count_if(late)::BIGINT AS late
FROM (SELECT a.*, coalesce(epoch_us(w) + {HOUR_US} <= mark, false) AS late FROM arr a JOIN wm ON a.n = wm.n) x GROUP BY app_id, channel, w""")
def q_touch_rollup_stream(spark, sf_dir):
    """T6 with late rows: hours as they are emitted, and the rows that came too late for them
    (clicks + impressions + late are the hour's rows of the batch form)."""
    rows = _sliced_events(spark, sf_dir, late=True)
    folder, out, late, state, late_state = (RP.scratch(spark, x) for x in ("events", "rollup", "late", "state", "late-state"))
    mark: list[int | None] = [None]

    def run(stream: DataFrame, _: int) -> None:
        events = normalize_events(stream)
        RP.run_now(ST.late_touches_stream(events, mark[0]), late_state, late)
        done = RP.run_now(ST.ad_touch_rollup_stream(events, watermark="1 hour"), state, out)
        told = (done or {}).get("eventTime", {}).get("watermark")
        if told:
            at = dt.datetime.fromisoformat(told.replace("Z", "+00:00"))
            mark[0] = int(at.timestamp() * 1000) * 1000

    RP.run_slices(rows, "_slice", SLICES, folder, run, last=_heartbeat(rows.drop("_slice")))
    key = ["app_id", "channel", "window_start"]
    too_late = spark.read.schema("app_id string, channel string, window_start timestamp, touch_type string").parquet(late)
    both = spark.read.parquet(out).select(*key, "clicks", "impressions", F.lit(0).cast("long").alias("late")).unionByName(
        too_late.groupBy(*key).agg(F.lit(0).cast("long").alias("clicks"), F.lit(0).cast("long").alias("impressions"), F.count(F.lit(1)).alias("late")))
    return both.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("clicks", "impressions", "late")]).select(
        "app_id", "channel", ts_text("window_start"), "clicks", "impressions", "late")
