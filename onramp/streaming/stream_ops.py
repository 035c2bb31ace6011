"""Structured Streaming forms: scoring per micro-batch (T1), first-session trigger (T2),
sticky decisions with state (T3), approximate dedupe (T4), idempotent log sink (T5),
hourly ad-touch rollup (T6).

Event time must be TIMESTAMP (with the session zone UTC): ``withWatermark`` rejects
TIMESTAMP_NTZ, which ``normalize_events`` already casts away.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S
from ..functions.columns import US_PER_SECOND
from ..operators import logs as LG
from ..operators import lookup as LK
from ..operators import ltv as LT
from ..plans import score as SP
from ..sources.events import normalize_events

RAW_EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                     "value double, props string")


def read_events_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of raw events as a stream, normalised to journey rows."""
    r = spark.readStream.schema(RAW_EVENTS_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return normalize_events(r.parquet(path))


# --------------------------------------------------------------------------- T1

def _now(source, spark: SparkSession) -> DataFrame:
    """A DataFrame, or what a loader gives for this batch."""
    return source(spark) if callable(source) else source


def score_batch_fn(feature_loader: Callable[[SparkSession], DataFrame], readiness, cfg, out_path: str,
                   log_path: str | None = None, models=None):
    """foreachBatch body for T1: look up the *current* feature table, readiness and tier
    config (loaders are called per batch — a static DataFrame would keep the file list it
    was planned with), score, and write the batch under its batch id. The log is written
    under the batch id too, so a replayed batch replaces both, never duplicates. A log
    failure is reported and never fails scoring (K1)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        feats = LK.latest_per_key(feature_loader(spark))
        readiness_now, cfg_now = _now(readiness, spark), _now(cfg, spark)
        req = LK.requests_of_ready_apps(batch, readiness_now, "ready").drop("ready")
        hit = req.join(feats, S.KEY)
        # a request served from a sticky decision (T3 upstream: ``anchor_us``) repeats the
        # decision's draw; without T3 every request is its own decision
        keep = ["request_id", "request_ts", "app_id", "airbridge_uuid"]
        if "anchor_us" in batch.columns:
            keep.append("anchor_us")
            draw = F.col("anchor_us")
        else:
            draw = F.unix_micros("request_ts")
        scored = SP.score_rows(hit.select(*keep, *S.ALL_FEATURES), readiness_now, draw_extra=[draw],
                               models=None if models is None else _now(models, spark))
        tiered = LT.assign_tier(scored, cfg_now).withColumn("batch_id", F.lit(batch_id))
        tiered = tiered.persist()
        try:
            (tiered.drop("trigger_scores").write.mode("overwrite")
             .parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}"))
            if log_path is not None:
                LG.append_prediction_log(LG.flatten_for_log(tiered.withColumn("tier_avg_ltv", F.lit(None))),
                                         log_path, batch_id=batch_id)
        finally:
            tiered.unpersist()
    return run


def score_stream(requests: DataFrame, feature_loader, readiness, cfg,
                 out_path: str, checkpoint: str, log_path: str | None = None, trigger: dict | None = None, models=None):
    """Start the scoring stream. ``trigger`` e.g. {"availableNow": True}."""
    w = (requests.writeStream.foreachBatch(score_batch_fn(feature_loader, readiness, cfg, out_path, log_path, models))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(**(trigger or {"processingTime": "10 seconds"}))
    return w.start()


# --------------------------------------------------------------------------- T2

FIRST_SESSION_OUT = T.StructType(
    [T.StructField("app_id", T.StringType()), T.StructField("user_id", T.StringType()),
     T.StructField("t0", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in S.INAPP_FEATURES])
# Users are dealt into buckets by a hash of their key and a bucket's users share one state
# row: a call of a state function costs milliseconds whatever it is given, so a call a
# bucket (not one a user, for every batch and every timer) keeps the cost by rows. Fixed for
# the life of a checkpoint; raise it where a bucket's users outgrow a state row.
BUCKETS = 1024
NO_ID = -(1 << 63)             # a missing id among whole numbers


def _bucket(buckets: int, *key: str):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")


def _known(ident: str):
    return F.coalesce(F.col(ident), F.lit(NO_ID)).alias(ident)


def _longs() -> T.ArrayType:
    return T.ArrayType(T.LongType())


def _texts() -> T.ArrayType:
    return T.ArrayType(T.StringType())


_FS_STATE = T.StructType([
    T.StructField("app_id", _texts()), T.StructField("user_id", _texts()), T.StructField("t0_us", _longs()),
    T.StructField("install_id", _longs()), T.StructField("done", T.ArrayType(T.BooleanType())),
    T.StructField("n_ev", _longs()), T.StructField("ev_ts", _longs()), T.StructField("ev_id", _longs()), T.StructField("ev_type", _texts()),
])
_FEATURE_OF = {ev: feat for feat, ev in S.INAPP_EVENT_OF.items()}


def _session_row(key, t0_us: int, install_id: int, events, window_us: int) -> dict:
    counts = {c: 0.0 for c in S.INAPP_FEATURES}
    seen = set()
    total = 0
    for t, i, ty in events:
        if i == install_id != NO_ID or not t0_us <= t < t0_us + window_us or ty is None:
            continue
        total += 1
        seen.add(ty)
        if ty in _FEATURE_OF:
            counts[_FEATURE_OF[ty]] += 1.0
    counts["total_events"] = float(total)
    counts["n_event_types"] = float(len(seen))
    return {"app_id": key[0], "user_id": key[1], "t0": pd.Timestamp(t0_us, unit="us"), **counts}


class _Session:
    """A user's part of the state: the earliest install so far, the rows that may still
    count, and whether the row is out."""
    __slots__ = ("t0_us", "install_id", "done", "events")

    def __init__(self, t0_us=None, install_id=None, done=False, events=None) -> None:
        self.t0_us, self.install_id, self.done, self.events = t0_us, install_id, done, events or []


def _first_session_fn(window_us: int, flag_us: int):
    """State until the row is out: the earliest install so far and the rows that may still
    count. The watermark decides: a row at or before it can no longer arrive, so the
    window's row is final once the watermark reaches its end — in a data batch as well as
    on a timeout. Afterwards only the ``done`` flag stays, so that later sign-ups of the
    user give no second row, until the watermark is ``flag_us`` past the install. The
    bucket's timer is the earliest of its users'."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wm_ms = state.getCurrentWatermarkMs()
        wm_us = wm_ms * 1000
        users: dict[tuple, _Session] = {}
        if state.exists:
            *of_user, n_ev, ev_ts, ev_id, ev_type = state.get
            events, at = list(zip(ev_ts, ev_id, ev_type)), 0
            for app, user, t0_us, install_id, done, n in zip(*of_user, n_ev):
                if not (done and wm_us >= t0_us + flag_us):  # else rows of this batch begin anew
                    users[app, user] = _Session(t0_us, install_id, done, events[at:at + n])
                at += n
        if not state.hasTimedOut:
            for pdf in pdfs:
                tus = pdf["ts"].astype("datetime64[us]").astype(np.int64)
                for app, user, t, i, ty, inst in zip(*(c.tolist() for c in (pdf["app_id"], pdf["user_id"], tus, pdf["event_id"], pdf["event_type"], pdf["is_install"]))):
                    s = users.get((app, user))
                    if s is None:
                        s = users[app, user] = _Session()
                    if s.done:
                        continue
                    if inst and (s.t0_us is None or (t, i) < (s.t0_us, s.install_id)):
                        s.t0_us, s.install_id = t, i
                    s.events.append((t, i, ty))
        out, kept, due = [], [], []
        for name, s in users.items():
            if not s.done and s.t0_us is not None and wm_us >= s.t0_us + window_us:
                out.append(_session_row(name, s.t0_us, s.install_id, s.events, window_us))
                s.done, s.events = True, []
            if s.done:
                due.append(s.t0_us + flag_us)
            else:
                # an install that has yet to arrive lies after the watermark: rows before both it
                # and the present install cannot count; with an install, later rows cannot either
                low = wm_us if s.t0_us is None else min(s.t0_us, wm_us)
                s.events = [e for e in s.events if e[0] >= low and (s.t0_us is None or e[0] < s.t0_us + window_us)]
                if s.t0_us is None and not s.events:
                    continue
                due.append((s.t0_us if s.t0_us is not None else max(e[0] for e in s.events)) + window_us)
            kept.append((name, s))
        if kept:
            events = [e for _, s in kept for e in s.events]
            state.update(([n[0] for n, _ in kept], [n[1] for n, _ in kept], [s.t0_us for _, s in kept], [s.install_id for _, s in kept],
                          [s.done for _, s in kept], [len(s.events) for _, s in kept], *([e[k] for e in events] for k in range(3))))
            state.setTimeoutTimestamp(max(-(-min(due) // 1000), wm_ms + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=FIRST_SESSION_OUT.names)

    return fn


def five_minute_trigger(events: DataFrame, window_s: float = 300, watermark: str = "10 minutes",
                        flag_s: float = 90 * 86400, buckets: int = BUCKETS) -> DataFrame:
    """One row per installed user when event time passes t0 + window, with the
    in-app counts of [t0, t0 + window). One row per user, whatever the order of arrival
    within the watermark and however many sign-ups follow within ``flag_s`` of the install;
    the flag that ensures it is the only state kept of a finished user, and an event-time
    timer drops it then: state is bounded by the users of that time (a sign-up after it
    counts as a new user's). Anchored at the first open, so neither a tumbling
    window() nor a gap-based session_window() fits: a state with an event-time
    timer does, for the users of a bucket together (``BUCKETS``). Rows behind the watermark
    are dropped; a user without install in time produces nothing."""
    win_us = int(window_s * US_PER_SECOND)
    src = events.select(_bucket(buckets, "app_id", "user_id"), "app_id", "user_id", "ts", _known("event_id"), "event_type", "is_install").withWatermark("ts", watermark)
    return src.groupBy("bucket").applyInPandasWithState(
        _first_session_fn(win_us, max(win_us, int(flag_s * US_PER_SECOND))), FIRST_SESSION_OUT, _FS_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --------------------------------------------------------------------------- T3

STICKY_OUT = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("app_id", T.StringType()),
    T.StructField("airbridge_uuid", T.StringType()), T.StructField("model_version", T.StringType()),
    T.StructField("request_ts", T.TimestampType()), T.StructField("anchor_us", T.LongType()),
])
_STICKY_KEY = ("app_id", "airbridge_uuid", "model_version")
_STICKY_STATE = T.StructType([*[T.StructField(c, _texts()) for c in _STICKY_KEY], T.StructField("anchor_us", _longs()),
                              T.StructField("n", _longs()), T.StructField("ts", _longs()), T.StructField("ids", _longs())])


def _sticky_fn(ttl_us: int):
    """Requests wait in state until the watermark has reached them (no earlier one can
    follow), then are decided in event-time order, ties by request id."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wm_ms = state.getCurrentWatermarkMs()
        wm_us = wm_ms * 1000
        users: dict[tuple, list] = {}  # the anchor and the requests that wait
        if state.exists:
            *names, anchors, counts, ts, ids = state.get
            requests, at = list(zip(ts, ids)), 0
            for *name, anchor, n in zip(*names, anchors, counts):
                users[tuple(name)] = [anchor, requests[at:at + n]]
                at += n
        if not state.hasTimedOut:
            for pdf in pdfs:
                us = pdf["request_ts"].astype("datetime64[us]").astype(np.int64)
                for *name, t, i in zip(*(pdf[c].tolist() for c in _STICKY_KEY), us.tolist(), pdf["request_id"].tolist()):
                    users.setdefault(tuple(name), [None, []])[1].append((t, i))
        out, kept, due = [], [], []
        for name, (anchor, waiting) in users.items():
            waiting.sort()
            ready = bisect.bisect_right(waiting, wm_us, key=lambda w: w[0])
            for t, i in waiting[:ready]:
                if anchor is None or t - anchor >= ttl_us:
                    anchor = t
                out.append((i, *name, t, anchor))
            waiting = waiting[ready:]
            if waiting or anchor is not None and anchor + ttl_us > wm_us:
                kept.append((name, anchor, waiting))
                due.append(waiting[0][0] if waiting else anchor + ttl_us)
        if kept:
            requests = [w for *_, waiting in kept for w in waiting]
            state.update((*([k[0][c] for k in kept] for c in range(3)), [k[1] for k in kept], [len(k[2]) for k in kept],
                          [w[0] for w in requests], [w[1] for w in requests]))
            state.setTimeoutTimestamp(max(-(-min(due) // 1000), wm_ms + 1))
        elif state.exists:
            state.remove()
        if out:
            ids, *names, at, anchors = zip(*out)
            yield pd.DataFrame({"request_id": pd.array([None if i == NO_ID else i for i in ids], dtype="Int64"), **dict(zip(_STICKY_KEY, names)),
                                "request_ts": pd.to_datetime(list(at), unit="us"), "anchor_us": anchors})
    return fn


def sticky_decisions_stream(requests: DataFrame, ttl_s: float = S.DECISION_TTL_SECONDS,
                            watermark: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The anchored-TTL rule of W4 over a request stream, in event-time order whatever
    the order of arrival within the watermark: a request is decided once the watermark
    reaches it. State per (app, user, model_version), kept for the users of a bucket
    together (``BUCKETS``): the anchor and the requests that wait; dropped once event time
    passes anchor + TTL."""
    ttl_us = int(round(ttl_s * US_PER_SECOND))
    src = requests.select(_bucket(buckets, *_STICKY_KEY), _known("request_id"), *_STICKY_KEY, "request_ts") \
                  .withWatermark("request_ts", watermark)
    return src.groupBy("bucket").applyInPandasWithState(
        _sticky_fn(ttl_us), STICKY_OUT, _STICKY_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --------------------------------------------------------------------------- T4, T5, T6

def dedupe_requests_stream(requests: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """T4: one request per (app, user) while it is within the watermark (approximate TTL:
    expiry follows the watermark, not the strict 3600 s rule)."""
    return requests.withWatermark("request_ts", watermark) \
                   .dropDuplicatesWithinWatermark(["app_id", "airbridge_uuid"])


def log_stream(responses: DataFrame, log_path: str, checkpoint: str, trigger: dict | None = None):
    """T5: append flattened log rows per micro-batch; the batch id is written with the rows
    and a replayed batch overwrites its own partition only (idempotent). A failed write
    fails the batch, which is then retried from the checkpoint: no log row is lost."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = LG.flatten_for_log(batch).withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/batch_id={batch_id}")
    w = responses.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def late_touches_stream(events: DataFrame, watermark_us: int | None) -> DataFrame:
    """Touch rows that a rollup whose watermark stands at ``watermark_us`` drops: those of
    hours that ended at or before it (none before the first batch)."""
    t = events.where(F.col("touch_type").isNotNull()).withColumn("window_start", F.date_trunc("hour", "ts"))
    late = F.lit(False) if watermark_us is None else F.unix_micros("window_start") + 3600 * US_PER_SECOND <= watermark_us
    return t.where(late).select("app_id", "channel", "window_start", "touch_type")


def ad_touch_rollup_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Clicks and impressions per app, channel and tumbling hour; append mode emits a
    window once the watermark passes its end."""
    # event time advances with touch rows only (Catalyst pushes the filter below the
    # watermark operator anyway)
    t = events.withWatermark("ts", watermark).where(F.col("touch_type").isNotNull())
    return t.groupBy("app_id", "channel", F.window("ts", "1 hour")).agg(
        F.count_if(F.col("touch_type") == "click").alias("clicks"),
        F.count_if(F.col("touch_type") == "impression").alias("impressions"),
    ).select("app_id", "channel", F.col("window.start").alias("window_start"), "clicks", "impressions")
