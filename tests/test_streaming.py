"""Stream = batch: replay driver events through Structured Streaming (availableNow)."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from onramp.operators import evaluate as EV
from onramp.operators import features as FT
from onramp.operators import policy as PO
from onramp.sources.events import read_events
from onramp.streaming import stream_ops as ST


@pytest.fixture(scope="module")
def replay_dir(tmp_path_factory):
    """Driver events split into time-ordered files plus a far-future sentinel row, so
    event-time timers fire for every user."""
    d = tmp_path_factory.mktemp("events_replay")
    t = pq.read_table(f"{SF_CHECK}/events.parquet").sort_by("ts")
    n = t.num_rows
    step = (n + 7) // 8
    for i in range(8):
        pq.write_table(t.slice(i * step, step), os.path.join(d, f"part-{i:02d}.parquet"))
    import datetime as dt
    import pyarrow as pa
    sentinel = pa.table({
        "event_id": pa.array([10 ** 12], pa.int64()),
        "ts": pa.array([dt.datetime(2030, 1, 1)], t.schema.field("ts").type),
        "user_id": pa.array([10 ** 9], pa.int64()),
        "event_type": ["view"], "value": [0.0], "props": ['{"k": 1}']})
    pq.write_table(sentinel.cast(t.schema), os.path.join(d, "part-99.parquet"))
    return str(d)


def _run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def _write_in_turn(table, folder, n, sentinel, seed=None):
    """``n`` files and then the sentinel's, with rising modification times (the order in
    which the file source takes them). With a seed the rows are dealt at random: every
    file holds rows of all times."""
    import numpy as np
    order = np.arange(table.num_rows) if seed is None else np.random.default_rng(seed).permutation(table.num_rows)
    parts = [table.take(order[i::n] if seed is not None else order[i * len(order) // n:(i + 1) * len(order) // n]) for i in range(n)]
    for i, part in enumerate([*parts, sentinel]):
        path = os.path.join(folder, f"part-{i:02d}.parquet")
        pq.write_table(part, path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.fixture(scope="module")
def shuffled_dir(tmp_path_factory, replay_dir):
    import datetime as dt
    import pyarrow as pa
    d = str(tmp_path_factory.mktemp("events_shuffled"))
    t = pq.read_table(f"{SF_CHECK}/events.parquet")
    end = pq.read_table(os.path.join(replay_dir, "part-99.parquet"))
    end = end.set_column(end.schema.get_field_index("ts"), "ts", pa.array([dt.datetime(2090, 1, 1)], t.schema.field("ts").type))
    _write_in_turn(t, d, 6, end.cast(t.schema), seed=3)
    return d


def _first_session_rows(df):
    cols = ["app_id", "user_id", "product_viewed_count", "home_viewed", "total_events", "n_event_types"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _first_sessions(spark, window_s):
    """Batch form; users with no in-app event in the window are absent there: fill 0."""
    ev = read_events(spark, SF_CHECK)
    inst = FT.installs(ev)
    want = FT.inapp_features(FT.attach_install(ev, inst), window_s=window_s)
    return _first_session_rows(inst.select("app_id", "user_id").join(want, ["app_id", "user_id"], "left").na.fill(0.0))


@pytest.mark.parametrize("window_s", [24 * 3600, 300])   # fixture window and product default
def test_first_session_stream_equals_batch(spark, replay_dir, window_s):
    stream = ST.read_events_stream(spark, replay_dir, max_files_per_trigger=1)
    got = _run(ST.five_minute_trigger(stream, window_s=window_s, watermark="1 hour"), f"t2_out_{window_s}")
    assert _first_session_rows(got) == _first_sessions(spark, window_s)   # rows, not users: one each


def test_first_session_out_of_order(spark, shuffled_dir):
    stream = ST.read_events_stream(spark, shuffled_dir, max_files_per_trigger=1)
    got = _run(ST.five_minute_trigger(stream, window_s=86400, watermark="9000 days"), "t2_shuffled")
    assert _first_session_rows(got) == _first_sessions(spark, 86400)


def _hand_made(folder, files, start="2024-03-01"):
    """One parquet file per list of (event id, minutes, user, type)."""
    import datetime as dt
    import pyarrow as pa
    base = dt.datetime.fromisoformat(start)
    schema = pq.read_schema(f"{SF_CHECK}/events.parquet")
    for n, rows in enumerate(files):
        t = pa.table({"event_id": [r[0] for r in rows], "ts": [base + dt.timedelta(minutes=r[1]) for r in rows], "user_id": [r[2] for r in rows],
                      "event_type": [r[3] for r in rows], "value": [0.0] * len(rows), "props": ['{"k": 1}'] * len(rows)}).cast(schema)
        path = os.path.join(folder, f"f{n:02d}.parquet")
        pq.write_table(t, path)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def test_first_session_emits_once_and_in_time(spark, tmp_path):
    # a second sign-up after the row is out, and rows that keep arriving after the window
    _hand_made(str(tmp_path), [[(1, 0, 7, "signup"), (2, 2, 7, "view")], [(3, 30, 7, "view")], [(4, 60, 7, "signup")],
                               [(5, 90, 7, "view"), (6, 61, 7, "view")], [(7, 500, 8, "view")], [(8, 2000, 9, "view")]])
    stream = ST.read_events_stream(spark, str(tmp_path), max_files_per_trigger=1)
    rows = _run(ST.five_minute_trigger(stream, window_s=300, watermark="1 minute"), "t2_once").collect()
    assert [(r.user_id, r.total_events) for r in rows] == [(rows[0].user_id, 1.0)]


def _request_table(spark):
    ev = read_events(spark, SF_CHECK)
    return (ev.where(F.col("touch_type") == "click").join(FT.installs(ev), ["app_id", "user_id"])
            .where(F.col("ts") > F.col("t0"))
            .select(F.col("event_id").alias("request_id"), "app_id", F.col("user_id").cast("string").alias("airbridge_uuid"),
                    F.lit("v1").alias("model_version"), F.col("ts").alias("request_ts")))


@pytest.mark.parametrize("seed,watermark", [(None, "48 hours"), (5, "9000 days")])
def test_sticky_stream_equals_batch(spark, tmp_path, seed, watermark):
    import datetime as dt
    import pyarrow as pa
    req = _request_table(spark)
    want = sorted((r.request_id, r.anchor_us) for r in PO.sticky_decisions(req, ttl_s=86400).collect())
    req.coalesce(1).write.parquet(str(tmp_path / "all"))
    t = pq.read_table(str(tmp_path / "all")).sort_by("request_ts")
    t = t.set_column(4, "request_ts", t["request_ts"].cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")))
    end = pa.table({"request_id": [-1], "app_id": ["end"], "airbridge_uuid": ["end"], "model_version": ["v1"],
                    "request_ts": pa.array([dt.datetime(2090, 1, 1)], pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))})
    os.makedirs(tmp_path / "in")
    _write_in_turn(t, str(tmp_path / "in"), 6, end, seed=seed)
    stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(ST.sticky_decisions_stream(stream, ttl_s=86400, watermark=watermark), f"t3_out_{seed}")
    assert sorted((r.request_id, r.anchor_us) for r in got.where("request_id >= 0").collect()) == want


def test_sticky_stream_decides_in_event_time_order(spark, tmp_path):
    import datetime as dt
    import pyarrow as pa
    at = lambda h, m=0: dt.datetime(2024, 3, 1, h, m)
    schema = "request_id long, app_id string, airbridge_uuid string, model_version string, request_ts timestamp"
    files = [[(1, at(2))], [(2, at(0, 30))], [(3, at(1, 0)), (4, at(1, 45))], [(9, at(23))], [(10, dt.datetime(2024, 3, 3))]]
    for n, rows in enumerate(files):
        d = str(tmp_path / f"w{n}")
        spark.createDataFrame([(i, "a", "u" if i < 9 else "z", "v", t) for i, t in rows], schema).coalesce(1).write.parquet(d)
        name = next(f for f in os.listdir(d) if f.endswith(".parquet"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        dst = str(tmp_path / "in" / f"{n}.parquet")
        t = pq.read_table(os.path.join(d, name))
        pq.write_table(t.set_column(4, "request_ts", t["request_ts"].cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))), dst)
        os.utime(dst, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(ST.sticky_decisions_stream(stream, ttl_s=3600, watermark="3 hours"), "t3_order")
    us = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert {r.request_id: r.anchor_us for r in got.where("airbridge_uuid = 'u'").collect()} == {
        2: us(at(0, 30)), 3: us(at(0, 30)), 4: us(at(1, 45)), 1: us(at(1, 45))}


def test_replayed_batch_replaces_its_log(spark, tmp_path):
    from onramp.operators.logs import append_prediction_log
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "x int, app_id string").withColumn("timestamp", F.current_timestamp())
    for _ in range(2):
        assert append_prediction_log(rows, str(tmp_path / "log"), batch_id=7)
    assert append_prediction_log(rows.limit(1), str(tmp_path / "log"), batch_id=8)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_touch_rollup_stream_equals_batch(spark, replay_dir):
    stream = ST.read_events_stream(spark, replay_dir, max_files_per_trigger=3)
    got = _run(ST.ad_touch_rollup_stream(stream, watermark="1 hour"), "t6_out")
    want = EV.touch_rollup(read_events(spark, SF_CHECK))
    key = ["app_id", "channel", "window_start"]
    g = sorted(tuple(r) for r in got.select(*key, "clicks", "impressions").collect())
    w = sorted(tuple(r) for r in want.select(*key, "clicks", "impressions").collect())
    assert g == w


def test_dedupe_stream_runs(spark, replay_dir):
    stream = ST.read_events_stream(spark, replay_dir, max_files_per_trigger=4)
    req = stream.where(F.col("touch_type") == "click").select(
        "app_id", F.col("user_id").alias("airbridge_uuid"), F.col("ts").alias("request_ts"))
    got = _run(ST.dedupe_requests_stream(req, watermark="1 hour"), "t4_out")
    n_users = got.select("app_id", "airbridge_uuid").distinct().count()
    assert got.count() >= n_users > 0


def test_log_stream_idempotent_batches(spark, replay_dir, tmp_path):
    from onramp.operators import scoring as SC
    from onramp import params as P
    stream = ST.read_events_stream(spark, replay_dir, max_files_per_trigger=4)
    resp = stream.where(F.col("touch_type") == "click").select(
        "app_id", F.col("user_id").alias("airbridge_uuid"), *[F.lit(0.0).alias(c) for c in
                                                              __import__("onramp.schema").schema.ALL_FEATURES])
    resp = SC.score_triggers(resp, P.TRIGGER)
    from onramp.operators.policy import assign_trigger
    resp = assign_trigger(resp, F.lit(True), "s")
    resp = SC.score_binary(resp, P.D3_PURCHASE, P.D3_CHURN).withColumn("pltv_tier", F.lit(None).cast("string")) \
             .withColumn("pltv_percentile", F.lit(None).cast("int"))
    q = ST.log_stream(resp, str(tmp_path / "log"), str(tmp_path / "ckpt"), trigger={"availableNow": True})
    q.awaitTermination()
    logged = spark.read.parquet(str(tmp_path / "log"))
    assert logged.count() == spark.read.parquet(f"{replay_dir}").where("event_type = 'click'").count()


def test_score_stream_equals_batch(spark, tmp_path):
    """Requests arriving as files are scored per micro-batch against the current
    feature table; the output equals batch scoring of the same requests."""
    from onramp import schema as S
    from onramp.operators import lookup as LK
    from onramp.operators import ltv as LT
    from onramp.plans import catalog as C
    from onramp.plans import score as SP
    fx = C.fixture(spark, SF_CHECK)
    req_dir, feat_dir = str(tmp_path / "req"), str(tmp_path / "feat")
    fx.requests.repartition(4).write.parquet(req_dir)
    fx.features_with_duplicates.write.parquet(feat_dir)
    rd = LK.app_readiness(fx.inventory)
    cfg = C._tier_cfg(fx)
    stream = spark.readStream.schema(fx.requests.schema).option("maxFilesPerTrigger", 2).parquet(req_dir)
    q = ST.score_stream(stream, lambda s: s.read.parquet(feat_dir), rd, cfg, str(tmp_path / "out"),
                        str(tmp_path / "ckpt"), log_path=str(tmp_path / "log"), trigger={"availableNow": True})
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    feats = LK.latest_per_key(spark.read.parquet(feat_dir))
    hit = fx.requests.join(rd.where("ready").select("app_id"), "app_id").join(feats, S.KEY)
    want = LT.assign_tier(SP.score_rows(hit.select("request_id", "request_ts", "app_id", "airbridge_uuid",
                                                   *S.ALL_FEATURES), rd,
                                        draw_extra=[F.unix_micros("request_ts")]), cfg)
    cols = ["request_id", "best_trigger", "is_random", "d3_purchase_prob", "pltv_tier", "pltv_percentile"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())
    assert spark.read.parquet(str(tmp_path / "log")).count() == got.count()


def test_sticky_then_score_stream_equals_batch(spark, tmp_path):
    """T3 -> T1: the streaming request path (sticky state, then per-batch scoring keyed by
    the decision anchor) gives the batch ``score_requests`` rows."""
    from onramp.operators import lookup as LK
    from onramp.plans import catalog as C
    fx = C.fixture(spark, SF_CHECK)
    rd = LK.app_readiness(fx.inventory)
    cfg = C._tier_cfg(fx)
    req_dir, feat_dir = str(tmp_path / "req"), str(tmp_path / "feat")
    req = fx.requests.join(rd.where("ready").select("app_id", "model_version"), "app_id")
    # arrival order = event-time order: one file per time range, written one after the
    # other (the file source takes files in modification-time order)
    import time as _time
    bounds = req.select(F.percentile_approx(F.unix_micros("request_ts"), [i / 6 for i in range(1, 6)],
                                            100000)).first()[0]
    edges = [None] + list(bounds) + [None]
    for i in range(6):
        part = req
        if edges[i] is not None:
            part = part.where(F.unix_micros("request_ts") > edges[i])
        if edges[i + 1] is not None:
            part = part.where(F.unix_micros("request_ts") <= edges[i + 1])
        part.coalesce(1).write.mode("append").parquet(req_dir)
        _time.sleep(1.1)
    last = req.limit(1).withColumn("request_ts", F.lit("2090-01-01 00:00:00").cast(req.schema["request_ts"].dataType))
    last.withColumn("airbridge_uuid", F.lit("nobody").cast(req.schema["airbridge_uuid"].dataType)).coalesce(1).write.mode("append").parquet(req_dir)
    fx.features_with_duplicates.write.parquet(feat_dir)
    stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 2).parquet(req_dir)
    sticky = ST.sticky_decisions_stream(stream, ttl_s=3600, watermark="2 hours")
    q = ST.score_stream(sticky, lambda s: s.read.parquet(feat_dir), rd, cfg, str(tmp_path / "out"),
                        str(tmp_path / "ckpt"), trigger={"availableNow": True}, models=lambda s: fx.models)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = C._requests_scored(spark, SF_CHECK)
    # requests whose key has no feature row are refused in both forms
    cols = ["request_id", "anchor_us", "best_trigger", "is_random", "d3_purchase_prob", "pltv_tier", "pltv_percentile"]
    g = sorted(tuple(r) for r in got.select(*cols).collect())
    w = sorted(tuple(r) for r in want.select(*cols).collect())
    assert g == w and len(g) > 0
