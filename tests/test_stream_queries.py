"""Registered stream queries: late rows, bounded flags, replayed batches."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from onramp.operators import evaluate as EV
from onramp.plans import catalog as C
from onramp.plans import streams as SQ
from onramp.sources.events import read_events
from onramp.streaming import replay as RP
from onramp.streaming import stream_ops as ST
from test_streaming import _hand_made, _run


def test_rollup_accounts_for_every_row(spark):
    got = SQ.q_touch_rollup_stream(spark, SF_SMALL)
    want = EV.touch_rollup(read_events(spark, SF_SMALL)).withColumn("window_start", F.date_format("window_start", C.TS_FMT))
    both = got.join(want.withColumnRenamed("clicks", "c").withColumnRenamed("impressions", "i"), ["app_id", "channel", "window_start"], "full")
    assert both.where("clicks + impressions + late IS DISTINCT FROM c + i").count() == 0
    late, on_time = got.agg(F.sum("late"), F.sum(F.col("clicks") + F.col("impressions"))).first()
    assert late > 0 and on_time > late


def test_replayed_batch_and_restart_lose_nothing(spark):
    """The score table and its log hold one row per served request, after four runs from one
    checkpoint and one batch handed over twice."""
    sink = spark.read.parquet(SQ._sticky_sink(spark, SF_SMALL, 3600)).where("request_id >= 0")
    out, log = SQ._score_run(spark, SF_SMALL)
    served = spark.read.parquet(out)
    assert served.count() == served.select("request_id").distinct().count() == sink.count() == spark.read.parquet(log).count() > 0


def test_first_session_flag_is_dropped(spark, tmp_path):
    """A sign-up within the flag's time gives no second row, one long after does."""
    files = [[(1, 0, 7, "signup"), (2, 1, 7, "view")], [(3, 60, 7, "signup")], [(4, 300, 8, "view")], [(5, 3000, 7, "signup"), (6, 3001, 7, "view")], [(7, 9000, 9, "view")]]
    for flag_s, rows in ((90 * 86400, 1), (2 * 3600, 2)):
        d = tmp_path / str(flag_s)
        os.makedirs(d)
        _hand_made(str(d), files)
        stream = ST.read_events_stream(spark, str(d), max_files_per_trigger=1)
        got = _run(ST.five_minute_trigger(stream, window_s=300, watermark="1 minute", flag_s=flag_s), f"t2_flag_{flag_s}").collect()
        assert [r.total_events for r in got] == [1.0] * rows


def test_slices_cover_all_times(spark):
    rows = spark.range(101).withColumn("at", F.col("id") * 7 - 20)
    low, high = RP.bounds(rows, F.col("at"))
    got = [r.n for r in rows.select(RP.slice_of(F.col("at"), low, high, 4).alias("n")).orderBy("id").collect()]
    assert got == sorted(got) and set(got) == {0, 1, 2, 3}
    assert RP.bounds(rows.limit(0), F.col("at")) == (0, 0)


def test_score_batches_do_not_follow_the_number_of_files(spark, tmp_path):
    """T1 takes the sink up in as many batches as the replay has slices, at most, whatever
    the number of files in it: every batch reads the whole feature table."""
    path = str(tmp_path / "many")
    spark.range(0, 100, 1, 50).write.parquet(path)
    rows = spark.read.parquet(path)
    n = RP.files_per_batch(rows, SQ.SLICES)
    assert -(-len(rows.inputFiles()) // n) == SQ.SLICES
    assert RP.files_per_batch(rows.limit(0).coalesce(1), SQ.SLICES) >= 1
    out, _ = SQ._score_run(spark, SF_SMALL)
    assert 1 < spark.read.parquet(out).select("batch_id").distinct().count() <= SQ.SLICES


def test_state_functions_are_called_by_bucket(spark, tmp_path):
    """One state row holds the users of a bucket: 40 users in 3 buckets give at most 3 state
    rows, and every user has a row."""
    d = str(tmp_path / "events")
    os.makedirs(d)
    users = list(range(40))
    _hand_made(d, [[(2 * u, 0, u, "signup") for u in users] + [(2 * u + 1, u % 5, u, "view") for u in users], [(900, 3000, 99, "view")], [(901, 9000, 99, "view")]])
    stream = ST.read_events_stream(spark, d, max_files_per_trigger=1)
    q = (ST.five_minute_trigger(stream, window_s=300, watermark="1 minute", buckets=3).writeStream.format("memory").queryName("t2_buckets")
         .outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start())
    q.awaitTermination()
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 3
    got = spark.table("t2_buckets").collect()
    assert sorted(int(r.user_id) for r in got) == users and all(r.total_events == 1.0 for r in got)


def test_sticky_bucket_equals_rule(spark, tmp_path):
    """Requests of many users in one bucket are decided by the anchored rule of each user."""
    d = str(tmp_path / "requests")
    rows = [(u * 100 + k, "a" if u % 2 else None, f"u{u}", "v", 1_000_000_000 + k * 900 * (1 + u % 3)) for u in range(9) for k in range(8)]
    end = [(-1, "end", "end", "end", 1_100_000_000), (-2, "end", "end", "end", 1_100_000_001)]
    for part in (rows, end[:1], end[1:]):
        spark.createDataFrame(part, "request_id long, app_id string, airbridge_uuid string, model_version string, s long").select(
            "request_id", "app_id", "airbridge_uuid", "model_version", F.timestamp_seconds("s").alias("request_ts")).coalesce(1).write.mode("append").parquet(d)
    stream = spark.readStream.schema(spark.read.parquet(d).schema).parquet(d)
    got = _run(ST.sticky_decisions_stream(stream, ttl_s=3600, watermark="1 minute", buckets=1), "t3_bucket").where("request_id >= 0").collect()
    want = {}
    for u in range(9):
        anchor = None
        for k in range(8):
            at = (1_000_000_000 + k * 900 * (1 + u % 3)) * 1_000_000
            anchor = at if anchor is None or at - anchor >= 3600 * 1_000_000 else anchor
            want[u * 100 + k] = anchor
    assert {r.request_id: r.anchor_us for r in got} == want
