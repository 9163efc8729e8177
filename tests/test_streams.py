"""Streams compared with the batch form of the same work, and the watchdog over several batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.operators import lifecycle
from palisade.streaming import events as streams, ingest, watchdog

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, scan_id bigint, ts timestamp, kind string"


def minutes(*rows):
    return [(i, scan, START + timedelta(minutes=m), kind) for i, (scan, m, kind) in enumerate(rows)]


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_sessions_of_a_hot_key_equal_the_stream(spark, tmp_path):
    rows = [(i, 1 if i % 3 else 2 + i % 5, START + timedelta(minutes=(i * 37) % 9000), "heartbeat") for i in range(2000)]
    write(spark, tmp_path, "in", rows)
    stream = streams.event_stream(spark, f"{tmp_path}/in", SCHEMA).withColumnRenamed("scan_id", "project_id")
    streamed = streams.run_to_end(stream, streams.sessions, f"{tmp_path}/run", "sessions")
    batch = lifecycle.activity_sessions(spark.read.parquet(f"{tmp_path}/in").withColumnRenamed("scan_id", "project_id"), "project_id")
    expected = {tuple(r) for r in batch.collect()}
    assert {tuple(r) for r in streamed.select(batch.columns).collect()} == expected and len(expected) > 10


def test_late_rows_are_dropped_and_hours_close_once(spark, tmp_path):
    run = f"{tmp_path}/run"
    stream = streams.event_stream(spark, f"{tmp_path}/in/*", SCHEMA, files_per_trigger=1)
    write(spark, f"{tmp_path}/in", "a", minutes((1, 5, "heartbeat"), (1, 50, "heartbeat"), (1, 200, "heartbeat")))
    streams.run_available(streams.hourly_activity(stream), run, "hours")
    write(spark, f"{tmp_path}/in", "b", minutes((1, 10, "heartbeat"), (1, 400, "heartbeat")))
    rows = streams.run_available(streams.hourly_activity(stream), run, "hours").orderBy("window_start").collect()
    assert [(r.window_start, r.events) for r in rows] == [(START, 2), (START + timedelta(hours=3), 1)]


def test_watchdog_keeps_state_between_batches(spark, tmp_path):
    run = f"{tmp_path}/run"
    stream = streams.event_stream(spark, f"{tmp_path}/in/*", SCHEMA, files_per_trigger=1)
    # Scan 1 goes quiet three times; scan 2 completes; scan 3 is queued again after it failed.
    write(spark, f"{tmp_path}/in", "a", minutes((1, 0, "queued"), (2, 0, "queued"), (2, 5, "completed"), (1, 10, "heartbeat"), (1, 40, "heartbeat")))
    first = streams.run_available(watchdog.watch(stream), run, "alarms").collect()
    assert [(r.scan_id, r.alarm_at - START, r.attempt, r.action) for r in first] == [(1, timedelta(minutes=25), 1, "requeued")]
    write(spark, f"{tmp_path}/in", "b", minutes((9, 100, "heartbeat")))
    write(spark, f"{tmp_path}/in", "c", minutes((1, 110, "heartbeat"), (9, 111, "completed"), (8, 200, "queued"), (8, 201, "failed")))
    write(spark, f"{tmp_path}/in", "d", minutes((1, 230, "heartbeat"), (1, 240, "queued"), (8, 300, "heartbeat")))
    rows = sorted((r.scan_id, int((r.alarm_at - START).total_seconds() // 60), r.attempt, r.action) for r in streams.run_available(watchdog.watch(stream), run, "alarms").collect())
    assert rows == [(1, 25, 1, "requeued"), (1, 55, 2, "requeued"), (1, 125, 3, "failed"), (1, 255, 1, "requeued")]


def test_repeated_uploads_are_dropped_on_the_stream(spark, tmp_path):
    schema = "upload_id bigint, sha256_checksum string, uploaded_at timestamp"
    rows = [(1, "a", START), (2, "b", START + timedelta(minutes=1)), (3, "a", START + timedelta(minutes=2))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    kept = streams.run_available(streams.new_uploads(stream), f"{tmp_path}/run", "uploads").collect()
    assert sorted(r.sha256_checksum for r in kept) == ["a", "b"]


def test_new_files_become_facts_once(spark, tmp_path):
    tree = tmp_path / "tree" / "shop"
    tree.mkdir(parents=True)
    out, state = f"{tmp_path}/facts", f"{tmp_path}/state"
    (tree / "a.py").write_text("eval(x)\n")
    ingest.ingest(spark, str(tmp_path / "tree"), out, state).awaitTermination()
    (tree / "b.py").write_text("exec(x)\n")
    (tree / "c.py").write_bytes(b"\x00")
    ingest.ingest(spark, str(tmp_path / "tree"), out, state, partitions=2).awaitTermination()
    rows = spark.read.parquet(out).filter("kind = 'call'").orderBy("relative_path").collect()
    assert [(r.project_id, r.relative_path, r.call.callee, r.batch) for r in rows] == [("shop", "a.py", "eval", 0), ("shop", "b.py", "exec", 1)]


NOW = datetime(2024, 1, 1, 12)
SCAN = "scan_id int, status string, attempts int, heartbeat_at timestamp, current_stage string, status_message string, worker_id string, completed_at timestamp, cancel_requested_at timestamp, deadline_at timestamp, error_message string, estimated_completion_at timestamp, progress int, broke boolean"


def test_stale_scans_are_requeued_or_failed(spark):
    hour, edge = NOW - timedelta(hours=1), NOW - timedelta(minutes=15)
    rows = [(1, "running", 1, hour), (2, "running", 3, None), (3, "running", 1, edge), (4, "queued", 9, None), (5, "running", 2, None)]
    scans = spark.createDataFrame([(*r, "s", "m", "w", None, None, None, None, NOW, 5, None) for r in rows], SCAN)
    got = {r.scan_id: (r.status, r.worker_id, r.project_status, r.completed_at) for r in lifecycle.recover_stale(scans, NOW).collect()}
    assert got == {1: ("queued", None, "scanning", None), 2: ("failed", "w", "failed", NOW), 3: ("running", "w", None, None), 4: ("queued", "w", None, None), 5: ("queued", None, "scanning", None)}


def test_cancellation_wins_over_the_deadline(spark):
    rows = [(1, NOW, NOW), (2, None, NOW), (3, None, NOW + timedelta(seconds=1)), (4, None, None), (5, None, None)]
    scans = spark.createDataFrame([(i, "running", 1, None, "s", "m", "w", None, c, d, None, NOW, 100, i == 5) for i, c, d in rows], SCAN)
    got = {r.scan_id: (r.status, r.current_stage, r.project_status) for r in lifecycle.check_control(scans, NOW).collect()}
    assert got == {1: ("cancelled", "cancelled", "ready"), 2: ("failed", "timed_out", "failed"), 3: ("running", "s", None), 4: ("running", "s", None), 5: ("failed", "failed", "failed")}
    assert {r.scan_id: (r.progress, r.error_message) for r in lifecycle.check_control(scans, NOW).collect()} == {
        1: (100, None), 2: (100, "Security scan timed out."), 3: (100, None), 4: (100, None), 5: (99, "Security scan failed.")}


def test_a_finished_scan_is_not_cancelled(spark):
    scans = spark.createDataFrame([(1, "completed", 1, None, "completed", "m", "w", NOW, None, None, None, NOW, 100, None)], SCAN)
    before, after = scans.first(), lifecycle.request_cancellation(scans, NOW).first()
    assert not after.accepted and all(after[c] == before[c] for c in scans.columns)


def test_intermediates_need_a_shared_folder():
    from types import SimpleNamespace

    from palisade.session import shared_folder

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://cluster:7077")), "table")


def test_estimates(spark):
    sizes = spark.createDataFrame([(None,), (0,), (1024 * 1024 + 1,), (10**12,)], "b bigint")
    assert [r[0] for r in sizes.select(lifecycle.initial_estimate_seconds(F.col("b"))).collect()] == [30, 30, 33, 1800]
    rows = spark.createDataFrame([(NOW - timedelta(seconds=60), p) for p in (29, 30, 60, 99, 100)], "started timestamp, p int")
    ends = [r[0] for r in rows.select(lifecycle.seconds_remaining(lifecycle.remaining_estimate(F.col("started"), NOW, F.col("p")), NOW)).collect()]
    assert ends == [None, 140, 40, 5, None]


def test_thinning_a_busy_scan_keeps_its_ends(spark):
    import pandas as pd

    seconds = [(1, i, START + timedelta(seconds=i), "heartbeat") for i in range(150)] + [(1, 200, START + timedelta(seconds=75, milliseconds=500), "completed")]
    frame = pd.DataFrame(seconds, columns=["scan_id", "event_id", "ts", "kind"])
    kept = next(watchdog.thin(iter([frame])))
    assert list(kept["event_id"]) == [0, 59, 60, 75, 200, 76, 119, 120, 149]
