"""Versioned tables: what a version holds, writes that die, and tables that streams keep."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.operators import lifecycle
from palisade.sources import commits, snapshots
from palisade.streaming import deadlines, events as streams, tables

SCHEMA = "project_id long, path string, nested array<struct<a:int,b:string>>"
START = datetime(2024, 1, 1)


def rows(spark, *found):
    return spark.createDataFrame([(p, path, [(1, path)]) for p, path in found], SCHEMA)


def held(frame):
    return sorted((r.project_id, r.path, r.nested[0].b) for r in frame.collect())


def test_versions_stay_as_they_were(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.replace(rows(spark, (1, "a"), (1, "b"), (2, "c"), (None, "n")), root, ["project_id"], 10) == 1
    scope = spark.createDataFrame([(1,), (3,), (9,)], "project_id long")
    assert snapshots.replace(rows(spark, (1, "z"), (3, "d")), root, ["project_id"], 20, scope) == 2
    assert snapshots.replace(rows(spark), root, ["project_id"], 30, spark.createDataFrame([(2,)], "project_id long")) == 3
    first = [(1, "a", "a"), (1, "b", "b"), (2, "c", "c")]
    known = lambda label=None: held(snapshots.read(spark, root, label).filter("project_id is not null"))
    assert known(10) == known(19) == first
    assert known(20) == [(1, "z", "z"), (2, "c", "c"), (3, "d", "d")]
    assert known() == known(99) == [(1, "z", "z"), (3, "d", "d")]
    assert all(snapshots.read(spark, root, n).filter("project_id is null").count() == 1 for n in (10, 20, 30))
    with pytest.raises(ValueError, match="no version"):
        snapshots.read(spark, root, 9)


def test_only_buckets_of_changed_keys_are_written(spark, tmp_path):
    root = str(tmp_path)
    snapshots.replace(rows(spark, *((i, "a") for i in range(500))), root, ["project_id"], 1)
    before = snapshots.latest(root)["folders"]
    snapshots.replace(rows(spark, (7, "b")), root, ["project_id"], 2)
    after = snapshots.latest(root)["folders"]
    assert len([b for b in before if before[b] != after[b]]) == 1
    (changed,) = {f for f in after.values()} - set(before.values())
    assert 1 < spark.read.parquet(changed).count() < 30 and snapshots.read(spark, root).count() == 500


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    snapshots.replace(rows(spark, (1, "a")), root, ["project_id"], 1)
    # While the rows are written, and after that but before the commit.
    broken = rows(spark, (1, "b")).withColumn("path", F.expr("raise_error('gone')").cast("string"))
    with pytest.raises(Exception, match="gone"):
        snapshots.replace(broken, root, ["project_id"], 2)
    monkeypatch.setattr(commits, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        snapshots.replace(rows(spark, (1, "c")), root, ["project_id"], 2)
    monkeypatch.undo()
    assert held(snapshots.read(spark, root)) == [(1, "a", "a")] and list(commits.entries(root)) == [1]
    snapshots.replace(rows(spark, (1, "d"), (2, "e")), root, ["project_id"], 2)
    assert held(snapshots.read(spark, root, 1)) == [(1, "a", "a")] and held(snapshots.read(spark, root)) == [(1, "d", "d"), (2, "e", "e")]
    assert snapshots.vacuum(root) >= 2
    assert held(snapshots.read(spark, root)) == [(1, "d", "d"), (2, "e", "e")] and list(commits.entries(root)) == [2]
    with pytest.raises(FileExistsError):
        commits.commit(root, 2, {})


EVENTS = "event_id long, project_id long, ts timestamp, kind string, progress double"


def some_events(count=200):
    kinds = ("queued", "heartbeat", "progress", "completed")
    return [(i, i * 7 % 11, START + timedelta(seconds=(i * 37) % 900), kinds[i % 4], float((i * 13) % 140 - 10)) for i in range(count)]


@pytest.mark.parametrize("cuts", [[200], [1, 2, 3, 200], [50, 50, 120, 200]])
def test_the_kept_state_does_not_depend_on_batches(spark, tmp_path, cuts):
    root, found = str(tmp_path), some_events()
    begin = 0
    for number, end in enumerate(cuts):
        batch = spark.createDataFrame(found[begin:end], EVENTS)
        tables.fold_progress(batch, root, number)
        assert tables.fold_progress(batch, root, number) is None  # again
        begin = end
    if len(cuts) > 1:
        assert tables.fold_progress(spark.createDataFrame(found[:9], EVENTS), root, 0) is None
    expected = lifecycle.current_progress(spark.createDataFrame(found, EVENTS), ["project_id"])
    assert sorted(tables.scan_states(spark, root).collect()) == sorted(expected.collect())


def test_late_rows_are_led_aside_and_add_up(spark, tmp_path):
    root = str(tmp_path)
    minute = lambda m, i=0: (i, 1, START + timedelta(minutes=m), "heartbeat", 0.0)
    for number, batch in enumerate(([minute(60), minute(0)], [minute(50), minute(49), minute(100)], [minute(95), minute(55, 5), (9, None, None, "queued", None)])):
        frame = spark.createDataFrame(batch, EVENTS)
        tables.fold_windows(frame, root, number, "15 minutes", timedelta(minutes=10))
        tables.fold_windows(frame, root, number, "15 minutes", timedelta(minutes=10))
    late = tables.late_rows(spark, root, EVENTS)
    assert sorted((r.ts.hour * 60 + r.ts.minute, r.batch) for r in late.collect()) == [(49, 1), (55, 2)]
    assert snapshots.read(spark, root).agg(F.sum("events")).first()[0] == 5  # the row without a time is in no window
    hours = {(r.window_start - START).total_seconds() / 60: r.events for r in tables.window_counts(spark, root).collect()}
    assert hours[0] == 2 and hours[60] == 3 and hours[-45] == 1


def test_a_batch_that_dies_meets_the_same_watermark_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    at = lambda m: spark.createDataFrame([(1, 1, START + timedelta(minutes=m), "heartbeat", 0.0)], EVENTS)
    fold = lambda frame, number: tables.fold_windows(frame, root, number, "15 minutes", timedelta(minutes=10))
    fold(at(60), 0)
    monkeypatch.setattr(snapshots, "merge", lambda *_, **__: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        fold(at(10), 1)
    monkeypatch.undo()
    fold(at(10), 1)
    assert tables.late_rows(spark, root, EVENTS).count() == 1 and snapshots.read(spark, root).agg(F.sum("events")).first()[0] == 1


def test_sliding_windows_on_a_stream_equal_the_batch_form(spark, tmp_path):
    schema = "event_id long, ts timestamp, kind string"
    found = [(i, START + timedelta(seconds=i * 97), "ab"[i % 2]) for i in range(300)]
    spark.createDataFrame(found, schema).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = streams.event_stream(spark, f"{tmp_path}/in", schema)
    done = streams.run_to_end(stream, streams.sliding_activity, str(tmp_path), "sliding")
    assert sorted(done.collect()) == sorted(lifecycle.sliding_activity(spark.createDataFrame(found, schema)).collect())


DEADLINE = "scan_id long, event_id long, ts timestamp, kind string, deadline_at timestamp"


def test_the_first_end_of_a_scan_counts(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    found = [(s, s * 10, at(0), "queued", at(600) if s != 5 else None) for s in range(1, 8)]
    found += [(1, 1001, at(100), "cancel", None), (2, 1002, at(700), "broke", None), (3, 1003, at(300), "broke", None), (4, 1004, at(200), "completed", None),
              (5, 1005, at(800), "heartbeat", None), (6, 1006, at(600), "cancel", None), (3, 1007, at(400), "cancel", None), (4, 1008, at(900), "broke", None)]
    for step, part in enumerate((found[:9], found[9:])):
        spark.createDataFrame(part, DEADLINE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.event_stream(spark, f"{tmp_path}/in", DEADLINE, files_per_trigger=1)
    done = streams.run_to_end(stream, lambda e: deadlines.ended(e, "1 hour"), str(tmp_path), "ended").collect()
    assert {r.scan_id: (r.status, r.current_stage, (r.ended_at - START).total_seconds()) for r in done if r.scan_id} == {
        1: ("cancelled", "cancelled", 100), 2: ("failed", "timed_out", 600), 3: ("failed", "failed", 300), 6: ("cancelled", "cancelled", 600), 7: ("failed", "timed_out", 600)}
    assert len(done) == 5


def test_one_scan_with_all_events_keeps_several_tasks_busy(spark):
    found = spark.range(20_000).selectExpr(
        "1L as scan_id", "id as event_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 30) as ts", "'heartbeat' as kind", "cast(null as timestamp) as deadline_at")
    rows = deadlines.combined(found, "1 minute")
    assert rows.count() <= deadlines.SALTS * 2
    spread = spark.createDataFrame([(i,) for i in range(20_000)], "event_id long").select(F.pmod(F.xxhash64("event_id"), F.lit(deadlines.SALTS)).alias("salt")).groupBy("salt").count()
    assert spread.count() == deadlines.SALTS and spread.agg(F.max("count")).first()[0] < 20_000 / deadlines.SALTS * 1.3


def test_scans_of_one_bucket_end_each_for_itself(spark, tmp_path):
    """More scans than buckets: one timer a bucket, deadlines on both sides of the watermark and on it, and events over two batches."""
    at = lambda s: START + timedelta(seconds=s)
    first = [(i, i, "queued", at(0), at(600 + i)) for i in range(1, 41)] + [(i, 100 + i, "heartbeat", at(30), None) for i in range(1, 41)]
    second = [(5, 205, "cancel", at(601), None), (6, 206, "completed", at(602), None), (7, 207, "broke", at(9), None), (8, 208, "queued", at(90), at(9000)), (None, 209, "cancel", at(5), None)]
    schema = "scan_id bigint, event_id bigint, kind string, ts timestamp, deadline_at timestamp"
    for found in (first, second):
        spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    # The last mark is at 630 s: the deadline of scan 30 is on it.
    done = streams.run_to_end(stream, lambda e: deadlines.ended(e, "1 hour", buckets=2), str(tmp_path), "ended", str(at(4230))).collect()
    ended = {r.scan_id: (r.current_stage, (r.ended_at - START).total_seconds()) for r in done}
    late = {i: ("timed_out", 600 + i) for i in range(1, 30) if i not in (5, 6, 7, 8)}
    assert len(done) == len(ended) and {k: v for k, v in ended.items() if k != 30} == {**late, 5: ("cancelled", 601), 7: ("failed", 9), None: ("cancelled", 5)}


def test_heartbeats_take_no_state(spark):
    found = spark.range(1000).selectExpr(
        "id as scan_id", "id as event_id", "timestamp '2024-01-01' as ts", "if(id < 10, 'cancel', 'heartbeat') as kind", "cast(null as timestamp) as deadline_at")
    assert deadlines.combined(found, "1 minute").count() == 10


def test_a_stream_leaves_the_settings_of_the_session(spark, tmp_path):
    before = spark.conf.get(streams.STATE_STORE[0], None)
    spark.createDataFrame([(1, START, "a")], "event_id long, ts timestamp, kind string").write.parquet(f"{tmp_path}/in")
    streams.run_available(streams.event_stream(spark, f"{tmp_path}/in", "event_id long, ts timestamp, kind string"), str(tmp_path), "plain")
    assert spark.conf.get(streams.STATE_STORE[0], None) == before
