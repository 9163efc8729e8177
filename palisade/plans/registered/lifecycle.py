"""Scan lifecycle in batch and on streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators import lifecycle as ops, ranking
from palisade.plans.catalogue import register, twin
from palisade.sources import bindings as b
from palisade.streaming import events as streams, watchdog

NOW = datetime(2000, 1, 1, 12, 0, 0)
AS_OF = "timestamp '2000-01-01 12:00:00'"
AGE = "cast(floor(cost) as bigint) % 30"
BEAT = f"case when attempts = 1 then null else {AS_OF} - to_minutes(cast({AGE} as int)) end"


def now():
    return F.to_timestamp(F.lit("2000-01-01 12:00:00"))


def live_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan jobs with the columns a live row has, filled from the order's own values. Completed scans have an end."""
    whole = F.floor("cost").cast("bigint")
    age = (whole % 30) * -60
    later = (whole % 7 - 3) * 60
    ended = F.col("status") == "completed"
    return b.scan_jobs(spark, sf_dir).select(
        "scan_id", "project_id", "status", "attempts", "cost", "priority",
        F.when(ended, "completed").otherwise("analysis").alias("current_stage"), F.lit("working").alias("status_message"),
        F.when(whole % 11 == 0, "earlier error").alias("error_message"), (whole % 120).cast("int").alias("progress"),
        F.concat(F.lit("w"), F.col("attempts").cast("string")).alias("worker_id"),
        F.when(F.col("attempts") != 1, ops.plus_seconds(now(), age)).alias("heartbeat_at"),
        F.when(F.col("priority") == "1-URGENT", now()).alias("cancel_requested_at"),
        F.when(F.col("priority") != "5-LOW", ops.plus_seconds(now(), later)).alias("deadline_at"),
        ops.plus_seconds(now(), later + 600).alias("estimated_completion_at"),
        F.when(ended, ops.plus_seconds(now(), age)).alias("completed_at"),
        (whole % 5 == 0).alias("broke"),
    )


def _shown(rows: DataFrame, *names: str) -> DataFrame:
    """Times as seconds from ``now``, so that both engines write them alike."""
    times = ("heartbeat_at", "cancel_requested_at", "estimated_completion_at", "completed_at")
    second = lambda n: (F.unix_timestamp(n) - F.unix_timestamp(now())).alias(n)
    return rows.select(*(second(n) if n in times else F.col(n) for n in names))


WHOLE = "cast(floor(cost) as bigint)"
LIVE = f"""select *, case status when 'completed' then 'completed' else 'analysis' end as stage_, case when {WHOLE} % 11 = 0 then 'earlier error' end as error_,
  cast({WHOLE} % 120 as int) as progress_, case when attempts <> 1 then -60 * ({WHOLE} % 30) end as beat_, case when priority = '1-URGENT' then 0 end as asked_,
  60 * ({WHOLE} % 7 - 3) as deadline_, 60 * ({WHOLE} % 7 - 3) + 600 as eta_, case when status = 'completed' then -60 * ({WHOLE} % 30) end as end_ from scan_jobs"""


@register("stale_scan_recovery", "STR-1", twin(
    """select scan_id, stale as recovered, case when spent then 'failed' when stale then 'queued' else status end as status,
  case when spent then 'failed' when stale then 'queued' else stage_ end as current_stage,
  case when spent then 'Scan recovery limit was reached.' when stale then 'Recovered after an interrupted worker; queued again.' else 'working' end as status_message,
  case when spent then 'Security scan failed after recovery attempts.' else error_ end as error_message,
  case when stale and not spent then null else 'w' || cast(attempts as varchar) end as worker_id,
  cast(case when stale and not spent then null else beat_ end as bigint) as heartbeat_at, cast(case when spent then null else eta_ end as bigint) as estimated_completion_at,
  cast(case when spent then 0 else end_ end as bigint) as completed_at, case when spent then 'failed' when stale then 'scanning' end as project_status
from (select *, stale and attempts >= 3 as spent from (select *, status = 'running' and (beat_ is null or beat_ < -900) as stale from live) s) t""", "scan_jobs", live=LIVE))
def stale_scan_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(
        ops.recover_stale(live_scans(spark, sf_dir), NOW), "scan_id", "recovered", "status", "current_stage", "status_message", "error_message", "worker_id",
        "heartbeat_at", "estimated_completion_at", "completed_at", "project_status")


@register("scan_control", "STR-3", twin(
    """select scan_id, case how when 1 then 'cancelled' when 2 then 'failed' when 3 then 'failed' else status end as status,
  case how when 1 then 'cancelled' when 2 then 'timed_out' when 3 then 'failed' else stage_ end as current_stage,
  case how when 1 then 'Security scan cancelled.' when 2 then 'Security scan exceeded its time limit.' when 3 then 'The scan stopped before completion.' else 'working' end as status_message,
  case how when 2 then 'Security scan timed out.' when 3 then 'Security scan failed.' else error_ end as error_message,
  case when how = 3 then least(progress_, 99) else progress_ end as progress, cast(case when how > 0 then 0 else beat_ end as bigint) as heartbeat_at,
  cast(case when how > 0 then null else eta_ end as bigint) as estimated_completion_at, cast(case when how > 0 then 0 else end_ end as bigint) as completed_at,
  case how when 1 then 'ready' when 2 then 'failed' when 3 then 'failed' end as project_status
from (select *, case when status <> 'running' then 0 when priority = '1-URGENT' then 1 when priority <> '5-LOW' and deadline_ <= 0 then 2
  when cast(floor(cost) as bigint) % 5 = 0 then 3 else 0 end as how from live) s""", "scan_jobs", live=LIVE))
def scan_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(
        ops.check_control(live_scans(spark, sf_dir), now()), "scan_id", "status", "current_stage", "status_message", "error_message", "progress",
        "heartbeat_at", "estimated_completion_at", "completed_at", "project_status")


STAGE = "case when p >= 100 then 'completed' when p >= 85 then 'reporting' when p >= 70 then 'analysis' when p >= 50 then 'discovery' when p >= 30 then 'inventory' when p >= 10 then 'preparing' else 'starting' end"


@register("scan_progress", "STR-4", twin(
    f"""select project_id, kind, p as progress, {STAGE} as current_stage, events from (select project_id, kind,
  cast(floor(greatest(0, least(100, progress))) as int) as p, events from (select *, row_number() over (partition by project_id order by ts desc, event_id desc) as rn,
  cast(count(*) over (partition by project_id) as bigint) as events from scan_events) t where rn = 1) u""", "scan_events"))
def scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.current_progress(b.scan_events(spark, sf_dir), ["project_id"]).select("project_id", "kind", "progress", "current_stage", "events")


@register("scan_time_estimates", "STR-5 STR-7", twin(
    f"""select scan_id, p as progress, case when p >= 30 and p < 100 then cast(round_even(least(1800, greatest(5, elapsed * (100 - p) / p)), 0) as bigint) end as seconds_remaining
from (select scan_id, cast(cast(floor(cost) as bigint) % 120 as int) as p, cast(greatest(1, cast(floor(cost) as bigint) % 5000) as double) as elapsed from scan_jobs) s""", "scan_jobs"))
def scan_time_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.floor("cost").cast("bigint")
    timed = b.scan_jobs(spark, sf_dir).select(
        "scan_id", (whole % 120).cast("int").alias("progress"), ops.plus_seconds(now(), -(whole % 5000)).alias("started_at"))
    eta = ops.remaining_estimate(F.col("started_at"), now(), F.col("progress"))
    return timed.select("scan_id", "progress", ops.seconds_remaining(eta, now()).alias("seconds_remaining"))


@register("new_scans", "STR-6 TOP-1", twin(
    f"""select project_id, cast(greatest(30, least(1800, 30 + ceil(file_size * 1000 / 1048576.0 * 2))) as bigint) as estimate_seconds,
  cast(epoch({AS_OF}) as bigint) + 1800 as deadline from (select project_id, file_size, row_number() over (partition by project_id order by upload_id desc) as rn from uploads) t where rn = 1""",
    "uploads"))
def new_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = b.uploads(spark, sf_dir).withColumn("file_size", F.col("file_size") * 1000)
    latest = ranking.latest_per(uploads, ["project_id"], "upload_id")
    created = ops.new_scan(latest.select("project_id"), latest, now())
    return created.select("project_id", "estimate_seconds", F.unix_timestamp("deadline_at").alias("deadline"))


@register("cancel_requests", "STR-8", twin(
    """select scan_id, status in ('queued', 'running') as accepted, case when status = 'queued' then 'cancelled' else status end as new_status,
  case when status = 'queued' then 'cancelled' when status = 'running' then 'cancelling' else stage_ end as current_stage,
  case when status in ('queued', 'running') then 'Cancellation requested; stopping safely.' else 'working' end as status_message,
  cast(case when status in ('queued', 'running') then 0 else asked_ end as bigint) as cancel_requested_at,
  cast(case when status = 'queued' then 0 else end_ end as bigint) as completed_at, cast(case when status = 'queued' then null else eta_ end as bigint) as estimated_completion_at,
  case when status = 'queued' then 'ready' end as project_status from live""",
    "scan_jobs", live=LIVE))
def cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = ops.request_cancellation(live_scans(spark, sf_dir), now()).withColumn("new_status", F.col("status"))
    return _shown(
        answered, "scan_id", "accepted", "new_status", "current_stage", "status_message", "cancel_requested_at", "completed_at", "estimated_completion_at", "project_status")


@register("activity_per_hour", "STR-9", twin(
    "select cast(epoch(date_trunc('hour', ts)) as bigint) as window_start, kind, cast(count(*) as bigint) as events from scan_events group by 1, 2", "scan_events"))
def activity_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.activity_per_hour(b.scan_events(spark, sf_dir)).withColumn("window_start", F.unix_timestamp("window_start"))


SESSIONS = """select project_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from (select project_id, ts,
  sum(case when before is null or ts - before >= interval 15 minutes then 1 else 0 end) over (partition by project_id order by ts, event_id) as no
  from (select *, lag(ts) over (partition by project_id order by ts, event_id) as before from scan_events) t) u group by project_id, no"""


@register("activity_sessions", "STR-9", twin(
    "select project_id, epoch_us(first_ts) as session_start, epoch_us(last_ts) + 900000000 as session_end, cast(n as bigint) as events from sessions",
    "scan_events", sessions=SESSIONS))
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.activity_sessions(b.scan_events(spark, sf_dir), "project_id")
    return found.select("project_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "events")


# --- Streams over the event files, run to their end: the results are those of the batch forms. ---

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = streams.event_stream(spark, sf_dir, EVENT_SCHEMA, glob="events.parquet")
    kind = F.col("event_type")
    return raw.select(
        "event_id", F.col("user_id").alias("project_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "signup", "queued").when(kind == "view", "heartbeat").when(kind == "click", "progress")
        .when(kind == "purchase", "completed").otherwise("failed").alias("kind"))


@register("stream_activity_per_hour", "STR-9", twin(
    "select cast(epoch(date_trunc('hour', ts)) as bigint) as window_start, kind, cast(count(*) as bigint) as events from scan_events group by 1, 2", "scan_events"))
def stream_activity_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = streams.run_to_end(stream(spark, sf_dir), streams.hourly_activity, streams.run_folder(spark), "hourly")
    return done.withColumn("window_start", F.unix_timestamp("window_start"))


@register("stream_sessions", "STR-9", twin(
    "select project_id, epoch_us(first_ts) as session_start, epoch_us(last_ts) + 900000000 as session_end, cast(n as bigint) as events from sessions",
    "scan_events", sessions=SESSIONS))
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = streams.run_to_end(stream(spark, sf_dir), streams.sessions, streams.run_folder(spark), "sessions")
    return done.select("project_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "events")


@register("stream_stale_scans", "STR-2", twin(
    """select project_id as scan_id, epoch_us(ts) // 1000 + 900000 as alarm_ms, cast(no as int) as attempt, case when no >= 3 then 'failed' else 'requeued' end as action
from (select *, row_number() over (partition by project_id, spell order by ts, event_id) as no from (select *,
    count(*) filter (where kind in ('completed', 'failed')) over (partition by project_id, spell order by ts, event_id rows between unbounded preceding and current row) as closed,
    lead(ts) over (partition by project_id order by ts, event_id) as next_ts
  from (select *, count(*) filter (where kind = 'queued') over (partition by project_id order by ts, event_id rows between unbounded preceding and current row) as spell from scan_events) a) b
  where closed = 0 and kind in ('queued', 'heartbeat', 'progress')
    and (next_ts is null or epoch_us(next_ts) // 1000 - epoch_us(ts) // 1000 > 900000)) c where no <= 3""", "scan_events"))
def stream_stale_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream(spark, sf_dir).withColumnRenamed("project_id", "scan_id")
    done = streams.run_to_end(events, watchdog.watch, streams.run_folder(spark), "alarms")
    return done.select("scan_id", F.unix_millis("alarm_at").alias("alarm_ms"), "attempt", "action")
