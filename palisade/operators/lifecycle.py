"""Scan lifecycle as batch transformations. ``now`` is always a parameter, never the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from palisade.functions import scoring
from palisade.operators import ranking

# Limits of a scan, and the progress each stage starts at.
STALE_AFTER_SECONDS = 15 * 60
MAX_ATTEMPTS = 3
DEADLINE_SECONDS = 30 * 60
ESTIMATE_BASE, ESTIMATE_PER_MB, ESTIMATE_LOW, ESTIMATE_HIGH = 30, 2, 30, 1800
REMAINING_LOW, REMAINING_HIGH = 5, 1800
STAGES = (("preparing", 10), ("inventory", 30), ("discovery", 50), ("analysis", 70), ("reporting", 85), ("completed", 100))
MESSAGES = {
    "limit": "Scan recovery limit was reached.",
    "recovered": "Recovered after an interrupted worker; queued again.",
    "cancelled": "Security scan cancelled.",
    "timed_out": "Security scan exceeded its time limit.",
    "failed": "The scan stopped before completion.",
    "cancel_requested": "Cancellation requested; stopping safely.",
}
ERRORS = {
    "limit": "Security scan failed after recovery attempts.",
    "timed_out": "Security scan timed out.",
    "failed": "Security scan failed.",
}


def at(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def plus_seconds(time: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(time) + F.round(seconds.cast("double") * 1_000_000).cast("bigint"))


def seconds_between(first: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(first)) / 1_000_000


def is_stale(now: datetime | Column) -> Column:
    cutoff = plus_seconds(at(now), F.lit(-STALE_AFTER_SECONDS))
    return (F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < cutoff))


def recover_stale(scans: DataFrame, now: datetime | Column) -> DataFrame:
    """Put scans without a recent heartbeat back into the queue, or fail them after too many attempts.

    Returns every scan with its next state, and the state its project takes when the scan was touched.
    """
    stale = is_stale(now)
    spent = stale & (F.col("attempts") >= MAX_ATTEMPTS)
    retry = stale & ~spent

    def settle(name: str, failed: Column, queued: Column) -> Column:
        return F.when(spent, failed).when(retry, queued).otherwise(F.col(name))

    nothing = F.lit(None)
    return scans.withColumns({
        "recovered": stale,
        "status": settle("status", F.lit("failed"), F.lit("queued")),
        "current_stage": settle("current_stage", F.lit("failed"), F.lit("queued")),
        "status_message": settle("status_message", F.lit(MESSAGES["limit"]), F.lit(MESSAGES["recovered"])),
        "error_message": settle("error_message", F.lit(ERRORS["limit"]), F.col("error_message")),
        "worker_id": settle("worker_id", F.col("worker_id"), nothing),
        "heartbeat_at": settle("heartbeat_at", F.col("heartbeat_at"), nothing),
        "estimated_completion_at": settle("estimated_completion_at", nothing, F.col("estimated_completion_at")),
        "completed_at": settle("completed_at", at(now), F.col("completed_at")),
        "project_status": F.when(spent, "failed").when(retry, "scanning"),
    })


def check_control(scans: DataFrame, now: datetime | Column) -> DataFrame:
    """Stop running scans that were cancelled, ran out of time or broke off; a cancellation wins over the deadline, that over a failure.

    ``broke`` (boolean) says that a scan broke off; its progress ends below 100.
    """
    running = F.col("status") == "running"
    cancelled = running & F.col("cancel_requested_at").isNotNull()
    late = running & ~cancelled & F.coalesce(F.col("deadline_at") <= at(now), F.lit(False))
    broken = running & ~cancelled & ~late & F.coalesce("broke", F.lit(False))
    ended = cancelled | late | broken

    def settle(name: str, cancel, timeout, fail) -> Column:
        return F.when(cancelled, cancel).when(late, timeout).when(broken, fail).otherwise(F.col(name))

    return scans.withColumns({
        "status": settle("status", F.lit("cancelled"), F.lit("failed"), F.lit("failed")),
        "current_stage": settle("current_stage", F.lit("cancelled"), F.lit("timed_out"), F.lit("failed")),
        "status_message": settle("status_message", F.lit(MESSAGES["cancelled"]), F.lit(MESSAGES["timed_out"]), F.lit(MESSAGES["failed"])),
        "error_message": settle("error_message", F.col("error_message"), F.lit(ERRORS["timed_out"]), F.lit(ERRORS["failed"])),
        "progress": F.when(broken, F.least("progress", F.lit(99))).otherwise(F.col("progress")),
        "heartbeat_at": F.when(ended, at(now)).otherwise(F.col("heartbeat_at")),
        "estimated_completion_at": F.when(ended, F.lit(None)).otherwise(F.col("estimated_completion_at")),
        "completed_at": F.when(ended, at(now)).otherwise(F.col("completed_at")),
        "project_status": F.when(cancelled, "ready").when(late | broken, "failed"),
    })


def current_progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """Fold progress events to the latest row of each scan; progress is clamped to 0–100 and names its stage.

    A maximum by time is combined on the map side, so a scan with many events moves one row per partition.
    """
    latest = F.max_by(F.struct("kind", "progress", "ts"), F.struct("ts", "event_id"))
    folded = events.groupBy(*keys).agg(latest.alias("_e"), F.count("*").alias("events"))
    progress = clamped_progress(F.col("_e.progress"))
    return folded.select(
        *keys, F.col("_e.kind").alias("kind"), progress.alias("progress"), stage_of(progress).alias("current_stage"),
        F.col("_e.ts").alias("heartbeat_at"), "events")


def clamped_progress(progress: Column) -> Column:
    return F.floor(scoring.clamp(progress, 0, 100)).cast("int")


def stage_of(progress: Column) -> Column:
    chain = None
    for name, start in reversed(STAGES):
        chain = F.when(progress >= start, name) if chain is None else chain.when(progress >= start, name)
    return chain.otherwise("starting")


def remaining_estimate(started_at: Column, now: datetime | Column, progress: Column) -> Column:
    """Expected end of a scan from its progress so far; null below 30 % and at the end."""
    elapsed = F.greatest(F.lit(1.0), seconds_between(started_at, at(now)))
    left = scoring.clamp(elapsed * (100 - progress) / progress, REMAINING_LOW, REMAINING_HIGH)
    return F.when((progress >= 30) & (progress < 100), plus_seconds(at(now), left))


def initial_estimate_seconds(file_size: Column) -> Column:
    megabytes = F.coalesce(file_size, F.lit(0)) / (1024 * 1024)
    return scoring.clamp(ESTIMATE_BASE + F.ceil(megabytes * ESTIMATE_PER_MB), ESTIMATE_LOW, ESTIMATE_HIGH).cast("bigint")


def new_scan(requests: DataFrame, latest_uploads: DataFrame, now: datetime | Column) -> DataFrame:
    """Queued scan rows for accepted requests, with estimate and deadline."""
    sized = requests.join(latest_uploads.select("project_id", "file_size"), "project_id", "left")
    seconds = initial_estimate_seconds(F.col("file_size"))
    return sized.select(
        "project_id", F.lit("queued").alias("status"), F.lit(0).alias("progress"),
        seconds.alias("estimate_seconds"),
        plus_seconds(at(now), seconds).alias("estimated_completion_at"),
        plus_seconds(at(now), F.lit(DEADLINE_SECONDS)).alias("deadline_at"))


def seconds_remaining(estimated_at: Column, now: datetime | Column) -> Column:
    return F.when(estimated_at.isNotNull(), F.greatest(F.lit(0), scoring.half_even(seconds_between(at(now), estimated_at))))


def request_cancellation(scans: DataFrame, now: datetime | Column) -> DataFrame:
    """Answer cancel requests: a queued scan ends at once, a running one is told to stop, others are rejected and stay as they are."""
    queued, running = F.col("status") == "queued", F.col("status") == "running"
    nothing = F.lit(None)

    def settle(name: str, ends, stops) -> Column:
        return F.when(queued, ends).when(running, stops).otherwise(F.col(name))

    return scans.withColumns({
        "accepted": queued | running,
        "cancel_requested_at": settle("cancel_requested_at", at(now), at(now)),
        "current_stage": settle("current_stage", F.lit("cancelled"), F.lit("cancelling")),
        "status_message": settle("status_message", F.lit(MESSAGES["cancel_requested"]), F.lit(MESSAGES["cancel_requested"])),
        "completed_at": settle("completed_at", at(now), F.col("completed_at")),
        "estimated_completion_at": settle("estimated_completion_at", nothing, F.col("estimated_completion_at")),
        "project_status": F.when(queued, "ready"),
        "status": F.when(queued, "cancelled").otherwise(F.col("status")),
    })


def activity_per_hour(events: DataFrame) -> DataFrame:
    """Events per hour and kind (tumbling windows)."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), "kind", "events")


def panes(events: DataFrame, slide: str) -> DataFrame:
    """Events per kind in panes as long as the slide of the windows they will make up."""
    return events.groupBy(F.window("ts", slide)["start"].alias("pane_start"), "kind").agg(F.count("*").alias("events"))


def windows_of_panes(panes: DataFrame, length: str, slide: str) -> DataFrame:
    """Windows that overlap, from panes: each counts in every window that covers it. Only the panes are multiplied, not the events."""
    windows = panes.select(F.window("pane_start", length, slide)["start"].alias("window_start"), "kind", "events")
    return windows.groupBy("window_start", "kind").agg(F.sum("events").alias("events"))


def sliding_activity(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Events per kind in sliding windows."""
    return windows_of_panes(panes(events, slide), length, slide)


def activity_sessions(events: DataFrame, key: str, gap_seconds: int = STALE_AFTER_SECONDS) -> DataFrame:
    """Sessions of activity: events closer than the gap belong together.

    Ranges of a key's events are sessionised apart, then the partial sessions of a key that lie next to a bound are merged: a
    key has at most one partial session more for each range it reaches into.
    """
    micros = F.unix_micros("ts")
    gap = gap_seconds * 1_000_000

    def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = W.partitionBy(*keys).orderBy("_start", "_end")
        reach = F.max("_end").over(order.rowsBetween(W.unboundedPreceding, -1))
        opened = F.when(reach.isNull() | (F.col("_start") - reach >= gap), 1).otherwise(0)
        numbered = rows.withColumn("_new", opened).withColumn("_no", F.sum("_new").over(order))
        return numbered.groupBy(*keys, "_no").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.sum("_n").alias("_n")).drop("_no")

    points = events.select(key, micros.alias("_start"), micros.alias("_end")).groupBy(key, "_start", "_end").agg(F.count("*").alias("_n"))
    partial = merge(ranking.ranges(points, [key], [F.col("_start").asc()]), [key, "_slice"])
    # Only the first and the last partial session of a range can go on in another one.
    inside = W.partitionBy(key, "_slice")
    edge = (F.col("_start") == F.min("_start").over(inside)) | (F.col("_end") == F.max("_end").over(inside))
    placed = partial.withColumn("_edge", edge)
    columns = [key, "_start", "_end", "_n"]
    merged = merge(placed.filter("_edge").select(*columns), [key]).select(*columns).unionByName(placed.filter("not _edge").select(*columns))
    return merged.select(
        key, F.timestamp_micros("_start").alias("session_start"),
        F.timestamp_micros(F.col("_end") + gap).alias("session_end"), F.col("_n").cast("bigint").alias("events"))
