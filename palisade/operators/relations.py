"""Joins and set operations between projects, scans, users and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def owned(rows: DataFrame, projects: DataFrame, user_id: int | None = None) -> DataFrame:
    """Rows of the projects that belong to a user (or to any known user)."""
    own = projects.filter(F.col("user_id") == user_id) if user_id is not None else projects.filter("user_id is not null")
    return rows.join(own.select("project_id"), "project_id", "left_semi")


def active_scans(scans: DataFrame) -> DataFrame:
    return scans.filter(F.col("status").isin("queued", "running"))


def new_scan_requests(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """Requests of projects without an active scan; the others reuse the scan they have."""
    return requests.join(active_scans(scans).select("project_id"), "project_id", "left_anti")


def reused_scan_requests(requests: DataFrame, scans: DataFrame) -> DataFrame:
    return requests.join(active_scans(scans).select("project_id"), "project_id", "left_semi")


def notification_outbox(finished: DataFrame, projects: DataFrame, users: DataFrame, results: DataFrame) -> DataFrame:
    """One message row per finished scan: recipient, project, score and severity counts."""
    return (
        finished.select("scan_id", "project_id", "status")
        .join(projects.select("project_id", "user_id", F.col("name").alias("project_name")), "project_id")
        .join(users.select("user_id", F.col("email").alias("recipient"), "full_name"), "user_id")
        .join(results, "project_id", "left")
        .withColumn("message", F.when(F.col("status") == "completed", "scan_completed").otherwise("scan_failed"))
    )


def _presence(before: DataFrame, after: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Which of two snapshots holds each key: one tagged union and one aggregation, combined before the shuffle.

    Where keys seldom repeat, combining before the shuffle holds nearly all rows for nothing: with ``tasks`` they are moved first, to that many tasks.
    """
    tagged = before.select(*keys, F.lit(True).alias("_old"), F.lit(False).alias("_new")).unionByName(
        after.select(*keys, F.lit(False).alias("_old"), F.lit(True).alias("_new"))
    )
    if tasks:
        tagged = tagged.repartition(tasks, *keys)
    return tagged.groupBy(*keys).agg(F.bool_or("_old").alias("_old"), F.bool_or("_new").alias("_new"))


def _change(added: str, removed: str, kept: str):
    return F.when(~F.col("_old"), added).when(~F.col("_new"), removed).otherwise(kept).alias("change")


def discovery_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Compare two discovery snapshots (an extension of the stored active/removed state)."""
    return _presence(before, after, keys).select(
        *keys,
        _change("added", "removed", "unchanged"),
        F.when(F.col("_new"), "active").otherwise("removed").alias("discovery_status"),
    )


def finding_changes(before: DataFrame, after: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """New, resolved and persisting finding identities between two scans (an extension of stored history)."""
    return _presence(before, after, keys, tasks).select(*keys, _change("new", "resolved", "persisting"))
