"""Tables that a stream keeps: every batch is folded into the buckets it touches and committed under its number, so a repeated batch changes nothing."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.operators import lifecycle
from palisade.sources import snapshots

# --- The state of every scan. ---


def _partial(events: DataFrame, key: str) -> DataFrame:
    last = F.max_by(F.struct("kind", "progress", "ts", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(last.alias("last"), F.count("*").alias("events")).select(key, "last.*", "events")


def _folded(rows: DataFrame, key: str) -> DataFrame:
    """One row a key of partial rows: the latest event, and the sum of the counts."""
    last = F.max_by(F.struct("kind", "progress", "ts", "event_id"), F.struct("ts", "event_id"))
    return rows.groupBy(key).agg(last.alias("last"), F.sum("events").alias("events")).select(key, "last.*", "events")


def fold_progress(batch: DataFrame, root: str, number: int, key: str = "project_id") -> int | None:
    """Fold a batch of progress events into the table of states; events are combined before they move."""
    return snapshots.merge(_partial(batch, key), root, [key], lambda rows: _folded(rows, key), number)


def keep_progress(events: DataFrame, root: str, checkpoint: str, key: str = "project_id") -> StreamingQuery:
    """Keep the latest state of every scan in a table that readers find complete after every batch."""
    def store(batch: DataFrame, number: int) -> None:
        fold_progress(batch, root, number, key)

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_states(spark: SparkSession, root: str, key: str = "project_id") -> DataFrame:
    """The table as progress rows, like ``lifecycle.current_progress`` of all events."""
    states = snapshots.read(spark, root)
    progress = lifecycle.clamped_progress(F.col("progress"))
    return states.select(key, "kind", progress.alias("progress"), lifecycle.stage_of(progress).alias("current_stage"), F.col("ts").alias("heartbeat_at"), "events")


# --- Windows, with late rows led aside. ---


def fold_windows(batch: DataFrame, root: str, number: int, slide: str, lateness: timedelta) -> int | None:
    """Count the events of a batch in panes of the length ``slide``; those older than the watermark go to the late table.

    The watermark is the latest event time of the batches before, less the lateness. It is stored with the version that ends them, so a batch that
    is run again after a failure meets the same one, and its late rows overwrite their own partition.
    """
    last = snapshots.latest(root)
    if snapshots.repeated(last, number):
        return None
    mark = last["note"]["watermark"] if last else None
    in_time = F.lit(True) if mark is None else F.coalesce(F.unix_micros("ts") >= F.lit(mark), F.lit(True))
    late = batch.filter(~in_time).withColumn("batch", F.lit(number))
    late.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(f"{root}/late")
    panes = batch.filter(in_time).groupBy(F.window("ts", slide)["start"].alias("pane_start"), "kind").agg(F.count("*").alias("events"))
    newest = batch.agg(F.unix_micros(F.max("ts"))).first()[0]
    reached = [m for m in (mark, None if newest is None else newest - int(lateness.total_seconds() * 1_000_000)) if m is not None]
    fold = lambda rows: rows.groupBy("pane_start", "kind").agg(F.sum("events").alias("events"))
    return snapshots.merge(panes, root, ["pane_start", "kind"], fold, number, {"watermark": max(reached) if reached else None})


def keep_windows(events: DataFrame, root: str, checkpoint: str, slide: str = "15 minutes", lateness: timedelta = timedelta(minutes=10)) -> StreamingQuery:
    def store(batch: DataFrame, number: int) -> None:
        fold_windows(batch, root, number, slide, lateness)

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The events that came too late for the windows, with the batch they came in."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{root}/late")


def window_counts(spark: SparkSession, root: str, length: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """The panes combined to windows that may overlap."""
    return lifecycle.windows_of_panes(snapshots.read(spark, root), length, slide)
