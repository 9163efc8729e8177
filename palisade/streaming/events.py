"""Lifecycle events on Structured Streaming: hourly activity, sessions, the running progress and uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators import lifecycle
from palisade.session import prepare, setting, shared_folder

LATENESS = "10 minutes"
# Keeps state on disk, and knows timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_stream(spark: SparkSession, folder: str, schema: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; each trigger takes a bounded number of files."""
    reader = prepare(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def hourly_activity(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return lifecycle.activity_per_hour(events.withWatermark("ts", lateness))


def sliding_activity(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", lateness: str = LATENESS) -> DataFrame:
    """Events per kind in windows that overlap. Panes as long as the slide are counted first, so an event is counted once and not once a window."""
    panes = events.withWatermark("ts", lateness).groupBy(F.window("ts", slide).alias("pane"), "kind").agg(F.count("*").alias("n"))
    return panes.groupBy(F.window(F.window_time("pane"), length, slide).alias("w"), "kind").agg(F.sum("n").alias("events")).select(
        F.col("w.start").alias("window_start"), "kind", "events")


def sessions(events: DataFrame, key: str = "project_id", gap: str = "15 minutes", lateness: str = LATENESS) -> DataFrame:
    grouped = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("s"), key)
    return grouped.agg(F.count("*").alias("events")).select(
        key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def new_uploads(uploads: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Drop uploads whose checksum was seen within the lateness of the stream."""
    return uploads.withWatermark("uploaded_at", lateness).dropDuplicatesWithinWatermark(["sha256_checksum"])


def run_folder(spark: SparkSession) -> str:
    """A fresh folder for the state and output of a run, below the shared checkpoint folder."""
    return shared_folder(spark, "stream")


# Later than any event: the watermark that follows it closes every window, session and quiet period.
END_OF_INPUT = "2200-01-01 00:00:00"


def run_to_end(events: DataFrame, plan: Callable[[DataFrame], DataFrame], folder: str, name: str, end: str = END_OF_INPUT) -> DataFrame:
    """Like ``run_available``, for a bounded input that must end complete: ``plan`` of all ``events``, also of what is still open at the end.

    When everything is read, a row that says so follows, with the event time ``end`` and nothing else. Its own window never closes,
    so it leaves no trace in the output. The state cannot take events after that.
    """
    spark, marks = events.sparkSession, f"{folder}/{name}-end"
    spark.createDataFrame([], events.schema).write.mode("append").parquet(marks)
    stream = plan(events.unionByName(spark.readStream.schema(events.schema).parquet(marks)))
    run_available(stream, folder, name)
    ends = [F.lit(end if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*ends).write.mode("append").parquet(marks)
    return run_available(stream, folder, name)


def run_available(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Process what is there, append the results to files and read them back. Nothing passes the driver."""
    out = f"{folder}/{name}"
    with setting(stream.sparkSession, *STATE_STORE):
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/{name}-state")
            .option("path", out).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
