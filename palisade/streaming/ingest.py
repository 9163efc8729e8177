"""Incremental ingest: new source files become code facts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.catalog import technology as t
from palisade.operators import facts, inventory
from palisade.sources import files as file_source, walk


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Parse the files below ``root`` that are new or changed since the last call and add their facts to the table ``out``.

    A walk appends what it finds to the log beside the checkpoint, and the stream reads the log from where it stopped. Each batch owns one partition
    folder and overwrites it, so a batch that is run again after a failure leaves no repeats; the call after a failure finishes that batch, and the
    next one goes on. A changed file arrives again; ``current_facts`` takes its
    latest batch.
    """

    def store(batch: DataFrame, number: int) -> None:
        loaded = inventory.analysis_files(batch).filter("load_status = 'loaded'")
        spread = loaded.repartition(partitions, "project_id", "relative_path") if partitions else loaded
        rows = facts.code_facts(spread).withColumn("batch", F.lit(number))
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(out)

    log = f"{checkpoint.rstrip('/')}-found"
    walk.discover(spark, root, log, tuple(t.ANALYSIS_LANGUAGES))
    stream = file_source.source_tree_stream(spark, root, log)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_facts(spark: SparkSession, out: str) -> DataFrame:
    """The facts of every file as it was last seen. Each file has one row of kind ``file`` a batch, which says when."""
    rows = spark.read.parquet(out)
    last = rows.filter("kind = 'file'").groupBy("project_id", "relative_path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["project_id", "relative_path", "batch"], "left_semi")
