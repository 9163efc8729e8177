"""Session settings the operators rely on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import palisade
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Python functions of this package travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(palisade)

# Settings that change results; every entry point applies them to the session it is given.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings that only change speed. Partition counts are left to the cluster and to AQE.
SPEED_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Filters reach the readers of source trees.
    "spark.sql.python.filterPushdown.enabled": "true",
    # Call-site capture per column expression; the rule plan has thousands of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_LOCAL_FOLDER = "palisade.local.folder"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need to a session somebody else built."""
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "palisade", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RESULT_SETTINGS, **SPEED_SETTINGS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a block; the caller's own is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``, which driver and executors share.

    A local session that names none gets one folder of its own. Anywhere else an unnamed folder is an error: executors on other machines
    would not see a folder of this one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_FOLDER, None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set(_LOCAL_FOLDER, named)
    return f"{named.rstrip('/')}/palisade-{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    Unlike a checkpoint of rows, readers of the table take only the columns and partitions they need.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles_deleted(spark: SparkSession):
    """In this block the shuffle files of a query are deleted when it has ended, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored_in_turn(spark: SparkSession, frames: Iterable[DataFrame]) -> DataFrame:
    """The rows of all frames, each worked out and stored before the next one is asked for.

    The shuffle files of a frame go as soon as it is stored, so what is on disk at once is the result and the work of one frame.
    """
    with shuffles_deleted(spark):
        return reduce(DataFrame.unionByName, [cut_lineage(frame) for frame in frames])


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small in-code table as a local relation: no job is needed to read it and its size is known to the plan."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))
    named = [dict(zip(fields.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, schema=fields), schema)
