"""Tables with versions: rows in buckets of their key, and a commit log that says which files each version consists of.

A write touches only the buckets that its keys fall in. It reads those, writes them anew into a folder of its own, and commits a map from bucket to
folder, so that a version is complete or does not exist, and older ones stay as they were. What a write that dies has left is in no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from palisade.sources import commits

BUCKETS = 64


def _bucket(keys: list[str], buckets: int):
    # As text, so that a key has the same bucket whatever integer type it comes in.
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).cast("int")


def latest(root: str) -> dict | None:
    known = commits.entries(root)
    return known[max(known)] if known else None


def as_of(root: str, label: int) -> dict | None:
    """The last version whose label is not above ``label``."""
    known = commits.entries(root)
    numbers = [n for n, entry in known.items() if entry["label"] is not None and entry["label"] <= label]
    return known[max(numbers)] if numbers else None


def _rows(spark: SparkSession, entry: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets."""
    schema = StructType.fromJson(json.loads(entry["schema"]))
    folders = [folder for bucket, folder in entry["folders"].items() if buckets is None or int(bucket) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, label: int | None = None) -> DataFrame:
    """The latest version, or the one of a label; all columns as they were written."""
    entry = latest(root) if label is None else as_of(root, label)
    if entry is None:
        raise ValueError(f"{root} has no version" + ("" if label is None else f" for {label}"))
    return _rows(spark, entry)


def _written(rows: DataFrame, folder: str, keys: list[str], buckets: int) -> None:
    # Rebalancing splits a bucket that holds much of the data over several tasks.
    rows.withColumn("bucket", _bucket(keys, buckets)).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(folder)


def _held(folder: str) -> list[int]:
    system, path = commits.opened(folder)
    return [int(i.base_name.split("=")[1]) for i in system.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("bucket=")]


def _committed(root: str, folder: str, schema: StructType, touched: list[int], last: dict | None, buckets: int, **more) -> int:
    folders = {b: f for b, f in (last["folders"] if last else {}).items() if int(b) not in touched}
    folders |= {str(b): f"{folder}/bucket={b}" for b in _held(folder)}
    number = max(commits.entries(root), default=0) + 1
    return commits.commit(root, number, {"buckets": buckets, "folders": folders, "schema": schema.json(), **more})


def _folder(root: str) -> str:
    return f"{root}/data/{uuid.uuid4().hex}"


def replace(rows: DataFrame, root: str, keys: list[str], label: int | None = None, scope: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Store ``rows`` in place of all rows that share a key with ``scope`` (with ``rows`` themselves, if it is not named); returns the version.

    Keys of the scope without a row lose theirs. Everything else stays.
    """
    spark, last, folder = rows.sparkSession, latest(root), _folder(root)
    count = last["buckets"] if last else buckets
    if last:
        # What is stored names the columns.
        rows = _rows(spark, last, []).unionByName(rows)
    _written(rows, folder, keys, count)
    # The rows are made once; their keys are read from what is written.
    named = spark.read.schema(rows.schema).parquet(folder) if scope is None else scope
    changed = named.select(*keys).distinct()
    touched = _held(folder)
    if scope is not None:
        touched = sorted({*touched, *(r[0] for r in changed.select(_bucket(keys, count)).distinct().collect())})
    if last:
        old = _rows(spark, last, touched)
        kept = old.join(changed, keys, "left_anti").select(*old.columns)
        _written(kept.unionByName(rows.filter(F.lit(False))), folder, keys, count)
    return _committed(root, folder, rows.schema, touched, last, count, label=label, batch=None)


def repeated(last: dict | None, number: int) -> bool:
    """Whether a batch is in the table already."""
    return last is not None and last["batch"] is not None and number <= last["batch"]


def merge(
    batch: DataFrame, root: str, keys: list[str], fold: Callable[[DataFrame], DataFrame], number: int, note: dict | None = None, buckets: int = BUCKETS,
) -> int | None:
    """Fold a batch of partial rows into the table: ``fold`` makes one row a key of what is stored and what is new.

    A batch whose number is not above that of the last one stored is a repetition and changes nothing. ``note`` is kept with the version.
    """
    spark, last = batch.sparkSession, latest(root)
    if repeated(last, number):
        return None
    count = last["buckets"] if last else buckets
    touched = [r[0] for r in batch.select(_bucket(keys, count)).distinct().collect()]
    rows = fold(_rows(spark, last, touched).unionByName(batch) if last else batch)
    folder = _folder(root)
    _written(rows, folder, keys, count)
    return _committed(root, folder, rows.schema, touched, last, count, label=None, batch=number, note=note)


def vacuum(root: str, keep: int = 1) -> int:
    """Delete the files that none of the last ``keep`` versions has, those of writes that died included; older versions can no longer be read."""
    known = commits.entries(root)
    kept = {f for n in sorted(known)[-keep:] for f in known[n]["folders"].values()}
    system, data = commits.opened(f"{root}/data")
    commits.forget(root, sorted(known)[:-keep])
    gone = 0
    for run in system.get_file_info(fs.FileSelector(data)):
        used = [f for f in kept if f.split("/data/")[-1].split("/")[0] == run.base_name]
        for part in system.get_file_info(fs.FileSelector(run.path)) if used else [run]:
            if part.type == fs.FileType.Directory and not any(f.endswith(f"{run.base_name}/{part.base_name}") for f in used):
                system.delete_dir(part.path)
                gone += 1
    return gone
