"""Reads and checks of the relational tables: projects, uploads, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators.ranking import first_per
from palisade.session import prepare


def read_table(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """Read chosen columns of a stored table; the filter and the columns reach the scan."""
    frame = prepare(spark).read.parquet(path)
    return (frame.filter(where) if where else frame).select(*columns)


def read_jdbc(spark: SparkSession, url: str, name: str, partition_on: str, low: int, high: int, parts: int) -> DataFrame:
    """Read a database table in parallel ranges of a numeric column; filters are pushed to the database."""
    return prepare(spark).read.jdbc(url, name, column=partition_on, lowerBound=low, upperBound=high, numPartitions=parts)


def accept_uploads(uploads: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Uploads whose checksum is new: unknown so far, and the earliest of its kind in this batch.

    Checksums are compared across all users, as the stored uniqueness constraint does.
    """
    fresh = uploads if known is None else uploads.join(known.select("sha256_checksum"), "sha256_checksum", "left_anti")
    order = [F.asc(c) for c in ("uploaded_at", "upload_id") if c in uploads.columns]
    return first_per(fresh, ["sha256_checksum"], order)
