"""First-row, latest-row, numbering and next-row operators that hold up when one key owns much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from palisade.session import cut_lineage


def first_per(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key. The rank limit is also applied before the shuffle, so at most one row per
    key and input partition moves."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def latest_per(df: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    return first_per(df, keys, [F.desc(c) for c in newest])


def ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``_slice``: partitions of about equal size along the keys and the order.

    The bounds of the ranges come from a sample of the rows, so a key that owns much of the data is cut as often as it needs, wherever its
    times lie. The rows are stored, as the bounds may differ in another run of the plan.
    """
    cut = [F.col(k).asc_nulls_first() for k in keys] + order
    return cut_lineage(df.repartitionByRange(*cut).withColumn("_slice", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "position", total: str | None = None,
             crowded: list | None = None) -> DataFrame:
    """Row numbers per key without one task holding a whole key.

    Rows are numbered inside their range; the rows of a key in each range then start after those in the ranges before it. Only the table
    of (key, range) sizes is ever windowed by key alone, one row for each range that a key reaches into.

    A caller that has counted names with ``crowded`` the values of the last key that have too many rows for one task. Only their rows are cut
    into ranges then; the others are numbered where they are, and neither moved nor stored if they lie together by a key.
    """
    if crowded is not None:
        cut = F.coalesce(F.col(keys[-1]).isin(crowded), F.lit(False))
        whole = W.partitionBy(*keys)
        placed = (df.filter(~cut) if crowded else df).withColumns({
            name: F.row_number().over(whole.orderBy(*order)).cast("bigint"),
            **({total: F.count("*").over(whole)} if total else {}),
        })
        return placed.unionByName(numbered(df.filter(cut), keys, order, name, total)) if crowded else placed
    sliced = ranges(df, keys, order)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"))
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    along = by_key.orderBy("_slice")
    before = F.sum("_size").over(along.rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        F.coalesce(before, F.lit(0)).alias("_before"),
        *([F.sum("_size").over(by_key).alias(total)] if total else []),
    )
    inside = sliced.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)))
    match = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
        F.col("_slice").eqNullSafe(F.col("_s")),
    )
    joined = inside.join(sizes, match, "left").withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint"))
    return joined.drop("_slice", "_rn", "_before", "_s", *[f"_k{i}" for i in range(len(keys))])


def with_next(df: DataFrame, keys: list[str], time: str, tie: str, name: str) -> DataFrame:
    """The time of the next row of the key, null for the last one; ranges of a key are handled apart.

    Inside a range the next row is a window away. The last row of a range looks up the first time of the key's
    next range, taken from the table of first times per range.
    """
    sliced = ranges(df, keys, [F.col(time).asc(), F.col(tie).asc()])
    firsts = sliced.groupBy(*keys, "_slice").agg(F.min(time).alias("_first"))
    firsts = firsts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        F.lead("_first").over(W.partitionBy(*keys).orderBy("_slice")).alias("_later"),
    )
    here = F.lead(time).over(W.partitionBy(*keys, "_slice").orderBy(time, tie))
    match = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_slice") == F.col("_s")
    )
    joined = sliced.withColumn("_here", here).join(firsts, match)
    return joined.withColumn(name, F.coalesce("_here", "_later")).drop(
        "_slice", "_here", "_later", "_s", *[f"_k{i}" for i in range(len(keys))]
    )


def scan_history(scans: DataFrame) -> DataFrame:
    """Scans of a project, newest first (ties by id), with their number and the project's total."""
    return numbered(
        scans, ["project_id"], [F.desc("created_at"), F.desc("scan_id")], "scan_no", "total",
    )


def scan_queue(scans: DataFrame) -> DataFrame:
    """Position of every queued scan, oldest first, in one global order."""
    return numbered(scans.filter("status = 'queued'"), [], [F.asc("created_at"), F.asc("scan_id")], "queue_position")


def owner_projects(projects: DataFrame, user_id: int | None = None) -> DataFrame:
    """Projects of an owner, newest first, with the owner's total."""
    chosen = projects if user_id is None else projects.filter(F.col("user_id") == user_id)
    return numbered(
        chosen, ["user_id"], [F.desc("created_at"), F.desc("project_id")], "position", "total",
    )


def latest_report(reports: DataFrame, by: list[str], time_fields: list[str]) -> DataFrame:
    """The most recent report of each portfolio; the time of a report is the first filled one of its fields."""
    seen = F.coalesce(*time_fields)
    pick = F.max_by(F.struct("project_id", seen.alias("at")), F.struct(seen, F.col("project_id")))
    return reports.groupBy(*by).agg(pick.alias("_r")).select(
        *by, F.col("_r.project_id").alias("latest_project_id"), F.col("_r.at").alias("latest_scan_at")
    )
