"""Sinks: report documents, the endpoint report table, and the stored discovery of a project."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions import scoring
from palisade.sources import snapshots

REPORT_VERSION = "1.0"
FINDINGS_PER_PART = 1000


def report_parts(assessments: DataFrame, findings: DataFrame, keys: list[str], size: int = FINDINGS_PER_PART) -> DataFrame:
    """Nested report documents: every assessment with its findings, in parts of bounded size.

    An endpoint with few findings is one document. A larger one is split by a hash of the finding, so no list
    outgrows ``size`` by much and no task holds a whole hot endpoint. ``part`` and ``parts`` allow it to be put
    together again; findings inside a part are in report order.
    """
    counts = findings.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("parts"))
    fields = sorted(c for c in findings.columns if c not in keys)
    order = F.struct(scoring.severity_rank(F.col("severity")).alias("_rank"), *fields)
    split = findings.join(counts, keys).withColumn("part", F.pmod(F.xxhash64(*fields), F.col("parts")).cast("int"))
    packed = split.groupBy(*keys, "parts", "part").agg(F.transform(
        F.array_sort(F.collect_list(order)), lambda f: F.struct(*[f[n].alias(n) for n in fields])).alias("findings"))
    shown = assessments.select(*keys, F.struct(*sorted(c for c in assessments.columns if c not in keys)).alias("assessment"))
    return shown.join(packed, keys, "left").withColumns({"part": F.coalesce("part", F.lit(0)), "parts": F.coalesce("parts", F.lit(1))})


def source_analysis(runs: DataFrame, issues: DataFrame, errors: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Per project what the report says about the source: files, issues by severity, analyzer runs, and the counts of endpoints and errors.

    The issues themselves and the errors have no bound per project, so they are stored as parts; the document has their numbers.
    """
    counts = F.struct(*[F.count_if(F.col("severity") == s).alias(s) for s in sorted(scoring.SEVERITIES)])
    found = issues.groupBy("project_id").agg(F.count("*").alias("issue_count"), counts.alias("severity_counts"))
    failed = errors.groupBy("project_id").agg(F.count("*").alias("error_count"))
    listed = endpoints.groupBy("project_id").agg(F.count("*").alias("endpoint_count"))
    # One row for each analyzer of the catalogue.
    ran = runs.groupBy("project_id").agg(
        F.max("files_scanned").alias("files_scanned"),
        F.array_sort(F.collect_list(F.struct("analyzer", "files_scanned", "issue_count", "successful"))).alias("analyzers"))
    joined = ran.join(found, "project_id", "left").join(failed, "project_id", "left").join(listed, "project_id", "left")
    number = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return joined.select("project_id", "files_scanned", "analyzers", number("issue_count"), number("error_count"), number("endpoint_count"), F.col("severity_counts").alias("source_severities"))


def report_summaries(
    projects: DataFrame, scans: DataFrame, overall: DataFrame, severities: DataFrame, generated_at: datetime, analysis: DataFrame,
) -> DataFrame:
    """The head of each report: version, project, scan, source analysis and summary, as one JSON text per project and scan."""
    joined = scans.join(projects, "project_id").join(overall, "project_id").join(severities, "project_id", "left").join(analysis, "project_id", "left")
    counts = F.struct(*[F.coalesce(s, F.lit(0)).alias(s) for s in sorted(scoring.SEVERITIES)])
    number = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    language = F.col("language") if "language" in projects.columns else F.lit(None).cast("string")
    return joined.select("project_id", "scan_id", F.to_json(F.struct(
        F.lit(generated_at.isoformat()).alias("generated_at"),
        F.struct("framework", F.col("project_id").alias("id"), language.alias("language"), "name").alias("project"),
        F.lit(REPORT_VERSION).alias("report_version"),
        F.struct(number("endpoint_count"), number("error_count"), number("files_scanned"), F.col("scan_id").alias("id")).alias("scan"),
        F.struct("analyzers", number("files_scanned"), number("issue_count"), F.col("source_severities").alias("severity_counts")).alias("source_analysis"),
        F.struct("endpoint_score", F.col("overall_score").alias("score"), "severity", counts.alias("severity_counts"), "source_score").alias("summary"),
    )).alias("report"))


def stored_summary(payload: Column) -> Column:
    """The summary of a stored document as JSON text: its own, or that of the ``report`` or ``data`` it is wrapped in."""
    return F.coalesce(*(F.get_json_object(payload, f"$.{path}summary") for path in ("", "report.", "data.")))


BUCKETS = 64


def write_reports(tables: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> None:
    """Report tables below ``root``, each written once. The folders are buckets of projects, so their number does not grow with the projects.

    A run has the folders of its scan number to itself, so a rerun replaces what it wrote and nothing else.
    """
    for name, frame in tables.items():
        bucketed = frame.withColumn("bucket", F.pmod(F.xxhash64(F.col("project_id").cast("string")), F.lit(buckets)).cast("int"))
        # Rebalancing splits the bucket of a project with much of the data over several tasks.
        writer = bucketed.hint("rebalance", "bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
        writer.partitionBy("scan_id", "bucket").parquet(f"{root}/{name}")


def read_report(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").drop("bucket")


def export_json(spark: SparkSession, root: str, name: str, out: str) -> None:
    """A stored report table as JSON lines, from what was stored and not from another run of the plan."""
    read_report(spark, root, name).write.mode("overwrite").partitionBy("scan_id").json(out)


def endpoint_report(assessments: DataFrame) -> DataFrame:
    """The rows of the endpoint table: method, path, score, severity and finding count."""
    return assessments.select("project_id", "scan_id", "method", "path", "score", "severity", "finding_count")


def with_report_available(scans: DataFrame, reports: DataFrame) -> DataFrame:
    """Flag the scans that have a stored report."""
    stored = reports.select("project_id", "scan_id").distinct().withColumn("_stored", F.lit(True))
    return scans.join(stored, ["project_id", "scan_id"], "left").withColumn("report_available", F.coalesce("_stored", F.lit(False))).drop("_stored")


def replace_discovery(endpoints: DataFrame, path: str, scan_id: int | None = None, projects: DataFrame | None = None) -> int:
    """Store the discovery of a scan as a new version; what was stored for its projects before is replaced, also for those of ``projects`` without endpoints."""
    return snapshots.replace(endpoints, path, ["project_id"], scan_id, projects)


def read_discovery(spark: SparkSession, path: str, scan_id: int | None = None) -> DataFrame:
    """The discovery as it is now, or as it was after a scan."""
    return snapshots.read(spark, path, scan_id)
