"""Endpoint, project, source and portfolio scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.functions import scoring


def endpoint_scores(endpoints: DataFrame, findings: DataFrame, profile: str = "calculator") -> DataFrame:
    """One row per endpoint: finding count, score and band.

    ``calculator`` counts every finding, ``model`` only the open ones. Findings are reduced to one row per
    endpoint before the join, so a hot endpoint is combined on the map side.
    """
    points = scoring.weight(F.col("severity"), profile)
    if profile == "model":
        points = F.when(F.col("status") == "open", points).otherwise(0)
    totals = findings.groupBy("endpoint_id").agg(
        F.sum(points).alias("_penalty"),
        F.count("*").alias("_found"),
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("_penalty", F.lit(0)))).cast("bigint")
    return (
        endpoints.join(totals, "endpoint_id", "left")
        .withColumn("finding_count", F.coalesce("_found", F.lit(0)).cast("bigint"))
        .withColumn("score", score)
        .withColumn("severity", scoring.band(F.col("score"), profile))
        .drop("_penalty", "_found")
    )


def project_scores(endpoint_scores: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Mean endpoint score per project, rounded half to even; a project without endpoints scores 100."""
    scored = endpoint_scores.groupBy("project_id").agg(
        F.count("*").alias("endpoint_count"),
        F.sum("finding_count").cast("bigint").alias("finding_count"),
        scoring.half_even(F.avg("score")).alias("score"),
    )
    if projects is not None:
        scored = projects.select("project_id").join(scored, "project_id", "left").select(
            "project_id",
            F.coalesce("endpoint_count", F.lit(0)).cast("bigint").alias("endpoint_count"),
            F.coalesce("finding_count", F.lit(0)).cast("bigint").alias("finding_count"),
            F.coalesce("score", F.lit(100)).cast("bigint").alias("score"),
        )
    return scored.withColumn("severity", scoring.band(F.col("score"), "calculator"))


def project_model_scores(endpoints: DataFrame, findings: DataFrame) -> DataFrame:
    """Model form of the project score: mean endpoint score less penalties for open critical and high findings."""
    is_open = F.col("status") == "open"
    points = F.when(is_open, scoring.weight(F.col("severity"), "model")).otherwise(0)
    totals = findings.groupBy("endpoint_id").agg(
        F.sum(points).alias("_penalty"),
        F.count_if(is_open & (F.col("severity") == "critical")).alias("_critical"),
        F.count_if(is_open & (F.col("severity") == "high")).alias("_high"),
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("_penalty", F.lit(0))))
    per_project = (
        endpoints.select("endpoint_id", "project_id")
        .join(totals, "endpoint_id", "left")
        .groupBy("project_id")
        .agg(
            scoring.half_even(F.avg(score)).alias("average_score"),
            F.coalesce(F.sum("_critical"), F.lit(0)).cast("bigint").alias("open_critical"),
            F.coalesce(F.sum("_high"), F.lit(0)).cast("bigint").alias("open_high"),
        )
    )
    reduced = (
        F.col("average_score")
        - F.least(F.lit(30), F.col("open_critical") * 10)
        - F.least(F.lit(15), F.col("open_high") * 3)
    )
    return per_project.withColumn("score", scoring.clamp(reduced, 0, 100).cast("bigint")).withColumn(
        "severity", scoring.band(F.col("score"), "model")
    )


def source_scores(projects: DataFrame, issues: DataFrame) -> DataFrame:
    """100 less the summed model weights of a project's source issues."""
    totals = issues.groupBy("project_id").agg(F.sum(scoring.weight(F.col("severity"), "model")).alias("_penalty"))
    return (
        projects.select("project_id")
        .join(totals, "project_id", "left")
        .select("project_id", F.greatest(F.lit(0), 100 - F.coalesce("_penalty", F.lit(0))).cast("bigint").alias("source_score"))
    )


def overall_scores(endpoint_scores: DataFrame, source_scores: DataFrame) -> DataFrame:
    """Mean of the endpoint and source score, half to even, with the model band and the grade."""
    both = endpoint_scores.select("project_id", F.col("score").alias("endpoint_score")).join(source_scores, "project_id", "full_outer")
    return (
        both.select(
            "project_id",
            F.coalesce("endpoint_score", F.lit(100)).cast("bigint").alias("endpoint_score"),
            F.coalesce("source_score", F.lit(100)).cast("bigint").alias("source_score"),
        )
        .withColumn("overall_score", scoring.half_even((F.col("endpoint_score") + F.col("source_score")) / 2))
        .withColumn("severity", scoring.band(F.col("overall_score"), "model"))
        .withColumn("risk_grade", scoring.grade(F.col("overall_score")))
    )


def portfolio_scores(project_scores: DataFrame, by: list[str]) -> DataFrame:
    """Dashboard score of a set of projects: clamp each, average, round half up. Null scores do not count."""
    valid = scoring.clamp(F.floor(F.col("score") + 0.5), 0, 100)
    return project_scores.groupBy(*by).agg(
        F.count("score").alias("scored_projects"),
        scoring.half_up(F.avg(F.when(F.col("score").isNotNull(), valid))).alias("security_score"),
    )


def project_posture(scores: DataFrame, severity_counts: DataFrame) -> DataFrame:
    joined = scores.select("project_id", "score").join(severity_counts, "project_id", "left")
    counts = [F.coalesce(name, F.lit(0)) for name in ("critical", "high", "medium", "low")]
    return joined.select("project_id", "score", scoring.posture(F.col("score"), *counts).alias("posture"))
