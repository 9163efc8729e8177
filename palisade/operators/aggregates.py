"""Summaries of findings, knowledge, files and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from palisade.catalog import markers
from palisade.functions import scoring
from palisade.functions.text import rule_key


def _counts_of(column: str, values, where=None):
    """Zero-filled counters, one column per expected value, in a single pass."""
    wanted = F.lit(True) if where is None else where
    return [F.count_if(wanted & (F.col(column) == value)).alias(value) for value in values]


def severity_summary(findings: DataFrame, by: list[str], only_open: bool = False) -> DataFrame:
    where = (F.col("status") == "open") if only_open else None
    return findings.groupBy(*by).agg(*_counts_of("severity", scoring.SEVERITIES, where))


def category_summary(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(*_counts_of("category", markers.CATEGORIES, F.col("status") == "open"))


def rule_summary(findings: DataFrame) -> DataFrame:
    counted = findings.groupBy("project_id", rule_key(F.col("rule_id")).alias("rule_id")).agg(F.count("*").alias("finding_count"))
    return counted.filter("rule_id <> ''")


def endpoint_finding_counts(endpoints: DataFrame, findings: DataFrame) -> DataFrame:
    counted = findings.groupBy("endpoint_id").agg(F.count("*").alias("_n"))
    return endpoints.select("project_id", "endpoint_id", "method", "path").join(counted, "endpoint_id", "left").select(
        "project_id",
        "endpoint_id",
        F.concat_ws(" ", "method", "path").alias("endpoint"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("finding_count"),
    )


def affected_endpoints(endpoint_counts: DataFrame) -> DataFrame:
    return endpoint_counts.groupBy("project_id").agg(
        F.count_if(F.col("finding_count") > 0).alias("affected_endpoint_count"),
        F.count_if(F.col("finding_count") == 0).alias("clean_endpoint_count"),
    )


def source_issue_counts(issues: DataFrame) -> DataFrame:
    """Counts by severity, confidence, category and rule, each per project, in one pass over the issues."""
    issues = issues.select("project_id", "severity", "confidence", "category", "rule_id")
    grouped = issues.groupingSets(
        [["project_id", "severity"], ["project_id", "confidence"], ["project_id", "category"], ["project_id", "rule_id"]],
        "project_id", "severity", "confidence", "category", "rule_id",
    ).agg(F.count("*").alias("issue_count"), F.grouping_id().alias("_set"))
    # grouping_id bits, high to low: project, severity, confidence, category, rule. A cleared bit is a kept key.
    facet = F.when(F.col("_set") == 0b0111, "severity").when(F.col("_set") == 0b1011, "confidence").when(
        F.col("_set") == 0b1101, "category").otherwise("rule")
    return grouped.select(
        "project_id",
        facet.alias("facet"),
        F.coalesce("severity", "confidence", "category", "rule_id").alias("value"),
        "issue_count",
    )


def source_run_totals(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue, file, skipped and error counts per project; ``files`` carries one ``load_status`` per file."""
    loaded = files.groupBy("project_id").agg(
        F.count_if(F.col("load_status") == "loaded").alias("files_scanned"),
        F.count_if(F.col("load_status") == "skipped").alias("skipped_file_count"),
        F.count_if(F.col("load_status") == "error").alias("error_count"),
    )
    found = issues.groupBy("project_id").agg(F.count("*").alias("issue_count"))
    return loaded.join(found, "project_id", "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))


def knowledge_by_rule(findings: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Findings counted per project and rule, then matched with the knowledge of the rule.

    Counting first keeps the join input at one row per project and rule, whatever the number of findings.
    """
    counted = findings.groupBy("project_id", "rule_id").agg(F.count("*").alias("n"))
    known = knowledge.withColumn("_known", F.lit(True))
    return counted.join(known, "rule_id", "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def knowledge_summary(by_rule: DataFrame) -> DataFrame:
    known_n = F.when(F.col("known"), F.col("n")).otherwise(0)
    scored = F.when(F.col("cvss_score").isNotNull(), F.col("n")).otherwise(0)
    return by_rule.groupBy("project_id").agg(
        F.sum("n").alias("finding_count"),
        F.sum(known_n).alias("knowledge_enriched"),
        F.count("*").alias("unique_rule_count"),
        F.sum(scored).alias("cvss_count"),
        scoring.half_even_places(F.sum(F.col("cvss_score") * F.col("n")) / F.nullif(F.sum(scored), F.lit(0)), 2).alias("cvss_average"),
        F.max("cvss_score").alias("cvss_maximum"),
    ).withColumn("coverage_percent", scoring.half_even_places(F.col("knowledge_enriched") * 100 / F.col("finding_count"), 2))


def knowledge_histogram(by_rule: DataFrame, column: str) -> DataFrame:
    """How many findings each OWASP, CWE or CAPEC entry of the knowledge covers, per project."""
    return (
        by_rule.filter("known")
        .select("project_id", "n", F.explode(column).alias("entry"))
        .groupBy("project_id", "entry")
        .agg(F.sum("n").alias("finding_count"))
    )


def top_rules_per_project(rule_summary: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent rules of each project, by count then rule id."""
    order = W.partitionBy("project_id").orderBy(F.desc("finding_count"), F.asc("rule_id"))
    return rule_summary.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def top_rules(rule_summary: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent rules overall."""
    total = rule_summary.groupBy("rule_id").agg(F.sum("finding_count").alias("finding_count"))
    return total.orderBy(F.desc("finding_count"), F.asc("rule_id")).limit(k)


def executive_summary(project_scores: DataFrame, affected: DataFrame, severities: DataFrame, top: DataFrame) -> DataFrame:
    """One row per project. The top rules arrive as at most ten rows per project."""
    packed = top.groupBy("project_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "rule_id", "finding_count"))),
            lambda r: F.struct(r["rule_id"].alias("rule"), r["finding_count"].alias("count")),
        ).alias("top_rules")
    )
    filled = [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in scoring.SEVERITIES]
    return (
        project_scores.join(affected, "project_id", "left")
        .join(severities, "project_id", "left")
        .join(packed, "project_id", "left")
        .select(
            "project_id",
            F.col("score").alias("overall_score"),
            F.col("severity").alias("overall_severity"),
            scoring.grade(F.col("score")).alias("risk_grade"),
            "endpoint_count",
            F.coalesce("affected_endpoint_count", F.lit(0)).alias("affected_endpoint_count"),
            F.coalesce("clean_endpoint_count", F.lit(0)).alias("clean_endpoint_count"),
            "finding_count",
            *filled,
            "top_rules",
        )
    )


def combined_severity_counts(endpoint_findings: DataFrame, source_issues: DataFrame) -> DataFrame:
    """Open endpoint findings plus all source issues, counted per project and severity."""
    both = endpoint_findings.filter("status = 'open'").select("project_id", "severity").unionByName(
        source_issues.select("project_id", "severity")
    )
    return severity_summary(both, ["project_id"])


def language_counts(files: DataFrame, by: list[str] = ()) -> DataFrame:
    """Files per language with their place in the report order: most frequent first, then by name."""
    counted = files.groupBy(*by, "language").agg(F.count("*").alias("file_count"))
    order = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    return counted.withColumn("position", F.row_number().over(order.orderBy(F.desc("file_count"), F.lower("language"))))


def project_status_counts(projects: DataFrame, by: list[str]) -> DataFrame:
    status = F.lower("status")
    return projects.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(status == name).alias(name) for name in ("ready", "scanning", "completed")],
    )


def portfolio_severities(reported: DataFrame, by: list[str]) -> DataFrame:
    return reported.groupBy(*by).agg(*[F.sum(name).cast("bigint").alias(name) for name in ("critical", "high", "medium", "low")])


def critical_high_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(
        F.count("*").alias("finding_count"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("critical_high_count"),
    )


def project_result_columns(projects: DataFrame, endpoint_scores: DataFrame, overall: DataFrame) -> DataFrame:
    """The two result columns a finished scan leaves on its project."""
    counted = endpoint_scores.groupBy("project_id").agg(F.count("*").alias("api_count"))
    return (
        projects.join(counted, "project_id", "left")
        .join(overall.select("project_id", "overall_score"), "project_id", "left")
        .select("project_id", "name", F.coalesce("api_count", F.lit(0)).alias("api_count"), F.col("overall_score").alias("security_score"))
    )
