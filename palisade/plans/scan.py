"""The whole scan as one plan: source files of many projects in, findings, scores and reports out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from palisade.catalog import rules as catalog
from palisade.operators import aggregates, discovery, endpoint_rules, facts as fact_ops, findings as finding_ops, runs, scores, source_rules
from palisade.session import cut_lineage
from palisade.sources import reports

ENDPOINT_KEYS = ["project_id", "relative_path", "seq", "route_no"]


@dataclass(frozen=True)
class ScanResult:
    facts: DataFrame
    endpoints: DataFrame
    endpoint_findings: DataFrame
    assessments: DataFrame
    source_findings: DataFrame
    runs: DataFrame
    errors: DataFrame
    scores: DataFrame
    severity_counts: DataFrame


def scan(files: DataFrame, projects: DataFrame, store: bool = False) -> ScanResult:
    """Scan ``files(project_id, relative_path, language, content)`` of ``projects(project_id, name, framework)``.

    The files are parsed once. The facts are written to a table in the shared checkpoint folder, one partition per
    kind, as several branches read parts of them; everything after that is relational. With ``store``, endpoints, assessments and
    findings are written too: whoever stores reports reads each of them several times.
    """
    spark = files.sparkSession
    known = projects.withColumn("project_id", F.col("project_id").cast("string"))
    facts = cut_lineage(fact_ops.code_facts(files), "kind")
    keep = cut_lineage if store else (lambda frame: frame)
    endpoints = keep(discovery.endpoints(facts))
    endpoint_findings, assessments = map(keep, endpoint_rules.assess(endpoints, ENDPOINT_KEYS))
    analyzers = catalog.analyzers(spark)
    source_findings = keep(finding_ops.applicable(source_rules.source_findings(facts), known, analyzers))
    severity_counts = aggregates.combined_severity_counts(endpoint_findings, source_findings)
    endpoint_level = scores.project_scores(assessments.select("project_id", "score", "finding_count"), known)
    overall = scores.overall_scores(endpoint_level, scores.source_scores(known, source_findings))
    return ScanResult(
        facts, endpoints, endpoint_findings, assessments, source_findings,
        runs.analyzer_runs(facts, source_findings), fact_ops.parse_errors(facts), overall, severity_counts)


def write(result: ScanResult, projects: DataFrame, scans: DataFrame, root: str, generated_at: datetime) -> None:
    """Store the discovery and the reports of a scan; ``scans(project_id, scan_id)`` numbers the runs."""
    known = projects.withColumn("project_id", F.col("project_id").cast("string"))
    numbered = scans.withColumn("project_id", F.col("project_id").cast("string"))
    last = numbered.agg(F.max("scan_id")).first()[0]
    reports.replace_discovery(discovery.stored_endpoints(result.endpoints), f"{root}/endpoints", last, known)
    analysis = reports.source_analysis(result.runs, result.source_findings, result.errors, result.endpoints)
    numbers = numbered.select("project_id", "scan_id")
    texts = result.endpoint_findings.select(
        *ENDPOINT_KEYS, "rule_id", "title", "description", "category", "severity", "confidence", "remediation", "owasp_reference", "cwe_id", "evidence", "status")
    issues = result.source_findings.select(
        "project_id", "relative_path", "rule_id", "analyzer", "severity", "confidence", "category", "line_start", "column_start", "function_name", "class_name", "evidence",
        "detail", "fingerprint")
    reports.write_reports({
        "summary": reports.report_summaries(known, numbered, result.scores, result.severity_counts, generated_at, analysis),
        "assessments": reports.report_parts(result.assessments, texts, ENDPOINT_KEYS).join(numbers, "project_id"),
        "endpoints": reports.endpoint_report(result.assessments.join(numbers, "project_id")),
        "source_findings": issues.join(numbers, "project_id"),
        "runs": result.runs.join(numbers, "project_id"),
        "errors": result.errors.join(numbers, "project_id"),
    }, f"{root}/reports")
