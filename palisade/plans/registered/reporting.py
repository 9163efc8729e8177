"""Report documents, sinks read back, and the whole scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.functions import scoring, text
from palisade.operators import discovery, endpoint_rules, facts, scores
from palisade.plans import scan as scans
from palisade.plans.catalogue import register, twin
from palisade.plans.registered.code import EXPECTED_ASSESSMENTS, EXPECTED_ROUTE_FINDINGS, EXPECTED_RULES, MODULE_ROWS, values
from palisade.plans.registered.scoring import CALC_ENDPOINT
from palisade.session import cut_lineage
from palisade.sources import bindings as b, modules, reports
from palisade.streaming.events import run_folder


@register("report_documents", "FND-19 SRC-12", twin(
    """select c.project_id, c.endpoint_id, c.score, c.finding_count, cast(count(f.rule_id) as bigint) as listed,
  cast(count(*) filter (where f.severity = 'critical') as bigint) as critical, min(f.rule_id) as first_rule
from calc c left join findings f on f.endpoint_id = c.endpoint_id group by all""", "endpoints", "findings", calc=CALC_ENDPOINT))
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are split at three findings here, so that the parts of an endpoint have to be put together."""
    keys = ["project_id", "endpoint_id"]
    scored = scores.endpoint_scores(b.endpoints(spark, sf_dir), b.endpoint_severities(spark, sf_dir)).select(*keys, "method", "path", "score", "severity", "finding_count")
    found = b.findings(spark, sf_dir).select(*keys, "rule_id", "title", "severity", "status", "file_path", "line_number", F.col("seq.l_extendedprice").alias("price"))
    parts = reports.report_parts(scored, found, keys, size=3)
    critical = F.size(F.filter("findings", lambda f: f["severity"] == "critical"))
    listed = F.greatest(F.size("findings"), F.lit(0))
    return parts.groupBy(*keys, "assessment.score", "assessment.finding_count").agg(
        F.sum(listed).cast("bigint").alias("listed"),
        F.coalesce(F.sum(F.when(F.col("findings").isNotNull(), critical)), F.lit(0)).cast("bigint").alias("critical"),
        F.min(F.array_min(F.transform("findings", lambda f: f["rule_id"]))).alias("first_rule"))


ENDPOINT_SCORE = f"""select s.project_id, s.segment, s.k, coalesce(cast(round_even(avg(e.score), 0) as bigint), 100) as endpoint_score from modules s
left join {values(EXPECTED_ASSESSMENTS, 'e(k, method, path, rules, score)')} on e.k = s.k group by s.project_id, s.segment, s.k"""
RULE_SEVERITY = values(tuple((r[0], r[3]) for r in EXPECTED_RULES), "r(rule_id, severity)")
SCAN_SCORES = f"""select p.project_id, p.endpoint_score, greatest(0, 100 - cast(coalesce(sum(case r.severity when 'critical' then 25 when 'high' then 15 when 'medium' then 8 when 'low' then 3 else 0 end), 0) as bigint)) as source_score
from endpoint_score p left join {values(EXPECTED_ROUTE_FINDINGS, 'f(k, rule_id, line_start, column_start, function_name, evidence)')} on f.k = p.k and p.segment = 'BUILDING'
left join {RULE_SEVERITY} on r.rule_id = f.rule_id group by p.project_id, p.endpoint_score"""


def _scan(spark: SparkSession, sf_dir: str, store: bool = False) -> tuple[scans.ScanResult, DataFrame]:
    framework = F.when(F.col("framework") == "building", "FastAPI").otherwise(F.col("framework"))
    projects = b.projects(spark, sf_dir).select(F.col("project_id").cast("string").alias("project_id"), "name", framework.alias("framework"))
    return scans.scan(modules.route_modules(spark, sf_dir), projects, store), projects


@register("full_scan_scores", "EPR-5 FND-9 SCO-3 SCO-5 SCO-6 SCO-8", twin(
    """select *, case when overall_score >= 90 then 'info' when overall_score >= 70 then 'low' when overall_score >= 50 then 'medium' when overall_score >= 30 then 'high' else 'critical' end as severity
from (select *, cast(round_even((endpoint_score + source_score) / 2.0, 0) as bigint) as overall_score from scan_scores) t""",
    modules=MODULE_ROWS, endpoint_score=ENDPOINT_SCORE, scan_scores=SCAN_SCORES))
def full_scan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _ = _scan(spark, sf_dir)
    return result.scores.select("project_id", "endpoint_score", "source_score", "overall_score", "severity")


SOURCE_ISSUES = f"""select m.project_id, count(*) as issues from modules m
join {values(EXPECTED_ROUTE_FINDINGS, 'f(k, rule_id, line_start, column_start, function_name, evidence)')} on f.k = m.k and m.segment = 'BUILDING' group by 1"""


@register("stored_reports", "SRC-11 SRC-12 FND-19", twin(
    f"""select s.project_id, '1.0' as report_version, cast(round_even((endpoint_score + source_score) / 2.0, 0) as bigint) as score, true as report_available,
  cast(coalesce(e.endpoints, 0) as bigint) as endpoint_count, cast(1 as bigint) as files_scanned, cast(case when m.k = 24 then 1 else 0 end as bigint) as error_count,
  cast(coalesce(i.issues, 0) as bigint) as issue_count, cast(coalesce(i.issues, 0) as bigint) as stored_issues, cast(coalesce(e.endpoints, 0) as bigint) as endpoint_rows,
  coalesce(e.found, 0) as listed_findings, 'python' as language
from scan_scores s join modules m on m.project_id = s.project_id left join source_issues i on i.project_id = s.project_id
left join (select k, count(*) as endpoints, cast(sum(case rules when '' then 0 else len(string_split(rules, ',')) end) as bigint) as found
  from {values(EXPECTED_ASSESSMENTS, 'a(k, method, path, rules, score)')} group by k) e on e.k = m.k""",
    modules=MODULE_ROWS, endpoint_score=ENDPOINT_SCORE, scan_scores=SCAN_SCORES, source_issues=SOURCE_ISSUES))
def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store a scan with everything it found, read the tables back and compare documents, issues and endpoint rows."""
    result, projects = _scan(spark, sf_dir, store=True)
    runs = projects.select("project_id", F.lit(1).alias("scan_id"))
    root = run_folder(spark)
    scans.write(result, projects.withColumn("language", F.lit("python")), runs, root, datetime(2024, 1, 1))
    read = lambda name: reports.read_report(spark, f"{root}/reports", name)
    counted = lambda name, as_: read(name).groupBy("project_id").agg(F.count("*").alias(as_))
    report = F.from_json("report", "report_version string, project struct<language:string>, summary struct<score:bigint>, source_analysis struct<issue_count:bigint>, "
                         "scan struct<endpoint_count:bigint, files_scanned:bigint, error_count:bigint>")
    heads = read("summary").withColumn("r", report)
    found = read("assessments").groupBy("project_id").agg(F.sum(F.greatest(F.size("findings"), F.lit(0))).cast("bigint").alias("listed_findings"))
    joined = heads.join(reports.with_report_available(runs, heads), ["project_id", "scan_id"])
    for other in (counted("source_findings", "stored_issues"), counted("endpoints", "endpoint_rows"), found):
        joined = joined.join(other, "project_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return joined.select(
        "project_id", "r.report_version", "r.project.language", "r.summary.score", "report_available", "r.scan.endpoint_count", "r.scan.files_scanned", "r.scan.error_count",
        "r.source_analysis.issue_count", zero("stored_issues"), zero("endpoint_rows"), zero("listed_findings"))


@register("stored_summaries", "SRC-12", twin(
    """select scan_id, cast(case when scan_id % 4 < 3 then scan_id % 101 end as bigint) as score from scan_jobs""", "scan_jobs"))
def stored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they were stored over time: plain, wrapped in a report, wrapped in data, and without a summary."""
    scan, own = F.col("scan_id"), F.concat(F.lit('{"summary": {"score": '), (F.col("scan_id") % 101).cast("string"), F.lit("}}"))
    payload = F.when(scan % 4 == 0, own).when(scan % 4 == 1, F.concat(F.lit('{"report": '), own, F.lit("}"))).when(
        scan % 4 == 2, F.concat(F.lit('{"summary": null, "data": '), own, F.lit("}"))).otherwise(F.lit('{"data": []}'))
    found = reports.stored_summary(payload)
    return b.scan_jobs(spark, sf_dir).select("scan_id", F.from_json(found, "score bigint")["score"].alias("score"))


@register("project_search", "SRC-15", twin(
    """select project_id from projects where lower(name || ' building site ' || framework) like '%site mach%' or lower(name) like '%0042%'""", "projects"))
def project_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches over name, description, language, framework and status of the projects."""
    shown = b.projects(spark, sf_dir).withColumns({"description": F.lit("Building site"), "detected_language": F.lit(""), "status": F.lit(None).cast("string")})
    fields = [F.col(c) for c in ("name", "description", "detected_language", "framework", "status")]
    return shown.filter(text.search_match(fields, " SITE mach") | text.search_match(fields[:1], "0042 ")).select("project_id")


@register("discovery_snapshot", "SRC-13", twin(
    """select k as project_kind, cast(count(*) as bigint) as endpoints, case when k < 12 then 'second' else 'first' end as scan from (select s.k from modules s where s.k <> 24
union all select s.k from modules s where s.k = 23) t group by k""", modules=MODULE_ROWS))
def discovery_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store a discovery, store a second one for some of the kinds only, and read the table back."""
    kinds = b.projects(spark, sf_dir).select(F.col("project_id").cast("string").alias("p"), F.col("user_id").alias("kind"))
    found = discovery.endpoints(facts.code_facts(modules.route_modules(spark, sf_dir), discovery.ENDPOINT_FACTS)).select("project_id", "method", "full_path")
    # Parsed once for both scans.
    keyed = cut_lineage(found.join(kinds, F.col("project_id") == F.col("p")).select(F.col("kind").alias("project_id"), "method", "full_path"))
    path = f"{run_folder(spark)}/discovery"
    reports.replace_discovery(keyed.withColumn("scan", F.lit("first")), path)
    reports.replace_discovery(keyed.filter("project_id < 12").withColumn("scan", F.lit("second")), path)
    return reports.read_discovery(spark, path).groupBy(F.col("project_id").alias("project_kind"), "scan").agg(F.count("*").alias("endpoints"))
