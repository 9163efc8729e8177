"""Aggregates over findings, knowledge, files and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators import aggregates, scores
from palisade.plans.catalogue import register, twin
from palisade.plans.registered.scoring import CALC_ENDPOINT, CALC_PROJECT
from palisade.sources import bindings as b

SEVERITY_COUNTS = ", ".join(f"cast(count(*) filter (where severity = '{s}') as bigint) as {s}" for s in ("critical", "high", "medium", "low", "info"))
CATEGORY_COUNTS = ", ".join(
    f"cast(count(*) filter (where category = '{c}' and status = 'open') as bigint) as {c}"
    for c in ("authentication", "authorization", "input_validation", "file_upload", "rate_limiting", "data_exposure",
              "error_handling", "security_configuration", "transport_security", "business_logic"))
RULES = "select project_id, rule_id, cast(count(*) as bigint) as finding_count from findings group by project_id, rule_id"
ENDPOINT_COUNTS = """select e.project_id, e.endpoint_id, e.method || ' ' || e.path as endpoint, cast(count(f.rule_id) as bigint) as finding_count
from endpoints e left join findings f on f.endpoint_id = e.endpoint_id group by e.project_id, e.endpoint_id, e.method, e.path"""
AFFECTED = """select project_id, cast(count(*) filter (where finding_count > 0) as bigint) as affected_endpoint_count,
  cast(count(*) filter (where finding_count = 0) as bigint) as clean_endpoint_count from endpoint_counts group by project_id"""
BY_RULE = """select r.project_id, r.rule_id, r.finding_count as n, k.owasp, k.cwe, k.cvss_score, k.rule_id is not null as known
from (select project_id, rule_id, count(*) as finding_count from findings group by project_id, rule_id) r
left join rule_knowledge k on k.rule_id = r.rule_id"""


def _by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    knowledge = b.rule_knowledge(spark, sf_dir).select(
        "rule_id", F.array("owasp").alias("owasp_api_categories"), F.array("cwe").alias("cwe_ids"),
        F.array(F.replace("cwe", F.lit("CWE"), F.lit("CAPEC"))).alias("capec_ids"), "cvss_score")
    return aggregates.knowledge_by_rule(b.findings(spark, sf_dir), knowledge)


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.findings(spark, sf_dir).filter("confidence = 'medium'")


@register("severity_summary", "AGG-1", twin(f"select project_id, {SEVERITY_COUNTS} from findings group by project_id", "findings"))
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.severity_summary(b.project_findings(spark, sf_dir), ["project_id"])


@register("rule_summary", "AGG-2", twin(RULES, "findings"))
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.rule_summary(b.findings(spark, sf_dir))


@register("endpoint_finding_counts", "AGG-3", twin(ENDPOINT_COUNTS, "endpoints", "findings"))
def endpoint_finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.endpoint_finding_counts(b.endpoints(spark, sf_dir), b.endpoint_severities(spark, sf_dir))


@register("affected_endpoints", "AGG-4", twin(AFFECTED, "endpoints", "findings", endpoint_counts=ENDPOINT_COUNTS))
def affected_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.affected_endpoints(endpoint_finding_counts(spark, sf_dir))


@register("open_severity_counts", "AGG-5", twin(
    f"select project_id, {SEVERITY_COUNTS.replace(chr(39) + ')', chr(39) + ' and status = ' + chr(39) + 'open' + chr(39) + ')')} from findings group by project_id", "findings"))
def open_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.severity_summary(b.project_findings(spark, sf_dir), ["project_id"], only_open=True)


@register("open_category_counts", "AGG-6", twin(f"select project_id, {CATEGORY_COUNTS} from findings group by project_id", "findings"))
def open_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.category_summary(b.findings(spark, sf_dir), ["project_id"])


@register("source_issue_counts", "AGG-7", twin(
    " union all ".join(
        f"select project_id, '{facet}' as facet, {column} as value, cast(count(*) as bigint) as issue_count from issues group by project_id, {column}"
        for facet, column in (("severity", "severity"), ("confidence", "confidence"), ("category", "category"), ("rule", "rule_id"))),
    "findings", issues="select * from findings where confidence = 'medium'"))
def source_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.source_issue_counts(_source(spark, sf_dir))


@register("knowledge_summary", "AGG-8 JOI-3", twin(
    """select project_id, cast(sum(n) as bigint) as finding_count, cast(sum(case when known then n else 0 end) as bigint) as knowledge_enriched,
  cast(count(*) as bigint) as unique_rule_count, cast(sum(case when cvss_score is not null then n else 0 end) as bigint) as cvss_count,
  round_even(sum(cvss_score * n) / nullif(sum(case when cvss_score is not null then n else 0 end), 0), 2) as cvss_average,
  max(cvss_score) as cvss_maximum, round_even(sum(case when known then n else 0 end) * 100.0 / sum(n), 2) as coverage_percent
from by_rule group by project_id""", "findings", "rule_knowledge", by_rule=BY_RULE))
def knowledge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.knowledge_summary(_by_rule(spark, sf_dir))


@register("knowledge_histogram", "AGG-8 REM-6", twin(
    """select project_id, 'owasp' as kind, owasp as entry, cast(sum(n) as bigint) as finding_count from by_rule where known group by project_id, owasp
union all select project_id, 'cwe', cwe, cast(sum(n) as bigint) from by_rule where known group by project_id, cwe
union all select project_id, 'capec', replace(cwe, 'CWE', 'CAPEC'), cast(sum(n) as bigint) from by_rule where known group by project_id, cwe""",
    "findings", "rule_knowledge", by_rule=BY_RULE))
def knowledge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _by_rule(spark, sf_dir).filter("known").select("project_id", "n", F.explode(F.concat(
        F.transform("owasp_api_categories", lambda e: F.struct(F.lit("owasp").alias("kind"), e.alias("entry"))),
        F.transform("cwe_ids", lambda e: F.struct(F.lit("cwe").alias("kind"), e.alias("entry"))),
        F.transform("capec_ids", lambda e: F.struct(F.lit("capec").alias("kind"), e.alias("entry"))),
    )).alias("e"))
    return entries.groupBy("project_id", "e.kind", "e.entry").agg(F.sum("n").alias("finding_count"))


@register("executive_summary", "AGG-9 TOP-7", twin(
    f"""select c.project_id, c.score as overall_score,
  case when c.score >= 90 then 'info' when c.score >= 75 then 'low' when c.score >= 50 then 'medium' when c.score >= 25 then 'high' else 'critical' end as overall_severity,
  case when c.score >= 95 then 'A+' when c.score >= 90 then 'A' when c.score >= 80 then 'B' when c.score >= 70 then 'C'
    when c.score >= 60 then 'D' when c.score >= 40 then 'E' else 'F' end as risk_grade,
  c.endpoint_count, a.affected_endpoint_count, a.clean_endpoint_count, c.finding_count,
  coalesce(s.critical, 0) as critical, coalesce(s.high, 0) as high, coalesce(s.medium, 0) as medium, coalesce(s.low, 0) as low, coalesce(s.info, 0) as info,
  t.top_rules
from calc_project c left join affected a on a.project_id = c.project_id
left join (select project_id, {SEVERITY_COUNTS} from findings group by project_id) s on s.project_id = c.project_id
left join (select project_id, string_agg(rule_id || '=' || cast(finding_count as varchar), ',' order by finding_count desc, rule_id) as top_rules
  from (select *, row_number() over (partition by project_id order by finding_count desc, rule_id) as rn from rules) where rn <= 10 group by project_id) t
  on t.project_id = c.project_id""",
    "endpoints", "findings", calc=CALC_ENDPOINT, calc_project=CALC_PROJECT, endpoint_counts=ENDPOINT_COUNTS, affected=AFFECTED, rules=RULES))
def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, listed = b.findings(spark, sf_dir), b.endpoints(spark, sf_dir)
    scored = scores.project_scores(scores.endpoint_scores(listed, b.endpoint_severities(spark, sf_dir)))
    affected = aggregates.affected_endpoints(endpoint_finding_counts(spark, sf_dir))
    top = aggregates.top_rules_per_project(aggregates.rule_summary(found))
    summary = aggregates.executive_summary(scored, affected, aggregates.severity_summary(b.project_findings(spark, sf_dir), ["project_id"]), top)
    shown = F.transform("top_rules", lambda r: F.concat(r["rule"], F.lit("="), r["count"].cast("string")))
    return summary.withColumn("top_rules", F.concat_ws(",", shown)).withColumn(
        "top_rules", F.when(F.col("finding_count") > 0, F.col("top_rules")))


@register("combined_severity_counts", "AGG-10 SET-1", twin(
    f"""select project_id, {SEVERITY_COUNTS} from (select project_id, severity from findings where confidence = 'high' and status = 'open'
union all select project_id, severity from findings where confidence = 'medium') u group by project_id""", "findings"))
def combined_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.combined_severity_counts(*(b.project_findings(spark, sf_dir).filter(F.col("confidence") == c) for c in ("high", "medium")))


@register("language_counts", "AGG-12", twin(
    """select project_id, language, file_count, cast(row_number() over (partition by project_id order by file_count desc, lower(language)) as int) as position
from (select source as project_id, lang as language, cast(count(*) as bigint) as file_count from documents group by source, lang) t"""))
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.language_counts(b.source_files(spark, sf_dir), ["project_id"])


@register("project_status_counts", "AGG-13", twin(
    """select user_id, cast(count(*) as bigint) as total, cast(count(*) filter (where status = 'ready') as bigint) as ready,
  cast(count(*) filter (where status = 'scanning') as bigint) as scanning, cast(count(*) filter (where status = 'completed') as bigint) as completed
from (select user_id, case framework when 'building' then 'ready' when 'machinery' then 'scanning' when 'household' then 'completed' else 'uploaded' end as status
  from projects) t group by user_id""", "projects"))
def project_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("framework") == "building", "READY").when(F.col("framework") == "machinery", "scanning").when(
        F.col("framework") == "household", "Completed").otherwise("uploaded")
    return aggregates.project_status_counts(b.projects(spark, sf_dir).withColumn("status", status), ["user_id"])


@register("portfolio_severities", "AGG-14", twin(
    f"""select p.user_id, cast(sum(s.critical) as bigint) as critical, cast(sum(s.high) as bigint) as high, cast(sum(s.medium) as bigint) as medium,
  cast(sum(s.low) as bigint) as low from projects p join (select project_id, {SEVERITY_COUNTS} from findings where status = 'open' group by project_id) s
  on s.project_id = p.project_id group by p.user_id""", "projects", "findings"))
def portfolio_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregates.severity_summary(b.project_findings(spark, sf_dir).filter("status = 'open'"), ["project_id"])
    reported = counts.join(b.projects(spark, sf_dir).select("project_id", "user_id"), "project_id")
    return aggregates.portfolio_severities(reported, ["user_id"])


@register("critical_high_counts", "AGG-15", twin(
    """select project_id, cast(count(*) as bigint) as finding_count,
  cast(count(*) filter (where severity in ('critical', 'high')) as bigint) as critical_high_count from findings group by project_id""", "findings"))
def critical_high_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.critical_high_counts(b.project_findings(spark, sf_dir), ["project_id"])


@register("top_rules", "TOP-7 AGG-9", twin(
    "select rule_id, cast(count(*) as bigint) as finding_count from findings group by rule_id order by finding_count desc, rule_id limit 10", "findings"))
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_rules(aggregates.rule_summary(b.findings(spark, sf_dir)))
