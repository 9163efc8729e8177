"""Scores over the endpoint and finding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.functions import scoring
from palisade.operators import aggregates, scores
from palisade.plans.catalogue import CALCULATOR, MODEL, band, grade, register, twin
from palisade.sources import bindings as b

CALC_ENDPOINT = f"""select e.project_id, e.endpoint_id, cast(count(f.severity) as bigint) as finding_count,
  cast(greatest(0, 100 - coalesce(sum({CALCULATOR.replace('severity', 'f.severity')}), 0)) as bigint) as score
from endpoints e left join findings f on f.endpoint_id = e.endpoint_id group by e.project_id, e.endpoint_id"""
MODEL_ENDPOINT = f"""select e.project_id, e.endpoint_id,
  cast(greatest(0, 100 - coalesce(sum(case when f.status = 'open' then {MODEL.replace('severity', 'f.severity')} else 0 end), 0)) as bigint) as score,
  count(*) filter (where f.status = 'open' and f.severity = 'critical') as crit,
  count(*) filter (where f.status = 'open' and f.severity = 'high') as hi
from endpoints e left join findings f on f.endpoint_id = e.endpoint_id group by e.project_id, e.endpoint_id"""
CALC_PROJECT = """select project_id, cast(count(*) as bigint) as endpoint_count, cast(sum(finding_count) as bigint) as finding_count,
  cast(round_even(avg(score), 0) as bigint) as score from calc group by project_id"""
SOURCE_SCORE = f"""select p.project_id, cast(greatest(0, 100 - coalesce(sum({MODEL.replace('severity', 's.severity')}), 0)) as bigint) as source_score
from projects p left join (select project_id, severity from findings where confidence = 'medium') s on s.project_id = p.project_id group by p.project_id"""
OVERALL = """select project_id, endpoint_score, source_score,
  cast(round_even((endpoint_score + source_score) / 2.0, 0) as bigint) as overall_score
from (select coalesce(a.project_id, s.project_id) as project_id, coalesce(a.score, 100) as endpoint_score,
  coalesce(s.source_score, 100) as source_score from calc_project a full outer join source_score s on a.project_id = s.project_id) t"""


def _endpoint(spark: SparkSession, sf_dir: str, profile: str = "calculator") -> DataFrame:
    return scores.endpoint_scores(b.endpoints(spark, sf_dir), b.endpoint_severities(spark, sf_dir), profile)


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.project_findings(spark, sf_dir).filter("confidence = 'medium'")


def _overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_project = scores.project_scores(_endpoint(spark, sf_dir))
    source = scores.source_scores(b.projects(spark, sf_dir), _source(spark, sf_dir))
    return scores.overall_scores(per_project, source)


@register("project_scan_summary", "SCO-1 SCO-3 SCO-7", twin(
    f"select *, {band('score', 'calculator')} as severity from ({CALC_PROJECT}) t", "endpoints", "findings", calc=CALC_ENDPOINT))
def project_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.project_scores(_endpoint(spark, sf_dir))


@register("endpoint_score_calculator", "SCO-1 SCO-7", twin(
    f"select project_id, endpoint_id, finding_count, score, {band('score', 'calculator')} as severity from calc",
    "endpoints", "findings", calc=CALC_ENDPOINT))
def endpoint_score_calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endpoint(spark, sf_dir).select("project_id", "endpoint_id", "finding_count", "score", "severity")


@register("endpoint_score_model", "SCO-2 SCO-8", twin(
    f"select project_id, endpoint_id, score, {band('score', 'model')} as severity from model",
    "endpoints", "findings", model=MODEL_ENDPOINT))
def endpoint_score_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endpoint(spark, sf_dir, "model").select("project_id", "endpoint_id", "score", "severity")


@register("project_score_with_clean_projects", "SCO-3 AGG-3", twin(
    f"""select p.project_id, coalesce(t.endpoint_count, 0) as endpoint_count, coalesce(t.finding_count, 0) as finding_count,
  coalesce(t.score, 100) as score, {band('coalesce(t.score, 100)', 'calculator')} as severity
from projects p left join ({CALC_PROJECT}) t on t.project_id = p.project_id""",
    "projects", "endpoints", "findings", calc=CALC_ENDPOINT))
def project_score_with_clean_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.project_scores(_endpoint(spark, sf_dir), b.projects(spark, sf_dir))


@register("project_score_model", "SCO-4 SCO-8", twin(
    f"""select *, {band('score', 'model')} as severity from (
select project_id, average_score, open_critical, open_high,
  cast(greatest(0, least(100, average_score - least(30, open_critical * 10) - least(15, open_high * 3))) as bigint) as score
from (select project_id, cast(round_even(avg(score), 0) as bigint) as average_score, cast(sum(crit) as bigint) as open_critical,
  cast(sum(hi) as bigint) as open_high from model group by project_id) t) u""",
    "endpoints", "findings", model=MODEL_ENDPOINT))
def project_score_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.project_model_scores(b.endpoints(spark, sf_dir), b.endpoint_severities(spark, sf_dir))


@register("source_score", "SCO-5", twin("select * from source_score", "projects", "findings", source_score=SOURCE_SCORE))
def source_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.source_scores(b.projects(spark, sf_dir), _source(spark, sf_dir))


@register("overall_score", "SCO-6 SCO-8 SCO-9", twin(
    f"select *, {band('overall_score', 'model')} as severity, {grade('overall_score')} as risk_grade from overall",
    "projects", "endpoints", "findings", calc=CALC_ENDPOINT, calc_project=CALC_PROJECT, source_score=SOURCE_SCORE, overall=OVERALL))
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overall(spark, sf_dir)


@register("portfolio_score", "SCO-10", twin(
    """select p.user_id, cast(count(t.score) as bigint) as scored_projects, cast(floor(avg(t.score) + 0.5) as bigint) as security_score
from projects p left join calc_project t on t.project_id = p.project_id group by p.user_id""",
    "projects", "endpoints", "findings", calc=CALC_ENDPOINT, calc_project=CALC_PROJECT))
def portfolio_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_project = scores.project_scores(_endpoint(spark, sf_dir)).select("project_id", "score")
    owned = b.projects(spark, sf_dir).select("project_id", "user_id").join(per_project, "project_id", "left")
    return scores.portfolio_scores(owned, ["user_id"])


@register("project_posture", "SCO-11", twin(
    """select c.project_id, c.score, case when s.critical > 0 then 'Critical' when s.high > 0 then 'High Risk'
  when s.medium > 0 or c.score < 70 then 'Needs Review' when s.low > 0 or c.score < 85 then 'Moderate' else 'Secure' end as posture
from calc_project c left join (select project_id, count(*) filter (where severity = 'critical') as critical,
  count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium,
  count(*) filter (where severity = 'low') as low from findings where status = 'open' group by project_id) s on s.project_id = c.project_id""",
    "endpoints", "findings", calc=CALC_ENDPOINT, calc_project=CALC_PROJECT))
def project_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_counts = aggregates.severity_summary(b.project_findings(spark, sf_dir), ["project_id"], only_open=True)
    return scores.project_posture(scores.project_scores(_endpoint(spark, sf_dir)), open_counts)


@register("score_band_profiles", "SCO-7 SCO-8 SCO-9", twin(
    f"""select score, {band('score', 'calculator')} as calculator_band, {band('score', 'model')} as model_band,
  {grade('score')} as risk_grade, cast(count(*) as bigint) as endpoint_count from calc group by score""",
    "endpoints", "findings", calc=CALC_ENDPOINT))
def score_band_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _endpoint(spark, sf_dir).groupBy("score").agg(F.count("*").alias("endpoint_count"))
    return counted.select(
        "score",
        scoring.band(F.col("score"), "calculator").alias("calculator_band"),
        scoring.band(F.col("score"), "model").alias("model_band"),
        scoring.grade(F.col("score")).alias("risk_grade"),
        "endpoint_count",
    )


@register("project_result_columns", "AGG-16", twin(
    """select p.project_id, p.name, coalesce(c.endpoint_count, 0) as api_count, o.overall_score as security_score
from projects p left join calc_project c on c.project_id = p.project_id left join overall o on o.project_id = p.project_id""",
    "projects", "endpoints", "findings", calc=CALC_ENDPOINT, calc_project=CALC_PROJECT, source_score=SOURCE_SCORE, overall=OVERALL))
def project_result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.project_result_columns(b.projects(spark, sf_dir), _endpoint(spark, sf_dir), _overall(spark, sf_dir))
