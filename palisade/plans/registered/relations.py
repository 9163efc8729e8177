"""Ranking, joins and set operations over the project, scan and upload tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators import aggregates, ranking, relations, scores
from palisade.plans.catalogue import register, twin
from palisade.plans.registered.scoring import CALC_ENDPOINT, CALC_PROJECT
from palisade.sources import bindings as b
from palisade.sources.relational import accept_uploads


@register("latest_upload", "TOP-1", twin(
    "select project_id, upload_id, file_size from (select *, row_number() over (partition by project_id order by upload_id desc) as rn from uploads) t where rn = 1", "uploads"))
def latest_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest_per(b.uploads(spark, sf_dir), ["project_id"], "upload_id").select("project_id", "upload_id", "file_size")


@register("latest_scan", "TOP-2", twin(
    """select project_id, scan_id, status, created_at from (select *, row_number() over (partition by project_id order by created_at desc, scan_id desc) as rn
from scan_jobs) t where rn = 1""", "scan_jobs"))
def latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest_per(b.scan_jobs(spark, sf_dir), ["project_id"], "created_at", "scan_id").select("project_id", "scan_id", "status", "created_at")


@register("scan_history", "TOP-3", twin(
    """select project_id, scan_id, created_at, cast(row_number() over (partition by project_id order by created_at desc, scan_id desc) as bigint) as scan_no,
  cast(count(*) over (partition by project_id) as bigint) as total from scan_jobs""", "scan_jobs"))
def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scan_history(b.scan_jobs(spark, sf_dir)).select("project_id", "scan_id", "created_at", "scan_no", "total")


@register("owner_projects", "TOP-4 JOI-1", twin(
    """select user_id, project_id, name, cast(row_number() over (partition by user_id order by created_at desc, project_id desc) as bigint) as position,
  cast(count(*) over (partition by user_id) as bigint) as total
from (select p.user_id, p.project_id, p.name, min(s.created_at) as created_at from projects p join scan_jobs s on s.project_id = p.project_id
  group by p.user_id, p.project_id, p.name) t""", "projects", "scan_jobs"))
def owner_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = b.scan_jobs(spark, sf_dir).groupBy("project_id").agg(F.min("created_at").alias("created_at"))
    dated = b.projects(spark, sf_dir).join(since, "project_id")
    return ranking.owner_projects(dated).select("user_id", "project_id", "name", "position", "total")


@register("scan_queue", "TOP-5", twin(
    "select scan_id, project_id, cast(row_number() over (order by created_at, scan_id) as bigint) as queue_position from scan_jobs where status = 'queued'", "scan_jobs"))
def scan_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scan_queue(b.scan_jobs(spark, sf_dir)).select("scan_id", "project_id", "queue_position")


@register("latest_report", "TOP-6", twin(
    """select user_id, project_id as latest_project_id, seen as latest_scan_at from (select p.user_id, p.project_id, coalesce(s.finished, s.started) as seen,
  row_number() over (partition by p.user_id order by coalesce(s.finished, s.started) desc, p.project_id desc) as rn
from projects p join (select project_id, max(case when status = 'completed' then created_at end) as finished, max(created_at) as started from scan_jobs group by project_id) s
  on s.project_id = p.project_id) t where rn = 1""", "projects", "scan_jobs"))
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = b.scan_jobs(spark, sf_dir).groupBy("project_id").agg(
        F.max(F.when(F.col("status") == "completed", F.col("created_at"))).alias("completed_at"), F.max("created_at").alias("started_at"))
    return ranking.latest_report(b.projects(spark, sf_dir).join(times, "project_id"), ["user_id"], ["completed_at", "started_at"])


@register("owned_scans", "JOI-1 SRC-15", twin(
    "select s.scan_id, s.project_id, s.status from scan_jobs s where s.project_id in (select project_id from projects where user_id = 7)", "projects", "scan_jobs"))
def owned_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.owned(b.scan_jobs(spark, sf_dir), b.projects(spark, sf_dir), user_id=7).select("scan_id", "project_id", "status")


@register("scan_requests", "JOI-2", twin(
    """select p.project_id, case when exists (select 1 from scan_jobs s where s.project_id = p.project_id and s.status in ('queued', 'running'))
  then 'reuse' else 'new' end as decision from projects p""", "projects", "scan_jobs"))
def scan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = b.projects(spark, sf_dir).select("project_id")
    scans = b.scan_jobs(spark, sf_dir)
    new = relations.new_scan_requests(wanted, scans).withColumn("decision", F.lit("new"))
    return new.unionByName(relations.reused_scan_requests(wanted, scans).withColumn("decision", F.lit("reuse")))


@register("notification_outbox", "JOI-7", twin(
    """select s.scan_id, u.email as recipient, p.name as project_name, c.score, v.critical, v.high,
  case when s.status = 'completed' then 'scan_completed' else 'scan_failed' end as message
from scan_jobs s join projects p on p.project_id = s.project_id join users u on u.user_id = p.user_id
left join calc_project c on c.project_id = p.project_id
left join (select project_id, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'high') as high from findings group by project_id) v
  on v.project_id = p.project_id where s.status <> 'queued'""",
    "scan_jobs", "projects", "users", "endpoints", "findings", calc=CALC_ENDPOINT, calc_project=CALC_PROJECT))
def notification_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = b.project_findings(spark, sf_dir)
    scored = scores.project_scores(scores.endpoint_scores(b.endpoints(spark, sf_dir), b.endpoint_severities(spark, sf_dir)))
    results = scored.select("project_id", "score").join(aggregates.severity_summary(found, ["project_id"]), "project_id", "left")
    finished = b.scan_jobs(spark, sf_dir).filter("status <> 'queued'")
    rows = relations.notification_outbox(finished, b.projects(spark, sf_dir), b.users(spark, sf_dir), results)
    return rows.select("scan_id", "recipient", "project_name", "score", "critical", "high", "message")


@register("discovery_diff", "JOI-8", twin(
    """select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.method, b.method) as method, coalesce(a.path, b.path) as path,
  case when a.project_id is null then 'added' when b.project_id is null then 'removed' else 'unchanged' end as change,
  case when b.project_id is null then 'removed' else 'active' end as discovery_status
from (select distinct project_id, method, split_part(path, '/', 3) as path from endpoints where discovered_at < timestamp '1998-01-01') a
full outer join (select distinct project_id, method, split_part(path, '/', 3) as path from endpoints where discovered_at >= timestamp '1998-01-01') b
  on a.project_id = b.project_id and a.method = b.method and a.path = b.path""", "endpoints"))
def discovery_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = b.endpoints(spark, sf_dir).withColumn("path", F.split_part(F.col("path"), F.lit("/"), F.lit(3)))
    cut = F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    return relations.discovery_diff(
        listed.filter(F.col("discovered_at") < cut), listed.filter(F.col("discovered_at") >= cut), ["project_id", "method", "path"])


@register("finding_changes", "SET-3", twin(
    """select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.fingerprint, b.fingerprint) as fingerprint,
  case when a.project_id is null then 'new' when b.project_id is null then 'resolved' else 'persisting' end as change
from (select distinct project_id, rule_id || '|' || file_path as fingerprint from findings where found_at < timestamp '1998-07-01') a
full outer join (select distinct project_id, rule_id || '|' || file_path as fingerprint from findings where found_at >= timestamp '1998-07-01') b
  on a.project_id = b.project_id and a.fingerprint = b.fingerprint""", "findings"))
def finding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = b.finding_tasks(spark, sf_dir)
    marked = b.findings(spark, sf_dir, tasks).withColumn("fingerprint", F.concat_ws("|", "rule_id", "file_path"))
    cut = F.to_timestamp_ntz(F.lit("1998-07-01 00:00:00"))
    return relations.finding_changes(marked.filter(F.col("found_at") < cut), marked.filter(F.col("found_at") >= cut), ["project_id", "fingerprint"], tasks)


@register("upload_deduplication", "SRC-14", twin(
    """select upload_id, project_id, sha256_checksum, true as accepted
from (select *, row_number() over (partition by sha256_checksum order by upload_id) as rn from uploads) t where rn = 1""", "uploads"))
def upload_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept_uploads(b.uploads(spark, sf_dir)).select("upload_id", "project_id", "sha256_checksum", F.lit(True).alias("accepted"))
