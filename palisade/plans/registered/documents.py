"""Stored report documents of all ages, as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.plans.catalogue import register, twin
from palisade.sources import bindings as b, documents
from palisade.streaming.events import run_folder

LATE = '"2090-01-01T00:00:00Z"'
# What a project and its document look like, by kind; ``{t}`` is the time of the project as ISO text, ``{ms}`` in milliseconds, ``{s}`` its score.
DOCUMENTS = (
    ('{"summary": {"score": {s}}, "scan": {"completed_at": "{t}", "finished_at": ' + LATE + "}}", "{}"),
    ('{"report": {"summary": {"score": {s}}, "scan": {"finished_at": "{t}", "completed_at": ""}}}', "{}"),
    ('{"summary": null, "data": {"summary": {"score": {s}}, "scan": {"updated_at": "{t}", "finished_at": "not a time"}}}', "{}"),
    ('{"summary": {"score": {s}}, "scan": {"started_at": "{t}", "completed_at": null, "created_at": ' + LATE + "}}", "{}"),
    ('{"summary": {"score": {s}}, "scan": {"created_at": {ms}, "completed_at": 0}}', "{}"),
    ('{"summary": {"score": {s}}, "generated_at": "{t}"}', '{"updated_at": ' + LATE + "}"),
    ('{"summary": {"score": {s}}, "scan": []}', '{"updated_at": "{t}", "created_at": ' + LATE + "}"),
    ('{"summary": {"score": {s}}, "scan": "none"}', '{"created_at": "{t}"}'),
    ('{"summary": {"score": {s}}, "scan": {"completed_at": ' + LATE + "}}", '{"latest_scan": {"completed_at": "{t}"}}'),
    ('{"summary": {"score": {s}}, "scan": ', '{"updated_at": "{t}"}'),
    ("[1, 2]", "{}"),
    ('{"summary": {"score": {s}}, "scan": {"completed_at": ' + LATE + '}, "generated_at": "{t}"}', '{"latest_scan": {}}'),
)


def _text(place: int) -> Column:
    """The JSON of a row by the kind of its project."""
    chosen = F.element_at(F.array(*[F.lit(d[place]) for d in DOCUMENTS]), (F.col("project_id") % len(DOCUMENTS)).cast("int") + 1)
    for mark, value in (("{t}", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), ("{ms}", F.unix_millis("at").cast("string")), ("{s}", (F.col("project_id") % 101).cast("string"))):
        chosen = F.replace(chosen, F.lit(mark), value)
    return chosen


@register("latest_documents", "TOP-6 FND-19 SRC-12", twin(
    """select user_id, project_id as latest_project_id, seen as latest_scan_at, score from (
  select *, row_number() over (partition by user_id order by coalesce(seen, timestamp '1970-01-01') desc, project_id desc) as rn from (
    select p.user_id, p.project_id, case when p.project_id % 12 <> 10 then cast(s.at as timestamp) end as seen,
      cast(case when p.project_id % 12 not in (9, 10) then p.project_id % 101 end as bigint) as score
    from projects p join (select project_id, max(created_at) as at from scan_jobs group by project_id) s on s.project_id = p.project_id) d) t where rn = 1""",
    "projects", "scan_jobs"))
def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and projects of twelve kinds, stored as VARIANT and read back; per user the document seen last and its score."""
    times = b.scan_jobs(spark, sf_dir).groupBy("project_id").agg(F.max("created_at").cast("timestamp").alias("at"))
    rows = b.projects(spark, sf_dir).select("project_id", "user_id").join(times, "project_id")
    path = f"{run_folder(spark)}/documents"
    documents.write_documents(rows.select("project_id", "user_id", _text(0).alias("payload"), F.parse_json(_text(1)).alias("project")), path)
    seen = documents.seen_documents(documents.read_documents(spark, path))
    latest = documents.latest_documents(seen, ["user_id"], "project_id")
    return latest.select("user_id", F.col("project_id").alias("latest_project_id"), F.col("seen").alias("latest_scan_at"), "score")
