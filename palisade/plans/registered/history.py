"""Versions of stored tables, and tables and timers that streams keep."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators import discovery, facts, lifecycle as ops, relations, source_rules
from palisade.plans.catalogue import register, twin
from palisade.plans.registered import lifecycle as live
from palisade.plans.registered.code import EXPECTED_SCRIPT_FINDINGS, MODULE_ROWS, SCRIPT_ROWS, values
from palisade.sources import bindings as b, modules, reports, snapshots
from palisade.streaming import deadlines, events as streams, tables

# --- What is stored of the endpoint of each module: kind, method, path, function, line, flags, lists, response, texts, parameters, responses. ---

_USER = "user:UNKNOWN::false:Depends(get_current_user):"
_CURRENT = "current_user:UNKNOWN::false:Depends(get_current_user):"
_DB = "db:UNKNOWN:Session:true::"
_ITEM = "item_id:PATH:int:true::"
STORED = (
    (0, "GET", "/users/{user_id}", "get_user", 2, False, False, "", "", None, None, None, False, "user_id:PATH:int:true::", ""),
    (1, "GET", "/users/{user_id}", "get_user", 2, True, False, "Depends(get_current_user)", "", None, None, None, False, f"user_id:PATH:int:true::;{_CURRENT}", ""),
    (2, "GET", "/admin/report", "report", 2, False, True, "Depends(require_admin)", "", None, None, None, False, "", ""),
    (3, "DELETE", "/documents/{document_id}", "delete_document", 2, False, False, "", "", None, None, None, False, "document_id:PATH:int:true::", ""),
    (4, "POST", "/files/{n}", "store", 2, True, False, "Depends(get_current_user)", "", None, None, None, False, f"file:FILE:UploadFile:true::;{_USER}", ""),
    (5, "POST", "/files/{n}", "store", 2, True, False, "Depends(get_current_user)", "", None, None, None, False, f"file:FILE:UploadFile:true::;{_USER}", ""),
    (6, "GET", "/weather", "weather_now", 2, False, False, "", "", None, None, None, False, "station:UNKNOWN:str:true::", "502::"),
    (7, "GET", "/leave", "leave", 2, False, False, "", "", None, None, None, False, "onward:UNKNOWN:str:true::;note:UNKNOWN:str:true::", "200:Response:"),
    (8, "POST", "/badges", "issue_badge", 2, True, False, "Depends(get_current_user)", "", None, None, None, False, f"form:UNKNOWN:BadgeForm:true::;{_USER}", ""),
    (9, "GET", "/invoices", "every_invoice", 2, True, False, "Depends(get_current_user)", "", None, None, None, False, _USER, ""),
    (10, "GET", "/invoices", "some_invoices", 2, True, False, "Depends(get_current_user)", "", None, None, None, False, f"page_size:QUERY:int:false:20:;{_USER}", ""),
    (11, "POST", "/transfer/{n}", "move_points", 2, False, False, "", "", None, None, None, False, "order:UNKNOWN:PointsOrder:true::", ""),
    (12, "POST", "/transfer/{n}", "move_points", 2, False, False, "Depends(rate_limit_points)", "", None, None, None, False, "order:UNKNOWN:PointsOrder:true::", ""),
    (13, "GET", "/v1/items/{item_id}", "old_item", 2, False, False, "", "", None, None, None, True, _ITEM, ""),
    (14, "GET", "/health", "health", 2, False, False, "", "", None, None, None, False, "", ""),
    (15, "GET", "/admin/metrics", "metrics", 2, False, False, "", "", None, None, None, False, "", ""),
    (16, "GET", "/items/{item_id}", "read_item", 2, False, False, "", "", None, None, None, False, f"{_ITEM};{_DB}", ""),
    (17, "GET", "/items/{item_id}", "read_item", 2, True, False, "Depends(get_current_user)", "", None, None, None, False, f"{_ITEM};{_DB};{_CURRENT}", "403::"),
    (18, "PATCH", "/items/{item_id}", "edit", 2, False, False, "", "", None, None, None, False, f"{_ITEM};payload:UNKNOWN:ItemUpdate:true::;{_DB}", ""),
    (19, "DELETE", "/items/{item_id}", "drop", 2, True, False, "Depends(get_current_user)", "", None, None, None, False, f"{_ITEM};{_DB};{_USER}", ""),
    (20, "DELETE", "/items/{item_id}", "drop", 2, True, True, "Depends(require_permission)", "", None, None, None, False, f"{_ITEM};{_DB}", ""),
    (21, "POST", "/actions", "act", 2, False, False, "", "", None, None, None, False, "payload:UNKNOWN:ActionRequest:true::", ""),
    (22, "PUT", "/v2/things/{thing_id}/", "put_thing", 5, True, True, "Security(oauth2_scheme, scopes=['read'])", "things,api", 202, None, None, False,
     "thing_id:PATH:int:true::;body:BODY:ThingModel:true::;q:UNKNOWN:str | None:false:None:", "201:JSONResponse:;404::gone"),
    (23, "GET", "/reports/{report_id}", "report", 3, False, False, "", "", None, None, "Read a report.", False,
     "report_id:PATH:int:true::Key;page:QUERY:int:false:1:;token:HEADER:str:false:None:", "204:Response:"),
    (23, "HEAD", "/reports/{report_id}", "report", 3, False, False, "", "", None, "Head", "Read a report.", False,
     "report_id:PATH:int:true::Key;page:QUERY:int:false:1:;token:HEADER:str:false:None:", "404:Gone:no report;204:Response:"),
)
STORED_COLUMNS = "e(k, method, path, function_name, line, auth, permission, dependencies, tags, status, summary, description, deprecated, parameters, responses)"
# The second scan sees the projects of the first fourteen kinds: those of kinds 0 to 11 have become the next kind, 12 is as it was, 13 has no code any more.
SCANS = f"""select 1 as scan_id, s.* from modules s union all
select 2, project_id, relative_path, case when k < 12 then k + 1 else k end, n, segment from modules where k <> 13"""


def _stored_versions(spark: SparkSession, sf_dir: str) -> str:
    """Two scans of the discovery, the second one of some of the projects; returns where."""
    root = f"{streams.run_folder(spark)}/discovery"
    kinds = b.projects(spark, sf_dir).select(F.col("project_id").cast("string").alias("project_id"), F.col("user_id").alias("kind"))
    found = lambda shift: discovery.stored_endpoints(discovery.endpoints(facts.code_facts(modules.route_modules(spark, sf_dir, shift), discovery.ENDPOINT_FACTS)))
    reports.replace_discovery(found(0), root, 1)
    # What has not changed since the first scan is read from it.
    first = reports.read_discovery(spark, root, 1)
    later = found(1).join(kinds.filter("kind < 12"), "project_id", "left_semi").unionByName(first.join(kinds.filter("kind = 12"), "project_id", "left_semi"))
    reports.replace_discovery(later, root, 2, kinds.filter("kind < 14"))
    return root


def _text(items: str, *fields: str):
    value = lambda x, f: F.coalesce(x[f].cast("string"), F.lit(""))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", *(value(x, f) for f in fields))), ";")


@register("discovery_as_of", "SRC-13 DSC-21", twin(
    f"""select cast(s.scan_id as int) as scan_id, s.project_id, e.method as http_method, replace(e.path, '{{n}}', s.n) as path, case when e.k = 22 then '/v2' end as router_prefix,
  cast(null as varchar) as operation_id, e.function_name, s.relative_path as source_file, cast(e.line as int) as line_number, e.auth as authentication_required,
  case when e.auth then 'unknown' else 'public' end as authentication_type, e.tags, e.dependencies, cast(null as varchar) as response_model,
  cast(e.status as int) as response_status_code, e.summary, e.description, e.deprecated, e.permission as permission_required,
  case when e.k = 22 then 'OAuth2' else '' end as security_schemes, case when e.k = 22 then 'read' else '' end as security_scopes, e.parameters, e.responses
from scans s join {values(STORED, STORED_COLUMNS)} on e.k = s.k""", modules=MODULE_ROWS, scans=SCANS))
def discovery_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored discovery as it was after each of two scans, with all its columns."""
    root = _stored_versions(spark, sf_dir)
    out = reports.read_discovery(spark, root, 1).withColumn("scan_id", F.lit(1)).unionByName(reports.read_discovery(spark, root, 2).withColumn("scan_id", F.lit(2)))
    lists = {c: F.array_join(c, ",") for c in ("tags", "dependencies", "security_schemes", "security_scopes")}
    nested = {
        "parameters": _text("parameters", "name", "location", "data_type", "required", "default_value", "description"),
        "responses": _text("responses", "status_code", "model", "description")}
    return out.withColumns(lists | nested)


@register("snapshot_diff", "JOI-8 SRC-13", twin(
    f"""select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.method, b.method) as http_method, coalesce(a.path, b.path) as path,
  case when a.path is null then 'added' when b.path is null then 'removed' else 'unchanged' end as change, case when b.path is null then 'removed' else 'active' end as discovery_status
from (select * from keys where scan_id = 1) a full join (select * from keys where scan_id = 2) b on a.project_id = b.project_id and a.method = b.method and a.path = b.path""",
    modules=MODULE_ROWS, scans=SCANS, keys=f"""select s.scan_id, s.project_id, e.method, replace(e.path, '{{n}}', s.n) as path from scans s join {values(STORED, STORED_COLUMNS)} on e.k = s.k"""))
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two versions of the stored discovery."""
    root = _stored_versions(spark, sf_dir)
    return relations.discovery_diff(reports.read_discovery(spark, root, 1), reports.read_discovery(spark, root, 2), ["project_id", "http_method", "path"])


@register("finding_history", "SET-3 SRC-13", twin(
    f"""select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.relative_path, b.relative_path) as relative_path, coalesce(a.rule_id, b.rule_id) as rule_id,
  cast(coalesce(a.line_start, b.line_start) as int) as line_start, case when a.rule_id is null then 'new' when b.rule_id is null then 'resolved' else 'persisting' end as change
from (select * from keys where scan_id = 1) a full join (select * from keys where scan_id = 2) b using (project_id, relative_path, rule_id, line_start)""",
    scripts=SCRIPT_ROWS, keys=f"""select distinct s.scan_id, s.project_id, s.relative_path, e.rule_id, e.line_start
from (select 1 as scan_id, * from scripts union all select 2, project_id, relative_path, case when cast(project_id as int) <= 20 then k % 25 + 1 else k end, n from scripts) s
join {values(EXPECTED_SCRIPT_FINDINGS, 'e(k, rule_id, line_start, column_start, function_name, class_name, evidence)')} on e.k = s.k"""))
def finding_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, resolved and persisting findings between two scans, both read from the stored versions; the second scan looks at some projects only."""
    root = f"{streams.run_folder(spark)}/findings"
    found = lambda shift: source_rules.source_findings(facts.code_facts(modules.scripts(spark, sf_dir, shift))).select(
        "project_id", "relative_path", "rule_id", "line_start", "severity", "fingerprint")
    snapshots.replace(found(0), root, ["project_id"], 1)
    seen = b.table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("project_id")).filter("cast(project_id as int) <= 20")
    snapshots.replace(found(1).filter("cast(project_id as int) <= 20"), root, ["project_id"], 2, seen)
    keys = ["project_id", "relative_path", "rule_id", "line_start"]
    return relations.finding_changes(snapshots.read(spark, root, 1), snapshots.read(spark, root, 2), keys)


# --- Tables that a stream keeps. ---

EVENTS = "event_id bigint, project_id bigint, ts timestamp, kind string, progress double"
STEPS = 5


def _arriving(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The events as a stream of files, one a batch, in the order of their ids."""
    events = b.scan_events(spark, sf_dir)
    # A file for each fifth of the ids, older first; the source takes files by their time.
    last = events.agg(F.max("event_id")).first()[0] or 0
    step = F.least(F.expr(f"event_id * {STEPS} div {last + 1}"), F.lit(STEPS - 1))
    for number in range(STEPS):
        events.filter(step == number).coalesce(1).write.mode("append").parquet(folder)
    return streams.event_stream(spark, folder, EVENTS, files_per_trigger=1)


@register("stream_scan_state", "STR-1 STR-3 STR-4", twin(
    f"""select project_id, kind, p as progress, {live.STAGE} as current_stage, epoch_us(ts) as heartbeat_us, events from (select project_id, kind, ts,
  cast(floor(greatest(0, least(100, progress))) as int) as p, events from (select *, row_number() over (partition by project_id order by ts desc, event_id desc) as rn,
  cast(count(*) over (partition by project_id) as bigint) as events from scan_events) t where rn = 1) u""", "scan_events"))
def stream_scan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every scan, kept in a table by a stream of several batches."""
    folder = streams.run_folder(spark)
    root = f"{folder}/states"
    tables.keep_progress(_arriving(spark, sf_dir, f"{folder}/in"), root, f"{folder}/checkpoint").awaitTermination()
    return tables.scan_states(spark, root).withColumn("heartbeat_us", F.unix_micros("heartbeat_at")).drop("heartbeat_at")


SLIDING = """select cast(epoch(time_bucket(interval 15 minutes, ts)) as bigint) - 900 * i as window_start, kind, cast(count(*) as bigint) as events
from scan_events, (select unnest(range(4)) as i) group by 1, 2"""


@register("sliding_activity", "STR-9", twin(SLIDING, "scan_events"))
def sliding_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every hour that begins at a quarter of an hour, from panes of a quarter."""
    return ops.sliding_activity(b.scan_events(spark, sf_dir)).withColumn("window_start", F.unix_timestamp("window_start"))


@register("stream_sliding_activity", "STR-9", twin(SLIDING, "scan_events"))
def stream_sliding_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream, with two window aggregations one after the other."""
    done = streams.run_to_end(live.stream(spark, sf_dir), streams.sliding_activity, streams.run_folder(spark), "sliding")
    return done.withColumn("window_start", F.unix_timestamp("window_start"))


ARRIVED = f"""select *, least(event_id * {STEPS} // (select max(event_id) + 1 from scan_events), {STEPS - 1}) as step from scan_events"""
JUDGED = """select a.*, coalesce(a.ts < m.mark, false) as late from arrived a left join (
  select s.step, (select max(ts) - interval 10 minutes from arrived b where b.step < s.step) as mark from (select distinct step from arrived) s) m using (step)"""


@register("late_events", "STR-9", twin(
    """select kind, cast(count(*) filter (where not late) as bigint) as accepted, cast(count(*) filter (where late) as bigint) as late, cast(count(*) as bigint) as events
from judged group by kind""", "scan_events", arrived=ARRIVED, judged=JUDGED))
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted in windows and events that came too late for them; together they are all."""
    folder = streams.run_folder(spark)
    root = f"{folder}/windows"
    tables.keep_windows(_arriving(spark, sf_dir, f"{folder}/in"), root, f"{folder}/checkpoint", "15 minutes", timedelta(minutes=10)).awaitTermination()
    accepted = snapshots.read(spark, root).groupBy("kind").agg(F.sum("events").alias("accepted"))
    late = tables.late_rows(spark, root, EVENTS).groupBy("kind").agg(F.count("*").alias("late"))
    both = accepted.join(late, "kind", "full").select("kind", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("late", F.lit(0)).alias("late"))
    return both.withColumn("events", F.col("accepted") + F.col("late"))


@register("stream_deadlines", "STR-2 STR-3", twin(
    """select scan_id, case how when 1 then 'cancelled' else 'failed' end as status, case how when 1 then 'cancelled' when 2 then 'timed_out' else 'failed' end as current_stage
from (select *, case when priority = '1-URGENT' then 1 when priority <> '5-LOW' and deadline_ <= 0 then 2 when cast(floor(cost) as bigint) % 5 = 0 then 3 else 0 end as how
  from live where status = 'running') s where how > 0""", "scan_jobs", live=live.LIVE))
def stream_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How running scans have ended by now, from events on a stream: a start with its deadline, heartbeats, and requests to stop or failures."""
    folder = streams.run_folder(spark)
    scans = live.live_scans(spark, sf_dir).filter("status = 'running'")
    now, second = live.now(), lambda n: ops.plus_seconds(live.now(), F.lit(n))
    event = lambda kind, at, deadline=F.lit(None).cast("timestamp"): F.struct(F.lit(kind).alias("kind"), at.alias("ts"), deadline.alias("deadline_at"))
    events = scans.select("scan_id", F.explode(F.concat(
        F.array(event("queued", second(-1200), F.col("deadline_at"))),
        F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: event("heartbeat", ops.plus_seconds(now, i * 30 - 1100))),
        F.when(F.col("cancel_requested_at").isNotNull(), F.array(event("cancel", second(-600)))).otherwise(F.array().cast("array<struct<kind:string,ts:timestamp,deadline_at:timestamp>>")),
        F.when(F.col("broke"), F.array(event("broke", now))).otherwise(F.array().cast("array<struct<kind:string,ts:timestamp,deadline_at:timestamp>>")),
    )).alias("e")).select("scan_id", F.xxhash64("scan_id", "e.kind", "e.ts").alias("event_id"), "e.*")
    events.write.parquet(f"{folder}/in")
    stream = streams.event_stream(spark, f"{folder}/in", "scan_id bigint, event_id bigint, kind string, ts timestamp, deadline_at timestamp")
    # The stream ends half a minute after now, plus the lateness: later deadlines are still to come.
    done = streams.run_to_end(stream, deadlines.ended, folder, "ended", "2000-01-01 12:10:30")
    return done.select("scan_id", "status", "current_stage")
