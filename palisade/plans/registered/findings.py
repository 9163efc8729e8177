"""Finding operators over the finding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.catalog import rules
from palisade.functions import scoring, text
from palisade.operators import findings as ops
from palisade.plans.catalogue import SEQ, SEVERITY_RANK, register, twin
from palisade.session import stored_in_turn
from palisade.sources import bindings as b

FINGERPRINT = "rule_id || '|' || method || '|' || path || '|' || file_path || '|' || cast(line_number as varchar)"
SOURCE_PRINT = "rule_id || '|' || file_path || '|' || cast(line_number as varchar) || '||'"
FOLD = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.findings(spark, sf_dir).filter("confidence = 'medium'")


def _endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.findings(spark, sf_dir).filter("confidence = 'high'")


@register("normalised_findings", "FND-3 FND-4", twin(
    f"""select project_id, endpoint_id, rule_id, severity, title, status, file_path, cast({SEVERITY_RANK} as int) as severity_rank,
  cast(row_number() over (partition by project_id, endpoint_id order by {SEVERITY_RANK}, rule_id, {FOLD.format('title')}, line_number, {SEQ}) as bigint) as position
from (select *, row_number() over (partition by endpoint_id, rule_id, severity, {FOLD.format('title')}, {FOLD.format('description')} order by {SEQ}) as rn from findings) t
where rn = 1""", "findings"))
def normalised_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shown(piece: tuple[int, int]) -> DataFrame:
        # Numbering may store the rows, so they are left with what is shown and what orders them.
        kept = ops.normalise(b.findings(spark, sf_dir, piece=piece)).select(
            "project_id", "endpoint_id", "rule_id", "severity", "title", "status", "file_path", "line_number", "seq")
        return ops.severity_first(kept, ["project_id", "endpoint_id"], b.crowded_endpoints(spark, sf_dir, piece)).select(
            "project_id", "endpoint_id", "rule_id", "severity", "title", "status", "file_path",
            scoring.severity_rank(F.col("severity")).alias("severity_rank"), "position")

    pieces = b.finding_pieces(spark, sf_dir)
    # Endpoint by endpoint, as the joins of all findings take several times the space of the tables.
    return stored_in_turn(spark, map(shown, pieces)) if len(pieces) > 1 else shown(pieces[0])


@register("endpoint_fingerprints", "FND-5", twin(
    f"""select endpoint_id, fingerprint, severity, status from (select *, {FINGERPRINT} as fingerprint,
  row_number() over (partition by endpoint_id, {FINGERPRINT} order by {SEQ}) as rn from findings) t where rn = 1""", "findings"))
def endpoint_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.add_if_absent(b.findings(spark, sf_dir)).select("endpoint_id", "fingerprint", "severity", "status")


@register("source_fingerprints", "FND-6 FND-7", twin(
    f"""select project_id, fingerprint, severity, category from (select *, {SOURCE_PRINT} as fingerprint,
  row_number() over (partition by project_id, {SOURCE_PRINT} order by {SEQ}) as rn from findings where confidence = 'medium') t where rn = 1""", "findings"))
def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = _source(spark, sf_dir).withColumns({
        "rule_id": F.concat(F.lit("  "), F.lower("rule_id"), F.lit("\t")),
        "category": F.concat(F.upper("category"), F.lit(" ")),
    })
    return ops.dedupe_source(ops.normalise_fields(messy), [F.asc("seq")]).select("project_id", "fingerprint", "severity", "category")


@register("finding_constraint_checks", "FND-8", twin(
    """select project_id, file_path, line_start, line_end, valid, violations from (select project_id, file_path, line_start, line_end,
  line_start >= 1 and line_end >= 1 and line_end >= line_start and title <> '' as valid,
  concat_ws('; ', case when title = '' then 'title is blank' end, case when line_start < 1 then 'line_start is below one' end,
    case when line_end < 1 then 'line_end is below one' end, case when line_end < line_start then 'line_end is before line_start' end) as violations
from (select project_id, file_path, line_number - 2 as line_start, cast(6 - line_number as int) as line_end,
  case when severity = 'critical' then '' else title end as title from findings) f) t""", "findings"))
def finding_constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = b.findings(spark, sf_dir).withColumns({
        "line_start": (F.col("line_number") - 2).cast("int"),
        "line_end": (F.lit(6) - F.col("line_number")).cast("int"),
        "title": F.when(F.col("severity") == "critical", F.lit(" \n")).otherwise(F.col("title")),
        "remediation": F.lit("fix it"),
    })
    return ops.check_constraints(ranged).select(
        "project_id", "file_path", "line_start", "line_end", "valid", F.concat_ws("; ", "violations").alias("violations"))


ANALYZER_VALUES = "(values ('python-ast-security', '', 100, 0), ('fastapi-authorization-security', 'fastapi', 91, 1), ('python-configuration-security', '', 90, 2), ('fastapi-authentication-security', 'fastapi', 90, 3), ('fastapi-endpoint-security', 'fastapi', 80, 4)) a(analyzer, framework, priority, analyzer_ord)"
ANALYZER_CASE = "case f.category when 'authentication' then 'fastapi-authentication-security' when 'authorization' then 'fastapi-authorization-security' when 'input_validation' then 'fastapi-endpoint-security' when 'file_upload' then 'python-configuration-security' else 'python-ast-security' end"


@register("analyzer_applicability", "FND-9 FND-10", twin(
    f"""select p.project_id, a.analyzer, cast(a.analyzer_ord as int) as analyzer_ord, cast(count(*) as bigint) as hit_count
from findings f join {ANALYZER_VALUES} on a.analyzer = {ANALYZER_CASE}
join (select project_id, case when framework in ('building', 'machinery') then 'fastapi' else framework end as framework from projects) p on p.project_id = f.project_id
where (case when f.severity = 'info' then 'java' when f.severity = 'low' then '' else 'python' end) in ('python', '')
  and (a.framework = '' or a.framework = p.framework)
group by p.project_id, a.analyzer, a.analyzer_ord""", "projects", "findings"))
def analyzer_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzers = rules.analyzers(spark)
    category = F.col("category")
    analyzer = (
        F.when(category == "authentication", "fastapi-authentication-security")
        .when(category == "authorization", "fastapi-authorization-security")
        .when(category == "input_validation", "fastapi-endpoint-security")
        .when(category == "file_upload", "python-configuration-security")
        .otherwise("python-ast-security"))
    language = F.when(F.col("severity") == "info", "java").when(F.col("severity") == "low", "").otherwise("Python ")
    hits = b.findings(spark, sf_dir).select("project_id", analyzer.alias("analyzer"), language.alias("language"))
    framework = F.when(F.col("framework").isin("building", "machinery"), " FastAPI").otherwise(F.col("framework"))
    kept = ops.applicable(hits, b.projects(spark, sf_dir).withColumn("framework", framework), analyzers)
    counted = kept.groupBy("project_id", "analyzer").agg(F.count("*").alias("hit_count"))
    return counted.join(F.broadcast(analyzers.select("analyzer", "analyzer_ord")), "analyzer")


@register("assessment_upserts", "FND-12", twin(
    """select project_id, method, path, endpoint_id from (select project_id, method, '/v1/' || split_part(path, '/', 3) as path, endpoint_id,
  row_number() over (partition by project_id, method, split_part(path, '/', 3) order by discovered_at desc, endpoint_id desc) as rn from endpoints) t where rn = 1""",
    "endpoints"))
def assessment_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = b.endpoints(spark, sf_dir).withColumn("path", F.concat(F.lit("/v1/"), F.split_part(F.col("path"), F.lit("/"), F.lit(3))))
    mixed = grouped.withColumn("method", F.when(F.col("endpoint_id") % 2 == 0, F.lower("method")).otherwise(F.col("method")))
    return ops.upsert_assessments(mixed, ["discovered_at", "endpoint_id"]).select("project_id", "method", "path", "endpoint_id")


@register("evidence_text", "FND-13", twin(
    r"""select doc_id, trim(regexp_replace(text, '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) as evidence from documents"""))
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", text.evidence(F.col("text")).alias("evidence"))


@register("location_display", "FND-15", twin(
    """select file_path, line_number, cast(count(*) as bigint) as n, case when line_number is null then file_path
  when line_number % 3 = 0 then file_path || ':' || cast(line_number as varchar) || '-' || cast(line_number + 4 as varchar)
  else file_path || ':' || cast(line_number as varchar) end as display
from (select file_path, nullif(line_number, 1) as line_number from findings) f group by file_path, line_number""", "findings"))
def location_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text alone decides, so neither project nor rule is joined.
    lines = b.table(spark, sf_dir, "lineitem")
    placed = lines.select(F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file_path"), F.nullif("l_linenumber", F.lit(1)).alias("line_number"))
    counted = placed.groupBy("file_path", "line_number").agg(F.count("*").alias("n"))
    line = F.col("line_number")
    last = F.when(line % 3 == 0, line + 4).when(line % 3 == 1, line)
    return counted.withColumn("display", text.location_text(F.col("file_path"), line, last))


VIEW = f"""select *, 'endpoint' as origin, 0 as ord from findings where confidence = 'high' union all
select *, 'source' as origin, 1 as ord from findings where confidence = 'medium'"""
VIEW_KEY = f"case when origin = 'source' then {SOURCE_PRINT} else rule_id || '|' || method || '|' || path || '|' || file_path || ':' || cast(line_number as varchar) end"
VIEW_ROWS = f"select * from (select *, row_number() over (partition by project_id, {VIEW_KEY} order by ord, {SEQ}) as rn from tagged) t where rn = 1"


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _source(spark, sf_dir).withColumn("fingerprint", ops.source_fingerprint())
    return ops.report_view(_endpoint(spark, sf_dir), source)


@register("report_view", "FND-16 SET-1", twin("select project_id, origin, rule_id, severity, status, file_path, line_number from view_rows",
                                             "findings", tagged=VIEW, view_rows=VIEW_ROWS))
def report_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir).select("project_id", "origin", "rule_id", "severity", "status", "file_path", "line_number")


@register("report_facets", "FND-17", twin(
    "select project_id, rule_id, title, category, file_path from view_rows where severity = 'low' and origin = 'source' and "
    "contains(lower(rule_id || ' ' || title || ' ' || description || ' ' || method || ' ' || path || ' ' || file_path || ':' || cast(line_number as varchar)), 'red')",
    "findings", tagged=VIEW, view_rows=VIEW_ROWS))
def report_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ops.facets(_view(spark, sf_dir), severity="low", origin="source", query=" Red ")
    return shown.select("project_id", "rule_id", "title", "category", "file_path")


@register("report_categories", "FND-18", twin("select distinct category from findings", "findings"))
def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.categories(b.findings(spark, sf_dir))


@register("knowledge_enrichment", "FND-1 FND-2 JOI-3", twin(
    """select f.endpoint_id, f.rule_id, case when f.title <> '' then f.title else k.title end as title, coalesce(f.owasp, k.owasp) as owasp_reference,
  coalesce(f.cwe, k.cwe) as cwe_id, k.category as knowledge_category, 'own' as source, case when k.rule_id is null then null else k.category end as merged_category,
  cast(count(*) as bigint) as n
from (select endpoint_id, case category when 'authentication' then 'AUTH-001' when 'authorization' then 'AUTH-002' when 'input_validation' then 'VAL-001'
    when 'file_upload' then 'FILE-001' else rule_id end as rule_id, case when severity = 'info' then '' else title end as title,
    case when status = 'open' then 'API0' end as owasp, case when status = 'resolved' then 'CWE-0' end as cwe from findings) f
left join (values ('AUTH-001', 'Missing Authentication', 'Authentication', 'API2:2023', 'CWE-306'), ('AUTH-002', 'Missing Authorization', 'Authorization', 'API5:2023', 'CWE-285'),
  ('VAL-001', 'Input Validation', 'Validation', 'API8:2023', 'CWE-20'), ('FILE-001', 'Unsafe File Upload', 'File Upload', 'API8:2023', 'CWE-434'))
  k(rule_id, title, category, owasp, cwe) on k.rule_id = f.rule_id
group by all""".replace("case when f.title <> '' then f.title else k.title end", "case when f.title <> '' then f.title else coalesce(k.title, f.title) end"),
    "findings"))
def knowledge_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.col("category")
    rule = (F.when(category == "authentication", "auth-001 ").when(category == "authorization", "AUTH-002")
            .when(category == "input_validation", "VAL-001").when(category == "file_upload", "FILE-001").otherwise(F.col("rule_id")))
    # In pieces of bounded size, as the groups below are nearly as many as the findings.
    found = b.findings(spark, sf_dir, b.finding_tasks(spark, sf_dir)).select(
        "endpoint_id", rule.alias("rule_id"),
        F.when(F.col("severity") == "info", "").otherwise(F.col("title")).alias("title"), "description", F.lit("").alias("remediation"),
        F.when(F.col("status") == "open", "API0").alias("owasp_reference"), F.when(F.col("status") == "resolved", "CWE-0").alias("cwe_id"),
        F.create_map(F.lit("source"), F.lit("own")).alias("metadata"))
    enriched = ops.enrich(found, rules.knowledge(spark))
    defaults = F.when(F.col("knowledge").isNotNull(), F.create_map(F.lit("source"), F.lit("record"), F.lit("category"), F.col("knowledge.category"))).otherwise(
        F.create_map().cast("map<string,string>"))
    merged = enriched.withColumn("metadata", ops.merge_missing(F.col("metadata"), defaults))
    shown = merged.select(
        "endpoint_id", text.rule_key(F.col("rule_id")).alias("rule_id"), "title", "owasp_reference", "cwe_id",
        F.col("knowledge.category").alias("knowledge_category"), F.try_element_at("metadata", F.lit("source")).alias("source"),
        F.try_element_at("metadata", F.lit("category")).alias("merged_category"))
    return shown.groupBy(*shown.columns).agg(F.count("*").alias("n"))
