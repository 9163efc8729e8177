"""Remediation, account tables, secrets in documents and route paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.catalog import remediation as dims
from palisade.functions import paths, text
from palisade.operators import accounts, endpoint_rules, lifecycle, remediation
from palisade.plans.catalogue import register, twin
from palisade.plans.registered.code import values
from palisade.sources import bindings as b

GUIDED = """select f.project_id, f.endpoint_id, f.method, f.path, f.severity, p.framework, case category when 'authentication' then 'AUTH-001' when 'authorization' then 'AUTH-002'
  when 'input_validation' then 'VAL-001' when 'file_upload' then 'FILE-001' else f.rule_id end as rule_id,
  case p.framework when 'building' then 'Fast_API' when 'machinery' then '' when 'household' then 'fastapi' else p.framework end as shown_framework,
  case when f.confidence = 'high' then 'Python' else 'java' end as language
from findings f join projects p on p.project_id = f.project_id"""


def _guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    category, framework = F.col("category"), F.col("framework")
    rule = (F.when(category == "authentication", "auth-001").when(category == "authorization", "AUTH-002")
            .when(category == "input_validation", "VAL-001").when(category == "file_upload", "FILE-001").otherwise(F.col("rule_id")))
    shown = F.when(framework == "building", "Fast_API").when(framework == "machinery", "").when(framework == "household", "fastapi").otherwise(framework)
    found = b.findings(spark, sf_dir).join(b.projects(spark, sf_dir).select("project_id", "framework"), "project_id")
    return found.select("project_id", "endpoint_id", "method", "path", "severity", rule.alias("rule_id"), shown.alias("framework"),
                        F.when(F.col("confidence") == "high", "Python").otherwise("java").alias("language"))


@register("remediation_guidance", "REM-1 REM-2 REM-3 REM-4 REM-5 JOI-4", twin(
    f"""select g.project_id, g.endpoint_id, g.rule_id, adapted as customized, cast(r.steps + case when adapted then r.extra else 0 end as int) as steps,
  cast(r.checks + case when adapted then r.extra_checks else 0 end as int) as checks, cast(case when adapted then 1 else 0 end as int) as examples, r.time_label as estimated_time,
  case when adapted then 'fastapi' end as metadata_adapter, case when adapted then g.method || ' ' || g.path end as endpoint, cast(count(*) as bigint) as n
from (select *, shown_framework in ('Fast_API', 'fastapi') or (shown_framework = '' and language = 'Python') as adapted from guided) g
join {values((("AUTH-001", 4, 2, 3, 1, "30–90 minutes"), ("AUTH-002", 5, 2, 3, 1, "60–240 minutes"), ("VAL-001", 5, 2, 4, 1, "30–120 minutes"), ("FILE-001", 7, 3, 5, 2, "90–360 minutes")), "r(rule_id, steps, extra, checks, extra_checks, time_label)")}
  on r.rule_id = g.rule_id group by all""", "findings", "projects", guided=GUIDED))
def remediation_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remediation.remediate(_guided(spark, sf_dir), dims.guidance(spark), dims.adapters(spark), dims.patches(spark))
    shown = rows.select(
        "project_id", "endpoint_id", text.rule_key(F.col("rule_id")).alias("rule_id"), "customized", F.size("guidance.implementation_steps").alias("steps"),
        F.size("guidance.validation_steps").alias("checks"), F.size("guidance.code_examples").alias("examples"), "estimated_time",
        F.try_element_at("guidance.metadata", F.lit("adapter")).alias("metadata_adapter"), F.col("framework_remediation.endpoint").alias("endpoint"))
    return shown.groupBy(*shown.columns).agg(F.count("*").alias("n"))


@register("remediation_effort", "REM-1 REM-5", twin(
    f"""select g.project_id, r.priority, cast(count(*) as bigint) as findings, cast(sum(r.low) as bigint) as minutes_min, cast(sum(r.high) as bigint) as minutes_max
from guided g join {values((("AUTH-001", "immediate", 30, 90), ("AUTH-002", "high", 60, 240), ("VAL-001", "high", 30, 120), ("FILE-001", "immediate", 90, 360)), "r(rule_id, priority, low, high)")}
  on r.rule_id = g.rule_id group by g.project_id, r.priority""", "findings", "projects", guided=GUIDED))
def remediation_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    guidance = F.broadcast(dims.guidance(spark).select("rule_id", "priority", "estimated_minutes_min", "estimated_minutes_max"))
    counted = _guided(spark, sf_dir).groupBy("project_id", text.rule_key(F.col("rule_id")).alias("rule_id")).agg(F.count("*").alias("n"))
    return counted.join(guidance, "rule_id").groupBy("project_id", "priority").agg(
        F.sum("n").alias("findings"), F.sum(F.col("n") * F.col("estimated_minutes_min")).alias("minutes_min"),
        F.sum(F.col("n") * F.col("estimated_minutes_max")).alias("minutes_max"))


MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"
MAILS = f"select doc_id, unnest(regexp_extract_all(text, '{MAIL}')) as raw from documents"


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(MAIL), 0)).alias("email"))


@register("duplicate_emails", "IDN-1", twin(
    "select lower(raw) as email, cast(count(*) as bigint) as accounts from mails group by lower(raw) having count(*) > 1", mails=MAILS))
def duplicate_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    cased = _mails(spark, sf_dir).withColumn("email", F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper("email"), F.lit(" "))).otherwise(F.col("email")))
    return accounts.duplicate_emails(cased)


@register("account_validity", "IDN-2", twin(
    r"""select doc_id, raw as email, concat_ws(' ', case when length(raw) > 255 then 'Email address must not exceed 255 characters.' end,
  case when not regexp_full_match(lower(raw), '[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') then 'Enter a valid email address.' end) as email_errors,
  case when source = 'src1' then 'Full name must contain at least 2 characters.' when source = 'src2' then 'Full name is required.' when source = 'src3' then 'Full name must not exceed 100 characters.' else '' end as name_errors
from (select m.doc_id, m.raw || case when d.source = 'src4' then '.' else '' end as raw, d.source from mails m join documents d on d.doc_id = m.doc_id) t""", mails=MAILS))
def account_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.col("source")
    named = _mails(spark, sf_dir).join(b.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumns({
        "email": F.when(source == "src4", F.concat("email", F.lit("."))).otherwise(F.col("email")),
        "name": F.when(source == "src1", " x ").when(source == "src2", " \t ").when(source == "src3", F.repeat(F.lit("ab "), 60)).otherwise("Ada Lovelace")})
    return named.select("doc_id", "email", F.array_join(accounts.email_errors(F.col("email")), " ").alias("email_errors"),
                        F.array_join(accounts.name_errors(F.col("name")), " ").alias("name_errors"))


AS_OF = "timestamp '2024-01-20 00:00:00'"
TOKENS = """select event_id as token_id, user_id, event_type as kind, ts as created_at, ts + interval 24 hours as expires_at,
  case when value > 30 then ts + interval 30 minutes end as used_at from events"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = F.col("ts").cast("timestamp")
    return b.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("token_id"), "user_id", F.col("event_type").alias("kind"), created.alias("created_at"),
        lifecycle.plus_seconds(created, F.lit(86400)).alias("expires_at"),
        F.when(F.col("value") > 30, lifecycle.plus_seconds(created, F.lit(1800))).alias("used_at"))


@register("token_states", "IDN-3", twin(
    f"""select user_id, kind, case when used_at is not null then 'used' when expires_at <= {AS_OF} then 'expired' else 'active' end as state, cast(count(*) as bigint) as tokens
from tokens group by all""", tokens=TOKENS))
def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = accounts.token_state(F.col("used_at"), F.col("expires_at"), F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return _tokens(spark, sf_dir).groupBy("user_id", "kind", state.alias("state")).agg(F.count("*").alias("tokens"))


@register("token_supersession", "IDN-4", twin(
    """select token_id, epoch_us(next_at) as superseded_at, epoch_us(least(coalesce(used_at, next_at), coalesce(next_at, used_at))) as used_at
from (select *, lead(created_at) over (partition by user_id, kind order by created_at, token_id) as next_at from tokens) t""", tokens=TOKENS))
def token_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.supersede(_tokens(spark, sf_dir), ["user_id", "kind"]).select(
        "token_id", F.unix_micros("superseded_at").alias("superseded_at"), F.unix_micros("used_at").alias("used_at"))


@register("login_eligible_users", "IDN-5", twin(
    "select project_id, name from projects where framework = 'building' and balance > 0", "projects"))
def login_eligible_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = b.projects(spark, sf_dir).withColumns({
        "status": F.when(F.col("framework") == "building", "ACTIVE").otherwise("suspended"), "is_email_verified": F.col("balance") > 0})
    return accounts.login_eligible(users).select("project_id", "name")


# --- Secrets written in documents: name = "value", over whole texts. ---

ASSIGNMENT = r'([A-Za-z_]\w*) = "([^"\n]*)"'
LITERALS = rf"""select doc_id, regexp_extract(m, '{ASSIGNMENT}', 1) as name, regexp_extract(m, '{ASSIGNMENT}', 2) as value, m as code
from (select doc_id, unnest(regexp_extract_all(text, '{ASSIGNMENT}')) as m from documents) t"""
ENTROPY = "list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -((length(value) - length(replace(value, c, ''))) / length(value)) * log2((length(value) - length(replace(value, c, ''))) / length(value))))"


@register("document_secrets", "CFG-1 CFG-2 FND-13 FND-14", twin(
    f"""select doc_id, name, case when regexp_matches(value, '(?i)(?:sk|pk|api|key|token|secret|password|passwd|pwd)[-_A-Za-z0-9]{{8}}') or length(value) >= 16 then length(value) >= 8 else false end as hard_coded,
  length(value) < 16 or {ENTROPY} < 3.0 as weak, round({ENTROPY}, 6) as entropy, name || ' = "[REDACTED]"' as evidence, cast(count(*) as bigint) as n
from literals where regexp_matches(lower(name), 'secret|password|passwd|pwd|token|api_key|apikey|private_key|signing_key') group by all""", literals=LITERALS))
def document_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = b.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(ASSIGNMENT), 0)).alias("code"))
    literals = pieces.select("doc_id", "code", F.regexp_extract("code", ASSIGNMENT, 1).alias("name"), F.regexp_extract("code", ASSIGNMENT, 2).alias("value"))
    value = F.col("value")
    found = literals.filter(text.is_sensitive_name(F.col("name"))).select(
        "doc_id", "name", text.is_probable_secret(text.strip(value)).alias("hard_coded"), text.is_weak_secret(text.strip(value)).alias("weak"),
        F.round(text.entropy(value), 6).alias("entropy"), text.redact(text.evidence(F.col("code"))).alias("evidence"))
    return found.groupBy(*found.columns).agg(F.count("*").alias("n"))


@register("route_paths", "DSC-4 DSC-5", twin(
    r"""select page_id, prefix || tail as joined, case when length(rtrim(regexp_replace(prefix || tail, '/+', '/', 'g'), '/')) = 0 then '/'
  else rtrim(regexp_replace(prefix || tail, '/+', '/', 'g'), '/') end as canonical, rtrim(prefix, '/') || '/' || ltrim(tail, '/') as loose, under as public_path
from (select page_id, '/' || split_part(split_part(url, '//', 2), '/', 2) as prefix,
  '/' || split_part(split_part(url, '//', 2), '/', 3) || case when page_id % 3 = 0 then '//' when page_id % 3 = 1 then '/' else '' end as tail,
  split_part(split_part(url, '//', 2), '/', 2) in ('en', 'de') as under from pages) p"""))
def route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.split_part(F.col("url"), F.lit("//"), F.lit(2))
    third = F.when(F.col("page_id") % 3 == 0, "//").when(F.col("page_id") % 3 == 1, "/").otherwise("")
    parts = b.table(spark, sf_dir, "pages").select(
        "page_id", F.split_part(inside, F.lit("/"), F.lit(2)).alias("prefix"), F.concat(F.split_part(inside, F.lit("/"), F.lit(3)), third).alias("tail"))
    prefix, tail = F.col("prefix"), F.col("tail")
    canonical = paths.canonical_path(F.concat(prefix, F.lit("/ ")), tail)
    return parts.select(
        "page_id", paths.join_paths(F.concat(F.lit(" "), prefix, F.lit("/")), tail).alias("joined"), canonical.alias("canonical"),
        F.concat(F.lit("/"), paths.loose_path(prefix, tail)).alias("loose"), paths.is_under(canonical, ("/en", "/de")).alias("public_path"))


TYPE_ROWS = (
    (1, "str", False), (2, "UserRequest", True), (3, "list[UserCreate]", True), (4, "dict[str, Any]", False), (5, "Optional[EmailStr]", True), (6, "int | None", False),
    (7, "models.OrderSchema", True), (8, "constr(min_length=1)", True), (9, "typing.List[int]", False), (10, "Dict[str, List[ItemModel]]", True), (11, "UUID", True),
    (12, "bytes", False), (13, "UploadFile", False), (14, "list[UploadFile]", False), (15, "Literal['a', 'b']", True), (16, "Thing", False), (17, "Optional[PayloadDTO]", True),
    (18, "None | UserUpdate", True), (19, "BinaryIO", False), (20, "tuple[int, ItemInput]", True), (21, "datetime", True), (22, "object", False), (23, "set[str]", False),
    (24, "Request", False), (25, None, False),
)
UPLOAD_TYPES = (12, 13, 14)


@register("parameter_rules", "EPR-3 EPR-4", twin(
    f"""select l.l_orderkey as endpoint_id, cast(count(*) filter (where loc in ('body', 'form', 'file') and (loc = 'file' or not t.validated)) as bigint) as unvalidated,
  cast(count(*) filter (where loc in ('file', 'upload') or t.k in (12, 13, 14) or (loc = 'form' and t.k = 19)) as bigint) as uploads
from (select l_orderkey, l_partkey, case l_returnflag when 'N' then 'body' when 'A' then case l_linestatus when 'O' then 'form' else 'query' end
    else case when l_quantity >= 45 then 'file' when l_quantity >= 40 then 'upload' else 'path' end end as loc from lineitem) l
join part p on p.p_partkey = l.l_partkey join {values(TYPE_ROWS, "t(k, python_type, validated)")} on t.k = cast(substr(p.p_brand, 7) as int)
group by l.l_orderkey"""))
def parameter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = b.table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    location = (F.when(flag == "N", "body").when((flag == "A") & (F.col("l_linestatus") == "O"), "form").when(flag == "A", "query")
                .when(F.col("l_quantity") >= 45, "File").when(F.col("l_quantity") >= 40, " upload ").otherwise("path"))
    types = F.element_at(F.array(*[F.lit(r[1]) for r in TYPE_ROWS]), F.substring("p_brand", 7, 10).cast("int"))
    part = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), types.alias("python_type"))
    parameter = F.struct(F.lit("p").alias("name"), F.col("location"), F.col("python_type"))
    rows = line.select(F.col("l_orderkey").alias("endpoint_id"), "l_partkey", location.alias("location")).join(part, "l_partkey").select("endpoint_id", parameter.alias("p"))
    return rows.groupBy("endpoint_id").agg(
        F.count_if(endpoint_rules.is_unvalidated(F.col("p"))).alias("unvalidated"), F.count_if(endpoint_rules.is_upload(F.col("p"))).alias("uploads"))
