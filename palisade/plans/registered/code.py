"""Facts, source rules, discovery and endpoint rules over modules derived from the part and customer tables.

The twins do not parse anything. They list, for each module text, what a reader of the text expects, and join
that with the table the modules come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.catalog import rules as catalog
from palisade.operators import discovery, endpoint_rules, facts, runs, source_rules
from palisade.plans.catalogue import register, twin
from palisade.session import cut_lineage
from palisade.sources import modules
from palisade.sources import bindings as b


def _quoted(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows, alias: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(_quoted(v) for v in row) + ")" for row in rows) + f") {alias}"


# --- Expected findings of the scripts: brand number, rule, line, column, function, class, evidence. ---

EXPECTED_SCRIPT_FINDINGS = (
    (1, "CODE-001", 1, 10, None, None, "eval(value_{n})"),
    (2, "CODE-002", 2, 5, "run_{n}", None, "exec(code)"),
    (3, "CMD-002", 5, 9, "start", "Job", "os.system(command)"),
    (4, "CMD-001", 2, 1, None, None, "subprocess.run( command, shell=True, )"),
    (5, "CMD-001", 4, 1, None, None, "subprocess.call(cmd, shell=options['shell'])"),
    (6, "DESER-001", 2, 9, None, None, "pickle.loads(payload_{n})"),
    (7, "DESER-002", 2, 5, None, None, "yaml.load(text)"),
    (7, "DESER-002", 4, 5, None, None, "yaml.load(text, Loader=yaml.Loader)"),
    (8, "SQL-001", 1, 1, None, None, 'cursor.execute(f"SELECT * FROM t WHERE id = {key}")'),
    (9, "SQL-001", 1, 1, None, None, 'db.session.executemany("DELETE FROM t WHERE id = %s" % key)'),
    (9, "SQL-001", 2, 1, None, None, 'execute("SELECT " + name)'),
    (9, "SQL-001", 3, 1, None, None, 'conn.exec_driver_sql("SELECT {}".format(name))'),
    (10, "SSRF-001", 2, 12, None, None, "requests.get(user_url)"),
    (10, "HTTP-001", 2, 12, None, None, "requests.get(user_url)"),
    (11, "SSRF-001", 2, 12, None, None, "httpx.request( 'GET', target, timeout=5, verify=False )"),
    (11, "HTTP-002", 2, 12, None, None, "httpx.request( 'GET', target, timeout=5, verify=False )"),
    (11, "TLS-001", 2, 12, None, None, "httpx.request( 'GET', target, timeout=5, verify=False )"),
    (13, "SSRF-001", 2, 12, None, None, "httpx.get(url=target, timeout=5)"),
    (13, "HTTP-001", 3, 9, None, None, "httpx.post('https://a.example', data={n})"),
    (14, "SECRET-001", 1, 1, None, None, 'MAIL_API_KEY = "[REDACTED]"'),
    (15, "SECRET-002", 1, 1, None, None, 'SECRET_KEY = "[REDACTED]"'),
    (15, "SECRET-001", 2, 1, None, None, 'jwtSecret = "[REDACTED]"'),
    (15, "SECRET-002", 2, 1, None, None, 'jwtSecret = "[REDACTED]"'),
    (16, "SECRET-001", 4, 9, "load", "Settings", 'self.auth_token = "[REDACTED]"'),
    (16, "SECRET-002", 4, 9, "load", "Settings", 'self.auth_token = "[REDACTED]"'),
    (18, "CONFIG-001", 3, 7, None, None, "FastAPI(debug=True)"),
    (18, "CONFIG-001", 4, 1, None, None, "uvicorn.run(app, debug=True)"),
    (19, "TLS-001", 1, 1, None, None, "session.get(url, verify=False)"),
    (20, "JWT-001", 2, 1, None, None, 'jwt.decode(token, key, algorithms=["none", "HS256"])'),
    (20, "FASTAPI-AUTH-004", 2, 1, None, None, 'jwt.decode(token, key, algorithms=["none", "HS256"])'),
    (20, "FASTAPI-AUTH-005", 2, 1, None, None, 'jwt.decode(token, key, algorithms=["none", "HS256"])'),
    (21, "JWT-002", 2, 1, None, None, 'jwt.decode(token, key, options={"verify_signature": False}, audience="a", issuer="b")'),
    (21, "FASTAPI-AUTH-006", 2, 1, None, None, 'jwt.decode(token, key, options={"verify_signature": False}, audience="a", issuer="b")'),
    (21, "JWT-002", 3, 1, None, None, 'jwt.decode(token, key, verify=False, options={"verify_aud": False, "verify_iss": False})'),
    (22, "CORS-001", 1, 1, None, None, 'app.add_middleware( CORSMiddleware, allow_origins=["*"], )'),
    (22, "CORS-002", 5, 1, None, None, 'app.add_middleware(CORSMiddleware, allow_origins=["*"], allow_credentials=True)'),
    (23, "FASTAPI-AUTH-010", 2, 5, "promote", None, "badge.privilege = payload.wanted"),
    (23, "FASTAPI-AUTH-010", 3, 5, "promote", None, 'badge.roles = data["roles"]'),
    (23, "FASTAPI-AUTH-010", 4, 5, "promote", None, 'card["is_staff"] = form.json()'),
)

# --- What every rule says of itself, written out: rule, analyzer, category, severity, confidence, CWE, OWASP. ---

EXPECTED_RULES = (
    ("CODE-001", "python-ast-security", "code-injection", "critical", "high", "CWE-95", "API8:2023"),
    ("CODE-002", "python-ast-security", "code-injection", "critical", "high", "CWE-95", "API8:2023"),
    ("CMD-001", "python-ast-security", "command-injection", "critical", "high", "CWE-78", "API8:2023"),
    ("CMD-002", "python-ast-security", "command-injection", "critical", "high", "CWE-78", "API8:2023"),
    ("DESER-001", "python-ast-security", "unsafe-deserialization", "critical", "high", "CWE-502", "API8:2023"),
    ("DESER-002", "python-ast-security", "unsafe-deserialization", "high", "high", "CWE-502", "API8:2023"),
    ("SQL-001", "python-ast-security", "sql-injection", "critical", "medium", "CWE-89", "API8:2023"),
    ("SSRF-001", "python-ast-security", "server-side-request-forgery", "high", "medium", "CWE-918", "API7:2023"),
    ("HTTP-001", "python-ast-security", "unrestricted-resource-consumption", "medium", "high", "CWE-400", "API4:2023"),
    ("HTTP-002", "python-ast-security", "unsafe-api-consumption", "high", "high", "CWE-295", "API10:2023"),
    ("SECRET-001", "python-configuration-security", "secrets-management", "critical", "high", "CWE-798", "API8:2023"),
    ("SECRET-002", "python-configuration-security", "secrets-management", "high", "high", "CWE-330", "API2:2023"),
    ("CONFIG-001", "python-configuration-security", "security-misconfiguration", "high", "high", "CWE-489", "API8:2023"),
    ("TLS-001", "python-configuration-security", "transport-security", "high", "high", "CWE-295", "API8:2023"),
    ("JWT-001", "python-configuration-security", "authentication", "critical", "high", "CWE-347", "API2:2023"),
    ("JWT-002", "python-configuration-security", "authentication", "critical", "high", "CWE-347", "API2:2023"),
    ("CORS-001", "python-configuration-security", "security-misconfiguration", "high", "high", "CWE-942", "API8:2023"),
    ("CORS-002", "python-configuration-security", "security-misconfiguration", "critical", "high", "CWE-942", "API8:2023"),
    ("FASTAPI-AUTH-001", "fastapi-endpoint-security", "authentication", "high", "medium", "CWE-306", "API2:2023"),
    ("FASTAPI-AUTH-002", "fastapi-endpoint-security", "authorization", "critical", "high", "CWE-862", "API1:2023"),
    ("FASTAPI-FILE-001", "fastapi-endpoint-security", "file-upload", "high", "medium", "CWE-434", "API8:2023"),
    ("FASTAPI-ERROR-001", "fastapi-endpoint-security", "information-disclosure", "medium", "high", "CWE-209", "API8:2023"),
    ("FASTAPI-REDIRECT-001", "fastapi-endpoint-security", "input-validation", "medium", "medium", "CWE-601", "API10:2023"),
    ("FASTAPI-PROPERTY-001", "fastapi-endpoint-security", "property-authorization", "high", "medium", "CWE-915", "API3:2023"),
    ("FASTAPI-RESOURCE-001", "fastapi-endpoint-security", "resource-consumption", "medium", "medium", "CWE-400", "API4:2023"),
    ("FASTAPI-FLOW-001", "fastapi-endpoint-security", "business-flow-abuse", "high", "medium", "CWE-799", "API6:2023"),
    ("FASTAPI-INVENTORY-001", "fastapi-endpoint-security", "api-inventory", "low", "high", "CWE-1059", "API9:2023"),
    ("FASTAPI-AUTH-004", "fastapi-authentication-security", "authentication", "high", "medium", "CWE-287", "API2:2023"),
    ("FASTAPI-AUTH-005", "fastapi-authentication-security", "authentication", "high", "medium", "CWE-287", "API2:2023"),
    ("FASTAPI-AUTH-006", "fastapi-authentication-security", "authentication", "critical", "high", "CWE-347", "API2:2023"),
    ("FASTAPI-AUTH-007", "fastapi-authentication-security", "authorization", "critical", "high", "CWE-862", "API5:2023"),
    ("FASTAPI-AUTH-010", "fastapi-authentication-security", "authorization", "critical", "high", "CWE-269", "API5:2023"),
    ("FASTAPI-AUTH-003", "fastapi-authorization-security", "authorization", "critical", "medium", "CWE-639", "API1:2023"),
    ("FASTAPI-AUTH-008", "fastapi-authorization-security", "authorization", "high", "high", "CWE-807", "API5:2023"),
    ("FASTAPI-AUTH-009", "fastapi-authorization-security", "authorization", "critical", "medium", "CWE-862", "API1:2023"),
)

# --- Expected findings of the route modules: nation key, rule, line, column, function, evidence. ---

EXPECTED_ROUTE_FINDINGS = (
    (0, "FASTAPI-AUTH-001", 1, 2, "get_user", 'router.get("/users/{user_id}")'),
    (3, "FASTAPI-AUTH-002", 1, 2, "delete_document", 'router.delete("/documents/{document_id}")'),
    (4, "FASTAPI-FILE-001", 2, 1, "store",
     'async def store( file: UploadFile = File(...), user=Depends(get_current_user), ): return {"name": file.filename}'),
    (6, "FASTAPI-ERROR-001", 6, 62, "weather_now", "fault"),
    (7, "FASTAPI-REDIRECT-001", 4, 16, "leave", "RedirectResponse(url=onward)"),
    (8, "FASTAPI-PROPERTY-001", 3, 12, "issue_badge", "Badge(**form.model_dump())"),
    (9, "FASTAPI-RESOURCE-001", 1, 2, "every_invoice", 'router.get("/invoices")'),
    (11, "FASTAPI-FLOW-001", 1, 2, "move_points", 'router.post("/transfer/{n}")'),
    (13, "FASTAPI-INVENTORY-001", 1, 2, "old_item", 'router.get("/v1/items/{item_id}", deprecated=True)'),
    (15, "FASTAPI-AUTH-001", 1, 2, "metrics", 'router.get("/admin/metrics")'),
    (15, "FASTAPI-AUTH-007", 1, 2, "metrics", 'router.get("/admin/metrics")'),
    (16, "FASTAPI-AUTH-003", 1, 2, "read_item", 'router.get("/items/{item_id}")'),
    (18, "FASTAPI-AUTH-009", 1, 2, "edit", 'router.patch("/items/{item_id}")'),
    (21, "FASTAPI-AUTH-008", 3, 8, "act", 'payload.permission == "root"'),
    (21, "FASTAPI-AUTH-008", 5, 12, "act", "not payload.is_admin"),
    (23, "FASTAPI-AUTH-001", 1, 2, "report", 'router.get("/reports/{report_id}")'),
    (23, "FASTAPI-AUTH-001", 2, 2, "report",
     'router.head("/reports/{report_id}", summary="Head", responses={404: {"model": Gone, "description": "no report"}})'),
)

# --- Expected endpoints: nation key, method, path, function, line, authenticated, permission, schemes, scopes, tags,
#     parameters as name:location:required:default:nullable, responses as status:model:description. ---

USER = "user:unknown:false:Depends(get_current_user):false"
EXPECTED_ENDPOINTS = (
    (0, "GET", "/users/{user_id}", "get_user", 2, False, False, "", "", "", "user_id:path:true:-:false", ""),
    (1, "GET", "/users/{user_id}", "get_user", 2, True, False, "", "", "",
     "user_id:path:true:-:false,current_user:unknown:false:Depends(get_current_user):false", ""),
    (2, "GET", "/admin/report", "report", 2, False, True, "", "", "", "", ""),
    (3, "DELETE", "/documents/{document_id}", "delete_document", 2, False, False, "", "", "", "document_id:path:true:-:false", ""),
    (4, "POST", "/files/{n}", "store", 2, True, False, "", "", "", "file:file:true:-:false," + USER, ""),
    (5, "POST", "/files/{n}", "store", 2, True, False, "", "", "", "file:file:true:-:false," + USER, ""),
    (6, "GET", "/weather", "weather_now", 2, False, False, "", "", "", "station:unknown:true:-:false", "502:-:-"),
    (7, "GET", "/leave", "leave", 2, False, False, "", "", "", "onward:unknown:true:-:false,note:unknown:true:-:false", "200:Response:-"),
    (8, "POST", "/badges", "issue_badge", 2, True, False, "", "", "", "form:unknown:true:-:false," + USER, ""),
    (9, "GET", "/invoices", "every_invoice", 2, True, False, "", "", "", USER, ""),
    (10, "GET", "/invoices", "some_invoices", 2, True, False, "", "", "", "page_size:query:false:20:false," + USER, ""),
    (11, "POST", "/transfer/{n}", "move_points", 2, False, False, "", "", "", "order:unknown:true:-:false", ""),
    (12, "POST", "/transfer/{n}", "move_points", 2, False, False, "", "", "", "order:unknown:true:-:false", ""),
    (13, "GET", "/v1/items/{item_id}", "old_item", 2, False, False, "", "", "", "item_id:path:true:-:false", ""),
    (14, "GET", "/health", "health", 2, False, False, "", "", "", "", ""),
    (15, "GET", "/admin/metrics", "metrics", 2, False, False, "", "", "", "", ""),
    (16, "GET", "/items/{item_id}", "read_item", 2, False, False, "", "", "", "item_id:path:true:-:false,db:unknown:true:-:false", ""),
    (17, "GET", "/items/{item_id}", "read_item", 2, True, False, "", "", "",
     "item_id:path:true:-:false,db:unknown:true:-:false,current_user:unknown:false:Depends(get_current_user):false", "403:-:-"),
    (18, "PATCH", "/items/{item_id}", "edit", 2, False, False, "", "", "",
     "item_id:path:true:-:false,payload:unknown:true:-:false,db:unknown:true:-:false", ""),
    (19, "DELETE", "/items/{item_id}", "drop", 2, True, False, "", "", "", "item_id:path:true:-:false,db:unknown:true:-:false," + USER, ""),
    (20, "DELETE", "/items/{item_id}", "drop", 2, True, True, "", "", "", "item_id:path:true:-:false,db:unknown:true:-:false", ""),
    (21, "POST", "/actions", "act", 2, False, False, "", "", "", "payload:unknown:true:-:false", ""),
    (22, "PUT", "/v2/things/{thing_id}/", "put_thing", 5, True, True, "OAuth2", "read", "things,api",
     "thing_id:path:true:-:false,body:body:true:-:false,q:unknown:false:None:true", "201:JSONResponse:-,404:-:gone"),
    (23, "GET", "/reports/{report_id}", "report", 3, False, False, "", "", "",
     "report_id:path:true:-:false,page:query:false:1:false,token:header:false:None:true", "204:Response:-"),
    (23, "HEAD", "/reports/{report_id}", "report", 3, False, False, "", "", "",
     "report_id:path:true:-:false,page:query:false:1:false,token:header:false:None:true", "404:Gone:no report,204:Response:-"),
)

# --- Expected assessments: nation key, method, canonical path, rules, score. ---

EXPECTED_ASSESSMENTS = (
    (0, "GET", "/users/{user_id}", "AUTH-001:info", 99),
    (1, "GET", "/users/{user_id}", "AUTH-002:medium", 90),
    (2, "GET", "/admin/report", "AUTH-001:info", 99),
    (3, "DELETE", "/documents/{document_id}", "AUTH-001:high", 75),
    (4, "POST", "/files/{n}", "AUTH-002:high,FILE-001:high,VAL-001:medium", 40),
    (5, "POST", "/files/{n}", "AUTH-002:high,FILE-001:high,VAL-001:medium", 40),
    (6, "GET", "/weather", "AUTH-001:info", 99),
    (7, "GET", "/leave", "AUTH-001:info", 99),
    (8, "POST", "/badges", "AUTH-002:high", 75),
    (9, "GET", "/invoices", "AUTH-002:medium", 90),
    (10, "GET", "/invoices", "AUTH-002:medium", 90),
    (11, "POST", "/transfer/{n}", "AUTH-001:high", 75),
    (12, "POST", "/transfer/{n}", "AUTH-001:high", 75),
    (13, "GET", "/v1/items/{item_id}", "AUTH-001:info", 99),
    (14, "GET", "/health", "", 100),
    (15, "GET", "/admin/metrics", "AUTH-001:info", 99),
    (16, "GET", "/items/{item_id}", "AUTH-001:info", 99),
    (17, "GET", "/items/{item_id}", "AUTH-002:medium", 90),
    (18, "PATCH", "/items/{item_id}", "AUTH-001:high", 75),
    (19, "DELETE", "/items/{item_id}", "AUTH-002:high", 75),
    (20, "DELETE", "/items/{item_id}", "", 100),
    (21, "POST", "/actions", "AUTH-001:high", 75),
    (22, "PUT", "/v2/things/{thing_id}", "", 100),
    (23, "GET", "/reports/{report_id}", "AUTH-001:info", 99),
    (23, "HEAD", "/reports/{report_id}", "AUTH-001:info", 99),
)

SCRIPT_ROWS = """select cast(p_size as varchar) as project_id, 'src/' || lower(p_type) || '/part_' || cast(p_partkey as varchar) || '.py' as relative_path,
  cast(substr(p_brand, 7) as int) as k, cast(p_partkey as varchar) as n from part"""
MODULE_ROWS = """select cast(c_custkey as varchar) as project_id, 'app/api/c' || cast(c_custkey as varchar) || '.py' as relative_path,
  c_nationkey as k, cast(c_custkey as varchar) as n, c_mktsegment as segment from customer"""


def _script_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.code_facts(modules.scripts(spark, sf_dir))


def _module_facts(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    return facts.code_facts(modules.route_modules(spark, sf_dir), kinds)


@register("script_rule_findings", "DSC-0 PY-1 PY-2 PY-3 PY-4 PY-5 PY-6 PY-7 PY-8 PY-9 PY-10 CFG-1 CFG-2 CFG-3 CFG-4 CFG-5 CFG-6 CFG-7 CFG-8 AN-1 AN-2 AN-3 AN-5 FND-6", twin(
    f"""select s.project_id, s.relative_path, e.rule_id, cast(e.line_start as int) as line_start, cast(e.column_start as int) as column_start,
  replace(e.function_name, '{{n}}', s.n) as function_name, e.class_name, replace(e.evidence, '{{n}}', s.n) as evidence,
  e.rule_id || '|' || s.relative_path || '|' || cast(e.line_start as varchar) || '||' as fingerprint
from scripts s join {values(EXPECTED_SCRIPT_FINDINGS, 'e(k, rule_id, line_start, column_start, function_name, class_name, evidence)')} on e.k = s.k""",
    scripts=SCRIPT_ROWS))
def script_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rules.source_findings(_script_facts(spark, sf_dir)).select(
        "project_id", "relative_path", "rule_id", "line_start", "column_start", "function_name", "class_name", "evidence", "fingerprint")


@register("route_rule_findings", "EP-1 EP-2 EP-3 EP-4 EP-5 EP-6 EP-7 EP-8 EP-9 AN-4 AZ-1 AZ-2 AZ-3 JOI-6", twin(
    f"""select s.project_id, s.relative_path, e.rule_id, cast(e.line_start as int) as line_start, cast(e.column_start as int) as column_start,
  e.function_name, replace(e.evidence, '{{n}}', s.n) as evidence
from modules s join {values(EXPECTED_ROUTE_FINDINGS, 'e(k, rule_id, line_start, column_start, function_name, evidence)')} on e.k = s.k""",
    modules=MODULE_ROWS))
def route_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rules.source_findings(_module_facts(spark, sf_dir)).select(
        "project_id", "relative_path", "rule_id", "line_start", "column_start", "function_name", "evidence")


@register("source_rule_severities", "PY-1 CFG-1 EP-1 AN-1 AZ-1 SCO-5 FND-10", twin(
    f"""select s.project_id, r.analyzer, r.severity, r.confidence, r.category, r.cwe_id, r.owasp_reference, cast(count(*) as bigint) as n
from scripts s join {values(EXPECTED_SCRIPT_FINDINGS, 'e(k, rule_id, line_start, column_start, function_name, class_name, evidence)')} on e.k = s.k
join {values(EXPECTED_RULES, "r")}(rule_id, analyzer, category, severity, confidence, cwe_id, owasp_reference) on r.rule_id = e.rule_id
group by all""", scripts=SCRIPT_ROWS))
def source_rule_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_rules.source_findings(_script_facts(spark, sf_dir))
    return found.groupBy("project_id", "analyzer", "severity", "confidence", "category", "cwe_id", "owasp_reference").agg(F.count("*").alias("n"))


@register("parse_errors", "DSC-0 FND-11", twin(
    """select project_id, relative_path, relative_path || ':1: SyntaxError: invalid syntax' as error from scripts where k = 24
union all select project_id, relative_path, relative_path || ':1: SyntaxError: invalid syntax' from modules where k = 24""",
    scripts=SCRIPT_ROWS, modules=MODULE_ROWS))
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.parse_errors(_script_facts(spark, sf_dir)).unionByName(facts.parse_errors(_module_facts(spark, sf_dir)))


@register("document_parse_status", "DSC-0 FND-11", twin(
    """select source as project_id, cast(count(*) as bigint) as files, cast(count(*) filter (where doc_id % 2 = 1) as bigint) as failed from documents group by source"""))
def document_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as comments of Python files, every other one with a line that no parser takes: each failure stays a row."""
    comment = F.concat(F.lit("# "), F.regexp_replace("content", r"[\n\r\f]", "\n# "))
    broken = F.when(F.col("file_id") % 2 == 1, F.lit("\ndef (:\n")).otherwise(F.lit("\n"))
    prose = b.source_files(spark, sf_dir).withColumns({"language": F.lit("python"), "content": F.concat(comment, broken)})
    return facts.code_facts(prose).filter("kind = 'file'").groupBy("project_id").agg(
        F.count("*").alias("files"), F.count("error").alias("failed"))


ENDPOINT_COLUMNS = "e(k, method, full_path, function_name, line_number, auth, perm, schemes, scopes, tags, parameters, responses)"


@register("discovered_endpoints", "DSC-1 DSC-2 DSC-3 DSC-4 DSC-6 DSC-7 DSC-8 DSC-10 DSC-11 DSC-12 DSC-13 DSC-14 DSC-15 DSC-16 DSC-17 DSC-18 DSC-19 DSC-20 JOI-5 SET-2", twin(
    f"""select s.project_id, s.relative_path, e.method, replace(e.full_path, '{{n}}', s.n) as full_path, e.function_name, cast(e.line_number as int) as line_number,
  e.auth as authentication_required, e.perm as permission_required, e.schemes, e.scopes, e.tags, e.parameters, e.responses
from modules s join {values(EXPECTED_ENDPOINTS, ENDPOINT_COLUMNS)} on e.k = s.k""", modules=MODULE_ROWS))
def discovered_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.endpoints(_module_facts(spark, sf_dir, discovery.ENDPOINT_FACTS))
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return found.select(
        "project_id", "relative_path", "method", "full_path", "function_name", "line_number", "authentication_required", "permission_required",
        F.array_join("security_schemes", ",").alias("schemes"), F.array_join("security_scopes", ",").alias("scopes"), F.array_join("tags", ",").alias("tags"),
        F.array_join(F.transform("parameters", lambda p: F.concat_ws(
            ":", p["name"], p["location"], p["required"].cast("string"), dash(p["default_value"]), p["nullable"].cast("string"))), ",").alias("parameters"),
        F.array_join(F.transform("responses", lambda r: F.concat_ws(":", r["status_code"].cast("string"), dash(r["model"]), dash(r["description"]))), ",").alias("responses"),
    )


@register("parameter_details", "DSC-9 DSC-6", twin(
    f"""select s.project_id, p.name, p.description, p.alias, p.deprecated from modules s join
{values(((23, "report_id", "Key", None, False), (23, "page", None, "p", True), (23, "token", None, None, False)), 'p(k, name, description, alias, deprecated)')} on p.k = s.k
join (values (1), (2)) twice(x) on true where s.k = 23""", modules=MODULE_ROWS))
def parameter_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.endpoints(_module_facts(spark, sf_dir, discovery.ENDPOINT_FACTS)).filter("function_name = 'report' and size(parameters) > 0")
    return found.select("project_id", F.explode("parameters").alias("p")).select("project_id", "p.name", "p.description", "p.alias", "p.deprecated")


@register("dependency_declarations", "DSC-10 DSC-11 DSC-12 DSC-13", twin(
    """select project_id, 'get_current_user' as dependency_name, 'Depends' as declaration_type,
  true as authentication_required, false as permission_required from modules where k in (1, 4, 5, 8, 9, 10, 17, 19)""", modules=MODULE_ROWS))
def dependency_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.dependency_rows(_module_facts(spark, sf_dir)).select(
        "project_id", "dependency_name", "declaration_type", "authentication_required", "permission_required")


@register("router_definitions", "DSC-1", twin(
    """select project_id, cast(1 as int) as line_number, 'router' as variable, '/v2' as prefix, 'things' as tags,
  'Security(oauth2_scheme, scopes=[''read''])' as dependencies from modules where k = 22""", modules=MODULE_ROWS))
def router_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.routers(_module_facts(spark, sf_dir)).select(
        "project_id", "line_number", "variable", "prefix", F.array_join("tags", ",").alias("tags"), F.array_join("dependencies", ",").alias("dependencies"))


@register("stored_endpoints", "DSC-21 SRC-13", twin(
    f"""select s.project_id, e.method as http_method, replace(e.full_path, '{{n}}', s.n) as path, case when e.auth then 'unknown' else 'public' end as authentication_type,
  cast(case when e.k = 22 then 202 end as int) as response_status_code, case when e.k = 22 then '/v2' end as router_prefix,
  case when e.k = 22 then 'PATH,BODY,UNKNOWN' when e.k = 23 then 'PATH,QUERY,HEADER' when e.k in (4, 5) then 'FILE,UNKNOWN' else null end as some_locations
from modules s join {values(EXPECTED_ENDPOINTS, ENDPOINT_COLUMNS)} on e.k = s.k""", modules=MODULE_ROWS))
def stored_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = discovery.stored_endpoints(discovery.endpoints(_module_facts(spark, sf_dir, discovery.ENDPOINT_FACTS)))
    named = F.col("function_name").isin("put_thing", "report", "store") & (F.size("parameters") > 0)
    return stored.select(
        "project_id", "http_method", "path", "authentication_type", "response_status_code", "router_prefix",
        F.when(named, F.array_join(F.transform("parameters", lambda p: p["location"]), ",")).alias("some_locations"))


@register("endpoint_assessments", "EPR-1 EPR-2 EPR-3 EPR-4 EPR-5 DSC-5 SCO-1 FND-3 SRC-12", twin(
    f"""select s.project_id, s.relative_path, e.method, replace(e.path, '{{n}}', s.n) as path, e.rules, cast(e.score as bigint) as score
from modules s join {values(EXPECTED_ASSESSMENTS, 'e(k, method, path, rules, score)')} on e.k = s.k""", modules=MODULE_ROWS))
def endpoint_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = endpoint_rules.with_hits(discovery.endpoints(_module_facts(spark, sf_dir, discovery.ENDPOINT_FACTS)))
    assessed = endpoint_rules.assessments_of(hit.withColumn("rules", F.transform("hits", lambda h: h["outcome"])), ["project_id", "relative_path", "rules"])
    severities = F.create_map(*[F.lit(part) for r in catalog.ENDPOINT_RULES for part in (r[0], f"{r[1]}:{r[5]}")])
    fired = F.array_join(F.array_sort(F.transform("rules", lambda o: F.element_at(severities, o))), ",")
    return assessed.select("project_id", "relative_path", "method", "path", fired.alias("rules"), "score")


@register("endpoint_rule_findings", "EPR-1 EPR-2 EPR-3 EPR-4 EPR-5 FND-1 REM-6", twin(
    f"""select s.project_id, split_part(rule, ':', 1) as rule_id, split_part(rule, ':', 2) as severity, case split_part(rule, ':', 1)
  when 'AUTH-001' then 'CWE-306' when 'AUTH-002' then 'CWE-862' when 'VAL-001' then 'CWE-20' else 'CWE-434' end as cwe_id,
  case split_part(rule, ':', 1) when 'AUTH-001' then 'Authentication' when 'AUTH-002' then 'Authorization' when 'VAL-001' then 'Validation' else 'File Upload' end as knowledge_category,
  case split_part(rule, ':', 1) when 'VAL-001' then '1 potentially unvalidated request parameter(s) detected: file.' when 'FILE-001' then '1 upload parameter(s) detected: file.'
    when 'AUTH-001' then 'authentication_required=False and no authentication dependency was discovered.' else 'permission_required=False and no security scopes found.' end as evidence,
  case split_part(rule, ':', 1) when 'AUTH-001' then 'Broken Authentication' when 'AUTH-002' then 'Broken Function Level Authorization' else 'Security Misconfiguration' end as owasp_title
from (select s.project_id, unnest(string_split(e.rules, ',')) as rule from modules s
  join {values(EXPECTED_ASSESSMENTS, 'e(k, method, path, rules, score)')} on e.k = s.k where e.rules <> '') s""", modules=MODULE_ROWS))
def endpoint_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = endpoint_rules.assess(discovery.endpoints(_module_facts(spark, sf_dir, discovery.ENDPOINT_FACTS)), ["project_id"])
    titles = catalog.owasp_categories(spark).select(F.col("owasp").alias("owasp_reference"), F.col("title").alias("owasp_title"))
    return found.join(F.broadcast(titles), "owasp_reference", "left").select(
        "project_id", "rule_id", "severity", "cwe_id", F.col("knowledge.category").alias("knowledge_category"), "evidence", "owasp_title")


@register("analyzer_runs", "AGG-11 FND-9", twin(
    f"""select s.project_id, a.analyzer, cast(1 as bigint) as files_scanned, cast(count(e.rule_id) as bigint) as issue_count, s.k <> 24 as successful,
  cast(case when a.analyzer in ('fastapi-endpoint-security', 'fastapi-authentication-security', 'fastapi-authorization-security')
    then case s.k when 24 then 0 when 23 then 2 else 1 end end as bigint) as endpoint_count,
  cast(case when a.analyzer = 'fastapi-authentication-security' then 0 end as bigint) as jwt_decode_calls,
  cast(case when a.analyzer = 'fastapi-authorization-security' then case when s.k = 19 then 1 else 0 end end as bigint) as authorization_checks,
  cast(case when a.analyzer = 'fastapi-authorization-security' then case when s.k = 17 then 1 else 0 end end as bigint) as ownership_checks,
  cast(case when a.analyzer = 'fastapi-authorization-security' then case when s.k in (16, 18) then 1 else 0 end end as bigint) as idor_candidates
from modules s join (values ('python-ast-security'), ('fastapi-authorization-security'), ('python-configuration-security'),
  ('fastapi-authentication-security'), ('fastapi-endpoint-security')) a(analyzer) on true
left join (select x.k, x.rule_id, case when x.rule_id in ('FASTAPI-AUTH-003', 'FASTAPI-AUTH-008', 'FASTAPI-AUTH-009') then 'fastapi-authorization-security'
  when x.rule_id = 'FASTAPI-AUTH-007' then 'fastapi-authentication-security' else 'fastapi-endpoint-security' end as analyzer
  from {values(EXPECTED_ROUTE_FINDINGS, 'x(k, rule_id, line_start, column_start, function_name, evidence)')}) e on e.k = s.k and e.analyzer = a.analyzer
group by s.project_id, a.analyzer, s.k""", modules=MODULE_ROWS))
def analyzer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = cut_lineage(_module_facts(spark, sf_dir), "kind")
    return runs.analyzer_runs(known, source_rules.source_findings(known))
