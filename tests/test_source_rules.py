"""Snippets with the rules they must and must not raise, run in one job through the facts and the rules."""

import pytest

from palisade.catalog import rules as catalog
from palisade.operators import discovery, facts, source_rules

# (name, source, rules that must be raised, rules that must not be raised; "*" means nothing else may be raised)
CASES = [
    ("eval", "result = eval(user_input)\n", {"CODE-001"}, {"*"}),
    ("exec", "exec(user_code)\n", {"CODE-002"}, {"*"}),
    ("system", "import os\nos.system(command)\n", {"CMD-002"}, {"*"}),
    ("shell", "import subprocess\nsubprocess.run(command, shell=True)\n", {"CMD-001"}, {"*"}),
    ("no shell", "import subprocess\nsubprocess.run(['ls'], shell=False, check=True)\n", set(), {"*"}),
    ("pickle", "import pickle\nvalue = pickle.loads(payload)\n", {"DESER-001"}, {"*"}),
    ("yaml", "import yaml\nvalue = yaml.load(payload)\n", {"DESER-002"}, {"*"}),
    ("safe yaml", "import yaml\nvalue = yaml.load(payload, Loader=yaml.SafeLoader)\n", set(), {"*"}),
    ("sql f-string", 'cursor.execute(f"SELECT * FROM users WHERE id = {user_id}")\n', {"SQL-001"}, {"*"}),
    ("sql percent", 'cursor.execute("SELECT * FROM users WHERE id = %s" % user_id)\n', {"SQL-001"}, {"*"}),
    ("sql format", 'cursor.execute("SELECT {}".format(user_id))\n', {"SQL-001"}, {"*"}),
    ("sql parameters", 'cursor.execute("SELECT 1 WHERE id = %s", (user_id,))\n', set(), {"*"}),
    ("ssrf", "import requests\nresponse = requests.get(user_url)\n", {"SSRF-001", "HTTP-001"}, {"*"}),
    ("request method", "import httpx\nhttpx.request('GET', target, timeout=5, verify=False)\n", {"SSRF-001", "HTTP-002", "TLS-001"}, {"*"}),
    ("static url", "import requests\nrequests.get('https://a.example', timeout=(2, 10), verify=True)\n", set(), {"*"}),
    ("keyword url", "import httpx\nhttpx.get(url=target, timeout=5)\n", {"SSRF-001"}, {"*"}),
    ("secret", 'MAIL_API_KEY = "key-77zq-0987654321lm"\n', {"SECRET-001"}, {"*"}),
    ("signing secret", 'JWT_SECRET = "this-is-a-hardcoded-signing-secret"\n', {"SECRET-001"}, set()),
    ("placeholder", 'SECRET_KEY = "change-me"\n', {"SECRET-002"}, {"*"}),
    ("annotated secret", 'JWT_SECRET: str = "hardcoded-jwt-secret-123456789"\n', {"SECRET-001"}, set()),
    ("attribute secret", 's.secret_key = "hardcoded-session-secret-123456"\n', {"SECRET-001"}, set()),
    ("tuple secret", 'a, api_key = "key-77zq-0987654321lm"\n', {"SECRET-001"}, set()),
    ("environment", 'import os\nAPI_KEY = os.getenv("API_KEY")\n', set(), {"*"}),
    ("debug", "app = FastAPI(debug=True)\n", {"CONFIG-001"}, {"*"}),
    ("no debug", "app = FastAPI(debug=False)\n", set(), {"*"}),
    ("tls", "import requests\nrequests.get(url, verify=False)\n", {"TLS-001"}, set()),
    ("jwt none", 'jwt.decode(t, k, algorithms=["none"], audience="a", issuer="b")\n', {"JWT-001"}, {"*"}),
    ("jwt unsigned", 'jwt.decode(t, k, options={"verify_signature": False}, audience="a", issuer="b")\n', {"JWT-002", "FASTAPI-AUTH-006"}, {"*"}),
    ("jwt strong", 'jwt.decode(t, k, algorithms=["RS256"], audience="a", issuer="b")\n', set(), {"*"}),
    ("jwt claims", 'def f(t):\n    return jwt.decode(t, K, algorithms=["HS256"])\n', {"FASTAPI-AUTH-004", "FASTAPI-AUTH-005"}, {"*"}),
    ("jwt no aud", 'jwt.decode(t, K, options={"verify_aud": False}, issuer="b")\n', set(), {"*"}),
    ("jwt no iss", 'jwt.decode(t, K, options={"verify_iss": False}, audience="b")\n', set(), {"*"}),
    ("jwt in a default", 'def f(x=jwt.decode(t, K, algorithms=["HS256"])):\n    pass\n', set(), {"FASTAPI-AUTH-004"}),
    ("cors", 'app.add_middleware(CORSMiddleware, allow_origins=["*"])\n', {"CORS-001"}, {"*"}),
    ("cors credentials", 'app.add_middleware(CORSMiddleware, allow_origins=["*"], allow_credentials=True)\n', {"CORS-002"}, {"*"}),
    ("cors list", 'app.add_middleware(CORSMiddleware, allow_origins=["https://a.example"], allow_credentials=True)\n', set(), {"*"}),
    ("security dependency", '@router.get("/profile")\nasync def profile(user=Security(require_user)):\n    return user\n', set(), {"*"}),
    ("delete", '@router.delete("/documents/{d}")\nasync def delete_document(d: int):\n    return d\n', {"FASTAPI-AUTH-002"}, {"FASTAPI-AUTH-001"}),
    ("upload", '@router.post("/up")\nasync def up(file: UploadFile = File(...), u=Depends(get_current_user)):\n    return file.filename\n', {"FASTAPI-FILE-001"}, set()),
    ("leak", '@r.get("/p")\nasync def p():\n    try:\n        return x()\n    except Exception as exc:\n        return {"error": str(exc)}\n', {"FASTAPI-ERROR-001"}, set()),
    ("no leak", '@r.get("/p")\nasync def p():\n    try:\n        return x()\n    except Exception:\n        raise HTTPException(status_code=500, detail="no")\n', set(), {"*"}),
    ("redirect", '@r.get("/redirect")\nasync def leave(onward: str):\n    return RedirectResponse(onward)\n', {"FASTAPI-REDIRECT-001"}, set()),
    ("static redirect", '@r.get("/redirect")\nasync def go():\n    return RedirectResponse("/home")\n', set(), {"*"}),
    ("mapped fields", '@r.post("/profiles")\nasync def c(payload: P):\n    return Profile(name=payload.name)\n', set(), {"FASTAPI-PROPERTY-001"}),
    ("paged", '@r.get("/orders")\nasync def some_invoices(page_size: int = Query(20), u=Depends(get_current_user)):\n    return r.part(page_size)\n', set(), {"FASTAPI-RESOURCE-001"}),
    ("admin", '@r.get("/admin/users")\nasync def list_admin_users():\n    return []\n', {"FASTAPI-AUTH-007"}, set()),
    ("protected admin", '@r.get("/admin/users", dependencies=[Depends(require_admin)])\nasync def list_admin_users():\n    return []\n', set(), {"FASTAPI-AUTH-007"}),
    ("static role", 'def enrol():\n    badge.role = "guest"\n', set(), {"*"}),
    ("idor", '@r.get("/d/{doc_id}")\nasync def g(doc_id: int, db: S):\n    return db.get(D, doc_id)\n', {"FASTAPI-AUTH-003"}, set()),
    ("put", '@r.put("/u/{uid}")\nasync def g(uid: int, p: U, db: S):\n    u = db.get(D, uid)\n    u.name = p.name\n', {"FASTAPI-AUTH-009"}, {"FASTAPI-AUTH-003"}),
    ("owner key", '@r.get("/d/{i}")\nasync def g(i: int, db: S, current_user=Depends(x)):\n    d = db.get(D, i)\n    if d["owner_id"] != current_user["id"]:\n        raise E()\n    return d\n', set(), {"FASTAPI-AUTH-003"}),
    ("trusted role", '@r.get("/x")\nasync def g(current_user=Depends(get_current_user)):\n    if current_user.role == "admin":\n        return 1\n', set(), {"FASTAPI-AUTH-008"}),
    ("nested route", '@r.get("/o")\ndef outer():\n    @r.get("/i/{k}")\n    def inner(k):\n        return db.get(D, k)\n', set(), {"FASTAPI-AUTH-003"}),
    ("late control", '@r.post("/login")\ndef login(p):\n' + "    step = work(step)\n" * 40 + "    return rate_limit(p)\n", set(), {"FASTAPI-FLOW-001"}),
    ("crlf and accents", 'é = "ü"\r\nx = "é"; eval(x)\r\n', {"CODE-001"}, {"*"}),
]


@pytest.fixture(scope="module")
def raised(spark):
    rows = [(name, "app/main.py", "python", source) for name, source, _, _ in CASES]
    files = spark.createDataFrame(rows, "project_id string, relative_path string, language string, content string").repartition(4)
    found = source_rules.source_findings(facts.code_facts(files)).collect()
    return {name: [f for f in found if f.project_id == name] for name, *_ in CASES}


@pytest.mark.parametrize("name,source,present,absent", CASES, ids=[c[0] for c in CASES])
def test_rules_of_a_snippet(raised, name, source, present, absent):
    ids = {f.rule_id for f in raised[name]}
    assert present <= ids
    assert ids <= present if "*" in absent else not ids & absent


def test_position_and_evidence_count_bytes_correctly(raised):
    hit = raised["crlf and accents"][0]
    assert (hit.line_start, hit.evidence) == (2, "eval(x)")


def test_secrets_never_reach_the_evidence(raised):
    assert all("0987654321" not in f.evidence for f in raised["secret"])


def test_controls_late_in_a_function_count(spark):
    source = dict((c[0], c[1]) for c in CASES)["late control"]
    files = spark.createDataFrame([("p", "a.py", "python", source)], "project_id string, relative_path string, language string, content string")
    assert source_rules.source_findings(facts.code_facts(files)).isEmpty()


def test_of_two_decorators_the_first_names_the_finding(spark):
    source = '@r.get("/one")\n@r.get("/two")\nasync def leave(onward: str, u=Depends(get_current_user)):\n    return RedirectResponse(onward)\n'
    files = spark.createDataFrame([("p", "a.py", "python", source)], "project_id string, relative_path string, language string, content string")
    (found,) = source_rules.source_findings(facts.code_facts(files)).collect()
    assert found.rule_id == "FASTAPI-REDIRECT-001" and found.detail["endpoint_path"] == "/one"


def test_findings_carry_their_metadata(spark):
    source = (
        'MAIL_API_KEY = "key-77zq-0987654321lm"\nTOKEN = "change-me"\n'
        '@r.get("/shelves/{shelf_id}/boxes/{box_id}")\nasync def box(shelf_id: int, box_id: int, db: Session):\n    return db.get(Box, box_id, shelf_id)\n')
    files = spark.createDataFrame([("p", "a.py", "python", source)], "project_id string, relative_path string, language string, content string")
    detail = {r.rule_id: r.detail for r in source_rules.source_findings(facts.code_facts(files)).collect()}
    assert detail["SECRET-001"] == {"variable_name": "MAIL_API_KEY", "secret_length": "21"}
    assert detail["SECRET-002"]["reason"] == "placeholder-value"
    assert detail["FASTAPI-AUTH-003"] == {
        "endpoint_method": "GET", "endpoint_path": "/shelves/{shelf_id}/boxes/{box_id}", "object_identifiers": "box_id,shelf_id"}


def test_a_file_not_read_to_its_end_has_no_facts():
    deep = "eval(x)\n" + "x = " + "-" * 20_000 + "1\n"
    rows = list(facts.rows_of("p", "deep.py", deep))
    assert [r["kind"] for r in rows] == ["file"] and rows[0]["error"]


def test_broken_files_become_error_rows_and_stop_nothing(spark):
    rows = [("p", "a.py", "python", "def broken(:\n"), ("p", "b.py", "python", "eval(x)\n"), ("p", "c.js", "javascript", "eval(x)")]
    known = facts.code_facts(spark.createDataFrame(rows, "project_id string, relative_path string, language string, content string"))
    assert [r.error for r in facts.parse_errors(known).collect()] == ["a.py:1: SyntaxError: invalid syntax"]
    assert [r.relative_path for r in source_rules.source_findings(known).collect()] == ["b.py"]


def test_deep_nesting_is_an_error_row(spark):
    deep = "x = " + "+".join(["1"] * 20000) + "\n"
    known = facts.code_facts(spark.createDataFrame([("p", "a.py", "python", deep)], "project_id string, relative_path string, language string, content string"))
    assert known.filter("kind = 'file'").count() == 1


def test_one_line_repeats_collapse(spark):
    known = facts.code_facts(spark.createDataFrame([("p", "a.py", "python", "eval(a); eval(b)\neval(c)\n")], "project_id string, relative_path string, language string, content string"))
    found = source_rules.source_findings(known).orderBy("line_start").collect()
    assert [(f.line_start, f.column_start, f.fingerprint) for f in found] == [(1, 1, "CODE-001|a.py|1||"), (2, 1, "CODE-001|a.py|2||")]


def test_every_rule_has_a_text_and_cannot_be_registered_twice():
    assert set(source_rules.RULES) == {r[0] for r in catalog.SOURCE_RULES}
    with pytest.raises(ValueError):
        source_rules.register_rule(source_rules.RULES["CODE-001"])


def test_discovery_of_a_router(spark):
    source = (
        'api = fastapi.APIRouter(prefix="v1/", tags=["a", "b"], dependencies=[Depends(auth.jwt)])\n'
        '@api.get(path="items/", tags=["b", "c"], summary="S", status_code=201, response_model=List[Item])\n'
        'def items(q: Annotated[str | None, Query(description="D")] = None, *args, k: Optional[int] = Header(...), **kw):\n'
        '    """Doc."""\n    return JSONResponse({})\n'
        '@api.trace("/t/{item_id}")\ndef t(item: int, files: list[UploadFile]):\n    raise HTTPException(status_code=HTTPStatus.NOT_FOUND)\n'
    )
    known = facts.code_facts(spark.createDataFrame([("p", "a.py", "python", source)], "project_id string, relative_path string, language string, content string"))
    rows = {r.method: r for r in discovery.endpoints(known).collect()}
    first, second = rows["GET"], rows["TRACE"]
    assert first.full_path == "/v1/items/" and first.tags == ["a", "b", "c"] and first.description == "Doc." and first.status_code == 201
    assert first.authentication_required and first.security_schemes == ["Bearer"] and first.dependencies == ["Depends(auth.jwt)"]
    assert [(p.name, p.location, p.required, p.default_value, p.nullable) for p in first.parameters] == [
        ("q", "query", False, "None", True), ("args", "vararg", False, None, False), ("k", "header", True, None, True), ("kw", "kwargs", False, None, False)]
    assert [(r.status_code, r.model) for r in first.responses] == [(200, "JSONResponse")]
    # A route part counts for every parameter whose name it starts with.
    assert [(p.name, p.location) for p in second.parameters] == [("item", "path"), ("files", "file")]
    assert [r.status_code for r in second.responses] == [404]
    stored = discovery.stored_endpoints(discovery.endpoints(known)).filter("http_method = 'GET'").first()
    assert [p.location for p in stored.parameters] == ["QUERY", "UNKNOWN", "HEADER", "UNKNOWN"]
