"""Python modules that Spark derives from the driver's tables: one script per part, one route module per customer.

The driver has no source code, so a row's own columns choose a module text and fill in its key. The number of
files grows with the tables. What each text must lead to is written down in the twins of the queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.sources.bindings import table

# One text per brand number (1 to 25). ``{n}`` is the key of the part.
SCRIPTS = (
    'result = eval(value_{n})\n',
    'def run_{n}(code):\n    exec(code)\n',
    'import os\n\nclass Job:\n    def start(self, command):\n        os.system(command)\n',
    'import subprocess\nsubprocess.run(\n    command,\n    shell=True,\n)\n',
    "import subprocess\nsubprocess.run(['ls', '-la'], shell=False, check=True)\nsubprocess.Popen(cmd, shell=flag)\nsubprocess.call(cmd, shell=options['shell'])\n",
    'import pickle\nvalue = pickle.loads(payload_{n})\n',
    'import yaml\na = yaml.load(text)\nb = yaml.load(text, Loader=yaml.SafeLoader)\nc = yaml.load(text, Loader=yaml.Loader)\nd = yaml.safe_load(text)\n',
    'cursor.execute(f"SELECT * FROM t WHERE id = {key}")\ncursor.execute("SELECT 1 WHERE id = %s", (key,))\n',
    'db.session.executemany("DELETE FROM t WHERE id = %s" % key)\nexecute("SELECT " + name)\nconn.exec_driver_sql("SELECT {}".format(name))\n',
    'import requests\nresponse = requests.get(user_url)\n',
    "import httpx\nresponse = httpx.request(\n    'GET', target, timeout=5, verify=False\n)\n",
    "import requests\nresponse = requests.get(\n    'https://api.example.com/health',\n    timeout=(2, 10),\n    verify=True,\n)\n",
    "import httpx\nresponse = httpx.get(url=target, timeout=5)\nother = httpx.post('https://a.example', data={n})\n",
    'MAIL_API_KEY = "key-9f{n}-qwz77k-r4t8v2hx"\n',
    'SECRET_KEY = "change-me"\njwtSecret = "aaaaaaaaaaaaaaaaaaaaaaaa"\n',
    'class Settings:\n    dbPassword: str = "short-pw"\n    def load(self):\n        self.auth_token = "token-1234-abcd"\n',
    'import os\nAPI_KEY = os.getenv("API_KEY")\nTOKEN = "${VAULT_TOKEN_PRODUCTION}"\nsecret_url = "https://vault.example.com/secret"\nlabel = "pk-sample-0987654321"\n',
    'from fastapi import FastAPI\nimport uvicorn\napp = FastAPI(debug=True)\nuvicorn.run(app, debug=True)\nother = Custom(debug=True)\n',
    'session.get(url, verify=False)\nclient.head(url, verify=False)\n',
    'import jwt\njwt.decode(token, key, algorithms=["none", "HS256"])\n',
    'import jwt\njwt.decode(token, key, options={"verify_signature": False}, audience="a", issuer="b")\njwt.decode(token, key, verify=False, options={"verify_aud": False, "verify_iss": False})\n',
    'app.add_middleware(\n    CORSMiddleware,\n    allow_origins=["*"],\n)\napp.add_middleware(CORSMiddleware, allow_origins=["*"], allow_credentials=True)\n',
    'def promote(payload):\n    badge.privilege = payload.wanted\n    badge.roles = data["roles"]\n    card["is_staff"] = form.json()\n    badge.role = "guest"\n    badge.colour = payload.colour\n',
    'def broken_{n}(:\n',
    '# only text {n}\nVALUE = {n}\n',
)

# One text per nation key (0 to 24). ``{n}`` is the key of the customer.
ROUTE_MODULES = (
    '@router.get("/users/{user_id}")\nasync def get_user(user_id: int):\n    return {"id": user_id}\n',
    '@router.get("/users/{user_id}")\nasync def get_user(user_id: int, current_user=Depends(get_current_user)):\n    return {"id": user_id}\n',
    '@router.get("/admin/report", dependencies=[Depends(require_admin)])\nasync def report():\n    return {}\n',
    '@router.delete("/documents/{document_id}")\nasync def delete_document(document_id: int):\n    return {"deleted": document_id}\n',
    '@router.post("/files/{n}")\nasync def store(\n    file: UploadFile = File(...),\n    user=Depends(get_current_user),\n):\n    return {"name": file.filename}\n',
    '@router.post("/files/{n}")\nasync def store(\n    file: UploadFile = File(...),\n    user=Depends(get_current_user),\n):\n    validate_upload(file)\n    return {"name": file.filename}\n',
    '@router.get("/weather")\nasync def weather_now(station: str):\n    try:\n        reading = probe(station)\n    except OSError as fault:\n        raise HTTPException(status_code=502, detail=describe(fault))\n    return reading\n',
    '@router.get("/leave")\nasync def leave(onward: str, note: str):\n    if note:\n        return RedirectResponse(url=onward)\n    return RedirectResponse("/start")\n',
    '@router.post("/badges")\nasync def issue_badge(form: BadgeForm, user=Depends(get_current_user)):\n    return Badge(**form.model_dump())\n',
    '@router.get("/invoices")\nasync def every_invoice(user=Depends(get_current_user)):\n    return ledger.rows_of(user)\n',
    '@router.get("/invoices")\nasync def some_invoices(page_size: int = Query(20, le=200), user=Depends(get_current_user)):\n    return ledger.part(user, page_size)\n',
    '@router.post("/transfer/{n}")\nasync def move_points(order: PointsOrder):\n    return bank.book_later(order)\n',
    '@router.post("/transfer/{n}", dependencies=[Depends(rate_limit_points)])\nasync def move_points(order: PointsOrder):\n    return bank.book_later(order)\n',
    '@router.get("/v1/items/{item_id}", deprecated=True)\nasync def old_item(item_id: int):\n    return load(item_id)\n',
    '@router.get("/health")\nasync def health():\n    return {"status": "ok"}\n',
    '@router.get("/admin/metrics")\nasync def metrics():\n    return []\n',
    '@router.get("/items/{item_id}")\nasync def read_item(item_id: int, db: Session):\n    return db.query(Item).filter(Item.id == item_id).first()\n',
    '@router.get("/items/{item_id}")\nasync def read_item(item_id: int, db: Session, current_user=Depends(get_current_user)):\n    item = db.get(Item, item_id)\n    if item.owner_id != current_user.id:\n        raise HTTPException(status_code=403)\n    return item\n',
    '@router.patch("/items/{item_id}")\nasync def edit(item_id: int, payload: ItemUpdate, db: Session):\n    item = db.get(Item, item_id)\n    item.title = payload.title\n    db.commit()\n',
    '@router.delete("/items/{item_id}")\nasync def drop(item_id: int, db: Session, user=Depends(get_current_user)):\n    item = db.get(Item, item_id)\n    authorize(item, user)\n    db.delete(item)\n',
    '@router.delete("/items/{item_id}", dependencies=[Depends(require_permission)])\nasync def drop(item_id: int, db: Session):\n    db.delete(db.get(Item, item_id))\n',
    '@router.post("/actions")\nasync def act(payload: ActionRequest):\n    if payload.permission == "root":\n        return run()\n    assert not payload.is_admin\n',
    'router = APIRouter(prefix="/v2", tags=["things"], dependencies=[Security(oauth2_scheme, scopes=["read"])])\n\nclass Api:\n    @router.put("/things/{thing_id}/", tags=["api", "things"], status_code=202)\n    def put_thing(self, thing_id: int, body: ThingModel = Body(...), q: str | None = None):\n        if thing_id:\n            raise HTTPException(status_code=status.HTTP_404_NOT_FOUND, detail="gone")\n        return JSONResponse(status_code=201, content={})\n',
    '@router.get("/reports/{report_id}")\n@router.head("/reports/{report_id}", summary="Head", responses={404: {"model": Gone, "description": "no report"}})\nasync def report(report_id: int = Path(..., description="Key"), page: int = Query(1, alias="p", deprecated=True), token: str = Header(None)):\n    """Read a report."""\n    return Response(status_code=HTTPStatus.NO_CONTENT)\n',
    'async def broken(:\n',
)


def _filled(texts: tuple[str, ...], index: Column, key: Column) -> Column:
    chosen = F.element_at(F.array(*[F.lit(t) for t in texts]), index)
    return F.replace(chosen, F.lit("{n}"), key.cast("string"))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Spread the narrow rows over the cores before they turn into module texts, which are costly to parse."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def scripts(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """One script a part; ``shift`` gives every part the text of a later brand, as if the project had changed."""
    part = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand"), "p_partkey")
    brand = F.substring("p_brand", 7, 10).cast("int")
    return part.select(
        F.col("p_size").cast("string").alias("project_id"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("relative_path"),
        F.lit("python").alias("language"),
        _filled(SCRIPTS, (brand - 1 + shift) % len(SCRIPTS) + 1, F.col("p_partkey")).alias("content"),
    )


def route_modules(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """One module a customer; ``shift`` gives every customer the text of a later kind, as if the project had changed."""
    customer = _spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return customer.select(
        F.col("c_custkey").cast("string").alias("project_id"),
        F.concat(F.lit("app/api/c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("relative_path"),
        F.lit("python").alias("language"),
        _filled(ROUTE_MODULES, (F.col("c_nationkey") + shift) % len(ROUTE_MODULES) + 1, F.col("c_custkey")).alias("content"),
    )
