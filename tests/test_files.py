"""Source trees on disk: inventory, loading, technology, reports, discovery snapshots and the whole scan."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palisade.operators import inventory, technology
from palisade.plans import scan as scans
from palisade.sources import files as sources, relational, reports

TREE = {
    "app/main.py": b"from fastapi import FastAPI\napp = FastAPI(debug=True)\n",
    "app/bad.py": b"x = '\xff'\n",
    "app/nul.py": b"x = 1\x00\n",
    "app/view.tsx": b"a\r\nb\rc",
    "app/Main.JAVA": b"class A {}",
    "big.js": b"x" * 3_000_000,
    "huge.py": b"#" * 6_000_000,
    "README": b"text",
    ".env.production": b"A=1\n",
    "dockerfile": b"FROM x\n",
    "requirements.txt": b"fastapi==0.110.1\n",
    "package-lock.json": b"{}",
    "noise.css": b"\x01\x02\x03abc",
    "empty.py": b"",
    "node_modules/a.js": b"x",
    "migrations/m.py": b"x = 1\n",
    "venv/b.py": b"x",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        target = base / "shop" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return str(base)


def test_inventory_of_a_tree(spark, root):
    rows = {r.relative_path: r for r in inventory.inventory(sources.source_tree(spark, root), limit=5 << 20).collect()}
    assert set(rows) == set(TREE) - {"node_modules/a.js", "venv/b.py"}
    assert {p: r.skip_reason for p, r in rows.items() if r.skip_reason} == {
        "app/nul.py": "binary_file", "huge.py": "file_too_large", "README": "unsupported_file_type", "package-lock.json": "ignored_filename", "noise.css": "binary_file"}
    assert {p: r.language for p, r in rows.items() if r.language} == {
        "app/main.py": "Python", "app/bad.py": "Python", "app/view.tsx": "TypeScript", "app/Main.JAVA": "Java", "big.js": "JavaScript", ".env.production": "Environment",
        "dockerfile": "Dockerfile", "requirements.txt": "Python Requirements", "empty.py": "Python", "migrations/m.py": "Python"}
    assert [rows[p].line_count for p in ("app/main.py", "app/view.tsx", "empty.py", "app/bad.py")] == [2, 3, 0, 1]
    assert rows["empty.py"].sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_unknown_text_can_be_included(spark, root):
    rows = {r.relative_path: r for r in inventory.inventory(sources.source_tree(spark, root), unknown_text=True).collect()}
    assert rows["README"].language == "Unknown Text" and rows["README"].skip_reason is None


def test_inventory_totals(spark, root):
    row = inventory.inventory_totals(inventory.inventory(sources.source_tree(spark, root))).first()
    assert (row.total_files, row.source_file_count, row.skipped_file_count) == (11, 8, 4)


def test_analysis_loading(spark, root):
    status = {r.relative_path: (r.language, r.load_status) for r in sources.analysis_tree(spark, root).collect()}
    assert status == {
        "app/main.py": ("python", "loaded"), "app/bad.py": ("python", "error"), "app/nul.py": ("python", "skipped"), "app/view.tsx": ("typescript", "loaded"),
        "big.js": ("javascript", "loaded"), "huge.py": ("python", "loaded"), "empty.py": ("python", "loaded"), "node_modules/a.js": ("javascript", "skipped"),
        "migrations/m.py": ("python", "skipped"), "venv/b.py": ("python", "skipped")}


def test_links_and_large_files_are_not_read(spark, root, tmp_path):
    import os

    os.makedirs(tmp_path / "p" / "src")
    (tmp_path / "p" / "src" / "__init__.py").write_text("a = 1\n")
    (tmp_path / "p" / "big.py").write_text("#" * 50)
    os.symlink(tmp_path / "p" / "big.py", tmp_path / "p" / "link.py")
    tree = sources.source_tree(spark, str(tmp_path), limit=20, folders_per_task=1)
    assert {r.relative_path: r.content is None for r in tree.collect()} == {"src/__init__.py": False, "big.py": True, "link.py": True}
    assert {r.relative_path: r.skip_reason for r in inventory.inventory(tree, limit=20).collect()} == {
        "src/__init__.py": None, "big.py": "file_too_large", "link.py": "symbolic_link"}


def test_technology_of_a_tree(spark, root):
    files = sources.source_tree(spark, root).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
    row = technology.detect(files).first()
    assert (row.primary_framework, row.framework_version, row.tools, row.manifests) == (
        "FastAPI", "0.110.1", ["Docker"], ["requirements.txt", "package-lock.json", "dockerfile"])
    assert row.languages[0] == "Python" and row.confidence == 94


def test_known_checksums_are_rejected(spark):
    schema = "upload_id int, project_id int, sha256_checksum string, uploaded_at timestamp"
    at = datetime(2024, 1, 1)
    fresh = spark.createDataFrame([(5, 1, "a", at), (4, 2, "a", at), (6, 3, "b", at)], schema)
    known = spark.createDataFrame([(1, 9, "b", at)], schema)
    assert [r.upload_id for r in relational.accept_uploads(fresh, known).collect()] == [4]


def test_reads_push_filters_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id as project_id", "id % 2 as user_id", "'x' as payload").write.parquet(path)
    frame = relational.read_table(spark, path, ["project_id"], "user_id = 1")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,1)" in plan and "payload" not in plan.split("ReadSchema")[1]
    assert frame.count() == 5


def test_hot_endpoint_is_reported_in_bounded_parts(spark):
    assessments = spark.createDataFrame([("p", 1, "GET", 0, "critical"), ("p", 2, "GET", 100, "info")], "project_id string, endpoint_id int, method string, score int, severity string")
    found = spark.range(5000).selectExpr("'p' as project_id", "1 as endpoint_id", "id as line", "case when id % 2 = 0 then 'low' else 'high' end as severity")
    parts = reports.report_parts(assessments, found, ["project_id", "endpoint_id"], size=500).collect()
    assert sum(len(r.findings or []) for r in parts) == 5000
    assert max(len(r.findings or []) for r in parts) < 700 and {r.parts for r in parts if r.endpoint_id == 1} == {10}
    first = next(r for r in parts if r.endpoint_id == 1).findings
    assert [f.severity for f in first] == sorted((f.severity for f in first), key=["high", "low"].index)
    assert [len(r.findings or []) for r in parts if r.endpoint_id == 2] == [0]


def test_discovery_snapshot_replaces_only_the_projects_it_holds(spark, tmp_path):
    path = str(tmp_path / "endpoints")
    schema = "project_id string, path string"
    reports.replace_discovery(spark.createDataFrame([("a", "/1"), ("a", "/2"), ("b", "/3")], schema), path)
    reports.replace_discovery(spark.createDataFrame([("a", "/9")], schema), path)
    assert sorted((r.project_id, r.path) for r in reports.read_discovery(spark, path).collect()) == [("a", "/9"), ("b", "/3")]


MODULE = '''
@app.get("/items/{item_id}")
def read_item(item_id: int, db):
    return db.get(Item, item_id)

@app.post("/items")
def create(payload: dict = Body(...)):
    return eval(payload)
'''


def test_whole_scan_and_its_reports(spark, tmp_path):
    files = spark.createDataFrame(
        [("1", "a.py", "python", MODULE), ("1", "b.py", "python", "def broken(:\n"), ("2", "c.py", "python", "x = 1\n")],
        "project_id string, relative_path string, language string, content string")
    projects = spark.createDataFrame([(1, "Shop", "FastAPI"), (2, "Plain", None), (3, "Empty", None)], "project_id int, name string, framework string")
    result = scans.scan(files, projects)
    assert sorted((r.method, r.score, r.severity) for r in result.assessments.collect()) == [("GET", 99, "info"), ("POST", 65, "medium")]
    assert {r.rule_id for r in result.source_findings.collect()} == {"CODE-001", "FASTAPI-AUTH-003"}
    assert {r.project_id: (r.endpoint_score, r.source_score, r.overall_score, r.severity) for r in result.scores.collect()} == {
        "1": (82, 50, 66, "medium"), "2": (100, 100, 100, "info"), "3": (100, 100, 100, "info")}
    assert [r.error for r in result.errors.collect()] == ["b.py:1: SyntaxError: invalid syntax"]
    run = {r.analyzer: r for r in result.runs.filter("project_id = '1'").collect()}
    assert run["fastapi-authorization-security"].idor_candidates == 1 and not run["python-ast-security"].successful and run["python-ast-security"].issue_count == 1
    root = str(tmp_path / "out")
    scans.write(result, projects, spark.createDataFrame([(1, 7), (2, 8)], "project_id int, scan_id int"), root, datetime(2024, 5, 1))
    stored_table = lambda name: reports.read_report(spark, f"{root}/reports", name)
    head = stored_table("summary").filter("project_id = '1'").first()
    import json

    report = json.loads(head.report)
    assert report["summary"]["score"] == 66 and report["summary"]["severity_counts"]["critical"] == 2 and report["project"]["name"] == "Shop"
    assert list(report) == sorted(report)
    assert report["scan"] == {"endpoint_count": 2, "error_count": 1, "files_scanned": 2, "id": 7}
    assert report["source_analysis"]["issue_count"] == 2 and len(report["source_analysis"]["analyzers"]) == len(run)
    parts = stored_table("assessments")
    assert parts.filter("project_id = '1' and scan_id = 7").count() == 2 and stored_table("endpoints").count() == 2
    assert {r.rule_id for r in stored_table("source_findings").collect()} == {"CODE-001", "FASTAPI-AUTH-003"} and stored_table("errors").count() == 1
    reports.export_json(spark, f"{root}/reports", "summary", f"{root}/json")
    assert spark.read.json(f"{root}/json").count() == 2
    scans_table = spark.createDataFrame([("1", 7), ("1", 9)], "project_id string, scan_id int")
    stored = parts.select(F.col("project_id").cast("string").alias("project_id"), "scan_id")
    assert {r.scan_id: r.report_available for r in reports.with_report_available(scans_table, stored).collect()} == {7: True, 9: False}
    assert reports.read_discovery(spark, f"{root}/endpoints", 8).count() == 2
