"""File inventory, source loading and technology detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators import aggregates, facts, inventory as inv, source_rules, technology
from palisade.plans.catalogue import register, twin
from palisade.plans.registered.code import EXPECTED_SCRIPT_FINDINGS, SCRIPT_ROWS, values
from palisade.sources import modules, trees

# Expected inventory of the document paths: source number, language by name, file name rule.
PATH_ROWS = (
    (0, "app/main_{d}.py", "Python", True, "python"), (1, "web/View{d}.TSX", "TypeScript", True, None),
    (2, "Dockerfile", "Dockerfile", False, None), (3, "makefile", "Makefile", False, None), (4, ".env.local", "Environment", False, None),
    (5, "docs/readme_{d}.md", None, False, None), (6, "node_modules/a/b_{d}.js", "JavaScript", True, "javascript"),
    (7, "package.json", "Node.js Manifest", False, None), (8, "src/a_{d}.go", "Go", True, None), (9, "src/util_{d}.hpp", "C++ Header", True, None),
    (10, "conf/app_{d}.yml", "YAML", False, None), (11, "LICENSE", None, False, None), (12, "package-lock.json", "JSON", False, None),
    (13, "a/b/c_{d}.java", "Java", True, "java"), (14, "build/x_{d}.py", "Python", True, "python"), (15, "migrations/m_{d}.py", "Python", True, "python"),
    (16, "GEMFILE", "Ruby", True, None), (17, "notes.", None, False, None), (18, "src/lib_{d}.rs", "Rust", True, None), (19, "web/page_{d}.html", "HTML", False, None),
)
TREE = f"""select d.doc_id, d.lang as project_id, 'd/' || cast(d.doc_id as varchar) || '/' || replace(p.path, '{{d}}', cast(d.doc_id as varchar)) as relative_path,
  p.k, p.language, p.is_code, p.analysis, coalesce(l.quality, 1) as quality, coalesce(l.toxic, 0) as toxic,
  case when l.quality = 0 then 'a' || chr(0) || d.text when l.toxic = 1 then repeat(chr(1) || chr(2), 3000) || d.text else d.text end as body
from documents d left join labels l on l.doc_id = d.doc_id join {values(PATH_ROWS, 'p(k, path, language, is_code, analysis)')} on p.k = cast(substr(d.source, 4) as int)"""
# Ignored: node_modules (6) and build (14). The lock file (12) is skipped by name. A toxic document has 6000 control bytes in front,
# which makes it binary if they are over 30 % of it.
INVENTORY = """select project_id, relative_path, k, is_code, strlen(body) as size_bytes, body, language,
  case when k = 12 then 'ignored_filename' when language is null then 'unsupported_file_type'
    when quality = 0 or (toxic = 1 and 6000 / strlen(body) > 0.3) then 'binary_file' end as skip_reason from tree where k not in (6, 14)"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.inventory(trees.document_tree(spark, sf_dir))


@register("file_inventory", "SRC-2 SRC-3 SRC-4 SRC-5 SRC-6 SRC-7 SRC-8", twin(
    r"""select project_id, relative_path, case when skip_reason is null then language end as language, size_bytes, skip_reason,
  skip_reason is null and is_code as is_source_code, case when skip_reason is null then sha256(body) end as sha256,
  cast(case when skip_reason is null then len(regexp_extract_all(body, '\r\n|\r|\n')) + case when body <> '' and right(body, 1) not in (chr(10), chr(13)) then 1 else 0 end end as int) as line_count
from inventory""", tree=TREE, inventory=INVENTORY))
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).select(
        "project_id", "relative_path", "language", "size_bytes", "skip_reason", "is_source_code", "sha256", "line_count")


@register("inventory_totals", "SRC-1 SRC-9", twin(
    """select project_id, cast(count(*) filter (where skip_reason is null) as bigint) as total_files,
  cast(count(*) filter (where skip_reason is null and is_code) as bigint) as source_file_count, cast(count(*) filter (where skip_reason is not null) as bigint) as skipped_file_count,
  cast(coalesce(sum(case when skip_reason is null then size_bytes end), 0) as bigint) as total_size_bytes,
  cast(count(distinct regexp_replace(relative_path, '/?[^/]*$', '')) as bigint) as visited_directories from inventory group by project_id""", tree=TREE, inventory=INVENTORY))
def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.inventory_totals(_inventory(spark, sf_dir))


@register("inventory_languages", "AGG-12 SRC-4", twin(
    """select language, cast(count(*) as bigint) as file_count, cast(row_number() over (order by count(*) desc, lower(language)) as int) as position
from inventory where skip_reason is null group by language""", tree=TREE, inventory=INVENTORY))
def inventory_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.language_counts(_inventory(spark, sf_dir).filter("skip_reason is null"))


# Excluded for the analysis: node_modules (6), build (14), migrations (15). NUL bytes skip a file; other control bytes do not.
ANALYSIS = """select project_id, relative_path, analysis as language, strlen(body) as size_bytes,
  case when k in (6, 14, 15) or contains(body, chr(0)) then 'skipped' else 'loaded' end as load_status, body from tree where analysis is not null"""


@register("analysis_files", "SRC-10", twin(
    "select project_id, relative_path, language, size_bytes, load_status, case when load_status = 'loaded' then sha256(body) end as sha256 from analysis",
    tree=TREE, analysis=ANALYSIS))
def analysis_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.analysis_files(trees.document_tree(spark, sf_dir)).select("project_id", "relative_path", "language", "size_bytes", "load_status", "sha256")


@register("source_run_totals", "AGG-7 SRC-10", twin(
    f"""select s.project_id, cast(count(distinct s.relative_path) filter (where s.k not in (12, 25)) as bigint) as files_scanned,
  cast(count(distinct s.relative_path) filter (where s.k = 12) as bigint) as skipped_file_count, cast(count(distinct s.relative_path) filter (where s.k = 25) as bigint) as error_count,
  cast(count(e.rule_id) as bigint) as issue_count
from scripts s left join {values(EXPECTED_SCRIPT_FINDINGS, 'e(k, rule_id, line_start, column_start, function_name, class_name, evidence)')} on e.k = s.k
group by s.project_id""", scripts=SCRIPT_ROWS))
def source_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts as files: one text gets a NUL byte and is skipped, another a byte that is no UTF-8 and is an error; issues come from the rules."""
    content, text = F.encode("content", "utf-8"), F.col("content")
    body = F.when(text.contains("api.example.com/health"), F.concat(content, F.lit(b"\x00"))).when(text.startswith("# only text"), F.concat(F.lit(b"\xff"), content)).otherwise(content)
    scripts = modules.scripts(spark, sf_dir).select("project_id", "relative_path", body.alias("content"))
    files = inv.analysis_files(scripts.withColumn("size_bytes", F.octet_length("content").cast("bigint")))
    issues = source_rules.source_findings(facts.code_facts(files.filter("load_status = 'loaded'")))
    return aggregates.source_run_totals(files, issues.select("project_id"))


# Expected detection: kind, language, languages, frameworks, framework, version, tools, manifests, confidence.
EXPECTED_TECHNOLOGY = (
    (0, "Python", "Python", "FastAPI,Flask", "FastAPI", "0.{n}.1", "", "requirements.txt", 84),
    (1, "TypeScript", "TypeScript,JavaScript", "Next.js,Express,React", "Next.js", "13", "", "package.json", 84),
    (2, "Java", "Java", "Spring Boot", "Spring Boot", "3.{n}", "", "pom.xml", 84),
    (3, "Kotlin", "Kotlin", "Spring Boot", "Spring Boot", "2.{n}", "", "build.gradle.kts", 84),
    (4, "PHP", "PHP", "Laravel", "Laravel", "10.{n}", "Docker", "composer.json,dockerfile,docker-compose.yml", 94),
    (5, "C#", "C#", "ASP.NET Core", "ASP.NET Core", "net8.{n}", "", "", 80),
    (6, "Dart", "Dart", "Flutter", "Flutter", ">=3.{n}.0", "", "pubspec.yaml", 84),
    (7, None, "", "", None, None, "Kubernetes,Terraform,GitHub Actions,Jenkins,OpenAPI,Postman Collection", "", 8),
    (8, "C", "C,Python", "Flask", "Flask", None, "", "", 80),
    (9, "Go", "Go,Rust,Ruby,C++", "", None, None, "", "go.mod,cargo.toml", 43),
    (10, "Python", "Python", "Starlette,Django", "Django", None, "", "pyproject.toml,pipfile", 88),
    (11, None, "", "", None, None, "", "", 0),
    (12, "Java", "Java", "Spring Boot", "Spring Boot", None, "", "pom.xml", 84),
    (13, "Java", "Java", "Spring Boot", "Spring Boot", "4.{n}", "", "pom.xml", 84),
    (14, "Java", "Java", "Spring Boot", "Spring Boot", "5.{n}", "", "pom.xml", 84),
    (15, "Java", "Java", "Spring Boot", "Spring Boot", None, "", "pom.xml", 84),
    (16, "Java", "Java", "Spring Boot", "Spring Boot", None, "", "pom.xml", 84),
)


@register("technology_detection", "TEC-1 TEC-2 TEC-3 TEC-4 TEC-5 TEC-6 TEC-7 TEC-8 TEC-9 TEC-10 TEC-11 TEC-12 TEC-13 TEC-14", twin(
    f"""select cast(c.c_custkey as varchar) as project_id, e.language as primary_language, e.languages, e.frameworks, e.framework as primary_framework,
  replace(e.version, '{{n}}', cast(c.c_custkey as varchar)) as framework_version, e.tools, e.manifests, cast(e.confidence as int) as confidence
from customer c join {values(EXPECTED_TECHNOLOGY, 'e(k, language, languages, frameworks, framework, version, tools, manifests, confidence)')} on e.k = c.c_nationkey % 17"""))
def technology_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = technology.detect(trees.project_files(spark, sf_dir))
    joined = {name: F.array_join(name, ",") for name in ("languages", "frameworks", "tools", "manifests")}
    return found.withColumns(joined)
