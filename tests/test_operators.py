"""Scores, ranking, findings, endpoint rules, remediation and accounts on small tables, skewed ones included."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W, functions as F

from palisade.catalog import remediation as dims, rules as catalog
from palisade.functions import paths, scoring, text
from palisade.operators import aggregates, endpoint_rules, findings, ranking, relations, remediation, scores


def column(spark, values, schema, build):
    frame = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in frame.select(build(F.col(frame.columns[0]))).collect()]


def test_rounding_of_ties(spark):
    assert column(spark, [2.5, 3.5, 62.5], "x double", scoring.half_even) == [2, 4, 62]
    assert column(spark, [2.5, 3.5, 62.5], "x double", scoring.half_up) == [3, 4, 63]
    assert column(spark, [4.475, 0.125], "x double", lambda x: scoring.half_even_places(x, 2)) == [4.47, 0.12]


def test_bands_and_grades(spark):
    marks = [100, 95, 90, 89, 75, 74, 70, 50, 49, 30, 29, 25, 24, 0]
    assert column(spark, marks, "x int", lambda x: scoring.band(x, "calculator")) == (
        ["info"] * 3 + ["low"] * 2 + ["medium"] * 3 + ["high"] * 4 + ["critical"] * 2)
    assert column(spark, marks, "x int", lambda x: scoring.band(x, "model")) == (
        ["info"] * 3 + ["low"] * 4 + ["medium"] + ["high"] * 2 + ["critical"] * 4)
    assert column(spark, [95, 90, 80, 70, 60, 40, 39], "x int", scoring.grade) == ["A+", "A", "B", "C", "D", "E", "F"]


def test_scores_clamp_and_clean_projects(spark):
    endpoints = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "endpoint_id int, project_id int")
    hits = [(1, "critical", "open")] * 5 + [(2, "info", "resolved")]
    found = spark.createDataFrame(hits, "endpoint_id int, severity string, status string")
    projects = spark.createDataFrame([(1,), (2,), (3,)], "project_id int")
    calculator = scores.endpoint_scores(endpoints, found)
    assert {r.endpoint_id: r.score for r in calculator.collect()} == {1: 0, 2: 99, 3: 100}
    assert {r.endpoint_id: r.score for r in scores.endpoint_scores(endpoints, found, "model").collect()} == {1: 0, 2: 100, 3: 100}
    assert {r.project_id: r.score for r in scores.project_scores(calculator, projects).collect()} == {1: 50, 2: 100, 3: 100}
    model = {r.project_id: r.score for r in scores.project_model_scores(endpoints, found).collect()}
    assert model == {1: 20, 2: 100}


def test_portfolio_score_ignores_projects_without_one(spark):
    rows = spark.createDataFrame([(1, 50), (1, None), (1, 51)], "user_id int, score int")
    assert scores.portfolio_scores(rows, ["user_id"]).first().security_score == 51


def hot_rows(n=3000):
    """A third of all rows belongs to key 0; times collide."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    return [(0 if i % 3 == 0 else rng.randrange(1, 40), start + timedelta(minutes=rng.randrange(0, 60 * 24 * 70)), i) for i in range(n)]


@pytest.mark.parametrize("newest_first", [False, True])
def test_numbering_in_slices_equals_a_plain_window(spark, newest_first):
    frame = spark.createDataFrame(hot_rows(), "project_id int, created_at timestamp, scan_id int")
    order = [F.desc("created_at"), F.desc("scan_id")] if newest_first else [F.asc("created_at"), F.asc("scan_id")]
    sliced = ranking.numbered(frame, ["project_id"], order, "no", "total")
    plain = frame.withColumn("no", F.row_number().over(W.partitionBy("project_id").orderBy(*order)).cast("bigint")).withColumn(
        "total", F.count("*").over(W.partitionBy("project_id")))
    columns = ["project_id", "scan_id", "no", "total"]
    assert sorted(sliced.select(columns).collect()) == sorted(plain.select(columns).collect())


def test_one_key_on_one_day_keeps_several_tasks_busy(spark):
    start = datetime(2024, 1, 1)
    frame = spark.createDataFrame([(1, start + timedelta(seconds=i % 9000), i) for i in range(20_000)], "project_id int, created_at timestamp, scan_id int")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # these rows are few enough for one task
    try:
        cut = ranking.ranges(frame, ["project_id"], [F.desc("created_at"), F.desc("scan_id")]).groupBy("_slice").count().collect()
    finally:
        spark.conf.set(key, "true")
    assert len(cut) > 1 and max(r["count"] for r in cut) < 0.6 * 20_000


def test_next_time_in_slices_equals_lead(spark):
    frame = spark.createDataFrame(hot_rows(), "user_id int, created_at timestamp, token_id int")
    sliced = ranking.with_next(frame, ["user_id"], "created_at", "token_id", "next_at").select("token_id", "next_at").collect()
    plain = frame.select("token_id", F.lead("created_at").over(W.partitionBy("user_id").orderBy("created_at", "token_id")).alias("next_at")).collect()
    assert sorted(sliced, key=lambda r: r[0]) == sorted(plain, key=lambda r: r[0])


def test_first_per_keeps_every_key_of_a_hot_table(spark):
    frame = spark.createDataFrame(hot_rows(), "k int, at timestamp, n int")
    kept = ranking.first_per(frame, ["k"], [F.asc("n")]).collect()
    expected = {}
    for k, _, n in hot_rows():
        expected.setdefault(k, n)
    assert {r.k: r.n for r in kept} == expected


def test_normalising_folds_text_and_keeps_the_first(spark):
    rows = [(1, "a-1", "high", "Big  Straße", "d", 2), (1, "A-1 ", "HIGH", " big strasse\n", "d", 1), (1, "a-1", "low", "big strasse", "d", 3), (2, "a-1", "high", "big strasse", "d", 4)]
    frame = spark.createDataFrame(rows, "endpoint_id int, rule_id string, severity string, title string, description string, seq int")
    assert sorted(r.seq for r in findings.normalise(frame).collect()) == [1, 3, 4]


def test_enrichment_fills_only_what_is_missing(spark):
    rows = [("auth-001", "", "d", " ", None, None), ("AUTH-002", "own", "d", "r", "API0", ""), ("X-1", "", "", "", None, None)]
    frame = spark.createDataFrame(rows, "rule_id string, title string, description string, remediation string, owasp_reference string, cwe_id string")
    got = {r.rule_id: r for r in findings.enrich(frame, catalog.knowledge(spark)).collect()}
    assert got["auth-001"].title == "Missing Authentication" and got["auth-001"].cwe_id == "CWE-306"
    assert got["AUTH-002"].title == "own" and got["AUTH-002"].owasp_reference == "API0" and got["AUTH-002"].cwe_id == "CWE-285"
    assert got["X-1"].title == "" and got["X-1"].knowledge is None
    assert catalog.duplicate_rule_ids(catalog.knowledge(spark)).count() == 0


def test_merge_missing_keeps_existing_keys(spark):
    frame = spark.createDataFrame([({"a": "1"}, {"a": "2", "b": "3"})], "x map<string,string>, y map<string,string>")
    assert frame.select(findings.merge_missing(F.col("x"), F.col("y"))).first()[0] == {"a": "1", "b": "3"}


def test_constraint_checks_name_what_is_wrong(spark):
    rows = [("R", "t", "d", "c", "r", "f", 1, 1), ("", "t", "d", "c", "r", " ", 0, 0), ("R", "t", "d", "c", "r", "f", 5, 4)]
    frame = spark.createDataFrame(rows, "rule_id string, title string, description string, category string, remediation string, file_path string, line_start int, line_end int")
    got = [r.violations for r in findings.check_constraints(frame).orderBy("line_start").collect()]
    assert got == [["rule_id is blank", "file_path is blank", "line_start is below one", "line_end is below one"], [], ["line_end is before line_start"]]


def test_finding_changes_between_scans(spark):
    schema = "project_id int, fingerprint string"
    old = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], schema)
    new = spark.createDataFrame([(1, "b"), (1, "c"), (1, "c")], schema)
    assert {(r.fingerprint, r.change) for r in relations.finding_changes(old, new, ["project_id", "fingerprint"]).collect()} == {
        ("a", "resolved"), ("b", "persisting"), ("c", "new")}


def test_path_forms(spark):
    rows = [("/api/", "/users/"), ("api", ""), ("", "users"), ("", ""), (" /a// ", "//b///c/ "), ("/a", "/")]
    frame = spark.createDataFrame(rows, "p string, t string")
    joined, canonical, loose = zip(*frame.select(paths.join_paths(F.col("p"), F.col("t")), paths.canonical_path(F.col("p"), F.col("t")), paths.loose_path(F.col("p"), F.col("t"))).collect())
    assert joined == ("/api/users/", "/api/", "/users", "/", "/a//b///c/", "/a/")
    assert canonical == ("/api/users", "/api", "/users", "/", "/a/b/c", "/a")
    assert loose[:4] == ("/api/users/", "api", "/users", "/")


def test_names_and_secrets(spark):
    assert column(spark, ["APIKey", "clientSecret", "JWTSecretV2", "__x-y.z__"], "x string", text.snake_name) == ["api_key", "client_secret", "jwt_secret_v2", "x_y_z"]
    assert column(spark, ["aaaa", "abcd", "", "aabb"], "x string", text.entropy) == [0.0, 2.0, 0.0, 1.0]
    assert column(spark, ["abcdefgh", "sk-12345678", "${SOME_LONG_SECRET_NAME}", "https://token.example.com/", "postgres://aaaaaaaaaaaaaaaa", "opaque-value-1234567"], "x string", text.is_probable_secret) == [
        False, True, False, False, False, True]
    assert column(spark, ["k = 'v'", "k = rb\"v\"", "call()", ""], "x string", text.redact) == ["k = '[REDACTED]'", 'k = rb"[REDACTED]"', "[REDACTED]", ""]
    assert column(spark, ["a.PY", ".env", "x.tar.gz", "noext", "dot."], "x string", text.extension_of) == [".py", "", ".gz", "", ""]
    assert column(spark, ["Fast-API", " fast_api ", "a.b/c\\d"], "x string", text.framework_key) == ["fast api", "fast api", "a b c d"]
    assert column(spark, ["/a/{x}/{y_1:path}/{x}"], "x string", text.path_parameters) == [["x", "y_1"]]


def test_type_validation(spark):
    kinds = {"Optional[UserModel]": True, "typing.Optional[str]": False, "list[dict[str, UserInput]]": True, "app.schemas.UserCreate": True, "int | None": False, "Annotated[str, X]": True, "Widget": False, "": False}
    assert column(spark, list(kinds), "x string", endpoint_rules.is_validated_type) == list(kinds.values())


def endpoint_rows(spark):
    schema = ("endpoint_id int, method string, path string, router_prefix string, authentication_required boolean, permission_required boolean, security_schemes array<string>, "
              "security_scopes array<string>, parameters array<struct<name:string,location:string,python_type:string>>")
    return spark.createDataFrame([
        (1, "get", "/x", "", False, False, [], [], []), (2, "POST", "/x/", "/a", False, False, [], [], []), (3, "GET", "/HEALTH/db", "", False, False, [], [], []),
        (4, "DELETE", "/x", "", True, False, [], [], []), (5, "DELETE", "/x", "", True, False, [], ["write"], []), (6, "GET", "/healthy", "", False, True, [], [], []),
        (7, "POST", "/f", "", True, True, [], [], [("f", "form", "bytes"), ("b", "body", "Dict[str, Any]"), ("q", "query", "str")]),
    ], schema)


def test_endpoint_rules(spark):
    found, assessed = endpoint_rules.assess(endpoint_rows(spark), ["endpoint_id"])
    got = {}
    for r in found.collect():
        got.setdefault(r.endpoint_id, []).append((r.rule_id, r.severity))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [("AUTH-001", "info")], 2: [("AUTH-001", "high")], 4: [("AUTH-002", "high")], 6: [("AUTH-001", "info")], 7: [("FILE-001", "high"), ("VAL-001", "medium")]}
    assert {r.endpoint_id: (r.score, r.path) for r in assessed.collect()} == {
        1: (99, "/x"), 2: (75, "/a/x"), 3: (100, "/HEALTH/db"), 4: (75, "/x"), 5: (100, "/x"), 6: (99, "/healthy"), 7: (65, "/f")}


def test_an_added_endpoint_analyzer_joins_the_score(spark):
    def no_delete(endpoints):
        return endpoints.filter("method = 'DELETE'").select(
            "endpoint_id", F.lit("TEAM-1").alias("rule_id"), F.lit("No deletes").alias("title"), F.lit("d").alias("description"), F.lit("r").alias("remediation"),
            F.lit("low").alias("severity"), F.lit(None).cast("string").alias("owasp_reference"), F.lit(None).cast("string").alias("cwe_id"))

    found, assessed = endpoint_rules.assess(endpoint_rows(spark), ["endpoint_id"], extra=(no_delete,))
    assert {r.endpoint_id for r in found.filter("rule_id = 'TEAM-1'").collect()} == {4, 5}
    assert {r.endpoint_id: r.score for r in assessed.collect()}[4] == 70


def test_remediation_merge_and_adapter_choice(spark):
    rows = [("AUTH-001", "get", "/x", "FastAPI", None), ("auth-001", None, None, None, "Python"), ("AUTH-001", "get", "/x", "Django", "Python"), ("VAL-001", "get", "/x", "fast.api", "x"), ("NONE-1", "g", "/", "fastapi", "x")]
    frame = spark.createDataFrame(rows, "rule_id string, method string, path string, framework string, language string")
    got = {(r.rule_id, r.framework): r for r in remediation.remediate(frame, dims.guidance(spark), dims.adapters(spark), dims.patches(spark)).collect()}
    assert len(got) == 4
    assert got[("AUTH-001", "FastAPI")].framework_remediation.endpoint == "GET /x" and len(got[("AUTH-001", "FastAPI")].guidance.implementation_steps) == 6
    assert got[("auth-001", None)].customized and got[("auth-001", None)].framework_remediation.endpoint is None
    plain = got[("AUTH-001", "Django")]
    assert not plain.customized and plain.framework_remediation is None and len(plain.guidance.implementation_steps) == 4
    assert plain.estimated_time == "30–90 minutes" and plain.guidance.metadata == {"recommended_http_status": "401", "control_type": "preventive"}


def test_merging_a_patch_twice_changes_nothing(spark):
    example = "struct<framework:string,language:string,title:string>"
    frame = spark.createDataFrame([(["a ", "b"], [" a", "c", "c "], [("F", "P", "T")], [("f", "p", "t"), ("f", "p", "u")])],
                                  f"base array<string>, added array<string>, e array<{example}>, f array<{example}>")
    steps = remediation.merge_steps(F.col("base"), F.col("added"))
    once = frame.select(steps.alias("base"), "added", remediation.merge_examples(F.col("e"), F.col("f")).alias("e"), "f")
    twice = once.select(remediation.merge_steps(F.col("base"), F.col("added")).alias("base"), remediation.merge_examples(F.col("e"), F.col("f")).alias("e")).first()
    assert once.first().base == twice.base == ["a ", "b", "c"]
    assert [x.title for x in once.first().e] == [x.title for x in twice.e] == ["T", "u"]


def test_time_labels(spark):
    frame = spark.createDataFrame([(5, 5), (5, 9), (5, None), (None, 9), (None, None)], "a int, b int")
    assert [r[0] for r in frame.select(remediation.estimated_time(F.col("a"), F.col("b"))).collect()] == ["5 minutes", "5–9 minutes", "At least 5 minutes", "Up to 9 minutes", None]


def test_top_rules_break_ties_by_name(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 3)], "project_id int, rule_id string, finding_count int")
    assert [r.rule_id for r in aggregates.top_rules_per_project(rows, 2).orderBy("position").collect()] == ["c", "a"]


@pytest.mark.parametrize("text, version", [
    ("<project><spring-boot.version> 3.1\n</spring-boot.version></project>\n", "3.1"),
    ('<project xmlns="urn:a" xmlns:m="u"><m:spring-boot.version>3.2</m:spring-boot.version></project>', "3.2"),
    ("<project><!-- <spring-boot.version>1</spring-boot.version> --><spring-boot.version>2.<!-- x -->5</spring-boot.version></project><!-- end -->", "2.5"),
    ("<project><spring-boot.version><![CDATA[3.3]]></spring-boot.version><x><![CDATA[<spring-boot.version>9</spring-boot.version>]]></x></project>", "3.3"),
    ("<a><spring-boot.version>1</spring-boot.version><spring-boot.version>2</spring-boot.version></a>", "2"),
    ("<project><a></b><spring-boot.version>3</spring-boot.version></project>", None), ("<project><a>x & y</a><spring-boot.version>3</spring-boot.version></project>", None),
    ("<project><spring-boot.version>3</spring-boot.version></project> junk", None), ("<project><spring-boot.version>3</spring-boot.version>", None), ("", None), ("spring-boot", None)])
def test_versions_of_well_formed_xml(spark, text, version):
    from palisade.functions.text import strip
    from palisade.operators.technology import xml_version

    assert spark.createDataFrame([(text,)], "c string").select(strip(xml_version(F.col("c")))).first()[0] == version
