"""Analyzers of the user as table functions, and documents stored as VARIANT."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from palisade.operators import analyzers as an, facts
from palisade.sources import documents


class Faulty(an.SourceAnalyzer):
    """Fails at the second call of a file."""

    name = "faulty"
    reads = {"callee": "call.callee"}
    adds = "callee string"
    rules = (("BAD-001", "t", "d", "c", "low", "low", "r", None, None),)

    def __init__(self, **options):
        super().__init__(**options)
        self.calls = 0

    def fact(self, row):
        if row["kind"] == "call":
            self.calls += 1
            if self.calls == 2:
                raise RuntimeError("second call")
            yield an.Hit("BAD-001", row, (row["callee"],))

    def finish(self):
        raise AssertionError("not reached after a failure")


FILES = "project_id string, relative_path string, language string, content string"


@pytest.fixture()
def known(make):
    rows = [
        ("p", "a.py", "python", "x = load()\nx = clean(x)\nstore(x)\nx = 1\nstore(x)\n"),
        ("p", "b.py", "python", "def f():\n    y = load()\n    return y\n\ndef g(y):\n    store(y)\n"),
        ("p", "c.py", "python", "broken(:\n"), ("p", "d.py", "python", None), ("q", "a.py", "python", "a = b(\n    c())\nd(a)\n"),
    ]
    return facts.code_facts(make(rows, FILES))


def test_state_follows_the_facts_of_one_file(known):
    found = an.table_function(an.ValueFlow)(known.asTable()).select("project_id", "relative_path", "line_start", "variable", "source", "lines").collect()
    assert sorted(map(tuple, found)) == [("p", "a.py", 2, "x", "load", 1), ("p", "a.py", 3, "x", "clean", 1), ("q", "a.py", 3, "a", "b", 2)]


def test_both_forms_find_the_same(spark, known, make):
    an.register_functions(spark)
    known.createOrReplaceTempView("known_facts")
    over = spark.sql("select line_start, variable from value_flow(table(known_facts), sources => 'load')").collect()
    text = make([("x = load()\nx = clean(x)\nstore(x)\n",), (None,)], "content string")
    lateral = spark.sql("select a.line_start, a.variable from {t} t, lateral value_flow_of(t.content, sources => 'load') a", t=text).collect()
    assert [tuple(r) for r in over] == [(2, "x")] == [tuple(r) for r in lateral]


def test_failure_ends_one_file_and_keeps_what_was_found(known):
    rows = an.table_function(Faulty)(known.asTable()).select("project_id", "relative_path", "callee", "error").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    assert by_file[("p", "a.py")] == [("load", None), (None, "faulty: RuntimeError: second call")]
    assert by_file[("q", "a.py")][-1][1].startswith("faulty: ")


def test_function_names_its_own_columns_and_order(known):
    plan = an.table_function(an.ValueFlow)(known.asTable())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Sort [" in plan
    moved = plan[plan.index("Sort [") :].partition("MapInArrow")[0]
    assert "call#" in moved and "names" in moved and "function#" not in moved and "router#" not in moved


@pytest.mark.parametrize("call", [
    "value_flow(table(select 1 as a))", "value_flow(table(known_facts), nothing => 1)", "value_flow('text')", "value_flow_of(table(known_facts))"])
def test_wrong_calls_are_refused_before_they_run(spark, known, call):
    an.register_functions(spark)
    known.createOrReplaceTempView("known_facts")
    with pytest.raises(AnalysisException):
        spark.sql(f"select * from {call}").schema  # noqa: B018


def test_names_are_registered_once():
    class Again(an.SourceAnalyzer):
        name = " value flow "

    class Nameless(an.SourceAnalyzer):
        name = " "

    for wrong in (Again, Nameless):
        with pytest.raises(ValueError):
            an.register_analyzer(wrong)
    before = an.ANALYZERS["value-flow"]
    try:
        assert an.register_analyzer(Again, replace=True) is an.ANALYZERS["value-flow"]
    finally:
        an.ANALYZERS["value-flow"] = before
    assert [an.key_of(a.name) for a in an.in_order()] == ["value-flow", "module-calls"]


def test_frameworks_and_languages_choose_projects(known, make):
    projects = make([("p", " fastapi "), ("q", None)], "project_id string, framework string")
    taken = an.accepted(known, projects, an.ModuleCalls).select("project_id").distinct().collect()
    assert [r[0] for r in taken] == ["p"]
    assert an.accepted(known, projects, an.ModuleCalls, "java").count() == 0
    assert an.accepted(known, projects, an.ValueFlow).count() == known.count()


# --- Documents as VARIANT. ---


def test_times_in_documents(make):
    texts = ['"2024-01-02T03:04:05Z"', "1704164645000", "0", '""', "false", "null", '"soon"', '{"a": 1}', "true", '"0"']
    rows = make([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", documents.time_of(F.parse_json("t")).alias("at")).orderBy("i").collect()
    assert [r[1] for r in rows] == [datetime(2024, 1, 2, 3, 4, 5)] * 2 + [None] * 8


def test_summary_is_looked_for_in_order(make):
    texts = ['{"summary": {"score": 1}, "data": {"summary": {"score": 2}}}', '{"report": {"summary": {"score": 3}}, "data": {"summary": {"score": 2}}}',
             '{"summary": [], "data": {"summary": {"score": 2}}}', "[]", "nonsense", None, '{"summary": {"score": "x"}}']
    rows = make([(i, t) for i, t in enumerate(texts)], "i int, t string")
    score = F.try_variant_get(documents.summary(F.try_parse_json("t")), "$.score", "bigint")
    assert [r[1] for r in rows.select("i", score).orderBy("i").collect()] == [1, 3, 2, None, None, None, None]


def test_documents_are_stored_parsed(spark, make, tmp_path):
    path = str(tmp_path / "documents")
    documents.write_documents(make([(1, '{"a": [1, {"b": "c"}]}'), (2, "{"), (3, None)], "id int, payload string"), path)
    back = documents.read_documents(spark, path)
    assert dict(back.dtypes)["payload"] == "variant"
    assert [tuple(r) for r in back.select("id", F.to_json("payload")).orderBy("id").collect()] == [(1, '{"a":[1,{"b":"c"}]}'), (2, None), (3, None)]
