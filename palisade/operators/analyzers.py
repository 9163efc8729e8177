"""Analyzers of the user: classes that see the facts of one file in order, as table functions of Spark.

A rule (``source_rules.register_rule``) is a column over one fact. An analyzer keeps state from fact to fact of a file, which no column over one
fact can, and is called from SQL or DataFrames in either form:

    select * from value_flow(table(facts))                                       -- facts of many files; the analyzer names its own partitioning
    select f.relative_path, a.* from files f, lateral value_flow_of(f.content)   -- one file a row, parsed on the way

The function tells Spark, before it runs, which columns it reads, that a file's facts come together and in what order, and what it returns: the
columns of every hit and those the analyzer adds. Nothing else is moved to Python, and one object holds the state of one file at a time.

Defined cases: an analyzer that fails ends its work on that file with a row that has only ``error``, and the hits before it stay; a file that cannot
be parsed has no facts; a null text is an empty file; an option that is not known, or is not a constant, is refused when the query is analysed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn
from pyspark.sql.types import StructType

from palisade.functions import text
from palisade.operators.facts import rows_of
from palisade.operators.findings import dedupe_source, source_fingerprint
from palisade.session import dimension

GRAIN = ("project_id", "relative_path")
HIT = "rule_id string, line_start int, line_end int, column_start int, column_end int, function_name string, class_name string, evidence string"
RULE_FIELDS = ("rule_id", "title", "description", "category", "severity", "confidence", "remediation", "cwe_id", "owasp_reference")


@dataclass(frozen=True)
class Hit:
    """``fact`` is the row of the fact that is hit; ``more`` fills the columns that the analyzer adds."""

    rule_id: str
    fact: Row
    more: tuple = ()


class SourceAnalyzer:
    """One object for each file: ``fact`` is called for its facts in order, then ``finish`` once. ``options`` are constants of the call."""

    name: str = ""
    languages: tuple[str, ...] = ()
    frameworks: tuple[str, ...] = ()
    priority: int = 0
    reads: dict[str, str] = {}  # column of a fact by the name it has in the row, besides the place of the fact
    adds: str = ""  # columns of a hit besides those of ``HIT``
    defaults: dict[str, object] = {}  # options
    rules: tuple[tuple, ...] = ()  # as in ``RULE_FIELDS``

    def __init__(self, **options) -> None:
        self.options = {**self.defaults, **options}

    def fact(self, row: Row) -> Iterable[Hit]:
        return ()

    def finish(self) -> Iterable[Hit]:
        return ()


# --- The registry. ---

ANALYZERS: dict[str, type[SourceAnalyzer]] = {}


def key_of(name: str) -> str:
    """Names that differ by case, blanks around them, or by ``_``, ``-`` and blank inside are one."""
    return name.strip().lower().replace("_", "-").replace(" ", "-")


def register_analyzer(analyzer: type[SourceAnalyzer], replace: bool = False) -> type[SourceAnalyzer]:
    """Add an analyzer; works as a decorator. A name can be registered once unless ``replace`` is set."""
    key = key_of(analyzer.name)
    if not key:
        raise ValueError("an analyzer needs a name")
    if key in ANALYZERS and not replace:
        raise ValueError(f"analyzer registered twice: {key}")
    ANALYZERS[key] = analyzer
    return analyzer


def in_order() -> list[type[SourceAnalyzer]]:
    """Analyzers in running order: priority, then name, both descending."""
    return sorted(ANALYZERS.values(), key=lambda a: (a.priority, a.name), reverse=True)


# --- An analyzer as a table function. ---

_PLACE = ("line_start", "line_end", "column_start", "column_end")
_FIXED = {
    "project_id": "project_id", "relative_path": "relative_path", "seq": "seq", "kind": "kind", **{p: f"place.{p}" for p in _PLACE},
    "function_name": "function_name", "class_name": "class_name", "evidence": "evidence",
}


def _schema(analyzer: type[SourceAnalyzer], *keys: str) -> StructType:
    parts = [f"{k} string" for k in keys] + [HIT, *([analyzer.adds] if analyzer.adds else []), "error string"]
    return StructType.fromDDL(", ".join(parts))


def _values(analyzer: type[SourceAnalyzer], hits: Callable[[], Iterable[Hit]], width: int) -> Iterator[tuple]:
    """Hits as tuples of the schema without its keys; a failure of the analyzer is the last of them."""
    try:
        for hit in hits():
            at = hit.fact
            place = tuple(at[p] for p in _PLACE)
            yield (hit.rule_id, *place, at["function_name"], at["class_name"], at["evidence"], *hit.more, None)
    except Exception as problem:  # noqa: BLE001 - the code is the user's
        yield (*([None] * (width - 1)), f"{analyzer.name}: {type(problem).__name__}: {problem}")


def _options(analyzer: type[SourceAnalyzer], given: dict[str, AnalyzeArgument]) -> None:
    for name, argument in given.items():
        if name not in analyzer.defaults:
            raise ValueError(f"{analyzer.name} has no option {name}")
        if not argument.isConstantExpression:
            raise ValueError(f"option {name} of {analyzer.name} must be a constant")


def table_function(analyzer: type[SourceAnalyzer]):
    """The analyzer as a function of a table of facts. It asks for the facts of a file together and in order, and for its own columns only."""
    columns = {**_FIXED, **analyzer.reads}
    schema = _schema(analyzer, *GRAIN)
    width = len(schema) - len(GRAIN)

    class OverFacts:
        @staticmethod
        def analyze(facts: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if not facts.isTable:
                raise ValueError(f"{analyzer.name} takes a table of facts")
            missing = sorted({c.partition(".")[0] for c in columns.values()} - set(facts.dataType.names))
            if missing:
                raise ValueError(f"{analyzer.name} reads columns that are not there: {', '.join(missing)}")
            _options(analyzer, options)
            return AnalyzeResult(
                schema=schema, partitionBy=[PartitioningColumn(k) for k in GRAIN], orderBy=[OrderingColumn("seq")],
                select=[SelectedColumn(path, alias=name) for name, path in columns.items()])

        def __init__(self) -> None:
            self.state, self.at, self.options, self.failed = None, None, {}, False

        def eval(self, facts: Row, **options):
            if self.at is None:
                self.at, self.options = (facts["project_id"], facts["relative_path"]), options
            if not self.failed:
                yield from self.told(lambda: self.of_file().fact(facts))

        def terminate(self):
            if self.at is not None and not self.failed:
                yield from self.told(lambda: self.of_file().finish())

        def of_file(self):
            if self.state is None:
                self.state = analyzer(**self.options)
            return self.state

        def told(self, hits):
            for row in _values(analyzer, hits, width):
                self.failed = row[-1] is not None
                yield (*self.at, *row)

    return F.udtf(OverFacts)


def _get(fact: dict, path: str):
    for part in path.split("."):
        fact = None if fact is None else fact.get(part)
    return fact


def file_function(analyzer: type[SourceAnalyzer]):
    """The analyzer as a function of one text, for lateral joins with the table the text stands in."""
    columns = {**_FIXED, **analyzer.reads}
    schema = _schema(analyzer)
    width = len(schema)

    def hits(content: str | None, options: dict) -> Iterator[Hit]:
        state, row_of = analyzer(**options), Row(*columns)
        for fact in rows_of(None, None, content or ""):
            yield from state.fact(row_of(*(_get(fact, path) for path in columns.values())))
        yield from state.finish()

    class OverText:
        @staticmethod
        def analyze(content: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if content.isTable:
                raise ValueError(f"{analyzer.name} takes a text here")
            _options(analyzer, options)
            return AnalyzeResult(schema=schema)

        def eval(self, content, **options):
            yield from _values(analyzer, lambda: hits(content, options), width)

    return F.udtf(OverText)


def register_functions(spark: SparkSession) -> list[str]:
    """Both forms of every registered analyzer as functions of SQL: ``name(table(...))`` and ``name_of(text)``."""
    names = []
    for key, analyzer in sorted(ANALYZERS.items()):
        name = key.replace("-", "_")
        spark.udtf.register(name, table_function(analyzer))
        spark.udtf.register(f"{name}_of", file_function(analyzer))
        names += [name, f"{name}_of"]
    return names


# --- All analyzers over the facts of a scan. ---


def rule_texts(spark: SparkSession) -> DataFrame:
    """The rules of all analyzers, with the running order of their analyzer; an in-code table."""
    rows = [(key_of(a.name), place, *rule) for place, a in enumerate(in_order()) for rule in a.rules]
    return dimension(spark, rows, "analyzer string, analyzer_ord int, " + ", ".join(f"{f} string" for f in RULE_FIELDS))


def accepted(facts: DataFrame, projects: DataFrame, analyzer: type[SourceAnalyzer], language: str = "python") -> DataFrame:
    """The facts that an analyzer takes: of its languages, and of projects of its frameworks (``projects`` has project_id and framework)."""
    tongues = {tongue.strip().lower() for tongue in analyzer.languages}
    if tongues and language not in tongues:
        return facts.limit(0)
    if not analyzer.frameworks:
        return facts
    wanted = sorted({f.strip().lower() for f in analyzer.frameworks})
    chosen = projects.filter(F.lower(text.strip(F.coalesce("framework", F.lit("")))).isin(*wanted)).select(F.col("project_id").cast("string").alias("project_id"))
    return facts.join(chosen, "project_id", "left_semi")


def raw_findings(facts: DataFrame, projects: DataFrame, options: dict[str, dict] | None = None) -> DataFrame:
    """Hits and errors of all analyzers; the columns an analyzer adds are null for the others. ``options`` are constants by analyzer."""
    parts = []
    for analyzer in in_order():
        given = {k: F.lit(v) for k, v in (options or {}).get(key_of(analyzer.name), {}).items()}
        found = table_function(analyzer)(accepted(facts, projects, analyzer).asTable(), **given)
        parts.append(found.withColumn("analyzer", text.analyzer_key(F.lit(analyzer.name))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def custom_findings(raw: DataFrame) -> DataFrame:
    """Findings with the texts of their rules. Of equal ones of a project the first stays, by the order of the analyzers."""
    texts = F.broadcast(rule_texts(raw.sparkSession))
    keyed = raw.filter("error is null").join(texts, ["analyzer", "rule_id"]).withColumn("file_path", F.col("relative_path"))
    keyed = keyed.withColumn("fingerprint", source_fingerprint("line_start"))
    return dedupe_source(keyed, [F.asc("analyzer_ord"), F.asc("relative_path"), F.asc_nulls_first("column_start"), F.asc("evidence")])


# --- The analyzers that come with the engine, also as an example. ---


@register_analyzer
class ValueFlow(SourceAnalyzer):
    """Calls whose first argument is a name that holds the result of an earlier call of the same function or module level."""

    name = "Value_Flow"
    languages = ("python",)
    priority = 10
    reads = {"callee": "call.callee", "argument": "call.arg0.dotted", "names": "assign.names", "source": "assign.value.callee"}
    adds = "variable string, source string, lines int"
    defaults = {"sources": "", "sinks": ""}
    rules = ((
        "FLOW-001", "Result passed on", "The result of a call goes unchecked into another call.", "data-flow", "medium", "medium",
        "Check the value between the two calls.", "CWE-20", "API10:2023"),)

    def __init__(self, **options) -> None:
        super().__init__(**options)
        self.held: dict[tuple, tuple[str, int]] = {}
        self.coming: list[Row] = []  # assignments that still hold for nothing, as their own right side comes after them

    def _matches(self, option: str, name: str) -> bool:
        ends = [e.strip() for e in self.options[option].split(",") if e.strip()]
        return not ends or any(name == e or name.endswith("." + e) for e in ends)

    def _settle(self, line: int) -> None:
        done = [a for a in self.coming if a["line_end"] < line]
        self.coming = [a for a in self.coming if a["line_end"] >= line]
        for row in done:
            for name in row["names"] or ():
                key = (row["class_name"], row["function_name"], name)
                if row["source"] and self._matches("sources", row["source"]):
                    self.held[key] = (row["source"], row["line_start"])
                else:
                    self.held.pop(key, None)

    def fact(self, row: Row) -> Iterable[Hit]:
        if row["kind"] == "assign":
            self._settle(row["line_start"])
            self.coming.append(row)
        elif row["kind"] == "call":
            self._settle(row["line_start"])
            key = (row["class_name"], row["function_name"], row["argument"])
            if key in self.held and self._matches("sinks", row["callee"]):
                source, line = self.held[key]
                yield Hit("FLOW-001", row, (row["argument"], source, row["line_start"] - line))


@register_analyzer
class ModuleCalls(SourceAnalyzer):
    """Files with at least ``least`` calls outside of functions, told once at the end, at the first of them."""

    name = "module calls"
    languages = ("Python",)
    frameworks = ("FastAPI",)
    reads = {"callee": "call.callee", "in_signature": "in_signature"}
    adds = "calls int, callees array<string>"
    defaults = {"least": 2}
    rules = ((
        "LOAD-001", "Work at import", "The module calls other code when it is imported.", "structure", "low", "high",
        "Move the calls into functions.", "CWE-1164", None),)

    def __init__(self, **options) -> None:
        super().__init__(**options)
        self.first, self.callees, self.calls = None, {}, 0

    def fact(self, row: Row) -> Iterable[Hit]:
        if row["kind"] == "call" and row["function_name"] is None and not row["in_signature"]:
            self.first = self.first or row
            self.callees.setdefault(row["callee"])
            self.calls += 1
        return ()

    def finish(self) -> Iterable[Hit]:
        if self.calls >= self.options["least"]:
            yield Hit("LOAD-001", self.first, (self.calls, sorted(self.callees)))
