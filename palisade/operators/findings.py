"""Normalising, de-duplicating, enriching, checking and viewing findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions import scoring, text
from palisade.operators.ranking import first_per, numbered

REQUIRED_TEXT = ("rule_id", "title", "description", "category", "remediation")


def normalise_fields(findings: DataFrame) -> DataFrame:
    """Upper-case rule ids and methods, lower-case categories, trimmed paths."""
    changed = {
        "rule_id": F.upper(text.strip(F.col("rule_id"))),
        "category": F.lower(text.strip(F.col("category"))),
        "method": F.upper(text.strip(F.col("method"))),
        "path": text.strip(F.col("path")),
    }
    return findings.withColumns({k: v for k, v in changed.items() if k in findings.columns})


def normalise(findings: DataFrame, endpoint_key: list[str] = ["endpoint_id"]) -> DataFrame:
    """Drop repeats inside an endpoint; the first by ``seq`` stays. Repeats share rule, severity, title and text."""
    keyed = findings.withColumns({
        "_rule": text.rule_key(F.col("rule_id")),
        "_severity": F.lower("severity"),
        "_title": text.fold(F.col("title")),
        "_text": text.fold(F.col("description")),
    })
    kept = first_per(keyed, [*endpoint_key, "_rule", "_severity", "_title", "_text"], [F.asc("seq")])
    return kept.drop("_rule", "_severity", "_title", "_text")


def report_order(findings: DataFrame) -> list[Column]:
    """Sort keys of a report: severity first, then rule, title and line."""
    line = [F.asc("line_number")] if "line_number" in findings.columns else []
    return [
        scoring.severity_rank(F.lower("severity")).asc(),
        text.rule_key(F.col("rule_id")).asc(),
        text.fold(F.col("title")).asc(),
        *line,
    ]


def severity_first(findings: DataFrame, within: list[str], crowded: list | None = None) -> DataFrame:
    """Findings with their ``position`` in the report of each ``within``, ties by ``seq``; no endpoint has to fit into one task.

    ``crowded`` names the endpoints with too many findings for that, where they are known.
    """
    return numbered(findings, within, [*report_order(findings), F.asc("seq")], "position", None, crowded)


def endpoint_fingerprint() -> Column:
    """Identity of an endpoint finding: rule, method, path, file and line."""
    parts = [F.col("rule_id"), F.upper("method"), F.col("path"), F.col("file_path"), F.col("line_number").cast("string")]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def source_fingerprint(line: str = "line_number", method: Column | None = None, path: Column | None = None) -> Column:
    """Identity of a source finding. The method and path parts stay empty unless the finding carries them."""
    parts = [
        F.upper(text.strip(F.col("rule_id"))),
        F.col("file_path"),
        F.coalesce(F.col(line), F.lit(0)).cast("string"),
        F.lit("") if method is None else F.coalesce(method, F.lit("")),
        F.lit("") if path is None else F.coalesce(path, F.lit("")),
    ]
    return F.concat_ws("|", *parts)


def add_if_absent(findings: DataFrame) -> DataFrame:
    """Keep the first finding of each endpoint fingerprint."""
    keyed = findings.withColumn("fingerprint", endpoint_fingerprint())
    return first_per(keyed, ["endpoint_id", "fingerprint"], [F.asc("seq")])


def dedupe_source(issues: DataFrame, order: list[Column]) -> DataFrame:
    """Keep the first issue of each source fingerprint of a project, across analyzers."""
    keyed = issues if "fingerprint" in issues.columns else issues.withColumn("fingerprint", source_fingerprint())
    return first_per(keyed, ["project_id", "fingerprint"], order)


def upsert_assessments(assessments: DataFrame, order: list[str]) -> DataFrame:
    """One assessment per project, method and path; the last one wins."""
    keyed = assessments.withColumn("method", F.upper("method"))
    return first_per(keyed, ["project_id", "method", "path"], [F.desc(c) for c in order])


def violations(findings: DataFrame) -> Column:
    """Names of the broken constraints of a finding, as an array."""

    def blank(name: str) -> Column:
        return F.when(F.coalesce(text.strip(F.col(name)), F.lit("")) == "", F.lit(f"{name} is blank"))

    tests = [blank(n) for n in (*REQUIRED_TEXT, "file_path") if n in findings.columns]
    for name in ("line_start", "line_end", "column_start", "column_end"):
        if name in findings.columns:
            tests.append(F.when(F.col(name) < 1, F.lit(f"{name} is below one")))
    if {"line_start", "line_end"} <= set(findings.columns):
        tests.append(F.when(F.col("line_end") < F.col("line_start"), F.lit("line_end is before line_start")))
    return F.array_compact(F.array(*tests))


def check_constraints(findings: DataFrame) -> DataFrame:
    return findings.withColumn("violations", violations(findings)).withColumn("valid", F.size("violations") == 0)


def enrich(findings: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Fill blank texts and missing references from the knowledge of the rule and attach the record.

    ``knowledge`` is the in-code rule dimension, whose size is fixed, so it is broadcast.
    """
    record = F.struct(*[c for c in knowledge.columns])
    known = F.broadcast(knowledge.select(text.rule_key(F.col("rule_id")).alias("_key"), record.alias("knowledge")))
    joined = findings.withColumn("_key", text.rule_key(F.col("rule_id"))).join(known, "_key", "left")

    def filled(name: str) -> Column:
        return F.when(F.coalesce(text.strip(F.col(name)), F.lit("")) != "", F.col(name)).otherwise(F.coalesce(F.col(f"knowledge.{name}"), F.col(name)))

    def first_of(own: str, listed: str) -> Column:
        return F.coalesce(F.nullif(F.col(own), F.lit("")), F.try_element_at(F.col(f"knowledge.{listed}"), F.lit(1)))

    return joined.withColumns({
        **{n: filled(n) for n in ("title", "description", "remediation")},
        "owasp_reference": first_of("owasp_reference", "owasp_api_categories"),
        "cwe_id": first_of("cwe_id", "cwe_ids"),
    }).drop("_key")


def merge_missing(existing: Column, defaults: Column) -> Column:
    """Map union in which existing keys win."""
    return F.map_concat(defaults, existing)


def applicable(hits: DataFrame, projects: DataFrame, analyzers: DataFrame) -> DataFrame:
    """Keep hits whose analyzer accepts the language of the file and the framework of the project.

    ``analyzers`` is the in-code dimension. ``hits`` carries ``language``; projects join by key and are left
    to adaptive execution, which broadcasts them only when they are small.
    """
    dimension = F.broadcast(analyzers.select("analyzer", "languages", "frameworks"))
    known = projects.select("project_id", F.lower(text.strip(F.coalesce("framework", F.lit("")))).alias("_framework"))
    language = F.lower(text.strip(F.coalesce("language", F.lit(""))))
    language_ok = (F.size("languages") == 0) | (language == "") | F.array_contains("languages", language)
    framework_ok = (F.size("frameworks") == 0) | F.array_contains("frameworks", F.coalesce("_framework", F.lit("")))
    return (
        hits.join(dimension, "analyzer")
        .join(known, "project_id", "left")
        .filter(language_ok & framework_ok)
        .drop("languages", "frameworks", "_framework")
    )


def report_view(endpoint_findings: DataFrame, source_findings: DataFrame) -> DataFrame:
    """Endpoint and source findings in one view, tagged by origin, repeats removed; endpoint findings come first."""
    first = endpoint_findings.withColumns({"origin": F.lit("endpoint"), "_rank": F.lit(0)})
    second = source_findings.withColumns({"origin": F.lit("source"), "_rank": F.lit(1)})
    both = first.unionByName(second, allowMissingColumns=True)
    place = text.location_text(F.coalesce("file_path", F.lit("Project-wide")), F.col("line_number"), F.lit(None).cast("int"))
    composite = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (F.col("rule_id"), F.col("method"), F.col("path"), place)])
    key = F.coalesce(F.nullif(F.col("fingerprint"), F.lit("")), composite) if "fingerprint" in both.columns else composite
    keyed = both.withColumn("view_key", key)
    return first_per(keyed, ["project_id", "view_key"], [F.asc("_rank"), F.asc("seq")]).drop("_rank")


def facets(view: DataFrame, severity: str = "", category: str = "", origin: str = "", query: str = "") -> DataFrame:
    """Filter a report view by the chosen facets and a search text; an empty choice keeps everything."""
    place = text.location_text(F.coalesce("file_path", F.lit("Project-wide")), F.col("line_number"), F.lit(None).cast("int"))
    chosen = view
    for name, value in (("severity", severity), ("category", category), ("origin", origin)):
        if value:
            chosen = chosen.filter(F.col(name) == value)
    names = [n for n in ("rule_id", "title", "description", "remediation", "method", "path") if n in view.columns]
    return chosen.filter(text.search_match([F.col(n) for n in names] + [place], query))


def categories(view: DataFrame) -> DataFrame:
    return view.select("category").filter("category <> ''").distinct().orderBy("category")
