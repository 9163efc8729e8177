"""Endpoint rules: authentication, authorization, input validation and uploads, in one pass over endpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from palisade.catalog import markers as m, rules as catalog
from palisade.functions import paths, scoring, text
from palisade.operators import findings as finding_ops

def _bare(value: Column, prefixes: tuple[str, ...] = ()) -> Column:
    bare = F.replace(F.lower(text.strip(F.coalesce(value, F.lit("")))), F.lit(" "), F.lit(""))
    for prefix in prefixes:
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    return bare


CONTAINERS = r"^(?:(?:list|set|tuple|sequence|dict|mapping)\[(?:[^,]*,)?)+"


def _is_model(kind: Column) -> Column:
    """Whether a type is named like a model. Containers are peeled off together: their opening names, and what
    precedes the first comma inside each."""
    element = F.when(kind.rlike(CONTAINERS), F.rtrim(F.regexp_replace(kind, CONTAINERS, ""), F.lit("]"))).otherwise(kind)
    base = F.substring_index(element, ".", -1)
    return ~base.isin(*m.PRIMITIVE_TYPES) & base.rlike("(?:" + "|".join(m.MODEL_SUFFIXES) + ")$")


def _without_optional(kind: Column) -> Column:
    inner = F.replace(F.replace(kind, F.lit("|none"), F.lit("")), F.lit("none|"), F.lit(""))
    opened = F.rtrim(F.regexp_replace(inner, r"^(?:optional\[)+", ""), F.lit("]"))
    return F.when(inner.startswith("optional["), opened).otherwise(inner)


def is_validated_type(python_type: Column) -> Column:
    """Whether a type annotation shows validation: constrained, a model, or either of them made optional."""
    kind = _without_optional(_bare(python_type, ("typing.",)))
    return ~kind.isin(*m.GENERIC_TYPES) & (text.contains_any(kind, m.VALIDATED_TYPE_WORDS) | _is_model(kind))


def is_unvalidated(parameter: Column) -> Column:
    location = _bare(parameter["location"], ("typing.",))
    return location.isin(*m.BODY_LOCATIONS) & ((location == "file") | ~is_validated_type(parameter["python_type"]))


def is_upload(parameter: Column) -> Column:
    location, kind, name = _bare(parameter["location"]), _bare(parameter["python_type"]), _bare(parameter["name"])
    file_like = text.contains_any(kind, m.FILE_TYPE_WORDS)
    return (
        location.isin(*m.UPLOAD_LOCATIONS)
        | kind.isin(*m.UPLOAD_TYPES)
        | F.contains(kind, F.lit("uploadfile"))
        | ((location == "form") & file_like)
        | (location.isin("form", "body") & name.isin(*m.UPLOAD_NAMES) & file_like)
    )


def _outcome(name: str, evidence: Column, path: Column, parameters: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(name).alias("outcome"), evidence.alias("evidence"), path.alias("endpoint_path"),
        (none if parameters is None else F.transform(parameters, lambda p: p["name"])).alias("parameter_names"))


def with_hits(endpoints: DataFrame) -> DataFrame:
    """Endpoints with the outcomes of the four rules as an array ``hits``. Each endpoint is looked at once.

    ``endpoints`` needs: method, path, router_prefix, authentication_required, permission_required,
    security_scopes and parameters(name, location, python_type).
    """
    prepared = endpoints.withColumns({
        "_path": paths.canonical_path(F.col("router_prefix"), F.col("path")),
        "_bare": paths.loose_path(F.col("router_prefix"), F.col("path")),
        "_loose": F.filter("parameters", is_unvalidated),
        "_uploads": F.filter("parameters", is_upload),
        "method": F.upper(F.coalesce("method", F.lit(""))),
    })
    path, bare_path, loose, uploads, method = (F.col(n) for n in ("_path", "_bare", "_loose", "_uploads", "method"))
    safe = method.isin(*m.SAFE_METHODS)
    known = F.coalesce("authentication_required", F.lit(False))
    open_endpoint = ~known & ~paths.is_under(path, m.PUBLIC_PATHS)
    unscoped = known & ~F.coalesce("permission_required", F.lit(False)) & (F.coalesce(F.size("security_scopes"), F.lit(0)) <= 0)
    names = lambda found: F.array_join(F.transform(found, lambda p: F.coalesce(p["name"], F.lit(""))), ", ")
    no_auth = F.lit("authentication_required=False and no authentication dependency was discovered.")
    no_scope = F.lit("permission_required=False and no security scopes found.")
    hits = F.array_compact(F.array(
        F.when(open_endpoint & safe, _outcome("open_read", no_auth, path)).when(open_endpoint, _outcome("open_write", no_auth, path)),
        F.when(unscoped & safe, _outcome("unscoped_read", no_scope, bare_path)).when(unscoped, _outcome("unscoped_write", no_scope, bare_path)),
        F.when(F.size(loose) > 0, _outcome("unvalidated", F.concat(
            F.size(loose).cast("string"), F.lit(" potentially unvalidated request parameter(s) detected: "), names(loose), F.lit(".")), path, loose)),
        F.when(F.size(uploads) > 0, _outcome("upload", F.concat(
            F.size(uploads).cast("string"), F.lit(" upload parameter(s) detected: "), names(uploads), F.lit(".")), path, uploads)),
    ))
    return prepared.withColumn("hits", hits).withColumn("path", path).drop("_path", "_bare", "_loose", "_uploads")


def findings_of(hit_endpoints: DataFrame) -> DataFrame:
    """One row per outcome with the rule texts, enriched. Both dimensions are in-code tables of fixed size."""
    spark = hit_endpoints.sparkSession
    texts = F.broadcast(catalog.endpoint_rules(spark))
    carried = [c for c in hit_endpoints.columns if c not in ("parameters", "responses", "description", "summary", "hits")]
    # The outer form keeps the optimizer from adding a size test that would evaluate every rule twice.
    exploded = hit_endpoints.select(*carried, F.posexplode_outer("hits").alias("rule_no", "hit")).filter("hit is not null")
    found = exploded.select(*carried, "rule_no", "hit.*").join(texts, "outcome").withColumn("status", F.lit("open"))
    return finding_ops.enrich(found, catalog.knowledge(spark))


def assessments_of(hit_endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Scored assessment of every endpoint, from its own row: no shuffle.

    The rules yield one outcome per rule id, so removing repeats would change nothing here.
    """
    weights = {outcome[0]: scoring.WEIGHTS["calculator"][outcome[5]] for outcome in catalog.ENDPOINT_RULES}
    points = F.create_map(*[part for name, value in weights.items() for part in (F.lit(name), F.lit(value))])
    penalty = F.aggregate("hits", F.lit(0), lambda total, h: total + F.element_at(points, h["outcome"]))
    return hit_endpoints.withColumn("score", F.greatest(F.lit(0), 100 - penalty).cast("bigint")).select(
        *keys, "method", "path", "score",
        scoring.band(F.col("score"), "calculator").alias("severity"),
        F.size("hits").cast("bigint").alias("finding_count"),
        F.coalesce("authentication_required", F.lit(False)).alias("authenticated"),
        F.coalesce("permission_required", F.lit(False)).alias("authorization_required"),
        "security_schemes", "security_scopes",
    )


EndpointAnalyzer = Callable[[DataFrame], DataFrame]


def assess(endpoints: DataFrame, keys: list[str], extra: tuple[EndpointAnalyzer, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Endpoint findings and assessments. ``extra`` analyzers map endpoints to further finding rows (the keys,
    rule_id, title, description, severity and so on); with them, repeats are removed and scores aggregated."""
    hit = with_hits(endpoints)
    if not extra:
        return findings_of(hit), assessments_of(hit, keys)
    found = findings_of(hit).withColumn("seq", F.col("rule_no"))
    for place, analyzer in enumerate(extra):
        more = analyzer(endpoints).withColumn("seq", F.lit(100 + place))
        found = found.unionByName(finding_ops.enrich(more, catalog.knowledge(endpoints.sparkSession)), allowMissingColumns=True)
    kept = finding_ops.normalise(found, keys)
    totals = kept.groupBy(*keys).agg(F.sum(scoring.weight(F.col("severity"), "calculator")).alias("_penalty"), F.count("*").alias("_n"))
    base = assessments_of(hit, keys).drop("score", "severity", "finding_count")
    scored = base.join(totals, keys, "left").withColumns({
        "score": F.greatest(F.lit(0), 100 - F.coalesce("_penalty", F.lit(0))).cast("bigint"),
        "finding_count": F.coalesce("_n", F.lit(0)).cast("bigint"),
    })
    return kept, scored.withColumn("severity", scoring.band(F.col("score"), "calculator")).drop("_penalty", "_n")
