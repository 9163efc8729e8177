"""Per-analyzer run metrics over code facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.catalog import markers as m, rules as catalog
from palisade.operators import source_rules as rules


def fact_counters(facts: DataFrame) -> DataFrame:
    """Counters of one pass over the facts, per project."""
    wanted = ("_fn_used", "_fn_authorizes", "_fn_owner")
    prepared = facts.withColumns({n: rules.FUNCTION_TESTS[n]() for n in wanted})
    routes = F.filter("function.routes", lambda r: r["verb"].isin(*m.RULE_VERBS))
    visible = (F.col("kind") == "function") & ~F.coalesce("function.inside_route", F.lit(False)) & (F.size(routes) > 0)
    candidates = F.size(F.filter(routes, rules.is_object_route))
    is_file = F.col("kind") == "file"
    return prepared.groupBy("project_id").agg(
        F.count_if(is_file).alias("files_scanned"),
        F.count_if(is_file & F.col("error").isNotNull()).alias("error_count"),
        F.coalesce(F.sum(F.when(F.col("kind") == "function", F.size(routes))), F.lit(0)).cast("bigint").alias("endpoint_count"),
        F.count_if((F.col("kind") == "call") & rules.is_token_decode()).alias("jwt_decode_calls"),
        F.count_if(visible & F.col("_fn_authorizes")).alias("authorization_checks"),
        F.count_if(visible & F.col("_fn_owner")).alias("ownership_checks"),
        F.coalesce(F.sum(F.when(visible, candidates)), F.lit(0)).cast("bigint").alias("idor_candidates"),
    )


def analyzer_runs(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per project and analyzer: files, issues, success and the counters the analyzer keeps."""
    names = F.array(*[F.lit(a[0]) for a in catalog.ANALYZERS])
    issues = findings.groupBy("project_id", "analyzer").agg(F.count("*").alias("issue_count"))
    runs = fact_counters(facts).withColumn("analyzer", F.explode(names))
    kept = {
        "endpoint_count": ("fastapi-endpoint-security", "fastapi-authentication-security", "fastapi-authorization-security"),
        "jwt_decode_calls": ("fastapi-authentication-security",),
        "authorization_checks": ("fastapi-authorization-security",),
        "ownership_checks": ("fastapi-authorization-security",),
        "idor_candidates": ("fastapi-authorization-security",),
    }
    return runs.join(issues, ["project_id", "analyzer"], "left").select(
        "project_id", "analyzer", "files_scanned",
        F.coalesce("issue_count", F.lit(0)).cast("bigint").alias("issue_count"),
        (F.col("error_count") == 0).alias("successful"),
        *[F.when(F.col("analyzer").isin(*owners), F.col(name)).alias(name) for name, owners in kept.items()],
    )
