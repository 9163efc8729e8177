"""Remediation: guidance by rule, merged with the patch of the framework's adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions import text
from palisade.operators.ranking import first_per


def estimated_time(low: Column, high: Column) -> Column:
    """Reading form of a minute range."""
    lows, highs = low.cast("string"), high.cast("string")
    return (
        F.when(low.isNotNull() & high.isNotNull() & (low == high), F.concat(lows, F.lit(" minutes")))
        .when(low.isNotNull() & high.isNotNull(), F.concat(lows, F.lit("–"), highs, F.lit(" minutes")))
        .when(low.isNotNull(), F.concat(F.lit("At least "), lows, F.lit(" minutes")))
        .when(high.isNotNull(), F.concat(F.lit("Up to "), highs, F.lit(" minutes"))))


def resolve_adapters(contexts: DataFrame, adapters: DataFrame) -> DataFrame:
    """The adapter of each distinct (framework, language): by framework alias, or by language when the framework
    is blank. Where several fit, the one with the highest priority number is taken."""
    asked = contexts.select("framework", "language").distinct().withColumns({
        "_framework": text.framework_key(F.col("framework")), "_language": text.framework_key(F.col("language"))})
    by_alias = adapters.select("adapter", "priority", F.explode("aliases").alias("_a")).select(
        "adapter", "priority", text.framework_key(F.col("_a")).alias("_key"), F.lit("framework").alias("_kind"))
    by_language = adapters.select("adapter", "priority", F.explode("languages").alias("_a")).select(
        "adapter", "priority", text.framework_key(F.col("_a")).alias("_key"), F.lit("language").alias("_kind"))
    known = F.broadcast(by_alias.unionByName(by_language).distinct())
    keyed = asked.withColumns({
        "_kind": F.when(F.col("_framework") != "", "framework").otherwise("language"),
        "_key": F.when(F.col("_framework") != "", F.col("_framework")).otherwise(F.nullif("_language", F.lit("")))})
    fitting = keyed.join(known, ["_kind", "_key"])
    return first_per(fitting, ["framework", "language"], [F.desc("priority"), F.desc("adapter")]).select("framework", "language", "adapter")


def merge_steps(base: Column, added: Column) -> Column:
    """Append steps whose trimmed text is new; the kept steps stay as they are written."""
    known = F.transform(base, text.strip)
    fresh = F.filter(
        F.coalesce(added, F.array().cast("array<string>")),
        lambda step, i: ~F.array_contains(known, text.strip(step))
        & ~F.array_contains(F.transform(F.slice(added, F.lit(1), i), text.strip), text.strip(step)))
    return F.concat(base, fresh)


def merge_examples(base: Column, added: Column) -> Column:
    """Append examples that are new by framework, language and title, whatever the case."""

    def identity(e: Column) -> Column:
        return F.lower(F.concat_ws("\x1f", e["framework"], e["language"], e["title"]))

    known = F.transform(base, identity)
    fresh = F.filter(F.coalesce(added, F.slice(base, F.lit(1), F.lit(0))), lambda e: ~F.array_contains(known, identity(e)))
    return F.concat(base, fresh)


def remediate(findings: DataFrame, guidance: DataFrame, adapters: DataFrame, patches: DataFrame) -> DataFrame:
    """Guidance for every finding with a known rule, refined by the adapter of its project's framework.

    Guidance, adapters and patches are in-code tables of fixed size and are merged before they meet the
    findings: one row per rule and (framework, language) pair, not one merge per finding.
    """
    contexts = resolve_adapters(findings, adapters).select(F.col("framework").alias("_cf"), F.col("language").alias("_cl"), "adapter")
    key = text.rule_key(F.col("rule_id"))
    rules = guidance.withColumn("_rule", key)
    patched = rules.join(
        patches.select("adapter", key.alias("_rule"), *[F.col(c).alias(f"_p_{c}") for c in ("implementation_steps", "validation_steps", "code_examples", "metadata")]),
        "_rule", "left")
    merged = patched.withColumns({
        "implementation_steps": merge_steps(F.col("implementation_steps"), F.col("_p_implementation_steps")),
        "validation_steps": merge_steps(F.col("validation_steps"), F.col("_p_validation_steps")),
        "code_examples": merge_examples(F.col("code_examples"), F.col("_p_code_examples")),
        "metadata": F.when(F.col("_p_metadata").isNull(), F.col("metadata")).otherwise(F.map_concat("metadata", "_p_metadata")),
    })
    texts = [c for c in guidance.columns if c != "rule_id"]
    # An adapter without a patch for the rule leaves the guidance as it is.
    plain = F.broadcast(rules.select("_rule", F.struct(*texts).alias("_plain")))
    special = F.broadcast(merged.filter("adapter is not null").select("_rule", "adapter", F.struct(*texts).alias("_special")))
    same_context = F.col("framework").eqNullSafe(F.col("_cf")) & F.col("language").eqNullSafe(F.col("_cl"))
    placed = findings.withColumn("_rule", key).join(contexts, same_context, "left").drop("_cf", "_cl")
    joined = placed.join(plain, "_rule").join(special, ["_rule", "adapter"], "left").withColumn("guidance", F.coalesce("_special", "_plain"))
    endpoint = F.when((F.coalesce("method", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != ""), F.concat_ws(" ", F.upper("method"), F.col("path")))
    return joined.drop("_rule", "_plain", "_special").withColumns({
        "customized": F.col("adapter").isNotNull(),
        "estimated_time": estimated_time(F.col("guidance.estimated_minutes_min"), F.col("guidance.estimated_minutes_max")),
        "framework_remediation": F.when(F.col("adapter").isNotNull(), F.struct(
            F.lit(True).alias("applied"), F.col("adapter").alias("adapter"), F.col("framework").alias("framework"),
            F.col("language").alias("language"), endpoint.alias("endpoint"))),
    })
