"""Stored report documents as VARIANT: parsed once when they are stored, read by path ever after.

A document may be a report, or wrap one as ``report`` or ``data``. Paths are looked for in that order.

Defined cases: a text that is no JSON is kept as null and gives nothing; JSON that is no object gives nothing; times that are empty, false, zero or
cannot be read are passed over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Where the time of a report is looked for, in order: in its scan, in the report, in the project (the project's latest scan stands for the report's).
SCAN_TIMES = ("completed_at", "finished_at", "updated_at", "started_at", "created_at")
REPORT_TIMES = ("generated_at",)
PROJECT_TIMES = ("updated_at", "created_at")
WRAPPERS = ("report", "data")


def write_documents(documents: DataFrame, path: str, payload: str = "payload") -> None:
    """Store ``documents`` with the JSON text ``payload`` as a VARIANT of that name."""
    documents.withColumn(payload, F.try_parse_json(payload)).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _filled(value: Column) -> Column:
    """``value``, null where it is JSON null, false, zero or an empty text."""
    plain = F.try_variant_get(value, "$", "string")
    nothing = plain.isNull() | (plain == "") | (F.schema_of_variant(value).isin("BOOLEAN", "BIGINT", "DECIMAL(1,0)") & plain.isin("false", "0"))
    return F.when(~nothing, value)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def part(document: Column, path: str) -> Column:
    """The value at a path of a VARIANT, as VARIANT, null where there is none or it is no object on the way."""
    return F.try_variant_get(document, f"$.{path}", "variant")


def summary(document: Column) -> Column:
    """The summary object of a document: its own, else that of the report or data it wraps."""
    found = [part(document, "summary"), *(part(document, f"{w}.summary") for w in WRAPPERS)]
    return reduce(lambda later, value: F.when(is_object(value), value).otherwise(later), reversed(found), F.lit(None).cast("variant"))


def time_of(value: Column) -> Column:
    """A time in a VARIANT: ISO text, or milliseconds since 1970; null if it is neither."""
    filled = _filled(value)
    plain = F.try_variant_get(filled, "$", "string")
    number = ~F.schema_of_variant(filled).startswith("STRING")
    return F.when(number, F.timestamp_millis(plain.try_cast("bigint"))).otherwise(F.when(plain.rlike("^[0-9]{4}-"), plain.try_cast("timestamp")))


def last_seen(document: Column, project: Column) -> Column:
    """When a report was last worked on: the first readable one of the eight times."""
    own = part(project, "latest_scan")
    scan = F.when(is_object(own), own).otherwise(part(document, "scan"))
    values = [part(scan, t) for t in SCAN_TIMES] + [part(document, t) for t in REPORT_TIMES] + [part(project, t) for t in PROJECT_TIMES]
    return F.coalesce(*(time_of(v) for v in values))


def seen_documents(stored: DataFrame, payload: str = "payload", project: str = "project") -> DataFrame:
    """Stored documents with ``seen`` and the numbers of their summary; the VARIANT columns stay behind."""
    whole = F.col(payload)
    wrapped = [F.when(is_object(part(whole, w)), part(whole, w)) for w in WRAPPERS]
    document = F.when(is_object(part(whole, "summary")), whole).otherwise(F.coalesce(*wrapped, whole))
    kept = [c for c in stored.columns if c not in (payload, project)]
    score = F.try_variant_get(summary(F.col(payload)), "$.score", "bigint")
    return stored.select(*kept, last_seen(document, F.col(project)).alias("seen"), score.alias("score"))


def latest_documents(seen: DataFrame, by: list[str], key: str) -> DataFrame:
    """The document of each portfolio seen last, those without a time behind all others, ties by the greater key."""
    rest = [c for c in seen.columns if c not in by]
    pick = F.max_by(F.struct(*rest), F.struct(F.coalesce("seen", F.timestamp_millis(F.lit(0))), F.col(key)))
    return seen.groupBy(*by).agg(pick.alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])
