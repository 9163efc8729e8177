"""File inventory: languages, skip reasons, binary test, checksums, line counts and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.catalog import technology as t
from palisade.functions.text import extension_of

# Bytes below 32 that text files use: bell, backspace, tab, line feed, form feed, carriage return, escape.
_CONTROL = r"[\x00-\x06\x0b\x0e-\x1a\x1c-\x1f]"
_LINE_END = r"\r\n|\r|\n"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def filename_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def in_ignored_directory(path: Column, names: tuple[str, ...]) -> Column:
    parts = F.split(directory_of(path), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def language_of(filename: Column) -> Column:
    """Language by exact special name, special name of any case, ``.env`` prefix, then extension; else null."""
    lowered = F.lower(filename)
    by_lower: dict[str, str] = {}
    for name, language in t.SPECIAL_FILES.items():
        by_lower.setdefault(name.lower(), language)
    return F.coalesce(
        F.try_element_at(_map(t.SPECIAL_FILES), filename),
        F.try_element_at(_map(by_lower), lowered),
        F.when(lowered.startswith(".env"), F.lit("Environment")),
        F.try_element_at(_map(t.EXTENSION_LANGUAGES), extension_of(filename)),
    )


def is_binary(content: Column) -> Column:
    """Binary by its content: a NUL byte, or more than 30 % control bytes."""
    text = F.decode(content, "ISO-8859-1")
    size = F.octet_length(content)
    odd = F.regexp_count(text, F.lit(_CONTROL))
    return (size > 0) & (F.contains(text, F.lit("\x00")) | (odd / F.greatest(size, F.lit(1)) > 0.30))


def line_count(text: Column) -> Column:
    """Lines with any of the three line ends; a last line without an end counts."""
    tail = (F.char_length(text) > 0) & ~text.rlike(r"[\r\n]\z")
    return F.regexp_count(text, F.lit(_LINE_END)) + tail.cast("int")


def skip_reason(
    link: Column, filename: Column, size: Column, language: Column, content: Column, limit: int | None, unknown_text: bool, failure: Column | None = None,
) -> Column:
    """First reason to leave a file out, else null. ``failure`` says what the reader could not do; a file it could not read is not called binary."""
    failure = F.lit(None) if failure is None else failure
    chain = F.when(link, "symbolic_link").when(filename.isin(*t.IGNORED_FILES), "ignored_filename").when(failure == "stat_failed", "stat_failed")
    if limit is not None:
        chain = chain.when(size > limit, "file_too_large")
    if not unknown_text:
        chain = chain.when(language.isNull(), "unsupported_file_type")
    return chain.when(is_binary(content), "binary_file").when(failure == "read_failed", "read_failed")


def failure_of(files: DataFrame) -> Column:
    """What the reader of the files could not do, null where it does not say."""
    return F.col("failure") if "failure" in files.columns else F.lit(None).cast("string")


def inventory(
    files: DataFrame,
    limit: int | None = None,
    unknown_text: bool = False,
    ignored_directories: tuple[str, ...] = t.IGNORED_DIRECTORIES,
) -> DataFrame:
    """Inventory of ``files(project_id, relative_path, size_bytes, content)``: a row per file, skipped ones with a
    reason. Files below ignored directories are left out before their content is looked at. Files of any size are
    taken unless the caller names a ``limit``."""
    path = F.col("relative_path")
    named = files.filter(~in_ignored_directory(path, ignored_directories)).withColumns({
        "filename": filename_of(path), "extension": extension_of(filename_of(path)), "_language": language_of(filename_of(path))})
    link = F.coalesce("symbolic_link", F.lit(False)) if "symbolic_link" in files.columns else F.lit(False)
    reason = skip_reason(link, F.col("filename"), F.col("size_bytes"), F.col("_language"), F.col("content"), limit, unknown_text, failure_of(files))
    judged = named.withColumn("skip_reason", reason)
    kept = F.col("skip_reason").isNull()
    language = F.when(kept, F.coalesce("_language", F.lit("Unknown Text")))
    return judged.select(
        "project_id", "relative_path", "filename", "extension", language.alias("language"), "size_bytes",
        F.when(kept, F.sha2("content", 256)).alias("sha256"),
        F.when(kept, line_count(F.make_valid_utf8(F.col("content").cast("string")))).alias("line_count"),
        F.coalesce(language.isin(*t.SOURCE_LANGUAGES), F.lit(False)).alias("is_source_code"),
        "skip_reason",
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    kept = F.col("skip_reason").isNull()
    folders = F.countDistinct(directory_of(F.col("relative_path")))
    return inventory.groupBy("project_id").agg(
        F.count_if(kept).alias("total_files"),
        F.count_if(kept & F.col("is_source_code")).alias("source_file_count"),
        F.count_if(~kept).alias("skipped_file_count"),
        F.coalesce(F.sum(F.when(kept, F.col("size_bytes"))), F.lit(0)).cast("bigint").alias("total_size_bytes"),
        folders.alias("visited_directories"),
    )


def analysis_files(
    files: DataFrame, limit: int | None = None, excluded: tuple[str, ...] = t.ANALYSIS_EXCLUDED_DIRECTORIES
) -> DataFrame:
    """Files for the source analysis with a ``load_status``: loaded, skipped or error (not valid UTF-8, or not to be read).

    Files of other types are not part of the result, as they match none of the name patterns.
    """
    path = F.col("relative_path")
    # The name patterns match the case of the suffix.
    language = F.try_element_at(_map(t.ANALYSIS_LANGUAGES), F.regexp_extract(filename_of(path), r"(\.[^.]+)$", 1))
    content = F.col("content")
    large = F.col("size_bytes") > limit if limit is not None else F.lit(False)
    status = (
        F.when(in_ignored_directory(path, excluded), "skipped")
        .when(failure_of(files).isNotNull(), "error")
        .when(large, "skipped")
        .when(F.contains(F.decode(content, "ISO-8859-1"), F.lit("\x00")), "skipped")
        .when(~F.is_valid_utf8(content.cast("string")), "error")
        .otherwise("loaded")
    )
    judged = files.withColumn("language", language).filter("language is not null").withColumn("load_status", status)
    return judged.select(
        "project_id", "relative_path", "language", "size_bytes", "load_status",
        F.when(F.col("load_status") == "loaded", content.cast("string")).alias("content"),
        F.when(F.col("load_status") == "loaded", F.sha2(content, 256)).alias("sha256"),
    )
