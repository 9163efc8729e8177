"""Technology detection per project: languages, frameworks, tools, manifests and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palisade.catalog import technology as t
from palisade.functions.text import extension_of, strip
from palisade.operators.inventory import filename_of

# Names the detection asks about. Only these are kept per project, so the set of a project stays small.
_ASKED = sorted({
    *t.KNOWN_MANIFESTS, *t.DOCKER_FILES, *t.KUBERNETES_FILES, *t.OPENAPI_FILES, "jenkinsfile",
    *(name for _, _, bonus in t.LANGUAGE_WEIGHTS for name in bonus),
})
ENTRY = "struct<framework:string, found:boolean, version:string, place:struct<detector:int, step:int, path:string, ord:int>>"


def _ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in t.TECHNOLOGY_IGNORED_DIRECTORIES]))


def _any_of(names: Column, wanted) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(n) for n in wanted]))


def file_statistics(files: DataFrame) -> DataFrame:
    """Per project: summed extension weights per language, the asked-for file names and a few path flags."""
    path = F.col("relative_path")
    named = files.filter(~_ignored(path)).select(
        "project_id", path.alias("path"), F.lower(filename_of(path)).alias("name"), extension_of(filename_of(path)).alias("ext"))
    weights = []
    for place, (_, extensions, _) in enumerate(t.LANGUAGE_WEIGHTS):
        table = F.create_map(*[F.lit(x) for pair in extensions.items() for x in pair])
        weights.append(F.sum(F.coalesce(F.try_element_at(table, F.col("ext")), F.lit(0))).alias(f"_w{place}"))
    return named.groupBy("project_id").agg(
        *weights,
        F.collect_set(F.when(F.col("name").isin(*_ASKED), F.col("name"))).alias("names"),
        F.bool_or(F.col("ext") == ".tf").alias("terraform"),
        F.bool_or(F.col("path").startswith(".github/workflows/")).alias("workflows"),
        F.bool_or(F.col("name").endswith(".postman_collection.json")).alias("postman"),
    )


def ranked_languages(statistics: DataFrame) -> Column:
    """Languages with a positive score, highest first; ties keep the declared order."""
    scored = []
    for place, (language, _, bonus) in enumerate(t.LANGUAGE_WEIGHTS):
        extra = [F.when(F.array_contains("names", name), F.lit(points)).otherwise(0) for name, points in bonus.items()]
        score = reduce(lambda a, b: a + b, extra, F.col(f"_w{place}"))
        scored.append(F.struct((-score).alias("rank"), F.lit(place).alias("ord"), F.lit(language).alias("language")))
    kept = F.filter(F.array_sort(F.array(*scored)), lambda s: s["rank"] < 0)
    return F.transform(kept, lambda s: s["language"])


def tools() -> Column:
    names = F.col("names")
    tests = (
        ("Docker", _any_of(names, t.DOCKER_FILES)), ("Kubernetes", _any_of(names, t.KUBERNETES_FILES)), ("Terraform", F.col("terraform")),
        ("GitHub Actions", F.col("workflows")), ("Jenkins", F.array_contains(names, "jenkinsfile")),
        ("OpenAPI", _any_of(names, t.OPENAPI_FILES)), ("Postman Collection", F.col("postman")),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def manifests() -> Column:
    return F.filter(F.array(*[F.lit(n) for n in t.KNOWN_MANIFESTS]), lambda n: F.array_contains(F.col("names"), n))


def clean_version(version: Column) -> Column:
    return F.nullif(F.regexp_replace(version, t.VERSION_PREFIX, ""), F.lit(""))


def _entry(framework, found: Column, version: Column, detector: int, step: Column | int, order: Column | int = 0) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    place = F.struct(F.lit(detector).alias("detector"), as_column(step).alias("step"), F.col("relative_path").alias("path"), as_column(order).alias("ord"))
    return F.struct(as_column(framework).alias("framework"), found.alias("found"), version.alias("version"), place.alias("place")).cast(ENTRY)


def _from_sections(content: Column, sections, frameworks: dict[str, str], detector: int) -> Column:
    """Entries of a JSON manifest: dependency sections merged, later ones winning, looked up in a table."""
    parsed = F.from_json(content, ", ".join(f"`{s}` map<string,string>" for s in sections))
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(*[F.coalesce(parsed[s], empty) for s in sections])
    known = F.array(*[F.struct(F.lit(d).alias("dependency"), F.lit(f).alias("framework"), F.lit(i).alias("ord")) for i, (d, f) in enumerate(frameworks.items())])
    present = F.filter(known, lambda k: F.map_contains_key(merged, k["dependency"]))
    return F.transform(present, lambda k: _entry(k["framework"], F.lit(True), clean_version(F.try_element_at(merged, k["dependency"])), detector, 0, k["ord"]))


def _python_entries(content: Column, name: Column) -> Column:
    step = F.array_position(F.array(*[F.lit(n) for n in t.PYTHON_MANIFESTS]), name).cast("int")
    found = []
    for order, framework in enumerate(t.PYTHON_FRAMEWORKS):
        pattern = t.PYTHON_REQUIREMENT.format(name=framework.lower())
        version = F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))
        found.append(F.when(content.rlike(pattern), _entry(framework, F.lit(True), version, 0, step, order)))
    return F.array_compact(F.array(*found))


def well_formed(content: Column) -> Column:
    """Whether a text is one XML document: the parser of the JVM finds no fault in its root, and nothing but white space follows that.

    A document with a type definition counts as not well formed; definitions are not read.
    """
    corrupt = F.from_xml(content, "_corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"]
    bare = F.regexp_replace(content, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "")
    return corrupt.isNull() & bare.rlike(r"(?s)\A\s*<([^\s/>]+)[^>]*>.*</\1\s*>\s*\z")


def xml_version(content: Column) -> Column:
    """The last version of Spring Boot in a well-formed XML text, under whatever prefix. Comments hold no elements, nor do CDATA sections, whose text is text."""
    plain = F.regexp_replace(content, r"(?s)<!--.*?-->", "")
    opened = F.regexp_replace(plain, r"(<(?:[\w.-]+:)?spring-boot\.version(?:\s[^>]*)?>\s*)<!\[CDATA\[([^<\]]*)\]\]>", "$1$2")
    elements = F.regexp_replace(opened, r"(?s)<!\[CDATA\[.*?\]\]>", "")
    return F.when(well_formed(content), F.try_element_at(F.regexp_extract_all(elements, F.lit(t.SPRING_VERSION), 1), F.lit(-1)))


def framework_entries(files: DataFrame) -> DataFrame:
    """Every sign of a framework in a manifest or a Python import, with its place in the detection order."""
    path, content = F.col("relative_path"), F.col("content")
    name = filename_of(path)
    readable = F.coalesce(content, F.lit(""))
    none = F.lit(None).cast("string")
    pom_version = xml_version(readable)
    gradle = F.contains(readable, F.lit("org.springframework.boot"))
    web = reduce(lambda a, b: a | b, [F.contains(readable, F.lit(m)) for m in t.DOTNET_MARKERS])
    extract = lambda pattern: F.nullif(F.regexp_extract(readable, pattern, 1), F.lit(""))
    imports = F.array_compact(F.array(*[
        F.when(reduce(lambda a, b: a | b, [F.contains(content, F.lit(m)) for m in marks]), _entry(framework, F.lit(True), none, 0, 9, order))
        for order, (framework, marks) in enumerate(t.PYTHON_IMPORTS.items())
    ]))
    entries = (
        F.when(name.isin(*t.PYTHON_MANIFESTS) & ~_ignored(path), _python_entries(readable, name))
        .when(path.endswith(".py") & ~_ignored(path), imports)
        .when((name == "package.json") & ~_ignored(path), _from_sections(readable, t.NODE_SECTIONS, t.NODE_FRAMEWORKS, 1))
        .when((name == "pom.xml") & ~_ignored(path), F.array(_entry("Spring Boot", F.contains(F.lower(readable), F.lit("spring-boot")), strip(pom_version), 2, 0)))
        .when(name == "build.gradle", F.array(_entry("Spring Boot", gradle, F.when(gradle, extract(t.GRADLE_VERSION)), 2, 1)))
        .when(name == "build.gradle.kts", F.array(_entry("Spring Boot", gradle, F.when(gradle, extract(t.GRADLE_VERSION)), 2, 2)))
        .when(name == "composer.json", _from_sections(readable, t.PHP_SECTIONS, t.PHP_FRAMEWORKS, 3))
        .when(name.endswith(".csproj"), F.array(_entry("ASP.NET Core", web, extract(t.DOTNET_VERSION), 4, 0)))
        .when(name == "pubspec.yaml", F.array(_entry("Flutter", readable.rlike(t.FLUTTER_KEY), strip(extract(t.DART_SDK)), 5, 0)))
    )
    # The outer form keeps the optimizer from adding a size test that would evaluate every pattern twice.
    return files.select("project_id", F.explode_outer(entries).alias("e")).filter("e is not null").select("project_id", "e.*")


def frameworks(entries: DataFrame) -> DataFrame:
    """Per project the frameworks in the order they were first found, the primary one and its version.

    The version seen last counts, even when it comes from a file that does not show the framework itself.
    """
    place = F.col("place")
    per_framework = entries.groupBy("project_id", "framework").agg(
        F.bool_or("found").alias("found"),
        F.min(F.when(F.col("found"), place)).alias("first"),
        F.max_by("version", F.when(F.col("version").isNotNull(), place)).alias("version"),
    ).filter("found")
    ranks = F.create_map(*[F.lit(x) for i, f in enumerate(t.FRAMEWORK_PRIORITY) for x in (f, i)])
    rank = F.coalesce(F.try_element_at(ranks, F.col("framework")), F.lit(len(t.FRAMEWORK_PRIORITY)))
    primary = F.min_by(F.struct("framework", "version"), F.struct(rank, F.col("first")))
    listed = F.array_sort(F.collect_list(F.struct("first", "framework")))
    return per_framework.groupBy("project_id").agg(
        F.transform(listed, lambda x: x["framework"]).alias("frameworks"), primary.alias("_p"),
    ).select("project_id", "frameworks", F.col("_p.framework").alias("primary_framework"), F.col("_p.version").alias("framework_version"))


def confidence(language: Column, framework: Column, manifests: Column, tools: Column) -> Column:
    return F.least(
        F.lit(100),
        F.when(language.isNotNull(), 35).otherwise(0) + F.when(framework.isNotNull(), 45).otherwise(0)
        + F.least(F.size(manifests) * 4, F.lit(12)) + F.least(F.size(tools) * 2, F.lit(8)),
    )


def detect(files: DataFrame) -> DataFrame:
    """One row per project of ``files(project_id, relative_path, content)``."""
    statistics = file_statistics(files)
    described = statistics.select(
        "project_id", ranked_languages(statistics).alias("languages"), tools().alias("tools"), manifests().alias("manifests"))
    joined = described.join(frameworks(framework_entries(files)), "project_id", "left")
    language = F.try_element_at("languages", F.lit(1))
    return joined.select(
        "project_id", language.alias("primary_language"), "primary_framework", "framework_version", "languages",
        F.coalesce("frameworks", F.array().cast("array<string>")).alias("frameworks"), "tools", "manifests",
        confidence(language, F.col("primary_framework"), F.col("manifests"), F.col("tools")).alias("confidence"),
    )
