"""Project trees that Spark derives from the customer and document tables: file names, manifests and bytes."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.sources import walk
from palisade.sources.bindings import table

# One list of (path, content) per kind of project; the kind follows from the nation key. ``{n}`` is the customer key.
PROJECT_KINDS = (
    (("requirements.txt", "fastapi==0.{n}.1\nflask>=2.0\n"), ("app/main.py", "from fastapi import FastAPI\n")),
    (("package.json", '{"dependencies":{"react":"^18.{n}.0","express":"~4.1"},"devDependencies":{"next":">=13"}}'),
     ("src/index.js", "x"), ("src/app.tsx", "x"), ("tsconfig.json", "{}")),
    (("pom.xml", "<project><spring-boot.version>3.{n}</spring-boot.version><artifactId>Spring-Boot</artifactId></project>"), ("src/A.java", "x")),
    (("build.gradle.kts", 'id "org.springframework.boot" version "2.{n}"'), ("Main.kt", "x")),
    (("composer.json", '{"require":{"laravel/framework":"^10.{n}"}}'), ("index.php", "x"), ("Dockerfile", "FROM php"), ("docker-compose.yml", "x")),
    (("Api.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web"><TargetFramework>net8.{n}</TargetFramework></Project>'), ("Program.cs", "x")),
    (("pubspec.yaml", "name: a\nenvironment:\n  sdk: '>=3.{n}.0'\ndependencies:\n  flutter:\n    sdk: flutter\n"), ("lib/main.dart", "x")),
    (("main.tf", "x"), ("deployment.yaml", "x"), (".github/workflows/ci.yml", "x"), ("Jenkinsfile", "x"), ("openapi.json", "{}"), ("api.postman_collection.json", "{}")),
    (("node_modules/x/package.json", '{"dependencies":{"vue":"1"}}'), ("node_modules/y/a.js", "x"), ("src/a.py", "import flask\n"), ("src/b.c", "x"), ("src/c.h", "x")),
    (("go.mod", "x"), ("a.go", "x"), ("b.rs", "x"), ("Cargo.toml", "x"), ("e.rb", "x"), ("f.hpp", "x")),
    (("Pipfile", 'django = "*"\n'), ("pyproject.toml", "[deps]\nstarlette^0.{n}\n")),
    (),
    (("pom.xml", "<project><a></b><spring-boot.version>3.{n}</spring-boot.version></project>"), ("src/A.java", "x")),
    (("pom.xml", '<?xml version="1.0"?>\n<m:project xmlns:m="urn:pom"><!-- <spring-boot.version>1</spring-boot.version> --><m:properties>'
                 '<m:spring-boot.version>4.{n}</m:spring-boot.version></m:properties></m:project>\n<!-- end -->\n'), ("src/A.java", "x")),
    (("pom.xml", "<project><x><![CDATA[<spring-boot.version>9</spring-boot.version>]]></x><spring-boot.version><![CDATA[5.{n}]]></spring-boot.version>"
                 "<y><![CDATA[<spring-boot.version>8</spring-boot.version>]]></y></project>"), ("src/A.java", "x")),
    (("pom.xml", "<project><spring-boot.version>3.{n}</spring-boot.version><b>x & y</b></project>"), ("src/A.java", "x")),
    (("pom.xml", "<project><spring-boot.version>3.{n}</spring-boot.version></project> and more"), ("src/A.java", "x")),
)

# One path per document source (src0 to src19). ``{d}`` is the document key.
DOCUMENT_PATHS = (
    "app/main_{d}.py", "web/View{d}.TSX", "Dockerfile", "makefile", ".env.local", "docs/readme_{d}.md", "node_modules/a/b_{d}.js",
    "package.json", "src/a_{d}.go", "src/util_{d}.hpp", "conf/app_{d}.yml", "LICENSE", "package-lock.json", "a/b/c_{d}.java",
    "build/x_{d}.py", "migrations/m_{d}.py", "GEMFILE", "notes.", "src/lib_{d}.rs", "web/page_{d}.html",
)


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_nationkey") % len(PROJECT_KINDS) + 1
    one = lambda path, content: F.struct(F.lit(path).alias("path"), F.lit(content).alias("content"))
    kinds = F.array(*[F.array(one("README.md", "# readme"), *[one(p, c) for p, c in files]) for files in PROJECT_KINDS])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.element_at(kinds, kind)).alias("f"))
    key = F.col("c_custkey").cast("string")
    return rows.select(
        key.alias("project_id"), F.col("f.path").alias("relative_path"), F.replace(F.col("f.content"), F.lit("{n}"), key).alias("content"))


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one project per language, as bytes. Labelled documents get a control-byte prefix when
    toxic, and a NUL byte when of quality 0, so that every outcome of the binary test occurs."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    number = F.substring("source", 4, 10).cast("int") + 1
    path = F.replace(F.element_at(F.array(*[F.lit(p) for p in DOCUMENT_PATHS]), number), F.lit("{d}"), F.col("doc_id").cast("string"))
    joined = documents.join(labels, "doc_id", "left")
    text = (
        F.when(F.col("quality") == 0, F.concat(F.lit("a\x00"), F.col("text")))
        .when(F.col("toxic") == 1, F.concat(F.repeat(F.lit("\x01\x02"), 3000), F.col("text")))
        .otherwise(F.col("text")))
    content = F.encode(text, "UTF-8")
    return joined.select(
        "doc_id", F.col("lang").alias("project_id"), F.concat_ws("/", F.lit("d"), F.col("doc_id").cast("string"), path).alias("relative_path"),
        F.octet_length(content).cast("bigint").alias("size_bytes"), content.alias("content"))


# --- Trees on a file system, written and thinned by the executors. ---


def _each(rows: DataFrame, columns: list[str], root: str, act, spread: bool = False) -> int:
    """``act(file system, path, values)`` for every row, and how many there were. Acts are safe to repeat.

    With ``spread``, over all cores, however few parts the rows come in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = walk.opened(root)
        done = 0
        for batch in batches:
            for project, path, *values in zip(*(c.to_pylist() for c in batch.columns)):
                act(system, f"{base}/{project}/{path}", values)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["done"])

    rows = rows.select("project_id", "relative_path", *columns)
    if spread:
        rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "project_id", "relative_path")
    return rows.mapInArrow(run, "done bigint").agg(F.coalesce(F.sum("done"), F.lit(0))).first()[0]


def write_tree(rows: DataFrame, root: str) -> int:
    """Write ``rows(project_id, relative_path, kind, content)`` below ``root``. ``kind`` is a file, an empty folder, a link or a socket.

    Links and sockets, which readers must not follow or wait for, only exist on a file system of the machine; elsewhere they are files.
    """
    def act(system: fs.FileSystem, path: str, values: list) -> None:
        kind, content = values
        system.create_dir(path if kind == "folder" else os.path.dirname(path), recursive=True)
        if kind == "folder":
            return
        if kind == "file" or not isinstance(system, fs.LocalFileSystem):
            with system.open_output_stream(path) as handle:
                handle.write(content or b"")
        elif not os.path.lexists(path):
            if kind == "link":
                os.symlink(".", f"{path}.folder")
                os.symlink("nowhere", path)
            else:
                os.mknod(path, stat.S_IFSOCK | 0o600)

    return _each(rows, ["kind", "content"], root, act, spread=True)


def remove_files(rows: DataFrame, root: str) -> int:
    """Delete the files of ``rows(project_id, relative_path)`` that are there."""
    def act(system: fs.FileSystem, path: str, values: list) -> None:
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_file(path)

    return _each(rows, [], root, act)


def odd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``document_tree``, and for some documents what a walk must survive: a file that will be gone, a socket, links, an empty folder."""
    documents = document_tree(spark, sf_dir)
    own = documents.select("project_id", "relative_path", F.lit("file").alias("kind"), "content")
    key = F.col("doc_id").cast("string")
    at = lambda name: F.concat(F.lit("d/"), key, F.lit("/"), F.lit(name))
    rest = documents.select("project_id", F.explode(F.array(
        F.struct((F.col("doc_id") % 7 == 0).alias("has"), at("gone.py").alias("relative_path"), F.lit("file").alias("kind"), F.lit(b"x = 1\n").alias("content")),
        F.struct((F.col("doc_id") % 7 == 1).alias("has"), at("socket.py").alias("relative_path"), F.lit("socket").alias("kind"), F.lit(None).cast("binary").alias("content")),
        F.struct((F.col("doc_id") % 7 == 2).alias("has"), at("link.py").alias("relative_path"), F.lit("link").alias("kind"), F.lit(None).cast("binary").alias("content")),
        F.struct((F.col("doc_id") % 7 == 3).alias("has"), at("empty/folder").alias("relative_path"), F.lit("folder").alias("kind"), F.lit(None).cast("binary").alias("content")),
        F.struct((F.col("doc_id") % 7 == 4).alias("has"), at("pkg/__init__.py").alias("relative_path"), F.lit("file").alias("kind"), F.lit(b"").alias("content")),
    )).alias("f")).filter("f.has")
    return own.unionByName(rest.select("project_id", "f.relative_path", "f.kind", "f.content"))
