"""Source trees as tables and as streams.

Spark's own file sources leave out names that start with a dot or an underscore and files of length zero, so
``__init__.py`` and ``.env`` would be missing. This Python data source reads what the walk has found instead: its partitions are ranges of the index, or
of the entries of a stream's log, and it opens only the files that filters on project and path leave.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith)

from palisade.catalog import technology as t
from palisade.operators.inventory import analysis_files
from palisade.session import prepare
from palisade.sources import walk

TREE_SCHEMA = "project_id string, relative_path string, size_bytes bigint, modified_at timestamp, symbolic_link boolean, failure string, content binary"
_ARROW = pa.schema([
    ("project_id", pa.string()), ("relative_path", pa.string()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", tz="UTC")),
    ("symbolic_link", pa.bool_()), ("failure", pa.string()), ("content", pa.binary()),
])
_BATCH_BYTES = 32 << 20
_BATCH_ROWS = 2000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Range(InputPartition):
    """One file of an index, which is a range of the files of a tree."""

    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


def _mask(wanted: Filter, column: pa.ChunkedArray) -> pa.ChunkedArray:
    """Where a filter holds."""
    if isinstance(wanted, (EqualTo, EqualNullSafe)):
        return pc.equal(column, wanted.value)
    if isinstance(wanted, In):
        return pc.is_in(column, value_set=pa.array([v for v in wanted.value if v is not None], pa.string()))
    if isinstance(wanted, IsNotNull):
        return pc.is_valid(column)
    match = {StringStartsWith: pc.starts_with, StringEndsWith: pc.ends_with, StringContains: pc.match_substring}[type(wanted)]
    return match(column, wanted.value)


class _Contents:
    """Reads the files of a range of an index. Files below ``unread`` folders, over the limit, and links come without content."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.unread = frozenset(options.get("unread", "").split("\n")) - {""}
        self.filters: list[Filter] = []

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        files, base = walk.opened(self.root)
        system, path = walk.opened(partition.file)
        index = pq.read_table(path, filesystem=system)
        for wanted in self.filters:
            index = index.filter(_mask(wanted, index.column(wanted.attribute[0])))
        rows, held = [], 0
        for row in index.to_pylist():
            below = any(part in self.unread for part in row["relative_path"].split("/")[:-1])
            content = None
            if not below and not row["symbolic_link"] and row["failure"] is None and (self.limit is None or row["size_bytes"] <= self.limit):
                try:
                    with files.open_input_stream(f"{base}/{row['project_id']}/{row['relative_path']}") as handle:
                        content = handle.read()
                except OSError:
                    row["failure"] = "read_failed"
            rows.append({**row, "content": content})
            held += len(content or b"")
            if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class TreeReader(_Contents, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.index = options["index"]

    def partitions(self) -> list[Range]:
        """The ranges that can hold a project that is asked for, from the manifest alone."""
        ranges = walk.read_manifest(self.index)
        for wanted in self.filters:
            if wanted.attribute == ("project_id",) and isinstance(wanted, (EqualTo, EqualNullSafe, In)):
                projects = wanted.value if isinstance(wanted, In) else [wanted.value]
                ranges = [r for r in ranges if any(p is not None and r["first"] <= p <= r["last"] for p in projects)]
        return [Range(r["file"]) for r in ranges]


class FilteringTreeReader(TreeReader):
    """With filters on project and path pushed down: what they leave out is not opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for wanted in filters:
            known = isinstance(wanted, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) or (
                isinstance(wanted, EqualNullSafe) and wanted.value is not None)
            if known and wanted.attribute in (("project_id",), ("relative_path",)):
                self.filters.append(wanted)
            else:
                yield wanted


class TreeStreamReader(_Contents, DataSourceStreamReader):
    """The files of a log (``walk.discover``). An offset is the number of the last entry read, so a batch that is run again reads the same files."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.log = options["log"]

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        return {"entry": max(walk.committed(self.log), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        entries = walk.committed(self.log)
        return [Range(r["file"]) for n in range(start["entry"] + 1, end["entry"] + 1) for r in walk.read_manifest(entries[n])]


class SourceTree(DataSource):
    """``root/project/relative/path``: the folder below the root is the project."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        # A reader that takes filters is an error to Spark where the session does not push them.
        return FilteringTreeReader(self.options) if self.options.get("pushdown") == "true" else TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStreamReader(self.options)


def indexed_tree(spark: SparkSession, root: str, index: str, limit: int | None = None, unread: tuple[str, ...] = ()) -> DataFrame:
    """The files of an ``index`` of ``root``, with their contents.

    Filters on project and path are pushed to the reader where the session allows it (``spark.sql.python.filterPushdown.enabled``).
    """
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("index", index).option("limit", "" if limit is None else limit).option("unread", "\n".join(unread))
    return reader.option("pushdown", spark.conf.get(PUSHDOWN, "false")).load(root)


def source_tree(
    spark: SparkSession, root: str, limit: int | None = None, ignored: tuple[str, ...] = t.IGNORED_DIRECTORIES, endings: tuple[str, ...] = (),
    folders_per_task: int = walk.FOLDERS_PER_TASK, files_per_task: int = walk.FILES_PER_TASK, projects: list[str] | None = None,
) -> DataFrame:
    """Every file below ``root``, walked now. Ignored folders are not entered; files over a limit, if one is named, come without content.

    With ``projects``, no other folder below the root is listed.
    """
    return indexed_tree(prepare(spark), root, walk.index(spark, root, ignored, endings, folders_per_task, files_per_task, projects), limit)


def analysis_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files the source analysis looks at, with their load status; links are the files that they lead to, and those are listed anyway."""
    index = walk.index(prepare(spark), root, (), tuple(t.ANALYSIS_LANGUAGES))
    return analysis_files(indexed_tree(spark, root, index, None, t.ANALYSIS_EXCLUDED_DIRECTORIES).filter("not symbolic_link"))


def source_tree_stream(spark: SparkSession, root: str, log: str) -> DataFrame:
    """The files of the log of ``root`` as a stream, each entry of the log in one batch or more entries together."""
    prepare(spark).dataSource.register(SourceTree)
    return spark.readStream.format("source_tree").option("log", log).option("unread", "\n".join(t.ANALYSIS_EXCLUDED_DIRECTORIES)).load(root)
