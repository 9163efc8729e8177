"""Distributed walk of source trees: folders are listed, and files looked at, on the executors.

The walk goes down one level a round. A round lists the folders of the level before, many to a task, and gives their names; folders among them are the
next round. Names are then cut into ranges along project and path, so the files of one crowded folder are looked at and read by as many tasks
as there are ranges. The result is an index: one row a file, in files of bounded length that are sorted by project and path, and a manifest that
says which projects each of those holds. Readers plan from the manifest.

A folder that cannot be listed, a file that is gone when it is looked at, and one that is no regular file are rows that say so, and the walk goes on.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.session import cut_lineage, shared_folder
from palisade.sources import commits
from palisade.sources.commits import opened

FOLDERS_PER_TASK = 64
# A level with more folders than these many tasks a core would take has more of them to a task.
TASKS_PER_CORE = 32
FILES_PER_TASK = 5000
_BATCH_ROWS = 4096

NAMES = "folder string, name string, kind string, size_bytes bigint, modified_at timestamp"
_NAMES = pa.schema([("folder", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", tz="UTC"))])
INDEX = "project_id string, relative_path string, symbolic_link boolean, size_bytes bigint, modified_at timestamp, failure string"
_INDEX = pa.schema([
    ("project_id", pa.string()), ("relative_path", pa.string()), ("symbolic_link", pa.bool_()), ("size_bytes", pa.int64()),
    ("modified_at", pa.timestamp("us", tz="UTC")), ("failure", pa.string())])


def _shown(name: str) -> str:
    """A name that is not UTF-8 is shown with replacement characters; it cannot be opened by that name, which the walk reports."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _entries(system: fs.FileSystem, path: str) -> Iterator[tuple[str, str, int | None, object]]:
    """``(name, kind, size, time)`` of what a folder holds, as it is listed. Links to folders are left out and not followed."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(path)):
            folder = info.type == fs.FileType.Directory
            yield info.base_name, "folder" if folder else "file", None if folder else info.size, None if folder else info.mtime
        return
    with os.scandir(path) as found:
        for entry in found:
            link = entry.is_symlink()
            if entry.is_dir():
                if not link:
                    yield _shown(entry.name), "folder", None, None
            else:
                yield _shown(entry.name), "link" if link else "file", None, None


def listed(folders: DataFrame, root: str) -> DataFrame:
    """What each of ``folders(folder)`` holds, and a row for the folder itself: ``listed``, or ``failed`` if it cannot be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                kind = "listed"
                try:
                    for entry in _entries(system, f"{base}/{folder}".rstrip("/")):
                        rows.append((folder, *entry))
                        if len(rows) >= _BATCH_ROWS:
                            yield _batch(rows, _NAMES)
                            rows = []
                except OSError:
                    kind = "failed"
                rows.append((folder, "", kind, None, None))
        if rows:
            yield _batch(rows, _NAMES)

    return folders.select("folder").mapInArrow(run, NAMES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def names(spark: SparkSession, root: str, pruned: tuple[str, ...] = (), folders_per_task: int = FOLDERS_PER_TASK, projects: list[str] | None = None) -> DataFrame:
    """``NAMES`` of everything below ``root``, whose own folders are the projects; folders named in ``pruned`` are not entered.

    Every level is written, so a lost executor repeats no more than its folders of the level at hand. The driver sees counts only.
    """
    def path(folder: str, name: str):
        return F.when(F.col(folder) == "", F.col(name)).otherwise(F.concat_ws("/", folder, name))

    levels, first = [], projects is None
    frontier = spark.createDataFrame([("",)] if first else [(p,) for p in projects], "folder string")
    while True:
        level = cut_lineage(listed(frontier, root))
        # Files beside the projects belong to none.
        levels.append(level.filter("kind not in ('file', 'link') or folder <> ''"))
        folders = level.filter("kind = 'folder'")
        if not first and pruned:
            folders = folders.filter(~F.col("name").isin(*pruned))
        first = False
        count = folders.count()
        if not count:
            break
        # By number, so that adaptive execution does not put a level into one task for being few bytes.
        tasks = min(-(-count // folders_per_task), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        frontier = folders.select(path("folder", "name").alias("folder")).repartition(tasks, "folder")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def files_of(found: DataFrame) -> DataFrame:
    """``names`` as files: project, path inside it, and what the listing knows."""
    inside = F.substring(F.col("folder"), F.char_length(F.substring_index("folder", "/", 1)) + 2, F.lit(1 << 30))
    return found.filter("kind in ('file', 'link')").select(
        F.substring_index("folder", "/", 1).alias("project_id"), F.when(inside == "", F.col("name")).otherwise(F.concat_ws("/", inside, "name")).alias("relative_path"),
        (F.col("kind") == "link").alias("symbolic_link"), "size_bytes", "modified_at")


def visited(found: DataFrame) -> DataFrame:
    """``(project_id, visited_directories, failed_directories)`` of ``names``; folders that are empty count."""
    own = found.filter("kind in ('listed', 'failed') and folder <> ''")
    return own.groupBy(F.substring_index("folder", "/", 1).alias("project_id")).agg(
        F.count_if(F.col("kind") == "listed").alias("visited_directories"), F.count_if(F.col("kind") == "failed").alias("failed_directories"))


def looked_at(files: DataFrame, root: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """``INDEX`` of ``files_of``: size and time of every file, or why there are none. Ranges along the names go to tasks of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            rows = []
            for project, path, link, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                failure = None
                if local and not link:
                    try:
                        known = os.stat(f"{base}/{project}/{path}", follow_symlinks=False)
                        size, at = known.st_size, known.st_mtime_ns // 1000
                        # Reading a pipe or a socket would not end.
                        failure = None if stat.S_ISREG(known.st_mode) else "read_failed"
                    except OSError:
                        failure = "stat_failed"
                rows.append((project, path, link, size, at, failure))
            if rows:
                yield _batch(rows, _INDEX)

    count = files.count()
    ranges = files.repartitionByRange(max(1, -(-count // files_per_task)), "project_id", "relative_path")
    return ranges.sortWithinPartitions("project_id", "relative_path").mapInArrow(run, INDEX)


def write_index(rows: DataFrame, folder: str) -> str:
    """Store ``INDEX`` rows, one file a task, and the manifest: file, number of rows, first and last project."""
    spark = rows.sparkSession
    rows.write.parquet(f"{folder}/files")
    stored = spark.read.schema(INDEX).parquet(f"{folder}/files")
    held = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("project_id").alias("first"), F.max("project_id").alias("last"))
    held.coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def read_manifest(folder: str) -> list[dict]:
    """A row for each file of an index, which is one for ``FILES_PER_TASK`` files of the tree."""
    import pyarrow.parquet as pq

    system, path = opened(f"{folder}/manifest")
    out: list[dict] = []
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.base_name.endswith(".parquet"):
            out += pq.read_table(info.path, filesystem=system).to_pylist()
    return sorted(out, key=lambda r: (r["first"], r["last"], r["file"]))


def index(
    spark: SparkSession, root: str, pruned: tuple[str, ...] = (), endings: tuple[str, ...] = (), folders_per_task: int = FOLDERS_PER_TASK, files_per_task: int = FILES_PER_TASK,
    projects: list[str] | None = None,
) -> str:
    """Walk ``root`` and store its index in the shared folder; returns where."""
    files = files_of(names(spark, root, pruned, folders_per_task, projects))
    return write_index(looked_at(with_endings(files, endings), root, files_per_task), shared_folder(spark, "index"))


def with_endings(files: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    if not endings:
        return files
    wanted = F.lit(False)
    for ending in endings:
        wanted = wanted | F.col("relative_path").endswith(ending)
    return files.filter(wanted)


# --- What a stream has seen: a log of indexes. ---


def committed(log: str) -> dict[int, str]:
    """The indexes of a log by number. One that is not committed does not exist for readers."""
    return {number: entry["folder"] for number, entry in commits.entries(log).items()}


def discover(spark: SparkSession, root: str, log: str, endings: tuple[str, ...] = (), pruned: tuple[str, ...] = ()) -> int | None:
    """Walk ``root`` and append to ``log`` the files that are new or have another size or time; returns the number of the entry, None if there are none.

    The entry is written beside the log and counts from the moment its commit file stands, so a walk that dies leaves the log as it was. One walk
    at a time may write to a log. Files that cannot be looked at are left for the next walk; those that are deleted stay in the log.
    """
    files = with_endings(files_of(names(spark, root, pruned)), endings)
    rows = cut_lineage(looked_at(files, root)).filter("not symbolic_link and failure is null")
    known = committed(log)
    if known:
        key = ["project_id", "relative_path", "size_bytes", "modified_at"]
        rows = rows.join(spark.read.schema(INDEX).parquet(*(f"{folder}/files" for folder in known.values())).select(key), key, "left_anti").select(*(c.strip().split(" ")[0] for c in INDEX.split(",")))
    count = rows.count()
    if not count:
        return None
    ranges = rows.repartitionByRange(-(-count // FILES_PER_TASK), "project_id", "relative_path").sortWithinPartitions("project_id", "relative_path")
    folder = write_index(ranges, f"{log}/{shared_folder(spark, 'found').rsplit('/', 1)[1]}")
    return commits.commit(log, max(known, default=0) + 1, {"folder": folder})
