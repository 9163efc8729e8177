"""The distributed walk, filters in the source, and ingest through the log."""

import os
import re
import stat
import time

import pytest
from pyspark.sql import functions as F

from palisade.operators import inventory
from palisade.sources import files as sources, walk
from palisade.streaming import ingest


def plant(base, tree):
    for path, content in tree.items():
        target = base / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)


def test_the_walk_sees_all_names_and_skips_pruned_folders(spark, tmp_path):
    plant(tmp_path, {"p/__init__.py": b"", "p/.env": b"A=1", "p/_x/.y/z.py": b"x", "p/build/b.py": b"x", "build/a.py": b"x", "beside.py": b"x", "q/é 😀.py": b"x"})
    (tmp_path / "p" / "hollow").mkdir()
    os.symlink(tmp_path / "p", tmp_path / "p" / "_x" / "round")
    os.symlink("nowhere", tmp_path / "p" / "broken.py")
    found = walk.names(spark, str(tmp_path), ("build",), folders_per_task=1)
    assert {(r.project_id, r.relative_path, r.symbolic_link) for r in walk.files_of(found).collect()} == {
        ("p", "__init__.py", False), ("p", ".env", False), ("p", "_x/.y/z.py", False), ("build", "a.py", False), ("q", "é 😀.py", False), ("p", "broken.py", True)}
    assert {r.project_id: r.visited_directories for r in walk.visited(found).collect()} == {"p": 4, "build": 1, "q": 1}
    only = walk.names(spark, str(tmp_path), projects=["q"])
    assert [r.relative_path for r in walk.files_of(only).collect()] == ["é 😀.py"]


def test_a_folder_that_cannot_be_listed_is_counted_and_the_walk_goes_on(spark, tmp_path):
    plant(tmp_path, {"p/a.py": b"x", "p/gone/b.py": b"x"})
    folders = spark.createDataFrame([("p",), ("p/gone",), ("p/never",)], "folder string")
    rows = walk.listed(folders, str(tmp_path))
    assert {(r.folder, r.kind) for r in rows.filter("kind in ('listed', 'failed')").collect()} == {("p", "listed"), ("p/gone", "listed"), ("p/never", "failed")}
    assert {r.failed_directories for r in walk.visited(rows).collect()} == {1}


def test_a_crowded_folder_is_many_tasks_and_nothing_is_listed_by_the_driver(spark, tmp_path, monkeypatch):
    crowd = tmp_path / "p" / "crowd"
    crowd.mkdir(parents=True)
    for i in range(10_000):
        (crowd / f"f{i:05d}.py").touch()
    monkeypatch.setattr(os, "scandir", None)  # here, on the driver; the workers are other processes
    index = walk.index(spark, str(tmp_path), files_per_task=1000)
    tree = sources.indexed_tree(spark, str(tmp_path), index)
    ranges = walk.read_manifest(index)
    assert sum(r["rows"] for r in ranges) == 10_000 and len(ranges) >= 8 and max(r["rows"] for r in ranges) <= 2500
    spread = tree.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(spread) == len(ranges) and sum(r["count"] for r in spread) == 10_000


def test_failing_files_are_rows(spark, tmp_path):
    plant(tmp_path, {"p/ok.py": b"x = 1\n", "p/gone.py": b"x", "p/later.py": b"x", "p/notes.txt": b"x"})
    os.mknod(tmp_path / "p" / "s.py", stat.S_IFSOCK | 0o600)
    os.mkfifo(tmp_path / "p" / "pipe.py")
    found = walk.names(spark, str(tmp_path))
    (tmp_path / "p" / "gone.py").unlink()
    index = walk.write_index(walk.looked_at(walk.files_of(found), str(tmp_path)), str(tmp_path / "index"))
    (tmp_path / "p" / "later.py").unlink()
    tree = sources.indexed_tree(spark, str(tmp_path), index)
    assert {r.relative_path: r.skip_reason for r in inventory.inventory(tree).collect()} == {
        "ok.py": None, "gone.py": "stat_failed", "later.py": "read_failed", "s.py": "read_failed", "pipe.py": "read_failed", "notes.txt": "unsupported_file_type"}
    assert {r.relative_path: r.load_status for r in inventory.analysis_files(tree).collect()} == {
        "ok.py": "loaded", "gone.py": "error", "later.py": "error", "s.py": "error", "pipe.py": "error"}


@pytest.fixture(scope="module")
def projects(tmp_path_factory):
    base = tmp_path_factory.mktemp("projects")
    plant(base, {f"p{i}/src/f{j}.{kind}": f"{i}{j}".encode() for i in range(6) for j in range(5) for kind in ("py", "js")})
    return str(base)


def test_filters_are_pushed_and_what_they_leave_out_is_not_opened(spark, projects, tmp_path):
    index = walk.index(spark, projects, files_per_task=10)
    tree = sources.indexed_tree(spark, projects, index)
    wanted = tree.filter("project_id in ('p2', 'p4') and relative_path like '%.py' and size_bytes > 0")
    plan = wanted._jdf.queryExecution().explainString(wanted._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed, left = re.search("PushedFilters: (.*)", plan).group(1), re.search("Condition : (.*)", plan).group(1)
    assert "In(project_id, [p2,p4])" in pushed and "StringEndsWith(relative_path,.py)" in pushed
    assert "size_bytes" in left and "project_id" not in left and "relative_path" not in left
    assert {(r.project_id, r.relative_path, bytes(r.content)) for r in wanted.collect()} == {
        (f"p{i}", f"src/f{j}.py", f"{i}{j}".encode()) for i in (2, 4) for j in range(5)}
    options = {"path": projects, "index": index}
    reader = sources.FilteringTreeReader(options)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains, StringEndsWith, StringStartsWith

    filters = [EqualTo(("project_id",), "p3"), StringEndsWith(("relative_path",), ".js"), GreaterThan(("size_bytes",), 1), IsNotNull(("project_id",)), StringStartsWith(("relative_path",), "src/")]
    assert list(reader.pushFilters(filters)) == [filters[2]]
    planned = reader.partitions()
    assert 0 < len(planned) < len(sources.TreeReader(options).partitions())
    opened = []
    whole = walk.opened

    class Counting:
        def __init__(self, system):
            self.system = system

        def open_input_stream(self, path):
            opened.append(path)
            return self.system.open_input_stream(path)

    sources.walk.opened = lambda root: (Counting(whole(root)[0]), whole(root)[1]) if root == projects else whole(root)
    try:
        rows = [r for p in planned for batch in reader.read(p) for r in batch.to_pylist()]
    finally:
        sources.walk.opened = whole
    assert len(rows) == len(opened) == 5 and all("/p3/" in p and p.endswith(".js") for p in opened)
    other = sources.FilteringTreeReader(options)
    list(other.pushFilters([In(("project_id",), ("p1", None)), StringContains(("relative_path",), "f1.")]))
    assert sorted(r["relative_path"] for p in other.partitions() for b in other.read(p) for r in b.to_pylist()) == ["src/f1.js", "src/f1.py"]


def test_a_session_that_does_not_push_filters_reads_the_same(spark, projects):
    index = walk.index(spark, projects)
    spark.conf.set(sources.PUSHDOWN, "false")
    try:
        rows = sources.indexed_tree(spark, projects, index).filter("project_id = 'p1' and relative_path like '%.py'")
        assert rows.count() == 5
    finally:
        spark.conf.set(sources.PUSHDOWN, "true")


def test_empty_tree(spark, tmp_path):
    (tmp_path / "p").mkdir()
    assert sources.source_tree(spark, str(tmp_path)).isEmpty() and sources.analysis_tree(spark, str(tmp_path)).isEmpty()
    assert walk.discover(spark, str(tmp_path), str(tmp_path / "log")) is None


def test_ingest_takes_hidden_and_empty_files_and_changed_ones_again(spark, tmp_path):
    tree, out, state = tmp_path / "tree", f"{tmp_path}/facts", f"{tmp_path}/state"
    run = lambda: ingest.ingest(spark, str(tree), out, state).awaitTermination()
    plant(tree, {"shop/__init__.py": b"", "shop/_hidden/.a.py": b"eval(x)\n", "shop/b.py": b"exec(x)\n", "shop/data.json": b"{}"})
    run()
    seen = lambda: {(r.relative_path, r.call.callee) for r in ingest.current_facts(spark, out).filter("kind = 'call'").collect()}
    assert seen() == {("_hidden/.a.py", "eval"), ("b.py", "exec")}
    assert "__init__.py" in {r.relative_path for r in spark.read.parquet(out).collect()}
    before = spark.read.parquet(out).count()
    run()  # nothing new
    assert spark.read.parquet(out).count() == before
    time.sleep(0.01)
    plant(tree, {"shop/b.py": b"compile(x)\n"})
    run()
    assert seen() == {("_hidden/.a.py", "eval"), ("b.py", "compile")}
    assert len(walk.committed(f"{state}-found")) == 2


def test_a_stream_that_dies_reads_the_same_files_again(spark, tmp_path, monkeypatch):
    tree, out, state = tmp_path / "tree", f"{tmp_path}/facts", f"{tmp_path}/state"
    plant(tree, {"shop/a.py": b"eval(x)\n"})
    whole = ingest.facts.code_facts
    monkeypatch.setattr(ingest.facts, "code_facts", lambda files: 1 / 0)
    with pytest.raises(Exception):
        ingest.ingest(spark, str(tree), out, state).awaitTermination()
    monkeypatch.setattr(ingest.facts, "code_facts", whole)
    plant(tree, {"shop/b.py": b"exec(x)\n"})
    ingest.ingest(spark, str(tree), out, state).awaitTermination()
    assert [r.relative_path for r in spark.read.parquet(out).filter("kind = 'file'").collect()] == ["a.py"]
    ingest.ingest(spark, str(tree), out, state).awaitTermination()
    rows = spark.read.parquet(out).filter("kind = 'call'").collect()
    assert sorted((r.relative_path, r.call.callee, r.batch) for r in rows) == [("a.py", "eval", 0), ("b.py", "exec", 1)]


def test_a_walk_that_dies_before_its_commit_leaves_the_log_as_it_was(spark, tmp_path, monkeypatch):
    tree, log = tmp_path / "tree", str(tmp_path / "log")
    plant(tree, {"shop/a.py": b"x"})
    monkeypatch.setattr(walk, "write_index", lambda rows, folder: rows.write.parquet(f"{folder}/files") or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        walk.discover(spark, str(tree), log)
    assert walk.committed(log) == {}
    monkeypatch.undo()
    assert walk.discover(spark, str(tree), log) == 1 and walk.discover(spark, str(tree), log) is None
    assert list(walk.committed(log)) == [1]
