"""Work that must not be repeated, and tasks and rows that must stay bounded as tables grow."""

import os
import time
from datetime import datetime

from pyspark.sql import functions as F

from palisade.operators import discovery, facts, findings as ops, ranking, relations
from palisade.plans.registered import findings as plans
from palisade.sources import bindings as b, modules, snapshots, trees, walk

AT = datetime(1998, 7, 1)


def tables(spark, folder):
    """Ten orders of three lines each, and five parts."""
    spark.createDataFrame([(i, f"part {i}", f"Brand#{i + 10}", "STANDARD" if i % 2 else "PROMO", i, 1.0) for i in range(5)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i, i % 4, "F", 1.0, AT, "2-HIGH") for i in range(10)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    lines = [(i % 10, i % 5, i % 3, i // 10, 10.0 * (i % 5), 1.0 * i, 0.0, 0.0, "NAR"[i % 3], "FO"[i % 2], AT.replace(month=6 + i % 3)) for i in range(30)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_findings_come_in_pieces_of_bounded_size(spark, tmp_path, monkeypatch):
    sf_dir = tables(spark, tmp_path)
    monkeypatch.setattr(b, "FINDINGS_PER_TASK", 3)
    assert b.finding_tasks(spark, sf_dir) == 10
    cut, plain = b.findings(spark, sf_dir, 10), b.findings(spark, sf_dir)
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect())) and cut.count() == 30
    found = plans.knowledge_enrichment(spark, sf_dir)
    assert found.agg(F.sum("n")).first()[0] == 30
    assert cut.rdd.getNumPartitions() == 10


def test_changes_do_not_depend_on_the_number_of_tasks(spark, make):
    before = make([(1, "a"), (1, "b"), (None, "c")], "p int, k string")
    after = make([(1, "b"), (2, "b"), (2, "b"), (None, "c")], "p int, k string")
    plain, cut = (sorted(map(tuple, relations.finding_changes(before, after, ["p", "k"], n).collect()), key=str) for n in (None, 7))
    assert plain == cut == [(1, "a", "resolved"), (1, "b", "persisting"), (2, "b", "new"), (None, "c", "persisting")]


def test_numbering_stores_only_what_is_shown_or_orders(spark, tmp_path, monkeypatch):
    seen = []
    real = ops.numbered
    monkeypatch.setattr(ops, "numbered", lambda frame, *more: seen.append(frame.columns) or real(frame, *more))
    assert plans.normalised_findings(spark, tables(spark, tmp_path)).count() > 0
    assert not {"method", "path", "description", "category", "confidence", "found_at"} & set(seen[0])


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {n for n in names if n.rsplit("/", 1)[-1].startswith("shuffle_")}


def mixed_tables(spark, folder):
    """``tables`` with other findings: three to an endpoint, of different rules, and two repeats of the first endpoint's."""
    sf_dir = tables(spark, folder)
    lines = [(i % 10, (i + i // 10) % 5, i % 3, i // 10, 10.0 * (i % 6), 1.0 * i, 0.0, 0.0, "NAR"[i % 3], "FO"[i % 2], AT) for i in [*range(30), 0, 10]]
    spark.createDataFrame(lines, spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema).write.parquet(f"{sf_dir}/mixed")
    spark.read.parquet(f"{sf_dir}/mixed").write.mode("overwrite").parquet(f"{sf_dir}/lineitem.parquet")
    return sf_dir


def test_findings_in_pieces_are_all_findings_and_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    sf_dir = mixed_tables(spark, tmp_path)
    whole = sorted(map(str, plans.normalised_findings(spark, sf_dir).collect()))
    monkeypatch.setattr(b, "FINDINGS_PER_PIECE", 12)
    pieces = b.finding_pieces(spark, sf_dir)
    assert pieces == [(0, 3), (1, 3), (2, 3)]
    of = [{r.endpoint_id for r in b.findings(spark, sf_dir, piece=p).select("endpoint_id").collect()} for p in pieces]
    assert len(set.union(*of)) == sum(map(len, of)) == 10
    monkeypatch.setattr(b, "MOST_PIECES", 2)
    assert b.finding_pieces(spark, sf_dir) == [(0, 2), (1, 2)]
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    setting = spark.conf.get(key, None)
    found = plans.normalised_findings(spark, sf_dir)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:  # they are deleted beside the query
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(key, None) == setting
    assert sorted(map(str, found.collect())) == whole and len(whole) == 30
    assert not shuffle_files(spark) - before  # what is read last has been worked out and is not moved again


def test_only_crowded_endpoints_are_cut_into_ranges(spark, tmp_path, monkeypatch):
    sf_dir = mixed_tables(spark, tmp_path)
    whole = sorted(map(str, plans.normalised_findings(spark, sf_dir).collect()))
    cuts, real = [], ranking.ranges
    monkeypatch.setattr(ranking, "ranges", lambda frame, *more: cuts.append(frame.count()) or real(frame, *more))
    assert b.crowded_endpoints(spark, sf_dir) == []
    assert sorted(map(str, plans.normalised_findings(spark, sf_dir).collect())) == whole and cuts == []
    monkeypatch.setattr(b, "FINDINGS_PER_TASK", 2)
    monkeypatch.setattr(b, "FINDINGS_PER_PIECE", 11)
    assert sorted(b.crowded_endpoints(spark, sf_dir)) == list(range(10))
    assert sorted(map(str, plans.normalised_findings(spark, sf_dir).collect())) == whole and sum(cuts) == 30


def test_numbering_is_the_same_whichever_keys_are_called_crowded(spark, make):
    rows = make([(k, i % 7, i) for i in range(300) for k in ([1, 2, None][i % 3],)], "k int, at int, n int")
    order = [F.asc("at"), F.desc("n")]
    plain, *others = (sorted(map(str, ranking.numbered(rows, ["k"], order, "no", "total", c).select("k", "n", "no", "total").collect())) for c in (None, [], [1], [1, 2, 3]))
    assert all(o == plain for o in others) and len(plain) == 300
    assert "_slice" not in ranking.numbered(rows, ["k"], order, "no", "total", [])._jdf.queryExecution().toString()


def counted(spark, rows, log):
    """``rows`` that leave a line in ``log`` for each time one of them is made."""
    def run(batches):
        for batch in batches:
            with open(log, "a") as out:
                out.write("x\n" * batch.num_rows)
            yield batch

    return rows.mapInArrow(run, rows.schema)


def test_rows_of_a_version_are_made_once(spark, make, tmp_path):
    log, root = f"{tmp_path}/log", f"{tmp_path}/table"
    for n in (1, 2):
        snapshots.replace(counted(spark, make([(i, n) for i in range(10 // n)], "k long, n int"), log), root, ["k"], n)
    assert len(open(log).readlines()) == 15
    assert sorted(map(tuple, snapshots.read(spark, root).collect())) == [(i, 2) for i in range(5)] + [(i, 1) for i in range(5, 10)]
    # A version that has the columns in another order and as another type.
    snapshots.replace(make([(9, 3)], "n int, k int"), root, ["k"], 3)
    assert snapshots.read(spark, root).filter("k = 3").first().asDict() == {"k": 3, "n": 9} and snapshots.read(spark, root).count() == 10


def test_facts_of_some_kinds_are_those_among_all(spark):
    files = spark.createDataFrame([(str(i), f"{i}.py", "python", t) for i, t in enumerate(modules.ROUTE_MODULES)], "project_id string, relative_path string, language string, content string")
    some = facts.code_facts(files, discovery.ENDPOINT_FACTS)
    every = facts.code_facts(files)
    assert {r.kind for r in some.select("kind").distinct().collect()} == {"function"}
    assert sorted(map(str, some.collect())) == sorted(map(str, every.filter("kind = 'function'").collect()))


def test_the_lean_walk_sees_the_nodes_of_the_full_one():
    import ast

    skipped = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)
    for text in modules.ROUTE_MODULES + modules.SCRIPTS:
        try:
            tree = ast.parse(text)
        except SyntaxError:
            continue
        assert [type(n) for n in facts.walk(tree)] == [type(n) for n in ast.walk(tree) if not isinstance(n, skipped)]


def test_a_tree_that_comes_as_one_part_is_written_by_all_cores(spark, make, tmp_path):
    by = f"{tmp_path}/by"
    os.makedirs(by)
    rows = make([("p", f"d/{i}.py", "file", bytearray(b"x")) for i in range(64)], "project_id string, relative_path string, kind string, content binary").coalesce(1)

    def act(system, path, values):
        from pyspark import TaskContext

        open(f"{by}/{TaskContext.get().partitionId()}", "w").close()

    assert trees._each(rows, ["kind", "content"], str(tmp_path), act, spread=True) == 64 and len(os.listdir(by)) > 4
    assert trees.write_tree(rows, f"{tmp_path}/tree") == 64 == len(os.listdir(f"{tmp_path}/tree/p/d"))


def test_a_level_of_many_folders_has_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    for i in range(40):
        os.makedirs(f"{tmp_path}/tree/p{i}/d")
        open(f"{tmp_path}/tree/p{i}/d/a.py", "w").close()
    sizes, real = [], walk.cut_lineage
    monkeypatch.setattr(walk, "TASKS_PER_CORE", 1)
    monkeypatch.setattr(walk, "cut_lineage", lambda frame: sizes.append(frame.rdd.getNumPartitions()) or real(frame))
    assert walk.files_of(walk.names(spark, f"{tmp_path}/tree", folders_per_task=1)).count() == 40
    assert max(sizes) <= spark.sparkContext.defaultParallelism
