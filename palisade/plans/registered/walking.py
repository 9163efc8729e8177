"""Source trees on a file system: the walk, what it survives, filters in the source, and ingest as a stream.

The trees are written by the executors, one file a row of the driver's tables, into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.catalog import technology as t
from palisade.operators import inventory as inv, source_rules
from palisade.plans.catalogue import register, twin
from palisade.plans.registered.code import EXPECTED_SCRIPT_FINDINGS, SCRIPT_ROWS, values
from palisade.plans.registered.inventory import INVENTORY, TREE
from palisade.session import shared_folder
from palisade.sources import bindings as b, files, modules, trees, walk
from palisade.streaming import events as streams, ingest

LIMIT = 20_000


def _walked(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The odd tree on disk and its names; the files that go away do so after they are listed."""
    root = shared_folder(spark, "tree")
    trees.write_tree(trees.odd_tree(spark, sf_dir), root)
    found = walk.names(spark, root, t.IGNORED_DIRECTORIES)
    trees.remove_files(walk.files_of(found).filter("relative_path like '%/gone.py'"), root)
    return root, found


def _inventory(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    index = walk.write_index(walk.looked_at(walk.files_of(found), root), shared_folder(spark, "index"))
    return inv.inventory(files.indexed_tree(spark, root, index, LIMIT), LIMIT)


ODD = """select project_id, relative_path, language, size_bytes, case when skip_reason in ('ignored_filename') then skip_reason when size_bytes > 20000 then 'file_too_large' else skip_reason end as skip_reason,
  is_code, body from inventory
union all select lang, 'd/' || doc_id || '/gone.py', 'Python', null, 'stat_failed', true, null from documents where doc_id % 7 = 0
union all select lang, 'd/' || doc_id || '/socket.py', 'Python', 0, 'read_failed', true, null from documents where doc_id % 7 = 1
union all select lang, 'd/' || doc_id || '/link.py', 'Python', null, 'symbolic_link', true, null from documents where doc_id % 7 = 2
union all select lang, 'd/' || doc_id || '/pkg/__init__.py', 'Python', 0, null, true, '' from documents where doc_id % 7 = 4"""


@register("walked_inventory", "SRC-1 SRC-2 SRC-3 SRC-5 SRC-6 SRC-7", twin(
    r"""select project_id, relative_path, case when skip_reason is null then language end as language, cast(size_bytes as bigint) as size_bytes, skip_reason,
  case when skip_reason is null then sha256(body) end as sha256,
  cast(case when skip_reason is null then len(regexp_extract_all(body, '\r\n|\r|\n')) + case when body <> '' and right(body, 1) not in (chr(10), chr(13)) then 1 else 0 end end as int) as line_count
from odd""", tree=TREE, inventory=INVENTORY, odd=ODD))
def walked_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of a walked tree, with files that vanish and cannot be read."""
    return _inventory(spark, *_walked(spark, sf_dir)).select("project_id", "relative_path", "language", "size_bytes", "skip_reason", "sha256", "line_count")




@register("walked_totals", "SRC-1 SRC-9", twin(
    """select c.project_id, cast(c.total as bigint) as total_files, cast(c.skipped as bigint) as skipped_file_count, cast(c.bytes as bigint) as total_size_bytes,
  cast(f.folders as bigint) as visited_directories, cast(0 as bigint) as failed_directories
from (select project_id, count(*) filter (where skip_reason is null) as total, count(*) filter (where skip_reason is not null) as skipped,
    coalesce(sum(size_bytes) filter (where skip_reason is null), 0) as bytes from odd group by 1) c
join (select d.lang as project_id, 2 + count(*) + sum(case when p.k in (6, 14) then 0 else len(string_split(p.path, '/')) - 1 end)
    + count(*) filter (where d.doc_id % 7 = 3) * 2 + count(*) filter (where d.doc_id % 7 = 4) as folders
  from documents d join tree_paths p on p.k = cast(substr(d.source, 4) as int) group by 1) f using (project_id)""",
    tree=TREE, inventory=INVENTORY, odd=ODD, tree_paths="select distinct k, regexp_replace(relative_path, '^d/[0-9]+/', '') as path from (select k, min(relative_path) as relative_path from tree group by k)"))
def walked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a walked tree with all folders that the walk entered, empty ones included."""
    root, found = _walked(spark, sf_dir)
    totals = inv.inventory_totals(_inventory(spark, root, found)).drop("visited_directories", "source_file_count")
    return totals.join(walk.visited(found), "project_id")


@register("pushed_tree_files", "SRC-1 SRC-15", twin(
    """select source as project_id, source || '/' || lang || '/' || cast(doc_id as varchar) || '.py' as relative_path, cast(strlen(text) as bigint) as size_bytes, sha256(text) as sha256
from documents where source in ('src1', 'src3', 'src7') and cast(doc_id as varchar) like '%7'"""))
def pushed_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of some projects and one suffix: both filters reach the source, which opens nothing else."""
    root = shared_folder(spark, "tree")
    content = F.encode("content", "utf-8").alias("content")
    trees.write_tree(b.source_files(spark, sf_dir).select("project_id", "relative_path", F.lit("file").alias("kind"), content), root)
    tree = files.indexed_tree(spark, root, walk.index(spark, root, files_per_task=200))
    wanted = tree.filter(F.col("project_id").isin("src1", "src3", "src7") & F.col("relative_path").endswith("7.py"))
    return wanted.select("project_id", "relative_path", "size_bytes", F.sha2("content", 256).alias("sha256"))


@register("stream_ingest_facts", "STR-10 SRC-10 DSC-0", twin(
    f"""select s.project_id, s.relative_path, e.rule_id, cast(e.line_start as int) as line_start, cast(e.column_start as int) as column_start,
  replace(e.function_name, '{{n}}', s.n) as function_name, e.class_name, replace(e.evidence, '{{n}}', s.n) as evidence
from scripts s join {values(EXPECTED_SCRIPT_FINDINGS, 'e(k, rule_id, line_start, column_start, function_name, class_name, evidence)')} on e.k = s.k
union all select project_id, regexp_replace(relative_path, '[^/]+$', '__init__.py'), 'CODE-001', 1, 1, null, null, 'eval(source)' from scripts
group by all""", scripts=SCRIPT_ROWS))
def stream_ingest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that arrive in two steps, read as a stream that is started twice, with the rules over the facts it has stored.

    The first step leaves an empty ``__init__.py`` in every folder, the second one with code; the later one counts.
    """
    folder = streams.run_folder(spark)
    root, out, state = f"{folder}/tree", f"{folder}/facts", f"{folder}/state"
    scripts = modules.scripts(spark, sf_dir).select("project_id", "relative_path", F.lit("file").alias("kind"), F.encode("content", "utf-8").alias("content"))
    packages = scripts.select("project_id", F.regexp_replace("relative_path", "[^/]+$", "__init__.py").alias("relative_path"), "kind").distinct()
    first = F.pmod(F.xxhash64("relative_path"), F.lit(2)) == 0
    for part, text in ((scripts.filter(first), b""), (scripts.filter(~first), b"eval(source)\n")):
        trees.write_tree(part.unionByName(packages.withColumn("content", F.lit(text))), root)
        ingest.ingest(spark, root, out, state).awaitTermination()
    return source_rules.source_findings(ingest.current_facts(spark, out)).select(
        "project_id", "relative_path", "rule_id", "line_start", "column_start", "function_name", "class_name", "evidence")
