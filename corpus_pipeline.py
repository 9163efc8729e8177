"""Training-data pipeline over ``documents``: classify, remove repeated passages, keep one of near copies, decontaminate, mix.

Every stage takes the documents that the stage before kept, as written and read again, and returns documents; the last returns the mix, one
row for every copy taken. Tables other than ``documents`` are read from the folder of the input.

Defined cases, in every stage: a null text is like an empty one and stays null; nulls in other columns and further columns pass through, whatever
their names; texts of any length are taken whole; rows of one id and one text are one document and stay or go together; an empty table gives an
empty one. What a stage adds to that stands at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from palisade.llm import cotraining, decontaminate, lines, mixing, simhash
from palisade.llm.common import cut_lineage, text_or_empty
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject. Without labels of both kinds nothing is rejected; one at the threshold stays."""
    return cotraining.kept(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of three or more lines that stand elsewhere before; those of which nothing is left go.

    Places are ordered by id, nulls last, then by text. A text of which nothing is removed stays as it is, blank or null ones too.
    """
    done = lines.deduplicated(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    left = done.filter((F.col("n_removed") == 0) | (F.btrim(text_or_empty("text"), F.lit(" \t\n\x0b\f\r")) != ""))
    return left.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that of the smallest id, nulls last. Texts without words are copies of each other."""
    return simhash.deduplicated(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that consist mostly of them go. ``n_chars`` stays, null or not, where the text does."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many ``_`` behind it as make it a column that is not there; names that differ by case are one."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is taken, numbered by ``copy`` from 1 (``copy_`` where the documents have such a column, and so on).

    Documents without words are not taken. What is taken of repeated rows together is dealt out to them evenly, so a source meets its target.
    """
    taken = mixing.mix(docs).groupBy("doc_id", "body", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    plan = cut_lineage(taken.filter("copies > 0").withColumnsRenamed({"doc_id": "plan_id", "body": "plan_body", "source": "plan_source"}))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = (
        F.col("row.doc_id").eqNullSafe(F.col("plan_id")) & (F.xxhash64(text_or_empty(F.col("row.text"))) == F.col("plan_body"))
        & F.col("row.source").eqNullSafe(F.col("plan_source"))
    )
    found = rows.join(plan, same)
    # Only rows whose copies do not divide evenly are numbered; which of the equal rows gets one more is told by their other columns.
    uneven = F.col("copies") % F.col("n") > 0
    place = F.row_number().over(Window.partitionBy("plan_id", "plan_body", "plan_source").orderBy(F.xxhash64("row")))
    even = found.filter(~uneven).select("row", F.expr("copies div n").alias("copies"))
    rest = found.filter(uneven).withColumn("place", place).select("row", F.expr("copies div n + if(place <= copies % n, 1, 0)").alias("copies"))
    copy = free_name(docs.columns, "copy")
    mixed = even.unionByName(rest).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return mixed.select("row.*", F.col("copy").alias(copy))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]
# The classifier is trained, so SQL cannot give the rows; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
