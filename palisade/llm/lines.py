"""Line dedup: passages that repeat across the corpus, found as windows of three consecutive lines.

Every document contributes the hashes of its overlapping windows; lines are compared without the blanks around them and empty lines do not
count. The first place of a window (smallest document, then position) stays, and every later place is removed. Places of one document are
merged, so that a passage of any length goes as a whole.

Defined cases: a null text has no lines; a document with fewer lines than a window has none and stays as it is; a document that repeats a
passage of its own loses the later ones; rows with the same id and text are one document and get the same result; a null id comes after all
others; an empty table gives an empty one; other columns pass through untouched.
"""

from __future__ import annotations

from palisade.llm.common import let, text_or_empty
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
BLANK = " \t\x0b\f\r"


def places(text: Column, window: int = WINDOW) -> Column:
    """Windows of a text as ``(line, last, hash)``: the first and last line of each in ``split(text, '\\n')``, from 0."""
    def numbered(lines: Column) -> Column:
        return F.filter(
            F.transform(lines, lambda line, i: F.struct(i.alias("line"), F.btrim(line, F.lit(BLANK)).alias("text"))), lambda x: x["text"] != "")

    def windows(full: Column) -> Column:
        def one(i: Column) -> Column:
            part = F.slice(full, i + 1, F.lit(window))
            return F.struct(
                F.get(full, i)["line"].alias("line"), F.get(full, i + (window - 1))["line"].alias("last"),
                F.xxhash64(F.transform(part, lambda x: x["text"])).alias("hash"))

        return F.when(F.size(full) >= window, F.transform(F.sequence(F.lit(0), F.size(full) - window), one))

    return let(numbered(F.split(text, "\n", -1)), windows)


def repeated(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, body, spans)`` for documents with something to remove: lines ``start`` to ``start + length - 1`` of each span.

    ``body`` is the hash of the text, which with the id names a document.
    """
    text = documents.select("doc_id", text_or_empty("text").alias("text"))
    windows = text.select("doc_id", F.xxhash64("text").alias("body"), F.explode(places(F.col("text"), window)).alias("w")).select("doc_id", "body", "w.*")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body", "line")
    # One row per window leaves each map task, however often a window repeats; only windows seen twice go on.
    first = windows.groupBy("hash").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, "hash").filter(order > F.col("first"))
    return later.groupBy("doc_id", "body").agg(
        F.collect_set(F.struct(F.col("line").alias("start"), (F.col("last") - F.col("line") + 1).alias("length"))).alias("spans"))


def without_lines(text: Column, spans: Column) -> Column:
    """``text`` without the lines of ``spans``, which are merged first; an array of the lines that stay."""
    def merged(ordered: Column) -> Column:
        start = F.array().cast("array<struct<start:int,end:int>>")

        def step(held: Column, s: Column) -> Column:
            last, end = F.element_at(held, -1), s["start"] + s["length"]
            joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
            return F.when((F.size(held) > 0) & (s["start"] <= F.try_element_at(held, F.lit(-1))["end"]), F.array_append(F.slice(held, 1, F.size(held) - 1), joined)).otherwise(
                F.array_append(held, F.struct(s["start"].alias("start"), end.alias("end"))))

        return F.aggregate(ordered, start, step)

    def kept(parts: Column) -> Column:
        inside = lambda i: F.exists(parts["ranges"], lambda r: (i >= r["start"]) & (i < r["end"]))
        return F.filter(parts["lines"], lambda _, i: ~inside(i))

    return let(F.struct(F.split(text, "\n", -1).alias("lines"), merged(F.array_sort(spans)).alias("ranges")), kept)


def deduplicated(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, text, n_lines, n_removed)`` of every document: its columns as they are, its text without repeated passages, its lines."""
    found = repeated(documents.select("doc_id", "text"), window)
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_or_empty("text")).alias("body"))
    joined = rows.join(found.withColumnRenamed("body", "found_body"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("body") == F.col("found_body")), "left")
    lines = lambda text: F.when(text_or_empty(text) == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1)))
    text = F.col("row.text")
    changed = let(without_lines(text, F.col("spans")), lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (lines(text) - F.size(kept)).alias("n_removed")))
    same = F.struct(text.alias("text"), F.lit(0).alias("n_removed"))
    return joined.select("row", lines(text).cast("long").alias("n_lines"), F.when(F.col("spans").isNotNull(), changed).otherwise(same).alias("new")).select(
        "row", "new.text", "n_lines", F.col("new.n_removed").cast("long").alias("n_removed"))
