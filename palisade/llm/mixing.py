"""Mixing sources to target weights by entropy balancing.

Every source gets a target number of words. A document of ``x`` words (in multiples of its source's mean) is taken at the rate
``2 / (1 + exp(-t x))``: the rates of largest entropy between 0 and 2, measured against one copy each, that meet the word constraint of the
source. ``t`` solves the convex dual by Newton's method, all sources at once: each step is one aggregation over the number of documents of
every (source, size), which is all the dual depends on. Rates become copies by systematic rounding along the sizes of a source, at the
offset, out of a fixed few, that comes nearest to the target.

Defined cases: a null or empty text has size 0, is never taken, and does not change its source; a source of such documents alone has the
target 0; a null source is a source, the last; documents of one source and size differ by the hash of their id and text, so reruns agree,
and repeated rows are rows; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from palisade.llm.common import BLANKS, cut_lineage, text_or_empty
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST = 2  # copies of a document
STEPS = 40
TOLERANCE = 1e-9
OFFSETS = 64
# Documents of one (source, size) that one task ranks, in the mean.
RANKED = 5000


def size_of(text: Column) -> Column:
    """Number of words: one more than the gaps inside the trimmed text."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANKS, -1))).cast("long")


def targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, n, target)`` of ``cells(source, size, n)``.

    Sources weigh ``weights`` in turn, by code point and null last. What a source's target exceeds ``most`` times its size by is shared among
    the others by weight, until no target does. One row per source takes part.
    """
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    held = cut_lineage(sources.withColumn("weight", weight).withColumn("full", F.lit(False)))
    limit = F.col("source_size") * float(most)
    while True:
        total = held.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), limit)).alias("full"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight")).first()
        # What one unit of weight gets of the words that full sources leave.
        unit = (share * (total["all"] or 0) - (total["full"] or 0.0)) / total["weight"] if total["weight"] else 0.0
        shared = F.col("weight") * F.lit(unit)
        above = held.filter(~F.col("full") & (shared > limit))
        if above.isEmpty():
            return held.select("source", "source_size", "n", F.when(F.col("full"), limit).otherwise(shared).alias("target"))
        held = cut_lineage(held.withColumn("full", F.col("full") | (shared > limit)))


def rate(t: Column, x: Column, most: int = MOST) -> Column:
    return F.lit(float(most)) / (1 + F.exp(-t * x))


def solve(cells: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """``aims`` with ``mean``, its mean size, and ``t``, the dual variable of its source; ``t`` is null where every document is taken ``most`` times.

    Newton's method, kept inside a bracket that shrinks at every step and halved where a step would leave it.
    """
    scaled = aims.withColumn("mean", F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-300)))
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(most) * (1 - 1e-12))
    state = scaled.select("source", "target", "mean", F.lit(0.0).alias("t"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), open_.alias("open"))
    state = cut_lineage(state.filter("open").drop("open"))
    solved = []
    for _ in range(STEPS):
        if state.isEmpty():
            break
        at = cells.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("x", F.col("size") / F.col("mean"))
        r = rate(F.col("t"), F.col("x"), most)
        step = at.groupBy("source").agg(
            *(F.first(c).alias(c) for c in ("target", "mean", "t", "low", "high")),
            F.sum(F.col("n") * F.col("size") * r).alias("words"), F.sum(F.col("n") * F.col("size") * F.col("x") * r * (1 - r / most)).alias("slope"))
        short = F.col("words") < F.col("target")
        step = step.withColumn("low", F.when(short, F.col("t")).otherwise(F.col("low"))).withColumn("high", F.when(short, F.col("high")).otherwise(F.col("t")))
        newton = F.col("t") + F.try_divide(F.col("target") - F.col("words"), F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        near = F.abs(F.col("words") - F.col("target")) <= TOLERANCE * F.col("target")
        moved = F.when(near, F.col("t")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        done = cut_lineage(step.select("source", "target", "mean", moved.alias("t"), "low", "high", near.alias("near")))
        solved.append(done.filter("near").select("source", "t"))
        state = done.filter("not near").drop("near")
    solved.append(state.select("source", "t"))
    known = reduce(DataFrame.unionByName, solved).withColumnRenamed("source", "s")
    return scaled.join(known, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def cell_copies(cells: DataFrame, solved: DataFrame, most: int = MOST) -> DataFrame:
    """Copies that each (source, size) gets in all, by systematic rounding; also what each document gets at least and how many get one more."""
    with_rate = cells.join(solved.drop("n", "source_size").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    r = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("t").isNull(), F.lit(float(most))).otherwise(rate(F.col("t"), F.col("size") / F.col("mean"), most))
    r = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(r)
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut_lineage(
        with_rate.withColumn("expected", F.col("n") * r).withColumn("upto", F.sum("expected").over(along))
        .select("source", "size", "n", "target", "expected", "upto"))
    # Sums of doubles end a little beside whole numbers.
    whole = lambda value: F.floor(value + 1e-7)
    copies = lambda u: whole(F.col("upto") + u) - whole(F.col("upto") - F.col("expected") + u)
    offset = lambda k: (k + 0.5) / OFFSETS
    tried = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1))))
    sums = tried.groupBy("source", "k").agg(F.first("target").alias("target"), F.sum(copies(offset(F.col("k"))) * F.col("size")).alias("words"))
    best = sums.groupBy(F.col("source").alias("s")).agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("miss"), "k"))["k"].alias("k"))
    best = best.select("s", offset(F.col("k")).alias("u"))
    chosen = placed.join(best, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.least(copies(F.col("u")), F.col("n") * most))
    each = F.floor(F.col("copies") / F.col("n"))
    return chosen.select("source", "size", "n", each.alias("each"), (F.col("copies") - each * F.col("n")).alias("more"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(doc_id, body, source, size, source_size, target, copies)`` of every document; ``body`` is the hash of its text."""
    text = text_or_empty("text")
    sized = cut_lineage(documents.select("doc_id", "source", size_of(text).alias("size"), F.xxhash64(text).alias("body")))
    cells = cut_lineage(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    aims = targets(cells, weights, share, most)
    planned = cell_copies(cells, solve(cells, aims, most), most).withColumn("buckets", F.ceil(F.col("n") / RANKED))
    known = aims.select("source", "source_size", "target").withColumnRenamed("source", "a")
    planned = planned.join(known, F.col("source").eqNullSafe(F.col("a"))).drop("a")
    planned = cut_lineage(planned.withColumnsRenamed({"source": "s", "size": "z"}))
    ranked = sized.join(planned, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    hashed = F.xxhash64("doc_id", "body")
    ranked = cut_lineage(ranked.select("doc_id", "body", "source", "size", "source_size", "target", "each", "more", F.pmod(hashed, F.col("buckets")).alias("bucket"), hashed.alias("hash")))
    # The documents of a cell that get one more copy are its first by bucket and hash; a task ranks one bucket.
    cell = ("source", "size")
    held = ranked.filter("more > 0").groupBy(*cell, "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = held.select(*(F.col(c).alias(f"b_{c}") for c in (*cell, "bucket")), (F.sum("m").over(Window.partitionBy(*cell).orderBy("bucket")) - F.col("m")).alias("before"))
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket"))
    number = F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("hash", "doc_id", "body"))
    some = ranked.filter("more > 0").withColumn("number", number).join(before, same)
    out = ("doc_id", "body", "source", "size", "source_size", "target")
    more = some.select(*out, (F.col("each") + (F.col("before") + F.col("number") <= F.col("more")).cast("long")).alias("copies"))
    return more.unionByName(ranked.filter("more = 0").select(*out, F.col("each").cast("long").alias("copies")))
