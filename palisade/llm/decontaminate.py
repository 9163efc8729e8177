"""Benchmark decontamination: windows of benchmark words, kept as a hash set that travels with the scan, looked up at every position.

The hash set is a bit array over anchors, the grams of half a window that windows consist of. Every window of a text holds an anchor that
starts at a multiple of a fixed stride, so only those are hashed; windows around an anchor that passes are verified by joining their words
with the windows themselves. A hit is never a collision, and all occurrences in whole texts are found. The way is the same for a benchmark of
any size: the bit array has a greatest size, beyond which it lets more by, and the join, whose sides Spark sizes at run time, turns those away.

Defined cases: a null text has no words; an item without words has no windows; an item of fewer words than a window is one window of all
its words; windows that several items share count for each of them; an item without an id marks words but is not counted or listed; rows
that repeat are judged each on its own; an empty benchmark leaves every document clean; other columns pass through untouched.
"""

from __future__ import annotations

from palisade.llm.common import ascii_lower, bit_at, bit_words, bits_literal, covered, cut_lineage, let, text_or_empty, words
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
# What stands between words once A to Z are lower case, and before that.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Greatest size of a bit array, 4 MB; it holds half a million anchors at 64 bits each.
MAX_BITS = 1 << 25


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), BETWEEN)


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct windows and the items they occur in, as ``(item_id, length, gram)``."""
    items = benchmark.select("item_id", item_words(text_or_empty("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(width))
    windows = items.select(
        "item_id", length.alias("length"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))).alias("window"),
    )
    return windows.select("item_id", F.col("length").cast("long").alias("length"), F.array_join("window", " ").alias("gram")).distinct()


def _positions(hash_: Column, bits: int) -> tuple[Column, Column]:
    mask = F.lit(bits - 1).cast("long")
    return hash_.bitwiseAND(mask), F.shiftrightunsigned(hash_, 32).bitwiseAND(mask)


def anchor_of(length: int) -> int:
    """Words of an anchor, the shorter gram looked up first.

    At every ``length - anchor + 1``-th position of a text starts an anchor; every window of ``length`` words holds one of these whole.
    """
    return max(1, length // 2)


class HashSet:
    """Hashes as a bit array constant of 64 to 128 bits each, or less at the greatest size; ``has`` is never wrongly false."""

    def __init__(self, hashes: DataFrame):
        self.bits = min(MAX_BITS, 1 << max(10, (max(1, hashes.count()) * 64 - 1).bit_length()))
        held = bit_words(hashes.select(F.explode(F.array(*_positions(F.col("hash"), self.bits))).alias("position")))
        self.array = bits_literal(held, self.bits)

    def has(self, hash_: Column) -> Column:
        first, second = _positions(hash_, self.bits)
        return bit_at(self.array, first) & bit_at(self.array, second)


def _candidates(found: Column, length: int, anchors: HashSet) -> Column:
    """Starts in ``found`` of windows of ``length`` words around anchors of the benchmark, with the words there."""
    last, anchor = F.size(found) - length, anchor_of(length)
    stride = length - anchor + 1
    hashes = F.transform(F.sequence(F.lit(0), F.size(found) - anchor, F.lit(stride)), lambda i: F.xxhash64(F.slice(found, i + 1, F.lit(anchor))))
    hit = F.filter(F.transform(hashes, lambda h, i: F.when(anchors.has(h), i * stride)), lambda i: i.isNotNull())
    around = F.flatten(F.transform(hit, lambda i: F.sequence(F.greatest(i - (stride - 1), F.lit(0)), i)))
    starts = F.filter(around, lambda i: i <= last)
    found_here = F.transform(starts, lambda i: F.struct(
        i.cast("long").alias("start"), F.lit(length).cast("long").alias("length"),
        F.array_join(F.slice(found, i + 1, F.lit(length)), " ").alias("gram")))
    return F.when(last >= 0, found_here).otherwise(F.array())


def occurrences(documents: DataFrame, windows: DataFrame, row: Column) -> tuple[DataFrame, DataFrame]:
    """``(rid, row, n_words, open)`` of every document, and its occurrences ``(rid, start, length, gram)`` of ``windows(length, gram)``.

    ``row`` is what the caller wants back of each document. It is written once, next to the candidates, so that the texts are scanned once;
    from there only what was found moves. Documents that are not ``open`` have no occurrences.
    """
    grams = cut_lineage(windows.select("length", "gram").distinct())
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())  # 1 to ``width``
    parts = []
    for n in lengths:
        window = F.split("gram", " ")
        pieces = F.transform(F.sequence(F.lit(1), F.lit(n - anchor_of(n) + 1)), lambda i: F.xxhash64(F.slice(window, i, F.lit(anchor_of(n)))))
        anchors = HashSet(grams.filter(F.col("length") == n).select(F.explode(pieces).alias("hash")).distinct())
        parts.append(lambda found, n=n, anchors=anchors: _candidates(found, n, anchors))
    nothing = F.array().cast("array<struct<start:bigint,length:bigint,gram:string>>")
    judged = let(item_words(text_or_empty("text")), lambda found: F.struct(
        F.size(found).cast("long").alias("n_words"), (F.concat(*(p(found) for p in parts)) if parts else nothing).alias("candidates")))
    scanned = cut_lineage(
        documents.select(row.alias("row"), judged.alias("judged"))
        .select(F.monotonically_increasing_id().alias("rid"), "row", "judged.n_words", "judged.candidates")
    )
    places = scanned.select("rid", F.explode("candidates").alias("at")).select("rid", "at.*")
    return scanned.select("rid", "row", "n_words", (F.size("candidates") > 0).alias("open")), cut_lineage(places.join(grams, ["length", "gram"]))


def spans_of(hits: DataFrame) -> DataFrame:
    """``(rid, spans)``: the occurrences (start, length) of documents that have some."""
    return hits.groupBy("rid").agg(F.collect_set(F.struct("start", "length")).alias("spans"))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document its words, hit words and the items found in it."""
    windows = cut_lineage(windows_of(benchmark, width))
    scanned, hits = occurrences(documents.select("doc_id", "text"), windows, F.col("doc_id"))
    # Items meet windows only once these are known to occur in a document, however many items share one.
    named = hits.select("rid", "length", "gram").distinct().join(windows.filter("item_id is not null"), ["length", "gram"])
    items = named.groupBy("rid").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    open_ = scanned.filter("open").join(spans_of(hits), "rid", "left").join(items, "rid", "left")
    ids = F.array().cast("array<string>")
    clean = scanned.filter("not open").select("row", "n_words", F.lit(0).cast("long").alias("n_hit"), ids.alias("items"))
    hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    found = clean.unionByName(open_.select("row", "n_words", hit.alias("n_hit"), F.coalesce("items", ids).alias("items")))
    return found.select(
        F.col("row").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words inside ``spans`` and what follows each of them up to the next word.

    The words hit become ranges first, and what lies between ranges is taken in slices, so that the cost follows the length of the text.
    """
    def rebuilt(parts: Column) -> Column:
        pieces, between = parts["pieces"], parts["between"]
        lead = (F.get(pieces, F.lit(0)) == "").cast("long")  # the text starts with something else than a word
        units = F.transform(pieces, lambda word, i: F.concat(word, F.coalesce(F.get(between, i), F.lit(""))))
        places = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))

        def kept(hit: Column) -> Column:
            before = F.filter(hit, lambda p, i: (i == 0) | (F.get(hit, i - 1) != p - 1))
            after = F.transform(F.filter(hit, lambda p, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != p + 1)), lambda p: p + 1)
            ends = F.concat(F.transform(before, lambda p: p + lead), F.array(F.size(pieces).cast("long")))
            starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(after, lambda p: p + lead))
            gaps = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))), lambda g: g["n"] > 0)
            return let(units, lambda unit: F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(unit, (g["a"] + 1).cast("int"), g["n"].cast("int")), "")), ""))

        return let(places, kept)

    pieces = F.split(text, CASED_BETWEEN, -1)
    return let(F.struct(pieces.alias("pieces"), F.regexp_extract_all(text, F.lit(CASED_BETWEEN), F.lit(0)).alias("between")), rebuilt)


def decontaminated(documents: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, width: int = WINDOW) -> DataFrame:
    """``documents`` without benchmark passages.

    Hit words are cut out of the text; a document of whose words at least ``drop_share`` are hit is dropped. Clean documents are
    returned unchanged. ``n_chars`` follows the text where the column exists. A document is found again by its id and the hash of its text, so
    only what was found in it is stored and moved.
    """
    columns = documents.columns
    key = F.struct(F.col("doc_id"), F.xxhash64(text_or_empty("text")).alias("body"))
    scanned, places = occurrences(documents.select("doc_id", "text"), windows_of(benchmark, width), key)
    found = scanned.filter("open").join(spans_of(places), "rid")
    hits = cut_lineage(found.select(F.col("row.doc_id").alias("hit_id"), F.col("row.body").alias("hit_body"), "n_words", "spans").dropDuplicates(["hit_id", "hit_body"]))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64(text_or_empty(F.col("row.text"))) == F.col("hit_body"))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0))
    kept = rows.join(hits, same, "left").withColumn("n_hit", n_hit).filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words") * drop_share))
    kept = kept.select("row", F.when(F.col("n_hit") > 0, without_spans(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text")).alias("cut"))
    new = {"text": F.col("cut")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("cut").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("cut").cast("long"))
    return kept.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))
