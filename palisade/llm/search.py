"""Ranked lexical search by presence masks.

The documents are the table and the items are a stated set of queries, which meet the documents in blocks. One pass over the texts leaves the postings
of every document, the terms of items it holds and how often, and the counts that weigh a term. A second pass reads the postings in blocks of
documents. For an item every document of a block gets the bitmap of the item's terms that it holds, built by or-ing one bit per term into the documents
of that term; equal masks are one group. No document of a group can score more than the best that the block has for each of its terms, so groups are
scored in descending order of that bound until the worst of the ``top`` found so far is above the bound of the next. Every task keeps ``top``
documents an item, across its blocks, and only these are ranked together.

Defined cases: a null text has no terms, nor has an empty or blank one, and such documents are never found; an item without terms finds nothing; rows of
documents are documents of their own even if their id or text is repeated, equal scores rank by id, nulls last; rows of one item id are one item each
only if their texts differ: repeated rows are one; empty tables give no rows; other columns are not looked at. Texts are read whole, and what a task
holds of a text after counting are the terms that items have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from palisade.llm.common import cut_lineage
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
ITEM_TERMS = 1 << 18  # terms of the items that meet the documents at once
BLOCK_ROWS = 1 << 14
BLOCK_ENTRIES = 1 << 20
SCALE = 1_000_000_000

# A to Z become lower case, digits and letters and all bytes beyond ASCII stay, everything else is a blank.
_FOLD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(text: pa.Scalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().translate(_FOLD).split() if text.is_valid else []


# --- Items. ---


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, key, terms, times)`` of every item that has a term; ``key`` tells apart different texts of one id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(text)) for text in batch.column(2)]
            terms = pa.array([list(f) for f in found], pa.list_(pa.binary()))
            times = pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, times], ["item_id", "key", "terms", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.sha2("text", 256).alias("key"), F.encode("text", "utf-8").alias("text")).distinct()
    return rows.mapInArrow(run, f"item_id {kind}, key string, terms array<binary>, times array<long>").filter("size(terms) > 0")


def item_blocks(items: DataFrame, most: int = ITEM_TERMS) -> Iterator[pa.Table]:
    """The rows of ``item_terms`` in blocks of at most ``most`` terms (or one item): hash buckets, as many as that takes."""
    rows = cut_lineage(items)
    size, count = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-size // most))
    bucket = lambda n: F.pmod(F.xxhash64("item_id", "key"), F.lit(n))
    while buckets < count * 64:
        fits = rows.groupBy(bucket(buckets).alias("b")).agg(F.sum(F.size("terms")).alias("n"), F.count(F.lit(1)).alias("items"))
        if fits.filter((F.col("n") > most) & (F.col("items") > 1)).isEmpty():
            break
        buckets *= 2
    for b in range(buckets):
        block = rows.filter(bucket(buckets) == b).toArrow()
        if block.num_rows:
            yield block


@dataclass
class Queries:
    """The items of a block: for each, the numbers of its terms in ascending order and how often it has them."""

    ids: pa.Array
    numbers: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]


def queries_of(block: pa.Table) -> Queries:
    numbers: dict[bytes, int] = {}
    terms, times = [], []
    for found, n in zip(block.column("terms").to_pylist(), block.column("times").to_pylist()):
        at = np.array([numbers.setdefault(t, len(numbers)) for t in found], np.int32)
        order = np.argsort(at)
        terms.append(at[order])
        times.append(np.array(n, np.int64)[order])
    return Queries(block.column("item_id").combine_chunks(), numbers, terms, times)


# --- Postings. ---


def postings(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tf)`` of every document that has a term: the number of all its terms, and those of ``numbers`` with their counts."""
    shared = documents.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, sizes, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = terms_of(text)
                if found:
                    numbers = np.fromiter((n for n in map(known.get, found) if n is not None), np.int32)
                    own, tf = np.unique(numbers, return_counts=True)
                    rows.append(i)
                    sizes.append(len(found))
                    terms.append(own)
                    counts.append(tf)
            ends = np.cumsum([0, *map(len, terms)]).astype(np.int32)
            flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, flat(terms, np.int32)),
                pa.ListArray.from_arrays(ends, flat(counts, np.int32))], ["doc_id", "n", "terms", "tf"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.encode("text", "utf-8").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


@dataclass(frozen=True)
class Statistics:
    documents: int
    terms: int
    weights: np.ndarray


def statistics(rows: DataFrame, known: int) -> Statistics:
    """Counts over all documents, and the weight of each of the ``known`` terms."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(known, np.float64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    return Statistics(n, total, np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64))


# --- Scoring. ---


def masks(rows: np.ndarray, bits: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``count`` documents, those that hold a term, and their masks: entry i says that document ``rows[i]`` holds term ``bits[i]`` of ``width``."""
    words = -(-width // 64)
    out = np.zeros((count, words), np.uint64)
    # Entries come term by term, so a document stands at most once in each step.
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bits)) + 1, [len(bits)]))
    for a, b in zip(edges[:-1], edges[1:]):
        out[rows[a:b], bits[a] >> 6] |= np.uint64(1 << int(bits[a] & 63))
    some = np.flatnonzero(out.any(axis=1))
    return some, out[some]


def groups(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks, and the order and ends that list the documents of each."""
    flat = held[:, 0] if held.shape[1] == 1 else held.view([("", np.uint64)] * held.shape[1])[:, 0]
    order = np.argsort(flat, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
    return held[order[new]], order, np.append(new, len(order))


class Block:
    """Documents with their postings, by document and by term, and what each entry adds to a score before its weight."""

    def __init__(self, ids: pa.Array, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, tf: np.ndarray, counts: Statistics):
        self.ids, self.starts, self.terms = ids, starts, terms
        m = 25 + (75 * n * counts.documents) // counts.terms
        sizes = np.diff(starts)
        tf = tf.astype(np.int64)
        self.parts = (SCALE * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
        self.by_term = np.argsort(terms, kind="stable")
        self.sorted_terms, self.rows = terms[self.by_term], np.repeat(np.arange(len(n), dtype=np.int64), sizes)[self.by_term]

    def best(self, terms: np.ndarray, worth: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all with a score above 0 and at least ``floor`` that can be among the ``top`` of this block for an item.

        ``worth`` is the weight of each of its ``terms`` times how often the item has it.
        """
        lows, highs = np.searchsorted(self.sorted_terms, terms), np.searchsorted(self.sorted_terms, terms, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(lows, highs)])
        bits = np.repeat(np.arange(len(terms)), highs - lows)
        none = np.empty(0, np.int64)
        if not len(at):
            return none, none
        docs, held = masks(self.rows[at], bits, len(self.ids), len(terms))
        most = np.array([self.parts[self.by_term[a:b]].max() if b > a else 0 for a, b in zip(lows, highs)], np.int64) * worth
        distinct, order, ends = groups(held)
        bound = np.zeros(len(distinct), np.int64)
        for i in range(len(terms)):
            bound += np.where(distinct[:, i >> 6] & np.uint64(1 << (i & 63)), most[i], 0)
        turn = np.argsort(-bound, kind="stable")
        weight = dict(zip(terms.tolist(), worth.tolist()))
        table = np.zeros(int(terms[-1]) + 1, np.int64)
        table[list(weight)] = list(weight.values())
        found, scores, size, i = none, none, 4 * top, 0
        least = max(1, floor)
        while i < len(turn) and bound[turn[i]] >= least:
            # As many groups as hold about ``size`` documents are scored at once, twice as many each time.
            chosen, n = [], 0
            while i < len(turn) and bound[turn[i]] >= least and n < size:
                g = turn[i]
                chosen.append(docs[order[ends[g] : ends[g + 1]]])
                n, i = n + len(chosen[-1]), i + 1
            some = np.concatenate(chosen)
            got = self.score(some, table)
            found, scores = np.concatenate((found, some[got >= least])), np.concatenate((scores, got[got >= least]))
            if len(scores) >= top:
                least = max(least, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
                found, scores = found[scores >= least], scores[scores >= least]
            size *= 2
        return found, scores

    def score(self, docs: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Scores of documents that all have an entry, with the worth of every term of an item in ``table``."""
        starts, sizes = self.starts[docs], self.starts[docs + 1] - self.starts[docs]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        terms = self.terms[at]
        inside = terms < len(table)
        worth = np.where(inside, table[np.where(inside, terms, 0)], 0)
        return np.add.reduceat(worth * self.parts[at], np.cumsum(sizes) - sizes)


@dataclass
class Leaders:
    """The best documents of an item so far: ids and scores, best first."""

    top: int
    rows: list[tuple] = field(default_factory=list)

    def floor(self) -> int:
        return self.rows[-1][0] if len(self.rows) >= self.top else 0

    def add(self, ids: list, scores: list[int]) -> None:
        self.rows += zip(scores, ids)
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        del self.rows[self.top :]


def leaders(rows: DataFrame, queries: Queries, counts: Statistics, top: int = TOP) -> DataFrame:
    """``(item, doc_id, score)`` of the best ``top`` documents of every task for every item, given by its place in ``queries``."""
    shared = rows.sparkSession.sparkContext.broadcast((queries.terms, queries.times, counts))
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, times, known = shared.value
        held = [Leaders(top) for _ in terms]
        ids_kind = None

        def blocks() -> Iterator[Block]:
            nonlocal ids_kind
            for batch in batches:
                ids_kind = batch.column(0).type
                ends = batch.column(2).offsets.to_numpy().astype(np.int64)
                own, tf = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
                a = 0
                while a < batch.num_rows:
                    b = int(np.searchsorted(ends, ends[a] + BLOCK_ENTRIES, "right")) - 1
                    b = min(max(b, a + 1), a + BLOCK_ROWS, batch.num_rows)
                    inside = slice(int(ends[a]), int(ends[b]))
                    yield Block(batch.column(0).slice(a, b - a), batch.column(1).to_numpy()[a:b], ends[a : b + 1] - ends[a], own[inside], tf[inside], known)
                    a = b

        for block in blocks():
            for item, (own, n) in enumerate(zip(terms, times)):
                docs, scores = block.best(own, known.weights[own] * n, top, held[item].floor())
                if len(docs):
                    held[item].add(block.ids.take(pa.array(docs)).to_pylist(), scores.tolist())
        out = [(i, doc, score) for i, h in enumerate(held) for score, doc in h.rows]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], ids_kind), pa.array([r[2] for r in out], pa.int64())], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, f"item int, doc_id {kind.simpleString()}, score long")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, most: int = ITEM_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of the ``top`` documents of every item with a score above 0."""
    spark, parts = documents.sparkSession, []
    for block in item_blocks(item_terms(items), most):
        queries = queries_of(block)
        rows = cut_lineage(postings(documents, queries.numbers))
        counts = statistics(rows, len(queries.numbers))
        names = spark.createDataFrame(
            pa.table({"item": pa.array(range(len(queries.ids)), pa.int32()), "item_id": queries.ids}), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = leaders(rows, queries, counts, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        parts.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        kinds = [(n, f.schema[n].dataType.simpleString()) for n, f in (("item_id", items), ("doc_id", documents))]
        return spark.createDataFrame([], f"item_id {kinds[0][1]}, rank int, doc_id {kinds[1][1]}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
