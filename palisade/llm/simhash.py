"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``r`` bits share a variant within half of that distance of each, so every distinct fingerprint is sent
to all its variants and fingerprints that meet are compared. A whole ball of radius 2 around 64 bits has 2,081 variants. A scheme with
``parts`` and ``keep`` emits fewer: the bits are cut into parts, and of a difference of ``r`` bits some choice of ``keep`` parts holds at most
``r * keep / parts``; each choice is hashed by its own, smaller balls. Fingerprints that meet are verified on all bits, so both schemes find the
same links.

Buckets stay small: copies share one fingerprint, and in a whole ball all that meet are linked to the smallest of them (two within half the
radius of a variant are within the radius of each other). A bucket of parts with more than ``HOT`` fingerprints is not compared: its
fingerprints go through the whole ball instead, whose buckets hold at most 2,081.

Defined cases: a null text is empty and has fingerprint zero, linked like any other; texts of fewer words than a shingle are one shingle;
repeated rows and null ids are rows of their own, a component's id is its smallest id that is not null; an empty table gives an empty one;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from palisade.llm.common import cut_lineage, scratch, text_or_empty
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 512
SEED = 42


# --- Fingerprints. ---


def shingles(text: bytes, width: int) -> list[bytes]:
    """Shingles of the words of a text, A to Z in lower case, in order and with repeats."""
    found = text.lower().split()  # on bytes, both know ASCII alone
    if len(found) <= width:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: len(found) - width]))
    return [joined[a:b] for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for block in np.array_split(hashes, -(-len(hashes) // 65536)):
        counts += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every document, from its shingles of ``width`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for text in batch.column(1):
                found = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", width)
                fps.append(majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return documents.select("doc_id", F.encode("text", "utf-8").alias("text")).mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


# --- Links. ---


@dataclass(frozen=True)
class Scheme:
    """How a ball is hashed: ``keep`` of ``parts`` parts of ``bits`` bits, for differences of at most ``radius`` bits."""

    bits: int = 64
    radius: int = 4
    parts: int = 1
    keep: int = 1

    def masks(self) -> list[tuple[int, list[int]]]:
        """For each choice of parts, the mask of its bits and the differences to apply."""
        cuts = [self.bits * i // self.parts for i in range(self.parts + 1)]
        half = self.radius * self.keep // self.parts // 2 + (self.radius * self.keep // self.parts) % 2
        out = []
        for chosen in combinations(range(self.parts), self.keep):
            own = [b for p in chosen for b in range(cuts[p], cuts[p + 1])]
            flips = [sum(1 << b for b in some) for size in range(half + 1) for some in combinations(own, size)]
            out.append((sum(1 << b for b in own), flips))
        return out


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def variants(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """``(key, fp)`` of every variant of every fingerprint."""
    def of(mask: int, flips: list[int], choice: int) -> Column:
        # The bits of the parts left out tell the choice.
        free = ~mask & ((1 << scheme.bits) - 1)
        mark = (free & -free) * choice & free
        numbers = F.expr("cast(split('" + ",".join(str(signed(f | mark)) for f in flips) + "', ',') as array<bigint>)")
        return F.transform(numbers, lambda flip: F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long")).bitwiseXOR(flip))

    keys = [of(mask, flips, i) for i, (mask, flips) in enumerate(scheme.masks())]
    return fps.select("fp", F.explode(F.concat(*keys)).alias("key")).select("key", "fp")


Pairs = list[tuple[np.ndarray, np.ndarray]]


def within(radius: int) -> Callable[[np.ndarray], Pairs]:
    """Links that connect the fingerprints of a bucket as those that differ in at most ``radius`` bits do: each but the first of a part with that first."""
    def links(fps: np.ndarray) -> Pairs:
        out, left = [], fps
        while len(left) > 1:
            # Everything that can be reached from the first of what is left; each fingerprint is compared with the rest once.
            first, front, left, reached = left[0], [left[0]], left[1:], []
            while front and len(left):
                # Without a sign: the bits of a negative number would be those of its absolute value.
                near = np.bitwise_count((left ^ front.pop()).view(np.uint64)) <= radius
                reached.append(left[near])
                front += reached[-1].tolist()
                left = left[~near]
            members = np.concatenate(reached) if reached else left[:0]
            out.append((np.full(len(members), first), members))
        return out

    return links


def to_first(members: np.ndarray) -> Pairs:
    return [(np.full(len(members) - 1, members[0]), members[1:])]


def large(members: np.ndarray) -> tuple[Pairs, np.ndarray | None]:
    """Marks the members of a large bucket, which is not compared."""
    return [(members, members)], None


def met(entries: DataFrame, links: Callable[[np.ndarray], Pairs], overflow: Callable[[np.ndarray], tuple[Pairs, np.ndarray | None]] | None = None) -> DataFrame:
    """``(a, b)`` of ``links`` among the members of every bucket of ``entries(key, member)``.

    Sorted entries stream past; a task holds one bucket, of at most ``HOT`` members where ``overflow`` is given: it turns what is held into
    links and what to go on with, or with None into the marks of a large bucket, whose other members are passed to it as they come.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(found: Pairs) -> pa.RecordBatch:
            a, b = (np.concatenate([pair[i] for pair in found]) if found else np.empty(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        none = np.empty(0, np.int64)
        last, pending, over = None, none, False
        for batch in batches:
            keys, members = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(keys):
                continue
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(keys)]))
            found: Pairs = []
            # Only buckets of several entries matter, the first (which may go on from before) and the last (which may go on).
            for i in np.unique(np.concatenate(([0], np.flatnonzero(ends - starts > 1), [len(starts) - 1]))).tolist():
                key, more = keys[starts[i]], members[starts[i] : ends[i]]
                if last is None or key != last:
                    if len(pending) > 1 and not over:
                        found += links(pending)
                    last, pending, over = key, none, False
                if over:
                    found += overflow(more)[0]
                    continue
                pending = np.unique(np.concatenate((pending, more)))
                while overflow is not None and len(pending) > HOT and not over:
                    block, rest = pending[:HOT], pending[HOT:]
                    pairs, held = overflow(block)
                    found += pairs
                    if held is None:
                        found += overflow(rest)[0]
                        pending, over = none, True
                    else:
                        pending = np.concatenate((held, rest))
            yield pack(found)
        if len(pending) > 1 and not over:
            yield pack(links(pending))

    member = entries.columns[1]
    return entries.repartition("key").sortWithinPartitions("key", member).mapInArrow(run, "a long, b long")


def linked(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """Links ``(a, b)`` with ``a < b`` that connect whatever is within the radius, among distinct fingerprints ``fps(fp)``."""
    whole = Scheme(scheme.bits, scheme.radius)
    if scheme.parts == 1:
        return met(variants(fps, scheme), to_first).distinct()
    found = cut_lineage(met(variants(fps, scheme), within(scheme.radius), large).distinct())
    marked, pairs = found.filter("a = b").select(F.col("a").alias("fp")), found.filter("a < b")
    if marked.isEmpty():
        return pairs
    return pairs.unionByName(met(variants(marked, whole), to_first)).distinct()


# --- Components. ---


Store = Callable[[DataFrame], DataFrame]


def components(links: DataFrame, store: Store = cut_lineage) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; ``root`` is the smallest node that it is connected to.

    Each round links the larger neighbours of every node to its smallest one, then every node's smaller ones to the smallest (large star, small
    star), until nothing changes; every round is written, so a lost executor costs no more than one.
    """
    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        joined = both.join(smallest, both["a"] == smallest["n"])
        if larger:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        own = smallest.filter("n <> m").select(F.col("n").alias("a"), F.col("m").alias("b"))
        return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()

    digest = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    with scratch(links.sparkSession) as keep:
        pairs = keep(links.select("a", "b"))
        before = None
        while (now := digest(pairs)) != before:
            before, old = now, pairs
            half = keep(star(old, True))
            pairs = keep(star(half, False))
            keep.drop(old, half)
        return store(pairs.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(
            pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def clusters(documents: DataFrame, width: int = 4, scheme: Scheme = Scheme(parts=3, keep=2)) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every document."""
    marked = cut_lineage(fingerprints(documents, width))
    known = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    roots = components(linked(known.select("fp"), scheme))
    rooted = known.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# --- Near-duplicates by the words that texts share. ---

SMALL = 16


@dataclass(frozen=True)
class Similarity:
    """Texts count as near-duplicates if their sets of shingles of ``width`` words have a Jaccard similarity of ``least``.

    First candidates are texts that meet in one of ``tables`` independent fingerprints of their sets of words. Where single words all over a text
    differ, a similarity of 0.8 of five-word shingles means about 2 % of the words, and 2 bits of 40; a table finds such a pair in about three of
    four cases. What this pass connects the second one need not compare; all that it misses, block edits above all, comes from the prefixes of
    the shingle sets (``prefix_pairs``), which miss none.
    """

    width: int = 5
    least: float = 0.8
    tables: int = 1
    scheme: Scheme = Scheme(bits=40, radius=2)


def mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Another hash of every hash, one function for each table."""
    x = hashes + np.uint64((table * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_of(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def node_of(text: bytes) -> int:
    """Texts of the same words in the same order are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()), SEED)).astype(np.int64))


def sketched(documents: DataFrame, similarity: Similarity) -> DataFrame:
    """``(doc_id, body, node, prints)``; ``prints`` are the fingerprints with the number of their table in the bits above."""
    bits = similarity.scheme.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints = [], []
            for value in batch.column(2):
                text = text_of(value)
                found = sorted(set(text.lower().split()))
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in found), np.uint64, len(found))
                nodes.append(node_of(text))
                prints.append([(majority(mixed(hashes, t)) & ((1 << bits) - 1)) | (t << bits) for t in range(similarity.tables)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], ["doc_id", "body", "node", "prints"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64(text_or_empty("text")).alias("body"), F.encode("text", "utf-8").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, body long, node long, prints array<long>")


def shingle_sets(wanted: DataFrame, width: int) -> DataFrame:
    """``(node, shingles)`` of ``wanted(text, node)``, as hashes, once for each node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for value, node in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text_of(value)
                if node_of(text) == node:
                    nodes.append(node)
                    sets.append(np.unique(np.fromiter((xxhash.xxh32_intdigest(s, SEED) for s in shingles(text, width)), np.uint32)).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int32()))], ["node", "shingles"])

    return wanted.select(F.encode("text", "utf-8").alias("text"), "node").mapInArrow(run, "node long, shingles array<int>").dropDuplicates(["node"])


# --- Exact candidates: prefixes of the shingle sets. ---

COUNTERS = 1 << 20  # counters that all shingles of the corpus share
COUNTER_BLOCK = 1 << 14
HELD = 1 << 20  # shingles that a task counts at once
BLOCK = 1 << 17  # pairs of one batch
CROWD = 8  # members of a bucket that is compared completely at once
MAP_BITS = 1024  # bits of the map of a set
ROUNDS = 3  # rounds in which larger buckets give a few pairs a member, before they are compared completely


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The set of shingles of a text as sorted 64-bit hashes, each from the hashes of its words."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(found)}
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(found) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(found))):
        out = mixed(out + hashes[i : i + n], i + 1)
    return np.unique(out)


def shingle_counts(documents: DataFrame, width: int) -> np.ndarray:
    """In how many documents the shingles of each counter stand, over the whole corpus.

    A shingle counts in one of ``COUNTERS`` counters, whose number does not grow with the corpus. They only set the order in which prefixes are taken.
    Any order is exact; this one keeps every shingle that is much more frequent than the mean of a counter out of the prefixes.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, held, size = np.zeros(COUNTERS, np.int64), [], 0

        def close() -> None:
            if held:
                np.add(counters, np.bincount(np.concatenate(held), minlength=COUNTERS), out=counters)
                held.clear()

        for batch in batches:
            for value in batch.column(0):
                held.append((shingle_hashes(text_of(value), width) & np.uint64(COUNTERS - 1)).astype(np.int64))
                size += len(held[-1])
                if size > HELD:
                    close()
                    size = 0
        close()
        yield blocks(dict(enumerate(counters.reshape(-1, COUNTER_BLOCK))))

    def blocks(counted: dict[int, np.ndarray]) -> pa.RecordBatch:
        some = [b for b in counted if counted[b].any()]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counted[b].tobytes() for b in some], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(counts.as_buffer(), np.int64)
                total[block] = total[block] + own if block in total else own
        yield blocks(total)

    schema = "block int, counts binary"
    parts = documents.select(F.encode("text", "utf-8").alias("text")).mapInArrow(count, schema)
    out = np.zeros((COUNTERS // COUNTER_BLOCK, COUNTER_BLOCK), np.int64)
    for row in parts.repartition("block").mapInArrow(add, schema).collect():
        out[row["block"]] = np.frombuffer(bytes(row["counts"]), np.int64)
    return out.reshape(-1)


def prefixes(documents: DataFrame, similarity: Similarity, counters: np.ndarray) -> DataFrame:
    """``(node, size, prefix, bits)`` of every node, once: the size of the shingle set, its first shingles, rare ones first, and its map.

    A bit of the map is set if an odd number of shingles fall on it, so two maps differ in no more bits than their sets do in shingles.

    Of two sets in one order, with a similarity of ``least``, the larger has at most ``size - least * size`` shingles that the other lacks, and so
    has the smaller; one shingle more of each must hold one that both have, the first that both have among them.
    """
    width, least = similarity.width, similarity.least
    shared = documents.sparkSession.sparkContext.broadcast(np.minimum(counters, np.iinfo(np.int32).max).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            nodes, sizes, firsts, maps = [], [], [], []
            for value in batch.column(0):
                text = text_of(value)
                found = shingle_hashes(text, width)
                if not len(found):
                    continue
                n = len(found)
                keep = n - int(np.ceil(least * n - 1e-9)) + 1
                counts = often[(found & np.uint64(COUNTERS - 1)).astype(np.int64)]
                nodes.append(node_of(text))
                sizes.append(n)
                firsts.append(found[np.lexsort((found, counts))[:keep]].view(np.int64))
                odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1
                maps.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(maps, pa.binary())], ["node", "size", "prefix", "bits"])

    return documents.select(F.encode("text", "utf-8").alias("text")).mapInArrow(run, "node long, size int, prefix array<long>, bits binary").dropDuplicates(["node"])


def few(root: np.ndarray, fits: Callable[[int, np.ndarray], np.ndarray], ends: np.ndarray, open_: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of a large bucket at most two partners a member: the next and the first one that may be similar and is not connected to it yet.

    ``open_`` is set for every member that has such a partner.
    """
    head: dict[int, int] = {}
    for i in range(len(root) - 1):
        j = np.arange(i + 1, ends[i])
        j = j[root[j] != root[i]]
        j = j[fits(i, j)]
        if not len(j):
            continue
        open_[i] = open_[j] = True
        found = int(j[0])
        yield i, j[:1]
        # Members that follow each other have the same first one, the one that began the run.
        head[found] = head.get(i, i)
        first = np.array([head[found]])
        if first[0] != i and root[first[0]] != root[found] and ends[first[0]] > found and fits(found, first)[0]:
            yield found, first


FOUND = "a long, b long, key long, shape long"


def prefix_entries(sets: DataFrame) -> DataFrame:
    """``(key, node, shape)``: a row for each shingle of a prefix; ``shape`` is the size of the set and, below it, how many shingles follow."""
    shape = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR((F.col("size") - 1 - F.col("at")).cast("long")).alias("shape")
    return sets.select("node", "size", F.posexplode("prefix").alias("at", "key")).select("key", "node", shape)


def banded(entries: DataFrame, similarity: Similarity) -> DataFrame:
    """Buckets cut into bands of size; sets that can be similar are in one band or in neighbours, and each goes to its own and to the next."""
    band = F.floor(F.log(F.shiftright("shape", 32).cast("double")) / float(np.log(1 / similarity.least)) + 1e-9)
    return entries.select(F.explode(F.array(band, band + 1)).alias("band"), "*").select(F.xxhash64("key", "band").alias("key"), "node", "shape")


def prefix_pairs(entries: DataFrame, roots: DataFrame, similarity: Similarity, whole: bool = True, maps: DataFrame | None = None) -> DataFrame:
    """``FOUND``: ``(a, b)`` of nodes of ``entries`` that may be similar and are not yet connected by ``roots(node, root)``.

    A pair is left out only if its sizes, or the shingles behind the one that it meets in, or its ``maps(node, bits)``, cannot give the similarity, or if it
    is connected already. A bucket is compared completely, in the order of sizes. Not ``whole``, one of over ``CROWD`` members gives a few pairs a
    member instead (``few``), and the entries that have such a pair, with their key, to be looked at again once what these pairs connect is known.
    """
    least, mapped = similarity.least, maps is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(key: np.ndarray, node: np.ndarray, root: np.ndarray, shape: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            root = np.where(root == 0, node, root)
            if (root == root[0]).all():
                return
            size, rest = shape >> 32, shape & 0xFFFFFFFF
            ends, found, held = np.searchsorted(size, size / least + 1e-6, "right"), [], 0

            def fits(i: int, j: np.ndarray) -> np.ndarray:
                both = size[j] + size[i]
                needed = least / (1 + least) * both - 1e-6
                good = np.minimum(rest[j], rest[i]) + 1 >= needed
                if mapped and good.any():
                    # Bits that differ are shingles that only one of the two has, at least one for each.
                    good[good] = np.bitwise_count(bits[j[good]] ^ bits[i]).sum(axis=1) <= both[good] - 2 * needed[good]
                return good

            large = not whole and len(node) > CROWD
            open_ = np.zeros(len(node), bool)
            every = lambda: ((i, j[fits(i, j)]) for i in range(len(node) - 1) for j in (np.arange(i + 1, ends[i]),) for j in (j[root[j] != root[i]],))
            for i, j in few(root, fits, ends, open_) if large else every():
                found.append((np.minimum(node[j], node[i]), np.maximum(node[j], node[i])))
                held += len(j)
                if held > BLOCK:
                    yield packed(found)
                    found, held = [], 0
            if held:
                yield packed(found)
            if open_.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[open_]) for c in (node, node, key, shape)], ["a", "b", "key", "shape"])

        def packed(found: Pairs) -> pa.RecordBatch:
            a, b = (np.concatenate([p[k] for p in found]) for k in (0, 1))
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], ["a", "b", "key", "shape"])

        pending: list[np.ndarray] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns[:4]]
            if not len(columns[0]):
                continue
            columns.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, MAP_BITS // 64) if mapped else columns[0])
            if pending:
                columns = [np.concatenate(pair) for pair in zip(pending, columns)]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(columns[0])) + 1, [len(columns[0])]))
            # The last bucket may go on in the next batch.
            for i in np.flatnonzero(np.diff(edges[:-1]) > 1).tolist():
                yield from compare(*(c[edges[i] : edges[i + 1]] for c in columns))
            pending = [c[edges[-2] :] for c in columns]
        if pending and len(pending[0]) > 1:
            yield from compare(*pending)

    # Rows are as narrow as they can be: no root for a node that is its own, and maps only where there are few rows.
    known = entries.join(roots.filter("node <> root"), "node", "left")
    if mapped:
        known = known.join(maps, "node")
    rows = known.select("key", "node", F.coalesce("root", F.lit(0)).alias("root"), "shape", *(["bits"] if mapped else []))
    return rows.repartition("key").sortWithinPartitions("key", "shape", "node").mapInArrow(run, FOUND).distinct()


# --- Groups of copies and near copies. ---


def candidate_pairs(members: np.ndarray) -> Pairs:
    """All pairs of a small bucket; of a larger one each member with the next and with the first, which connects it as well and stays linear.

    The other pairs of a large bucket, which mostly holds texts of one vocabulary in different orders, are left to ``prefix_pairs``, where they meet
    by shingles.
    """
    if len(members) <= SMALL:
        i, j = np.triu_indices(len(members), 1)
        return [(members[i], members[j])]
    return [*to_first(members), (members[1:-1], members[2:])]


def similar(documents: DataFrame, known: DataFrame, pairs: DataFrame, similarity: Similarity, store: Store = cut_lineage) -> DataFrame:
    """The ``pairs(a, b)`` of nodes of ``known(node, doc)`` whose shingle sets are similar, stored."""
    with scratch(documents.sparkSession) as keep:
        nodes = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node").join(known.select("node", "doc"), "node").withColumnRenamed("doc", "wanted")
        texts = documents.select("doc_id", "text").join(nodes, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("text", "node")
        sets = keep(shingle_sets(texts, similarity.width))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return store(both.filter(shared >= similarity.least * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def grown(roots: DataFrame, links: DataFrame, store: Store = cut_lineage) -> DataFrame:
    """``roots(node, root)`` with further ``links(a, b)``."""
    return components(links.unionByName(roots.filter("node > root").select(F.col("root").alias("a"), F.col("node").alias("b"))), store)


def duplicates(documents: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """``(doc_id, body)`` of every document that is a copy, or by links a near copy, of one that stays: the first of its group by id, nulls last. Stored.

    ``body`` is the hash of the text. Rows of the same id and text stay or go together; texts without words are copies of each other.
    """
    with scratch(documents.sparkSession) as keep:
        marked = keep(sketched(documents, similarity))
        known = keep(marked.groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("prints").alias("prints")))
        (_, flips), = similarity.scheme.masks()
        numbers = F.expr("array(" + ",".join(f"{f}L" for f in flips) + ")")
        entries = known.select(F.explode("prints").alias("print"), "node").select(F.explode(F.transform(numbers, lambda f: F.col("print").bitwiseXOR(f))).alias("key"), "node")
        pairs = keep(met(entries, candidate_pairs, lambda m: (candidate_pairs(m), m[:1])).distinct())
        roots = components(similar(documents, known, pairs, similarity, keep), keep)
        keep.drop(pairs)
        sets = keep(prefixes(documents, similarity, shingle_counts(documents, similarity.width)))
        entries, maps = prefix_entries(sets), None
        for turn in range(ROUNDS + 1):
            pairs = keep(prefix_pairs(entries, roots, similarity, turn == ROUNDS, maps))
            met_now = pairs.filter("a < b").select("a", "b")
            if not met_now.isEmpty():
                roots = grown(roots, similar(documents, known, met_now, similarity, keep), keep)
            # What is left open in large buckets is looked at again, in bands of size and with the maps of its sets.
            entries = pairs.filter("a = b").select("key", F.col("a").alias("node"), "shape")
            if entries.isEmpty():
                break
            if not turn:
                entries, maps = banded(entries, similarity), sets.select("node", "bits")
        members = marked.select("doc_id", "body", "node").join(roots, "node", "left").select("doc_id", "body", F.coalesce("root", "node").alias("root"))
        order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body")
        first = members.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        return cut_lineage(members.join(first, "root").filter(order > F.col("first")).select("doc_id", "body").distinct())


def deduplicated(documents: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """``documents`` with one document of each group of copies and near copies."""
    gone = duplicates(documents, similarity).withColumnsRenamed({"doc_id": "gone_id", "body": "gone_body"})
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_or_empty(F.col("row.text"))) == F.col("gone_body"))
    return rows.join(gone, same, "left_anti").select("row.*")
