"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Peeling starts at the greatest depth: the nodes there are the conversations that end there, copies merged.
Each is emitted with its totals, then loses its last turn and becomes a part of the node above, where it meets its siblings and the conversations
that end one turn earlier. One descent finds every node and all its totals, those over whole subtrees included, because nothing above is looked
at before everything below it is merged.

A turn is known by a digest, and a sequence by the digest that chains those of its turns, so no text is moved. Conversations that share a beginning are
peeled in one task: the beginning is the shortest that at most ``GROUP`` different conversations share. Nodes that more conversations share
are hot and not peeled yet: what the tasks leave at their top loses its last turn, is merged by an aggregation and is the input of the next round, in
which there are fewer by about that factor. A task holds the digests of ``GROUP`` conversations, a third of all under one beginning or not; only the
digests of one conversation, 20 bytes a turn, are always held together.

Defined cases: rows without ``conv_id`` belong to no conversation; a null role or text is empty; turns of one conversation are ordered by
number, nulls first, then by role and the MD5 of the text; repeated rows are turns like others; a conversation may have no turns when it is
rebuilt and then ends at the root; an empty table has no nodes; other columns are not looked at; texts of any length are only digested and measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from palisade.llm.common import cut_lineage, text_or_empty
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = 8192
WIDTH = 16  # bytes of a digest
ROOT = b"\0" * WIDTH
KEY = f"V{WIDTH}"
NO_END = hashlib.sha256(b"").hexdigest()


# --- Conversations. ---


def conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` of every conversation, its turns in order: role, digest and number of characters of the text."""
    turn = F.struct("turn", text_or_empty("role").alias("role"), F.md5(text_or_empty("text")).alias("digest"), F.char_length(text_or_empty("text")).alias("chars"))
    held = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(rows: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """``(conv_id, turns)``: the beginning of the first conversation of its hundred, then its own turns after as many. A checksum of the id says how many."""
    own = cut_lineage(conversations(rows))
    firsts = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    # Ids of one hundred meet at one row, so the join has at most a hundred rows a key.
    joined = own.join(firsts, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    first = F.coalesce(F.slice("first", F.lit(1), h), F.slice("turns", F.lit(1), F.lit(0)))
    return joined.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def paths(talks: DataFrame) -> DataFrame:
    """``(conv_id, path, chars, last)``: the chained digests of all beginnings of a conversation, laid end to end, and the last of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1)
            roles, digests = (turns.values.field(n).to_pylist() for n in ("role", "digest"))
            ends = turns.offsets.to_pylist()
            found = []
            for a, b in zip(ends[:-1], ends[1:]):
                at, parts = ROOT, []
                for i in range(a, b):
                    at = hashlib.blake2b(b"\0".join((at, digests[i].encode(), roles[i].encode())), digest_size=WIDTH).digest()
                    parts.append(at)
                found.append(b"".join(parts))
            chars = pa.ListArray.from_arrays(turns.offsets, turns.values.field("chars"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), chars], ["conv_id", "path", "chars"])

    kind = talks.schema["conv_id"].dataType.simpleString()
    return talks.select("conv_id", "turns").mapInArrow(run, f"conv_id {kind}, path binary, chars array<int>").withColumn("last", last_of("path"))


def last_of(path: str) -> Column:
    return F.when(F.octet_length(path) == 0, F.lit(bytearray(ROOT))).otherwise(F.substring(path, -WIDTH, WIDTH))


def end_digests(ends: DataFrame) -> DataFrame:
    """``(last, ends_sha256)``: the SHA-256 of the ids of the conversations that end at a node, in order and joined by commas.

    The ids stream past in order, so one node where much of all conversations ends takes no more memory than any other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = np.frombuffer(b"".join(batch.column(0).to_pylist()), KEY)
            ids = batch.column(1).to_pylist()
            edges = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(ids)]
            closed = []
            for a, b in zip(edges[:-1], edges[1:]):
                text = ",".join(map(str, ids[a:b])).encode()
                if nodes[a].tobytes() == node:
                    digest.update(b"," + text)
                    continue
                if node is not None:
                    closed.append((node, digest.hexdigest()))
                node, digest = nodes[a].tobytes(), hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in closed], pa.binary()), pa.array([c[1] for c in closed], pa.string())], ["last", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["last", "ends_sha256"])

    return ends.select("last", "conv_id").repartition("last").sortWithinPartitions("last", "conv_id").mapInArrow(run, "last binary, ends_sha256 string")


# --- Peeling. ---

# What is carried from below: members, the smallest of them, children, leaves and saved characters.
TOTALS = ("n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")
_NODE = pa.schema([
    ("node", pa.binary()), ("depth", pa.int64()), *((c, pa.int64()) for c in TOTALS), ("parent_conv_id", pa.int64()), ("parent", pa.binary()),
    ("path", pa.binary()), ("chars", pa.list_(pa.int32()))])
NODE = "node binary, depth long, " + ", ".join(f"{c} long" for c in TOTALS) + ", parent_conv_id long, parent binary, path binary, chars array<int>"


def planned(rows: DataFrame, group: int) -> DataFrame:
    """``rows`` with ``stop``, the depth down to which each is peeled, -1 for all of it, and ``key``, equal for rows that are peeled together."""
    beginnings = F.transform(F.sequence(F.lit(0), F.expr(f"octet_length(path) div {WIDTH}").cast("int")), lambda d: F.struct(
        d.alias("depth"), F.when(d == 0, F.lit(bytearray(ROOT))).otherwise(F.substring("path", (d - 1) * WIDTH + 1, F.lit(WIDTH))).alias("node")))
    shared = rows.select("last", F.explode(beginnings).alias("b")).select("last", "b.*")
    hot = cut_lineage(shared.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("node"))
    if hot.isEmpty():
        return rows.select("*", F.lit(-1).alias("stop"), F.lit(bytearray(ROOT)).alias("key"))
    stops = shared.join(hot, "node", "left_semi").groupBy("last").agg(F.max("depth").alias("stop"))
    stop = F.col("stop")
    key = F.when(F.octet_length("path") > stop * WIDTH, F.substring("path", stop * WIDTH + 1, F.lit(WIDTH)))
    return rows.join(stops, "last").withColumn("key", key)


def peeled(paths: list[bytes], chars: list[np.ndarray], stops: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    """The nodes of some rows, down to the depth where each stops; rows that meet there stop at the same depth.

    ``totals`` has a row for each of ``TOTALS``. Nodes at the depth of the stop plus one come with the path and characters of the node above.
    """
    lengths = np.array([len(p) // WIDTH for p in paths], np.int64)
    flat = np.frombuffer(b"".join(paths), KEY)
    sizes = np.concatenate([*chars, np.empty(0, np.int32)]).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    turn, active, held, out = 0, np.empty(0, np.int64), np.empty((len(TOTALS), 0), np.int64), []
    depth = int(lengths.max(initial=-1))
    while depth >= 0:
        end = turn + int(np.searchsorted(-lengths[order[turn:]], -depth, "right"))
        ended = order[turn:end]
        turn = end
        rows, parts = np.concatenate((active, ended)), np.concatenate((held, totals[:, ended]), axis=1)
        if not len(rows):
            depth -= 1
            continue
        keys = flat[starts[rows] + depth - 1] if depth else np.zeros(len(rows), KEY)
        # Rows of one node become one row, the first of them.
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        merged = np.zeros((len(TOTALS), len(first)), np.int64)
        for i, name in enumerate(TOTALS):
            if name == "conv_id":
                merged[i] = np.iinfo(np.int64).max
                np.minimum.at(merged[i], which, parts[i])
            else:
                np.add.at(merged[i], which, parts[i])
        n, member, children, leaves, saved = merged  # views
        leaves[children == 0] = 1
        if depth:
            saved += (n - 1) * sizes[starts[rows[first]] + depth - 1]
        if len(active):
            out[-1]["parent_member"][out[-1]["goes_on"]] = member[which[: len(active)]]
        kept = rows[first]
        goes_on = (depth > stops[kept] + 1) & (depth > 0)
        out.append({"keys": keys[first], "depth": depth, "totals": merged, "rows": kept, "goes_on": goes_on, "parent_member": np.full(len(kept), -1, np.int64)})
        active = kept[goes_on]
        held = merged[:, goes_on].copy()
        held[2] = 1
        depth -= 1
    return node_batch(out, paths, chars)


def node_batch(levels: list[dict], paths: list[bytes], chars: list[np.ndarray]) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in _NODE]
    for level in levels:
        depth, tops = level["depth"], ~level["goes_on"]
        columns[0] += [k.tobytes() for k in level["keys"]]
        columns[1] += [depth] * len(tops)
        for i, values in enumerate(level["totals"]):
            columns[2 + i] += values.tolist()
        columns[7] += [None if top else p for top, p in zip(tops, level["parent_member"].tolist())]
        for top, row in zip(tops.tolist(), level["rows"].tolist()):
            up = paths[row][: (depth - 1) * WIDTH] if top and depth else None
            columns[8].append(None if up is None else up[-WIDTH:] or ROOT)
            columns[9].append(up)
            columns[10].append(None if up is None else chars[row][: depth - 1])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], schema=_NODE)


def peel(rows: DataFrame) -> DataFrame:
    """The nodes of ``planned`` rows, whole groups in one task, several small ones together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            column = lambda n: whole.column(n).combine_chunks()
            lists = column("chars")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            totals = np.stack([column(n).to_numpy() for n in TOTALS])
            return peeled(column("path").to_pylist(), [values[a:b] for a, b in zip(ends[:-1], ends[1:])], column("stop").to_numpy().astype(np.int64), totals)

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), KEY)
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts_new = not pending or pending[-1].column("key")[-1].as_py() != keys[0].tobytes()
            if starts_new and held >= GROUP:
                yield close(pending)
                pending, held = [], 0
            # The last group of a batch may go on in the next.
            if len(edges) and held + edges[-1] >= GROUP:
                yield close([*pending, batch.slice(0, int(edges[-1]))])
                pending, held = [batch.slice(int(edges[-1]))], batch.num_rows - int(edges[-1])
            else:
                pending.append(batch)
                held += batch.num_rows
        if pending:
            yield close(pending)

    return rows.select("key", "stop", "path", "chars", *TOTALS).repartition("key").sortWithinPartitions("key").mapInArrow(run, NODE)


def prefix_trie(talks: DataFrame, group: int = GROUP) -> DataFrame:
    """The nodes of the trie of ``talks(conv_id, turns)``, each named by its smallest member and its depth.

    ``n_convs`` are its members, ``parent_conv_id`` names the node above, ``n_leaves`` are nodes without children at or below it, ``saved_tokens`` the
    characters that sharing saves at or below it, ``ends_sha256`` tells the members that end at it.
    """
    ends = cut_lineage(paths(talks))
    zero = F.lit(0).cast("long")
    rows = cut_lineage(ends.groupBy("last").agg(
        F.first("path").alias("path"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").cast("long").alias("conv_id"),
    ).select("*", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens")))
    found = []
    while True:
        plan = cut_lineage(planned(rows, group))
        nodes = cut_lineage(peel(plan.filter("key is not null")))
        found.append(nodes)
        tops = nodes.filter("parent is not null")
        if tops.isEmpty() and plan.filter("key is null").isEmpty():
            break
        # What is left: the parents of the topmost nodes, and conversations that end at a hot node.
        stripped = tops.select(F.col("parent").alias("last"), "path", "chars", "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
        left = stripped.unionByName(plan.filter("key is null").select(stripped.columns))
        rows = cut_lineage(left.groupBy("last").agg(F.first("path").alias("path"), F.first("chars").alias("chars"), *((F.min if c == "conv_id" else F.sum)(c).alias(c) for c in TOTALS)))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.drop("path", "chars")
    if len(found) > 1:
        hot = nodes_of(found[1:]).select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
        nodes = nodes.join(hot, F.col("parent") == F.col("up"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv")).drop("up", "up_conv")
    digests = end_digests(ends).withColumnRenamed("last", "end")
    return nodes.join(digests, F.col("node") == F.col("end"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_END)).alias("ends_sha256"))


def nodes_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("node", "conv_id")
    for part in parts[1:]:
        out = out.unionByName(part.select("node", "conv_id"))
    return out
