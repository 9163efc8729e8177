"""Prefix trie against brute force, hot nodes included, and on awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from palisade.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path string, last string, turns string, node string, n_convs string"
EXTRA = ("x",) * 6


def brute_force(rows):
    """The nodes of all rebuilt conversations, straight from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        talk = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
        for d in range(len(talk) + 1):
            members[tuple(talk[:d])].append(c)
        ends[tuple(talk)].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children(node)), sum(not children(n) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, convs=60, words=3):
    """Conversations over few texts, so that beginnings are shared, with copies, nested ones and a long one."""
    rnd = random.Random(seed)
    rows = []
    for c in [*range(convs), 100, 101, 105, 250, 307]:
        length = rnd.choice([1, 2, 3, 4, 6, 8])
        rows += [(c, t, ("user", "assistant")[t % 2], rnd.choice("abc"[:words]) * rnd.choice([1, 1, 2])) for t in range(length)]
    rows += [(900, t, "user", "a") for t in range(30)]
    rows += [(901, t, "user", "a") for t in range(31)]
    return rows


AWKWARD = [
    (None, 1, "user", "lost"), (1, None, "user", "first"), (1, 0, None, "b"), (1, 0, None, "b"), (1, 0, "user", None), (2, 5, None, None), (2, 5, None, ""),
    (3, 1, "user", "z" * 200_000), (3, 2, "user", "é😀" * 50_000), (-7, 0, "user", "a"), (-107, 1, "user", "a"), (-100, 1, "user", "q"), (-100, 2, "user", "r"),
    (10**15, 1, "role with : and \x00", "\x00"), (4, 1, "u", "ser"), (5, 1, "us", "er"), (5, 1, "us", "er"),
]


def found(spark, rows, group):
    table = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    nodes = tries.prefix_trie(tries.rebuilt(table), group)
    return sorted((tuple(r) for r in nodes.collect()), key=str)


@pytest.mark.parametrize("group", [1, 4, 8192])
def test_trie_equals_brute_force_with_hot_nodes_or_without(spark, group):
    rows = talks(7) + AWKWARD
    assert found(spark, rows, group) == brute_force(rows)


def test_groups_over_many_batches_are_peeled_whole(spark, monkeypatch):
    rows = talks(3, convs=40, words=2)
    monkeypatch.setattr(tries, "GROUP", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert found(spark, rows, 5) == brute_force(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_has_no_nodes(spark):
    assert found(spark, [], 8192) == []


def test_ends_of_a_crowded_node_are_hashed_in_order(spark):
    rows = [(c, t, "user", "same") for c in range(1, 3000) for t in range(6)]
    nodes = {r[1]: r for r in found(spark, rows, 8192)}
    ids = [c for c in range(1, 3000)]
    # Conversations of a hundred whose first is missing lose the turns that they should take from it.
    lengths = {c: (6 if c - c % 100 in range(1, 3000) or c % 100 == 0 else 6 - zlib.crc32(str(c).encode()) % 6) for c in ids}
    for depth, node in nodes.items():
        assert node[3] == sum(n >= depth for n in lengths.values())
        assert node[7] == hashlib.sha256(",".join(str(c) for c in ids if lengths[c] == depth).encode()).hexdigest()
