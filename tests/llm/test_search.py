"""Ranked search against brute force, over many blocks and masks of any width, and on awkward rows."""

import math
import random
import re
from collections import Counter

import pytest
from palisade.llm import search

DOCS = "doc_id long, text string, item_id string, n long, terms string, tf string, score string, rank string, item string"
EXTRA = ("x", 1, "x", "x", "x", "x", "x")
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute_force(docs, items, top=10):
    held = [(doc, Counter(terms(text)), len(terms(text))) for doc, text in docs if terms(text)]
    big_n, big_l = len(held), sum(n for _, _, n in held)
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(terms(text))
        weights = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * sum(t in c for _, c, _ in held) + 1))) for t in asked}
        scored = []
        for doc, counts, n in held:
            m = 25 + (75 * n * big_n) // big_l
            score = sum(k * weights[t] * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t, k in asked.items() if t in counts)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    documents = spark.createDataFrame([(*d, *EXTRA) for d in docs], DOCS)
    asked = spark.createDataFrame([(*i, "x", "x") for i in items], "item_id long, text string, doc_id string, key string")
    return sorted((tuple(r) for r in search.search(documents, asked, **options).collect()), key=str)


def corpus(seed, docs=400, words=40):
    rnd = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rnd.choices(names, weights, k=rnd.choice([1, 2, 5, 30, 90]))) for _ in range(docs)]
    texts += texts[:60]  # copies tie
    items = [(i, " ".join(rnd.choices(names, k=rnd.choice([1, 2, 6, 12])))) for i in range(12)]
    return list(enumerate(texts)), items


def test_search_equals_brute_force(spark):
    docs, items = corpus(1)
    assert found(spark, docs, items) == brute_force(docs, items)


def test_small_blocks_of_documents_and_items(spark, monkeypatch):
    docs, items = corpus(2)
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(search, "BLOCK_ENTRIES", 60)
    assert found(spark, docs, items, top=3, most=9) == brute_force(docs, items, 3)


def test_masks_of_more_than_a_word(spark):
    rnd = random.Random(4)
    names = [f"t{i}" for i in range(200)]
    docs = [(i, " ".join(rnd.sample(names, rnd.choice([1, 5, 50, 199])))) for i in range(150)]
    items = [(1, " ".join(names)), (2, " ".join(names[:65])), (3, " ".join(names[64:] + names[:3]))]
    assert found(spark, docs, items) == brute_force(docs, items)


def test_awkward_rows(spark):
    long = "needle " + "hay " * 150_000 + "x" * 100_000
    docs = [
        (None, None), (1, None), (2, ""), (3, " \t-_.!"), (4, "Needle ÉTÉ été_needle"), (5, long), (None, "needle"), (None, "needle"), (6, "needle"), (6, "needle"), (7, "needle"), (8, "other words")]
    items = [(1, "NEEDLE"), (1, "NEEDLE"), (1, "été ÉTÉ"), (2, None), (3, ""), (None, "hay needle needle"), (4, "absent"), (5, "a_b-c")]
    assert found(spark, docs, items) == brute_force(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, docs, [(1, "?!")]) == []


@pytest.mark.parametrize("count", [1, 64, 65, 130])
def test_masks_and_groups(count):
    import numpy as np

    rnd = random.Random(count)
    held = [sorted(rnd.sample(range(count), rnd.randrange(count + 1))) for _ in range(50)]
    entries = sorted((b, d) for d, bits in enumerate(held) for b in bits)
    docs, masks = search.masks(np.array([d for _, d in entries]), np.array([b for b, _ in entries]), 50, count) if entries else (np.empty(0), None)
    assert docs.tolist() == [d for d in range(50) if held[d]]
    if len(docs):
        distinct, order, ends = search.groups(masks)
        assert sorted(sorted(held[d] for d in docs[order[a:b]])[0] for a, b in zip(ends[:-1], ends[1:])) == sorted([list(x) for x in {tuple(h) for h in held if h}])
        assert len(distinct) == len({tuple(h) for h in held if h})
