"""Token counts against the tokenizers library, and on awkward texts."""

import random
import time

import numpy as np
import pytest
import public_tokenizers
from palisade.llm import tokens
from palisade.llm.queries import QUERIES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda some: [len(e.ids) for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def test_query_equals_the_library(spark, library):
    rows = QUERIES["op12_token_counts"](spark, DATA).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = [r.doc_id for r in rows]
    want = library([docs[i] for i in ids])
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in rows] == [(len(docs[i].encode()), n, n > 512) for i, n in zip(ids, want)]
    assert len(ids) == len(docs)


def test_every_character_and_random_mixes(vocabulary, library):
    rnd = random.Random(1)
    marks = [*"ab'st \n\t!19é中😀 ́　\x85 ᠎ ", "<|endoftext|>", "'ll", "'S", "\U0001e5d0", "<|end"]
    some = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(60))) for _ in range(5000)]
    some += ["a" + "".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) + "1" for k in range(0, 0x110000, 64)]
    assert tokens.Counter(vocabulary).counts(some) == library(some)


def test_long_texts_and_pieces(vocabulary, library, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 50)
    monkeypatch.setattr(tokens, "HELD", 100)
    monkeypatch.setattr(tokens, "KNOWN", 30)
    rnd = random.Random(2)
    some = ["".join(rnd.choice("ab  \n'!s1") for _ in range(5000)) for _ in range(6)] + ["x" * 400 + " " + " " * 300 + "y", "word " * 999, " ", "", "\n\n"]
    assert tokens.Counter(vocabulary).counts(some) == library(some)


def test_one_long_pre_token_costs_in_proportion(vocabulary, library):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(1_000_000))
    begin = time.perf_counter()
    (count,) = tokens.Counter(vocabulary).counts([text])
    assert time.perf_counter() - begin < 60
    # The library is quadratic here, so the two ways of merging check each other on a part, and the library on a smaller one.
    part = np.frombuffer(text[:20_000].encode(), np.uint8)
    sizes = np.array([15_000, 1, 4_999])
    both = [merge(vocabulary, vocabulary.first[part], sizes).tolist() for merge in (tokens.merged_in_rounds, tokens.merged_by_links)]
    assert both[0] == both[1] == library([text[:15_000], text[15_000:15_001], text[15_001:20_000]])
    assert 0 < count < len(text)


def test_awkward_rows(spark, awkward, no_documents, vocabulary, library):
    column = tokens.token_counts(F.col("text"), vocabulary).alias("n_tokens")
    rows = awkward.select("doc_id", "text", "n", column).collect()
    assert sorted((r.n_tokens.n_bytes, r.n_tokens.n_tokens) for r in rows) == sorted(
        (len((t or "").encode()), n) for (_, t, _, _), n in zip(texts(), library([t or "" for _, t, _, _ in texts()])))
    assert no_documents.select(column).isEmpty()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
