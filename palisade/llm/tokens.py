"""Token counts of a public byte-level BPE vocabulary, by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens. Those not met before are laid end to end in one array of symbols; in every round each of them applies its pair of
the lowest rank, wherever it occurs in it, all at once, and leaves the array when no pair of it has a rank. What is left of it are its tokens.
Pre-tokens of more than ``LONG`` bytes would stay for too many rounds: they merge by the same rule over linked positions, where a step touches only
the places of one rank, so that a text costs no more than in proportion to its length.

The vocabulary and the pre-tokenizer's classes of characters are read on the driver, from a file whose path is a parameter, and travel to the
executors as arrays; their size is that of the vocabulary, whatever the corpus.

Defined cases: a null text has no tokens, like an empty one; special tokens of the vocabulary that stand in a text are one token each, as the
tokenizers library has them by default; rows are counted one by one, so repeated rows, ties and null ids change nothing; an empty table gives an empty
one. A text of any length is counted whole, in pieces that end where every pre-token ends. ``token_counts`` is a column and knows no other columns.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = np.iinfo(np.int32).max  # the rank of a pair that never merges
LONG = 256
PIECE = 1 << 18  # characters of a text that are cut at once
HELD = 1 << 20  # characters of new pre-tokens that are merged at once
KNOWN = 1 << 19  # pre-tokens whose count a task remembers
RESULT = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


# --- Vocabulary. ---


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others count on from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def character_class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def classes(pre_tokenizer) -> dict[str, list[tuple[int, int]]]:
    """Ranges of code points that a pre-tokenizer takes as letters, numbers and white space, asked of the pre-tokenizer itself.

    Libraries follow different versions of Unicode, so their patterns cannot be trusted to agree on new characters.
    """
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = {"letter": [], "number": [], "space": []}
    for _, (start, end) in pre_tokenizer.pre_tokenize_str("".join(map(chr, points))):
        piece = points[start:end]
        # A plain space may lead the piece; all the rest of it has one class.
        for part in ([piece[:1], piece[1:]] if piece[0] == 0x20 else [piece]):
            if part:
                joins = lambda mark: len(pre_tokenizer.pre_tokenize_str(mark + chr(part[0]))) == 1
                kind = "letter" if joins("a") else "number" if joins("1") else None if joins("!") else "space"
                if kind:
                    for c in part:
                        held = found[kind]
                        if held and held[-1][1] == c - 1:
                            held[-1] = (held[-1][0], c)
                        else:
                            held.append((c, c))
    return found


@dataclass(frozen=True)
class Vocabulary:
    """``keys`` are the pairs that merge, sorted, with their ``ranks``; ``products`` are the symbols they become, by rank."""

    first: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    pattern: str
    edge: str
    special: str

    @cached_property
    def patterns(self) -> tuple[re.Pattern, re.Pattern, re.Pattern | None]:
        return re.compile(self.pattern), re.compile(self.edge), re.compile(self.special) if self.special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE).astype(np.int32)


def vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE vocabulary from a ``.json`` file of the tokenizers library; other kinds of files are an error."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        text = file.read()
    held = json.loads(text)
    model, before, added = held["model"], held["pre_tokenizer"] or {}, held["added_tokens"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    plain = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or held["normalizer"] or odd or not plain:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    ids = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
    order = np.argsort(pairs)
    known = {k: character_class(r) for k, r in classes(Tokenizer.from_str(text).pre_tokenizer).items()}
    letter, number, space = known["letter"], known["number"], known["space"]
    return Vocabulary(
        first=np.array([ids[c] for c in byte_letters()], np.int32), keys=pairs[order], ranks=order.astype(np.int32),
        products=np.array([ids[a + b] for a, b in merges], np.int32),
        pattern=f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+",
        edge=f"[^{space}](?=[{space}])",
        special="|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))))


# --- Merging. ---


def every_other(starts_run: np.ndarray) -> np.ndarray:
    """Of places in runs, of which ``starts_run`` marks the firsts, those at even places of their run: pairs of a run overlap."""
    at = np.arange(len(starts_run))
    return (at - np.maximum.accumulate(np.where(starts_run, at, 0))) % 2 == 0


def merged_in_rounds(vocabulary: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of symbols that are left of each of the sequences of ``symbols``, which lie end to end and are not empty."""
    left, open_ = lengths.astype(np.int64), np.arange(len(lengths))
    ends = np.cumsum(lengths)
    rank = np.full(len(symbols), NONE, np.int32)
    rank[:-1] = vocabulary.rank(symbols[:-1], symbols[1:])
    rank[ends - 1] = NONE
    while len(open_):
        sizes = left[open_]
        starts = np.cumsum(sizes) - sizes
        lowest = np.minimum.reduceat(rank, starts)
        going = lowest < NONE
        if not going.all():
            stay = np.repeat(going, sizes)
            symbols, rank, open_, sizes, lowest = symbols[stay], rank[stay], open_[going], sizes[going], lowest[going]
            if not len(open_):
                break
        owner = np.repeat(np.arange(len(open_)), sizes)
        hits = np.flatnonzero((rank == lowest[owner]) & (rank < NONE))
        hits = hits[every_other(np.diff(hits, prepend=-2) != 1)]
        symbols[hits] = vocabulary.products[rank[hits]]
        rank[hits] = rank[hits + 1]
        stay = np.ones(len(symbols), bool)
        stay[hits + 1] = False
        left[open_] -= np.bincount(owner[hits], minlength=len(open_))
        moved = hits - np.arange(len(hits))
        symbols, rank, owner = symbols[stay], rank[stay], owner[stay]
        # Only pairs that a merged symbol belongs to have a new rank.
        changed = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
        changed = changed[changed < len(symbols) - 1]
        rank[changed] = np.where(owner[changed] == owner[changed + 1], vocabulary.rank(symbols[changed], symbols[changed + 1]), NONE)
    return left


def merged_by_links(vocabulary: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same as ``merged_in_rounds``, in time in proportion to the symbols however many rounds they take.

    Sequences do not touch each other, so each has its lowest pair merged when the lowest rank of all is taken, one rank after the other.
    """
    ends = np.cumsum(lengths)
    after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
    after[ends - 1], before[ends - lengths] = -1, -1
    symbols, rank = symbols.copy(), np.full(len(symbols), NONE, np.int32)
    alive = np.ones(len(symbols), bool)
    places: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def put(at: np.ndarray) -> None:
        nxt = after[at]
        rank[at] = np.where(nxt >= 0, vocabulary.rank(symbols[at], symbols[nxt]), NONE)
        at = at[rank[at] < NONE]
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, cuts) if len(at) else ():
            r = int(rank[part[0]])
            if r not in places:
                places[r] = []
                heapq.heappush(ranks, r)
            places[r].append(part)

    put(np.arange(len(symbols)))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        at = at[every_other(np.concatenate(([True], after[at[:-1]] != at[1:])))]
        gone = after[at]
        symbols[at], alive[gone], rank[gone] = vocabulary.products[r], False, NONE
        after[at] = after[gone]
        tail = after[at]
        before[tail[tail >= 0]] = at[tail >= 0]
        head = before[at]
        put(np.unique(np.concatenate((at, head[head >= 0]))))
    return np.add.reduceat(alive.astype(np.int64), ends - lengths)


def symbol_counts(vocabulary: Vocabulary, pieces: list[str]) -> list[int]:
    """Number of tokens of each of ``pieces``, pre-tokens that are not empty."""
    coded = [p.encode("utf-8") for p in pieces]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    out = np.zeros(len(coded), np.int64)
    for some, merge in ((lengths <= LONG, merged_in_rounds), (lengths > LONG, merged_by_links)):
        chosen = np.flatnonzero(some)
        if len(chosen):
            symbols = vocabulary.first[np.frombuffer(b"".join(coded[i] for i in chosen), np.uint8)]
            out[chosen] = merge(vocabulary, symbols, lengths[chosen])
    return out.tolist()


# --- Counting. ---


class Counter:
    """Counts the tokens of texts and remembers the counts of pre-tokens, a bounded number of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in bounded lists. A text is cut before white space that follows something else, where a pre-token always ends."""
        pattern, edge, _ = self.vocabulary.patterns
        start = 0
        while start < len(text):
            cut = edge.search(text, start + PIECE) if len(text) - start > PIECE else None
            end = cut.end() if cut else len(text)
            yield pattern.findall(text[start:end] if start or cut else text)
            start = end

    def learn(self, new: set[str]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        held, size = [], 0
        for piece in new:
            held.append(piece)
            size += len(piece)
            if size > HELD:
                self.known.update(zip(held, symbol_counts(self.vocabulary, held)))
                held, size = [], 0
        if held:
            self.known.update(zip(held, symbol_counts(self.vocabulary, held)))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. The texts are read until enough pre-tokens are new, and those are merged together."""
        special = self.vocabulary.patterns[2]
        out, lists, new, size = [0] * len(texts), [], set(), 0

        def close() -> None:
            nonlocal new, size, lists
            forgotten = len(self.known) > KNOWN
            self.learn({p for _, found in lists for p in found} if forgotten else new)
            for i, found in lists:
                out[i] += sum(map(self.known.__getitem__, found))
            lists, new, size = [], set(), 0

        for i, text in enumerate(texts):
            parts = special.split(text) if special and text else [text or ""]
            out[i] += len(parts) - 1
            for part in parts:
                for found in self.pieces(part):
                    lists.append((i, found))
                    new.update(p for p in found if p not in self.known)
                    size += len(found)
                    if size > HELD >> 1:
                        close()
        close()
        return out


def token_counts(text: Column, vocabulary: Vocabulary) -> Column:
    """``n_bytes`` (of the text in UTF-8) and ``n_tokens`` of a text column, as a struct."""
    def run(batches):
        counter = Counter(vocabulary)
        for texts in batches:
            sizes = [t.as_buffer().size if t.is_valid else 0 for t in texts]
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(counter.counts(texts.to_pylist()), pa.int64())], fields=list(RESULT))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n_bytes long, n_tokens long")(text)
