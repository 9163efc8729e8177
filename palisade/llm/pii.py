"""Personal data: four patterns, and a skip-chain conditional random field over the tokens that could be part of one.

Nodes are the tokens with a digit or an ``@``; all others are outside by construction. Neighbouring nodes are linked in a chain, and tokens that
repeat or resemble an earlier one (the same local part, address or last digits) to the one before them, however far. Loopy belief propagation
over these links makes labels agree within a document, so that a number written once in full marks its other spellings. Documents are propagated
in blocks of about ``BLOCK`` nodes, and each stops when its own messages have settled, so its labels do not depend on the others of its block. A
document's cost grows with its tokens (times the logarithm of its spans); there is no limit on their number or their distance.

The field is trained on the spans of the patterns, by pseudo-likelihood over the tokens of at most ``SAMPLE`` documents, those with the smallest
hash of their id. Equal tokens in equal surroundings are counted on Spark, and only the counts reach the driver. Every token counts half with the
features that say whether it is well-formed and half without, so that links have to make up for them.

Defined cases: a null or empty text has no spans; an empty table gives an empty one; of equally probable labels the first in the order of the kinds
is taken; spans of the patterns always stay, and of the field's those that meet one of them are left out; positions count code points; repeated
rows are scanned each on its own; without anything to train on the field adds nothing; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from palisade.llm.common import cut_lineage
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 3_000
ROUNDS = 30  # of message passing, at most
CERTAIN = 0.8  # marginal of a label that makes a span
AGREE = 8.0  # what equal labels on a skip link are worth before training
EVIDENCE = 6.0  # what a pattern span is worth to the label of its tokens
BLOCK = 20_000  # nodes propagated together, about; a document with more is a block of its own
MESSAGES = 50_000  # messages computed at once
SETTLED = 1e-4

# --- Patterns. Each is matched in linear time: a run of one class is entered at its start only. ---

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def octet(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) < 4 and int(kept or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds exactly one ``@``: the run of local characters before it starts the match, as far as the match before lets it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = free = m.end()
            yield start, end
        else:
            free = max(free, at + 1)
        at = text.find("@", end)


def pattern_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind and start."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- Nodes, features and links of a document. ---

LABELS = 1 + len(KINDS)  # outside first
_TRIM = ".,;:!?\"'()[]<>"
_CUES = ("mail", "tel", "phone", "call", "fax", "card", "visa", "ip", "host", "server", "contact", "iban")
FEATURES = (
    "bias", "at", "at_dot", "plus", "dots3", "dots", "hyphen", "letters", "digits_only", "hex", "space_run",
    *(f"digits_{n}" for n in range(0, 22)), "first_zero", *(f"cue_{c}" for c in _CUES), "email_form", "octets", "luhn", "phone_length")
_INDEX = {name: i for i, name in enumerate(FEATURES)}
WELL_FORMED = [_INDEX[n] for n in ("email_form", "octets", "luhn", "phone_length")]


@dataclass
class Graph:
    """Nodes of some documents: their places, features and links."""

    places: list[tuple[int, int, int]]  # document, start, end
    active: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]

    @staticmethod
    def empty() -> Graph:
        return Graph([], [], [], [])


def node_features(token: str, before: str, joined: bool) -> list[int]:
    digits = [c for c in token if "0" <= c <= "9"]
    n, letters = len(digits), any(c.isalpha() for c in token)
    dots = token.count(".")
    cue = before.lower()
    tests = {
        "bias": True, "at": "@" in token, "at_dot": "@" in token and "." in token.rpartition("@")[2], "plus": token.startswith("+"), "dots3": dots == 3,
        "dots": dots > 0, "hyphen": "-" in token, "letters": letters, "digits_only": n == len(token), "hex": letters and all(c in "0123456789abcdef" for c in token),
        "space_run": joined, f"digits_{min(n, 21)}": True, "first_zero": n > 0 and digits[0] == "0",
        "email_form": any(e - s > 2 for s, e in emails(token)), "octets": dots == 3 and all(p.isascii() and p.isdigit() and octet(p) for p in token.split(".")),
        "luhn": 13 <= n <= 19 and luhn("".join(digits)), "phone_length": token.startswith("+") and 9 <= n <= 15,
    }
    return [_INDEX[k] for k, v in tests.items() if v] + [_INDEX[f"cue_{c}"] for c in _CUES if c in cue]


def likeness(token: str) -> str | None:
    """What similar tokens have in common: the local part of an address, the last seven digits of a number."""
    if "@" in token:
        return "@" + token.partition("@")[0].lower() if token.partition("@")[0] else None
    digits = "".join(c for c in token if "0" <= c <= "9")
    return digits[-7:] if len(digits) >= 7 else None


def add_document(graph: Graph, number: int, text: str) -> None:
    """Nodes of a document and their links, in one pass."""
    last, last_end, seen = None, -10, {}
    for m in _NODE.finditer(text):
        raw = m[0]
        left = len(raw) - len(raw.lstrip(_TRIM.replace("(", "") + "("))
        token = raw.strip(_TRIM)
        if not token:
            continue
        start = m.start() + left
        node = len(graph.places)
        joined = start - last_end <= 2
        graph.places.append((number, start, start + len(token)))
        graph.active.append(node_features(token, text[max(0, start - 24) : start].rpartition("\n")[2], joined))
        if last is not None and joined:
            graph.chain.append((last, node))
        if key := likeness(token):
            if key in seen:
                graph.skip.append((seen[key], node))
            seen[key] = node
        last, last_end = node, start + len(token)


# --- The field. ---


@dataclass
class Field:
    """Weights of features by label, and of label pairs on chain and skip links."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self, graph: Graph) -> np.ndarray:
        of = np.repeat(np.arange(len(graph.active)), [len(a) for a in graph.active])
        out = np.zeros((len(graph.active), LABELS))
        np.add.at(out, of, self.unary[np.concatenate(graph.active).astype(int)])
        return out

    def marginals(self, graph: Graph, rounds: int = ROUNDS, known: np.ndarray | None = None) -> np.ndarray:
        """Loopy belief propagation in the log domain, damped, until messages settle; ``known`` labels other than outside are evidence."""
        unary = self.potentials(graph)
        if known is not None:
            found = np.flatnonzero(known)
            unary[found, known[found]] += EVIDENCE
        pairs = np.array(graph.chain + graph.skip, int).reshape(-1, 2)
        if len(pairs):
            tables = np.stack([self.chain, self.skip, self.chain.T, self.skip.T])  # [label of source, label of target]
            skips = np.arange(len(pairs)) >= len(graph.chain)
            table = np.concatenate([skips, skips + 2])
            source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            back = np.roll(np.arange(len(source)), len(pairs))
            documents, of = np.unique([graph.places[i][0] for i in source], return_inverse=True)
            messages = np.zeros((len(source), LABELS))
            moving = np.arange(len(source))
            for _ in range(rounds):
                belief = unary.copy()
                np.add.at(belief, target, messages)
                new, change = messages.copy(), np.zeros(len(documents))
                for first in range(0, len(moving), MESSAGES):
                    part = moving[first : first + MESSAGES]
                    inner = (belief[source[part]] - messages[back[part]])[:, :, None] + tables[table[part]]
                    top = inner.max(axis=1)
                    told = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
                    new[part] = 0.5 * messages[part] + 0.5 * (told - told.max(axis=1, keepdims=True))
                    np.maximum.at(change, of[part], np.abs(new[part] - messages[part]).max(axis=1))
                messages = new
                moving = moving[change[of[moving]] >= SETTLED]
                if not len(moving):
                    break
            np.add.at(unary, target, messages)
        unary = np.exp(unary - unary.max(axis=1, keepdims=True))
        return unary / unary.sum(axis=1, keepdims=True)


@dataclass
class Examples:
    """Distinct nodes with their surroundings: active features, label, labels of the neighbours by kind of link, and how often they occur."""

    active: list[list[int]]
    labels: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    counts: np.ndarray


def train(seen: Examples, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Pseudo-likelihood: every node given the labels of its neighbours, by Adam. Links start as a wish to agree."""
    n = len(seen.labels)
    # Each node twice at half its weight: with all features, and without those that say whether it is well-formed.
    of = np.repeat(np.arange(n), [len(a) for a in seen.active])
    slots = np.concatenate(seen.active).astype(int)
    shown = ~np.isin(slots, WELL_FORMED)
    of, slots = np.concatenate([of, of[shown] + n]), np.concatenate([slots, slots[shown]])
    around = [np.concatenate([c, c]).astype(float) for c in (seen.chain, seen.skip)]
    weight = np.concatenate([seen.counts, seen.counts])[:, None] / (2 * seen.counts.sum())
    start = [np.zeros((len(FEATURES), LABELS)), 0.5 * np.eye(LABELS), AGREE * np.eye(LABELS)]
    now, m, v = [w.copy() for w in start], [np.zeros_like(w) for w in start], [np.zeros_like(w) for w in start]
    truth = np.eye(LABELS)[np.concatenate([seen.labels, seen.labels])]
    for step in range(1, steps + 1):
        z = np.zeros((2 * n, LABELS))
        np.add.at(z, of, now[0][slots])
        z += around[0] @ now[1] + around[1] @ now[2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - truth) * weight
        first = np.zeros_like(now[0])
        np.add.at(first, slots, error[of])
        slopes = [first, around[0].T @ error, around[1].T @ error]
        for i in range(3):
            slope = slopes[i] if i == 0 else (slopes[i] + slopes[i].T) / 2  # links have no direction
            slope = slope + ridge * (now[i] - start[i])
            m[i], v[i] = 0.9 * m[i] + 0.1 * slope, 0.999 * v[i] + 0.001 * slope * slope
            now[i] = now[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Field(*now)


class Meeting:
    """Which spans of a document a place meets. Those of one kind do not overlap, so a search by halving finds the only candidate of each."""

    def __init__(self, spans: list[Span]):
        self.kinds = []
        for kind in range(len(KINDS)):
            own = sorted((a, b) for k, a, b in spans if k == kind)
            if own:
                self.kinds.append((kind, [a for a, _ in own], [b for _, b in own]))

    def first(self, start: int, end: int) -> int | None:
        """The first kind with a span that meets ``start`` to ``end``."""
        for kind, starts, ends in self.kinds:
            i = bisect_right(ends, start)
            if i < len(starts) and starts[i] < end:
                return kind
        return None


def weak_labels(graph: Graph, spans: dict[int, Meeting]) -> np.ndarray:
    """Label of each node: the first kind of pattern span that it meets, else outside."""
    found = (spans[number].first(start, end) for number, start, end in graph.places)
    return np.array([0 if kind is None else 1 + kind for kind in found], int)


def neighbour_labels(pairs: list[tuple[int, int]], labels: np.ndarray) -> np.ndarray:
    """Per node how many neighbours on ``pairs`` have each label."""
    counts = np.zeros((len(labels), LABELS), int)
    if pairs:
        a, b = np.array(pairs).T
        np.add.at(counts, (a, labels[b]), 1)
        np.add.at(counts, (b, labels[a]), 1)
    return counts


def field_spans(field: Field | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Per document the spans that the field adds: runs of chained nodes whose label is certain, away from pattern spans."""
    out: list[list[Span]] = [[] for _ in texts]
    graph, known = Graph.empty(), {}

    def label_block() -> None:
        labels = weak_labels(graph, known)
        marginals = field.marginals(graph, known=labels)
        label = np.where(marginals.max(axis=1) >= CERTAIN, marginals.argmax(axis=1), 0)
        chained = {b: a for a, b in graph.chain}
        for i in np.flatnonzero((label > 0) & (labels == 0)).tolist():
            number, start, end = graph.places[i]
            kind, own = int(label[i]) - 1, out[number]
            before = chained.get(i)
            if before is not None and own and label[before] == label[i] and own[-1][2] == graph.places[before][2]:
                own[-1] = (kind, own[-1][1], end)
            else:
                own.append((kind, start, end))

    if field is not None:
        for number, text in enumerate(texts):
            if "@" in text or _DIGIT.search(text):
                add_document(graph, number, text)
                known[number] = Meeting(base[number])
                if len(graph.places) >= BLOCK:
                    label_block()
                    graph, known = Graph.empty(), {}
        if graph.places:
            label_block()
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# --- On Spark. ---


def fitted(documents: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field, trained on a bounded sample of documents that could hold personal data."""
    could = documents.filter(F.col("text").rlike("[0-9@]"))
    chosen = cut_lineage(could.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample).withColumnRenamed("doc_id", "chosen"))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                graph = Graph.empty()
                add_document(graph, 0, text)
                if graph.places:
                    labels = weak_labels(graph, {0: Meeting(pattern_spans(text))})
                    lists = pa.list_(pa.int32())
                    links = [pa.array(neighbour_labels(pairs, labels).tolist(), lists) for pairs in (graph.chain, graph.skip)]
                    yield pa.RecordBatch.from_arrays([pa.array(graph.active, lists), pa.array(labels, pa.int32()), *links], ["active", "label", "chain", "skip"])

    some = could.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("text")
    told = some.mapInArrow(nodes, "active array<int>, label int, chain array<int>, skip array<int>")
    rows = sorted(told.groupBy("active", "label", "chain", "skip").count().collect())
    if len({row["label"] for row in rows}) < 2:
        return None
    column = lambda name: np.array([row[name] for row in rows], int)
    return train(Examples([row["active"] for row in rows], column("label"), column("chain"), column("skip"), column("count")))


def find_personal(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document the counts of pattern spans, ``base`` (those spans) and ``spans`` (those and the field's), as ``kind:start:end`` lists."""
    field = fitted(documents.select("doc_id", "text"), sample)
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [pattern_spans(t) for t in texts]
            added = field_spans(field, texts, base)
            kinds = [[sum(k == i for k, _, _ in spans) for spans in base] for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in kinds), pa.array(map(listed, base), pa.string()),
                 pa.array([listed(sorted(b + a)) for b, a in zip(base, added)], pa.string())], ["doc_id", *counts, "base", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base string, spans string")
