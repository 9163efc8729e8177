"""Quality classifier by co-training: one classifier sees the words of a text, the other its metadata and layout.

Both start from labelled documents. In each round either one labels, among all documents, those that it is sure of, for the other to learn
from: the other counts its slots in them, on Spark, and leans towards the class in which a slot is more frequent. Labels are given anew in
every round, so a wrong one is not kept. At the end both are calibrated, and combined, on labelled documents held out; all documents are
scored whole, next to their row, without a shuffle. A document is good if its quality is 1 and it is not toxic.

Only the labelled rows to fit on are bounded: at most ``labelled``, those with the smallest hash of their id, whatever the size of the corpus.
Every other document, labelled or not, takes part in the exchange; what reaches the driver of it is one row per slot.

Defined cases: a null text is empty; nulls and missing columns of the metadata are a value of their own; labels without a document, or of null
quality, are ignored, of several labels the worst counts, and a null toxicity is not toxic; without both good and bad labels every document is
kept with the score 1; where a view is sure of documents of one class only, the other learns nothing from it; an empty table gives an empty
one; very long texts are taken whole; repeated rows get the same score; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from palisade.llm.common import cut_lineage, text_or_empty
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELLED = 10_000
ROUNDS = 3
SURE = 0.95  # calibrated confidence of a pseudo-label
LEAST, TELLING = 3, 3.5  # a slot counts if so many documents have it, and its share of good and of bad ones differs by so many standard errors
KEEP_AT = 0.5
WORD_BITS = 17
META_NAMES = ("lang", "source")
META_SLOTS = 256
BINS = 10

# Lower case, and blanks for punctuation; marks and symbols stay parts of words.
_WORDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:?\"'()", b"abcdefghijklmnopqrstuvwxyz         ")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"#*$%&|<>{}[]=~^_\\/@+"


# --- The two views. ---


def word_slots(text: bytes) -> np.ndarray:
    """Slots of the distinct words."""
    mask = (1 << WORD_BITS) - 1
    found = {zlib.crc32(w) & mask for w in set(text.translate(_WORDS).split())}
    return np.fromiter(found, np.int32, len(found))


def layout(text: bytes) -> list[float]:
    """Shape of a text: lengths, and shares of kinds of characters."""
    n = max(1, len(text))
    without = lambda drop: 1 - len(text.translate(None, drop)) / n
    lines = text.count(b"\n") + 1
    return [
        float(np.log1p(len(text))), float(np.log1p(lines)), float(np.log1p(n / lines)), without(_UPPER), without(_SYMBOLS), without(b"0123456789"),
        without(b"!?"), without(b" \n\t"), without(b".,;:"),
    ]


def named_slots(values: list[str | None]) -> list[int]:
    return [zlib.crc32(f"{i}:{v}".encode()) % META_SLOTS for i, v in enumerate(values)]


# --- Linear models over slots. ---


def telling(in_good: np.ndarray, in_bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """Which slots tell good documents from bad ones, by the number of either that have them."""
    total, n1, n0 = in_good + in_bad, max(1.0, n_good), max(1.0, n_bad)
    share = np.clip(total / max(1.0, n_good + n_bad), 1e-9, 1 - 1e-9)
    difference = np.abs(in_good / n1 - in_bad / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return (total >= LEAST) & (difference >= TELLING)


def lean_of(in_good: np.ndarray, in_bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """Log-odds of telling slots, from counts of pseudo-labelled documents; nothing where these are of one class."""
    if min(n_good, n_bad) < 1:
        return np.zeros(len(in_good))
    odds = np.log((in_good + 0.5) / (n_good + 1)) - np.log((in_bad + 0.5) / (n_bad + 1))
    return np.where(telling(in_good, in_bad, n_good, n_bad), odds, 0.0)


@dataclass
class Logistic:
    """Logistic regression on rows that are sets of slots."""

    size: int
    penalty: float
    weights: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.weights = np.zeros(self.size + 1)

    def fit(self, rows: list[np.ndarray], good: np.ndarray, steps: int = 150, rate: float = 0.05) -> None:
        """Full-batch Adam from the present weights, over telling slots; the others only add noise to long texts."""
        slots, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        in_good = np.bincount(slots, good[of], self.size)
        common = telling(in_good, np.bincount(slots, minlength=self.size) - in_good, good.sum(), (1 - good).sum())
        slots, of = slots[common[slots]], of[common[slots]]
        m, v = np.zeros(self.size + 1), np.zeros(self.size + 1)
        for step in range(1, steps + 1):
            z = np.bincount(of, self.weights[slots], len(rows)) + self.weights[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good) / len(rows)
            slope = np.append(np.bincount(slots, error[of], self.size), error.sum()) + self.penalty * np.append(self.weights[:-1], 0.0)
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
            self.weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights[:-1][~common] = 0.0


def calibrated(columns: np.ndarray, good: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights and offset that turn columns of logits into probabilities, by Newton's method with a small ridge."""
    x = np.column_stack([columns, np.ones(len(good))])
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, 0.1), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - good) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(columns: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(columns @ w[:-1] + w[-1], -30, 30)))


@dataclass
class View:
    """What one classifier knows: weights from labels, the lean of slots from the other's pseudo-labels, and the calibration of both."""

    weights: np.ndarray
    lean: np.ndarray
    scale: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def columns(self, rows: list[np.ndarray]) -> np.ndarray:
        """Per row its logit, and the lean of its telling slots over the root of their number, so that long texts are not surer by length."""
        leans = [self.lean[r] for r in rows]
        return np.array([(self.weights[r].sum() + self.weights[-1], x.sum() / max(1, np.count_nonzero(x)) ** 0.5) for r, x in zip(rows, leans)]).reshape(-1, 2)


@dataclass
class Model:
    """Both views and their combination; ``edges`` bin the layout, ``taught`` are the documents labelled by (words, metadata) in each round."""

    edges: np.ndarray
    text: View
    meta: View
    both: np.ndarray = field(default_factory=lambda: np.zeros(5))
    taught: list[tuple[int, int]] = field(default_factory=list)

    def slots(self, texts: list[bytes], names: list[list[str | None]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [word_slots(x) for x in texts], [meta_slots(n, layout(x), self.edges) for x, n in zip(texts, names)]

    def score(self, texts: list[bytes], names: list[list[str | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the views and of both."""
        words, metas = self.slots(texts, names)
        t, m = self.text.columns(words), self.meta.columns(metas)
        return probability(t, self.text.scale), probability(m, self.meta.scale), probability(np.column_stack([t, m]), self.both)


class Exchange:
    """Counts of slots in pseudo-labelled documents: ``counts[k]`` holds bad and good ones by slot of view ``k``, as the other view labels them.

    The last slot of a view counts the documents themselves.
    """

    def __init__(self, meta_size: int):
        self.counts = [np.zeros((2, (1 << WORD_BITS) + 1), np.int64), np.zeros((2, meta_size + 1), np.int64)]

    def add(self, model: Model, words: list[np.ndarray], metas: list[np.ndarray]) -> None:
        rows = (words, metas)
        for pupil, teacher in ((0, model.meta), (1, model.text)):
            p = probability(teacher.columns(rows[1 - pupil]), teacher.scale)
            for good, sure in enumerate((p <= 1 - SURE, p >= SURE)):
                of = [rows[pupil][i] for i in np.flatnonzero(sure)]
                count = self.counts[pupil][good]
                count[-1] += len(of)
                if of:
                    count[:-1] += np.bincount(np.concatenate(of), minlength=len(count) - 1)


def meta_slots(names: list[str | None], shape: list[float], edges: np.ndarray) -> np.ndarray:
    """Slots of the named values, then one bin for each number of the layout."""
    bins = [META_SLOTS + i * BINS + int(np.searchsorted(e, v)) for i, (e, v) in enumerate(zip(edges, shape))]
    return np.array(named_slots(names) + bins, np.int32)


# --- Fitting. ---


def _batch(batch: pa.RecordBatch, names: int) -> tuple[list[bytes], list[tuple]]:
    """Texts and named values of a batch that starts with them."""
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(0)]
    return texts, list(zip(*(c.to_pylist() for c in batch.columns[1 : 1 + names]))) if names else [()] * len(texts)


def features(documents: DataFrame, names: list[str]) -> DataFrame:
    """``(good, body, words, names, layout)`` of ``documents(text, good, <names>)``; ``body`` is a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, named = _batch(batch, len(names))
            yield pa.RecordBatch.from_arrays([
                batch.column("good"), batch.column("body"), pa.array([word_slots(t) for t in texts], pa.list_(pa.int32())),
                pa.array([list(n) for n in named], pa.list_(pa.string())), pa.array([layout(t) for t in texts], pa.list_(pa.float64()))],
                ["good", "body", "words", "names", "layout"])

    rows = documents.select(F.encode("text", "utf-8").alias("text"), *names, "good", F.xxhash64(text_or_empty("text")).alias("body"))
    return rows.mapInArrow(run, "good int, body long, words array<int>, names array<string>, layout array<double>")


def _named(documents: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(n).cast("string").alias(f"m{i}") for i, n in enumerate(names)]


def sample(documents: DataFrame, labels: DataFrame, names: list[str], labelled: int) -> DataFrame:
    """Features of the labelled documents to fit on."""
    judged = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.min(F.when((F.col("quality") >= 1) & (F.coalesce("toxic", F.lit(0)) < 1), F.lit(1)).otherwise(F.lit(0)))).alias("good"))
    # The list is bounded by a parameter, so the join below moves no text.
    chosen = cut_lineage(judged.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(labelled).withColumnRenamed("doc_id", "chosen"))
    rows = documents.select(F.col("doc_id").alias("id"), F.col("text"), *_named(documents, names)).join(F.broadcast(chosen), F.col("id") == F.col("chosen"))
    return cut_lineage(features(rows.drop("id", "chosen"), [f"m{i}" for i in range(len(names))]))


def exchange_over(documents: DataFrame, names: list[str]) -> Callable[[Model, np.ndarray], Exchange]:
    """A round of pseudo-labels over all ``documents`` but those whose text is held out, as counts by slot; a task holds one array per view."""
    rows = documents.select(F.encode("text", "utf-8").alias("text"), *_named(documents, names), F.xxhash64(text_or_empty("text")).alias("body"))

    def teach(model: Model, held: np.ndarray) -> Exchange:
        size = META_SLOTS + BINS * len(model.edges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Exchange(size)
            for batch in batches:
                texts, named = _batch(batch, len(names))
                free = np.flatnonzero(~np.isin(batch.column("body").to_numpy(), held))
                found.add(model, *model.slots([texts[i] for i in free], [named[i] for i in free]))
            for view, (bad, good) in enumerate(found.counts):
                at = np.flatnonzero(bad + good)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view, np.int32)), pa.array(at), pa.array(bad[at]), pa.array(good[at])], ["view", "slot", "bad", "good"])

        counted = rows.mapInArrow(run, "view int, slot long, bad long, good long").groupBy("view", "slot").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        total, table = Exchange(size), counted.toArrow()
        view, slot, bad, good = (table.column(c).to_numpy() for c in ("view", "slot", "bad", "good"))
        for k, count in enumerate(total.counts):
            count[0, slot[view == k]], count[1, slot[view == k]] = bad[view == k], good[view == k]
        return total

    return teach


def fit(rows: list[dict], teach: Callable[[Model, np.ndarray], Exchange], rounds: int = ROUNDS) -> Model | None:
    """Co-training from labelled features (``words`` and ``layout`` are arrays); None without both classes.

    ``teach`` counts the slots of what a model is sure of, over all documents but those of the hashes given.
    """
    # Copies of a text count once, and never on both sides of the hold-out.
    unique = {}
    for r in rows:
        unique.setdefault(hashlib.sha256(np.sort(r["words"]).tobytes()).digest(), r)
    known = [unique[k] for k in sorted(unique)]
    if len({r["good"] for r in known}) < 2:
        return None
    shapes = np.array([r["layout"] for r in known])
    edges = np.quantile(shapes, np.arange(1, BINS) / BINS, axis=0).T
    held, train = known[::4], [r for i, r in enumerate(known) if i % 4]
    if len({r["good"] for r in held}) < 2 or len({r["good"] for r in train}) < 2:
        held = train = known
    y, y_held = (np.array([r["good"] for r in some], float) for some in (train, held))
    bodies = np.array([r["body"] for r in held], np.int64)
    cut = (lambda some: [r["words"] for r in some], lambda some: [meta_slots(r["names"], r["layout"], edges) for r in some])
    starts = (Logistic(1 << WORD_BITS, 1e-5), Logistic(META_SLOTS + BINS * shapes.shape[1], 1e-4))
    for start, slots in zip(starts, cut):
        start.fit(slots(train), y)
    model = Model(edges, *(View(start.weights, np.zeros(start.size)) for start in starts))
    views, held_rows = (model.text, model.meta), [slots(held) for slots in cut]

    def calibrate() -> None:
        for view, some in zip(views, held_rows):
            view.scale = calibrated(view.columns(some), y_held)

    calibrate()
    for _ in range(rounds):
        found = teach(model, bodies)
        for view, (bad, good) in zip(views, found.counts):
            view.lean = lean_of(good[:-1], bad[:-1], good[-1], bad[-1])
        calibrate()
        model.taught.append((int(found.counts[1][:, -1].sum()), int(found.counts[0][:, -1].sum())))
    model.both = calibrated(np.column_stack([view.columns(some) for view, some in zip(views, held_rows)]), y_held)
    return model


def rows_of(sample: pa.Table) -> list[dict]:
    """Rows of ``features`` whose arrays are views of the table, which takes a tenth of the memory of Python numbers."""
    columns = {n: sample.column(n).combine_chunks() for n in ("words", "layout")}
    views = {n: (c.values.to_numpy(), c.offsets.to_numpy()) for n, c in columns.items()}
    cut = lambda n, i: views[n][0][views[n][1][i] : views[n][1][i + 1]]
    named = zip(sample.column("good").to_pylist(), sample.column("body").to_pylist(), sample.column("names").to_pylist())
    return [{"good": g, "body": b, "names": names, "words": cut("words", i), "layout": cut("layout", i)} for i, (g, b, names) in enumerate(named)]


SCORES = "p_text double, p_meta double, score double"


def scorer(model: Model | None):
    """A column function of (text in UTF-8, named values) that scores documents."""
    kind = pa.struct([("p_text", pa.float64()), ("p_meta", pa.float64()), ("score", pa.float64())])

    def run(text: pa.Array, names: pa.Array) -> pa.Array:
        if model is None:
            one = pa.array(np.ones(len(text)))
            return pa.StructArray.from_arrays([one, one, one], fields=list(kind))
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in text]
        return pa.StructArray.from_arrays([pa.array(c) for c in model.score(texts, names.to_pylist())], fields=list(kind))

    run.__annotations__ = {"text": pa.Array, "names": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, SCORES)


def trained(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """The model of ``documents`` and ``labels``; None where there is nothing to tell apart."""
    names = [n for n in META_NAMES if n in documents.columns]
    return fit(rows_of(sample(documents, labels, names, labelled).toArrow()), exchange_over(documents, names))


def scored(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """``(row, scores)`` of every document: its columns as they are, and ``p_text``, ``p_meta`` and ``score``, the chance that it is good."""
    names = [n for n in META_NAMES if n in documents.columns]
    model = trained(documents, labels, labelled)
    columns: list[Column] = [F.col(f"`{c}`") for c in documents.columns]
    named = F.array(*(F.col(n).cast("string") for n in names)) if names else F.array().cast("array<string>")
    return documents.select(F.struct(*columns).alias("row"), scorer(model)(F.encode("text", "utf-8"), named).alias("scores"))


def kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those that are more likely bad than good."""
    return scored(documents, labels).filter(F.col("scores.score") >= KEEP_AT).select("row.*")
