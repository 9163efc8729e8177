"""Quality rules: text statistics, and a decision list learned from labelled ones.

Rules are conjunctions of thresholds that reject. Sequential covering grows one at a time: the threshold with the best gain is added until
no negative is covered, the last thresholds are pruned while that helps on documents held out, and what the rule covers is taken out before
the next. Every count the learner looks at is one aggregation over the labelled statistics; candidate thresholds are quantiles of each.
The learned list is an ordered conditional expression, evaluated next to the statistics.

Defined cases: a null text has no words; a document without words fails the base rules; labels that are null or without a document are
ignored, and several labels of a document count as bad if one is; without bad (or good) labels the list is empty and keeps what the base
rules keep; repeated rows are judged each on its own; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from palisade.llm.common import covered, cut_lineage, let, text_or_empty, words
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
SYMBOLS = "#*$%&|<>"
# Thresholds tried for each statistic, rules in a list and conditions in a rule at most: settings of the learner.
QUANTILES = 40
MAX_RULES = 8
MAX_CONDITIONS = 3
LEAST_PRECISION = 0.8
LEAST_COVERED = 5


def window_hashes(found: Column, window: int = WINDOW) -> Column:
    """Hash of every window of ``window`` words (a power of two): hashes of words, then of neighbouring pairs, pairs of pairs and so on."""
    def joined(h: Column, width: int) -> Column:
        pairs = F.transform(F.slice(h, 1, F.size(h) - width), lambda x, i: F.xxhash64(x, F.get(h, i + width)))
        return F.when(F.size(h) > width, pairs).otherwise(F.array().cast("array<bigint>"))

    def grown(h: Column, width: int) -> Column:
        return h if width == window else let(joined(h, width), lambda wider: grown(wider, 2 * width))

    return let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: grown(h, 1))


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in ``found``."""
    none = F.lit(0).cast("long")

    def words_of(places: Column) -> Column:
        return covered(F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(window).alias("length"))))

    def by_pair(h: Column) -> Column:
        def repeats(order: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(order, j)["hash"] == x["hash"], F.lit(False))
            return F.transform(F.filter(order, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["place"])

        return words_of(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.alias("place")))), repeats))

    def of_hashes(h: Column) -> Column:
        # Most texts repeat nothing, which a hash set finds out without a sort.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(by_pair(h))

    return F.when(F.size(found) <= window, none).otherwise(let(window_hashes(found, window), of_hashes))


def statistics(documents: DataFrame) -> DataFrame:
    """Counts of whole texts, one row per document."""
    text = F.col("text")
    kept = documents.select("doc_id", text_or_empty("text").alias("text"))

    def word_counts(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_words"), F.char_length(F.array_join(found, "")).cast("long").alias("word_chars"),
            repeated_words(found).alias("n_repeat_words"))

    def line_counts(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = let(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), line_counts)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return kept.select(
        "doc_id", let(words(text), word_counts).alias("w"), lines.alias("l"), count(f"[{SYMBOLS}]").alias("n_symbols"), count("[A-Z]").alias("n_upper"),
    ).select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features() -> dict[str, Column]:
    """Statistics that rules put thresholds on."""
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "word_chars"),
        "capitals": share("n_upper", "word_chars"), "equal_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value


@dataclass
class Rule:
    conditions: list[Condition] = field(default_factory=list)

    def column(self) -> Column:
        holds = F.lit(True)
        for condition in self.conditions:
            holds = holds & condition.column()
        return holds

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.value:.4g}" for c in self.conditions)


def _tallies(rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[Condition, int, int]]:
    """Each possible threshold with the bad and good rows that it keeps, from one count by (statistic, bin)."""
    bins = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in cuts)))
    counted = rows.select("bad", bins.alias("at")).groupBy("at.feature", "at.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    out = []
    for feature, values in cuts.items():
        own = {r["bin"]: (r["p"], r["n"]) for r in counted if r["feature"] == feature}
        p, n = (sum(v[i] for v in own.values()) for i in (0, 1))
        below_p = below_n = 0
        for i, value in enumerate(values):  # bin i holds the values up to values[i]
            below_p, below_n = below_p + own.get(i, (0, 0))[0], below_n + own.get(i, (0, 0))[1]
            out += [(Condition(feature, False, value), below_p, below_n), (Condition(feature, True, value), p - below_p, n - below_n)]
    return out


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each statistic among bad and among good rows, and the middle of each two, so that a rule need not start at a value seen."""
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    names = list(features())
    rows = labelled.groupBy("bad").agg(*(F.percentile_approx(n, shares, 1000).alias(n) for n in names)).collect()
    cuts = {}
    for n in names:
        values = sorted({v for r in rows for v in r[n] or []})
        cuts[n] = sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:]))})
    return cuts


def learn(labelled: DataFrame) -> list[Rule]:
    """Decision list over ``labelled(bad, held, <features>)``; rows with ``held`` prune, the others grow."""
    cuts = thresholds(labelled)
    bin_of = lambda n: F.size(F.filter(F.expr(f"array({', '.join(f'{v!r}D' for v in cuts[n])})"), lambda c: c < F.col(n)))
    rest, rules = cut_lineage(labelled.withColumns({f"bin_{n}": bin_of(n) for n in cuts})), []
    while len(rules) < MAX_RULES:
        rule, inside = Rule(), rest.filter("not held")
        p = n = None
        while len(rule.conditions) < MAX_CONDITIONS and n != 0:
            tallies = _tallies(inside, cuts)
            if p is None:
                p, n = (tallies[0][i] + tallies[1][i] for i in (1, 2)) if tallies else (0, 0)
            if p < LEAST_COVERED or n == 0:
                break

            def gain(entry: tuple[Condition, int, int], p: int = p, n: int = n) -> tuple[float, float]:
                """Gain of a threshold; of equal ones the one that rejects less is first."""
                condition, p1, n1 = entry
                worth = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n))) if p1 >= LEAST_COVERED else -math.inf
                return worth, condition.value if condition.above else -condition.value

            best = max(tallies, key=gain)
            if gain(best)[0] <= 0:
                break
            rule.conditions.append(best[0])
            inside = inside.filter(best[0].column())
            p, n = best[1], best[2]
        if not rule.conditions:
            break
        prefixes = [Rule(rule.conditions[: i + 1]) for i in range(len(rule.conditions))]
        counts = rest.filter("held").agg(*(
            c for i, r in enumerate(prefixes)
            for c in (F.count_if(r.column() & F.col("bad")).alias(f"p{i}"), F.count_if(r.column() & ~F.col("bad")).alias(f"n{i}")))).first()
        worth = [(counts[f"p{i}"] - counts[f"n{i}"]) / max(1, counts[f"p{i}"] + counts[f"n{i}"]) for i in range(len(prefixes))]
        chosen = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        good, wrong = counts[f"p{chosen}"], counts[f"n{chosen}"]
        if good + wrong == 0 or good / (good + wrong) < LEAST_PRECISION:
            break
        rules.append(prefixes[chosen])
        rest = rest.filter(~prefixes[chosen].column())
    return rules


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1, or null."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(number)).otherwise(out)
    return out


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every document with ``base_failed``, ``rule`` (that rejects it, as text, or null) and ``kept``."""
    counted = cut_lineage(statistics(documents))
    wide = counted.select("*", *(c.alias(n) for n, c in features().items()))
    marked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg((F.min("quality") < 1).alias("bad"))
    )
    # Texts of the same statistics are one row of the same fold, so that copies never prune the rule they grew.
    labelled = cut_lineage(
        wide.filter(~base_failed()).join(marked, "doc_id")
        .select("bad", (F.pmod(F.xxhash64(*features()), F.lit(3)) == 0).alias("held"), *features())
    )
    rules = learn(labelled)
    number = first_rule(rules)
    name = F.lit(None).cast("string")
    for i, rule in enumerate(rules, 1):
        name = F.when(F.col("number") == i, F.lit(str(rule))).otherwise(name)
    return (
        wide.withColumn("base_failed", base_failed()).withColumn("number", number)
        .select(*counted.columns, "base_failed", name.alias("rule"), (~F.col("base_failed") & F.col("number").isNull()).alias("kept"))
    )
