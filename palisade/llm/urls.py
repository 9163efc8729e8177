"""URL filter: path rules first, then exact list membership by a cascade of Bloom filters.

The first filter holds the listed keys. Keys of the corpus that are not listed but pass it go into the second, listed keys that pass the
second into the third, and so on until nothing passes by mistake. Over the complete set of keys the cascade was built with, membership is
therefore exact, and looking a key up needs no join: the filters are constants of the expression.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule; an empty list lists nothing; repeated rows get
the same verdict each; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from palisade.llm.common import ascii_lower, bit_at, bit_words, bits_literal, cut_lineage
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 8
PROBES = 4
# A level of more bits than this does not travel as a constant; membership is then a join on the key.
MAX_BITS = 1 << 25


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A to Z) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as its text, or null. A rule fits its host and every subdomain, for paths that start with its path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its number, its size in bits and its words that are not zero."""

    number: int
    bits: int
    words: dict[int, int]

    def passes(self, key: Column) -> Column:
        array = bits_literal(self.words, self.bits)
        passed = F.lit(True)
        for position in probes(key, self.number, self.bits):
            passed = passed & bit_at(array, position)
        return passed


def probes(key: Column, level: int, bits: int) -> list[Column]:
    """Bit positions of a key at a level, by double hashing."""
    first, second = (F.shiftrightunsigned(F.xxhash64(key, F.lit(n)), 32) for n in (2 * level, 2 * level + 1))
    return [F.pmod(first + F.lit(i) * second, F.lit(bits).cast("long")) for i in range(PROBES)]


def build_cascade(universe: DataFrame) -> list[Level] | None:
    """Filters over ``universe(key, listed)``, which must hold every key that will be looked up, once each.

    None where a level would exceed ``MAX_BITS``.
    """
    levels: list[Level] = []
    encoded, other = universe.filter("listed"), universe.filter("not listed")
    while count := encoded.count():
        bits = -(-count * BITS_PER_KEY // 64) * 64
        if bits > MAX_BITS:
            return None
        number = len(levels)
        positions = encoded.select(F.explode(F.array(*probes(F.col("key"), number, bits))).alias("position"))
        level = Level(number, bits, bit_words(positions))
        levels.append(level)
        encoded, other = other.filter(level.passes(F.col("key"))), encoded
    return levels


def in_cascade(levels: list[Level], key: Column) -> Column:
    """Membership of a key of the universe: the first filter that it does not pass decides."""
    member = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        member = F.when(level.passes(key), member).otherwise(F.lit(level.number % 2 == 1))
    return member


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], listed: Column, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of their URLs; needs a column ``page_id``.

    ``listed`` is a condition on ``host`` that names the listed keys; it is evaluated over the distinct hosts of the corpus alone.
    A rule's verdict holds where one fits; else ``block`` for listed hosts and ``allow`` for the others.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe = cut_lineage(parts.select("host").distinct().select(F.col("host").alias("key"), F.coalesce(listed, F.lit(False)).alias("listed")))
    levels = build_cascade(universe)
    if levels is None:
        known = universe.filter("listed").select(F.col("key").alias("host"), F.lit(True).alias("member"))
        parts = parts.join(known, "host", "left").withColumn("member", F.coalesce("member", F.lit(False)))
    else:
        parts = parts.withColumn("member", in_cascade(levels, F.col("host")))
    ruled = parts.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("member"), F.lit("block")).otherwise(F.lit("allow"))
    for rule in rules:
        verdict = F.when(F.col("rule") == rule.text, F.lit(rule.verdict)).otherwise(verdict)
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
