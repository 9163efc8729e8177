"""Secret scan: three patterns, and sliding-window entropy over long mixed tokens.

A token of at least ``WINDOW`` characters that mixes letters and digits is a candidate. Its characters decide its class (hexadecimal,
alphanumeric or base 64), and the class its alphabet and threshold. The Shannon entropy of each window follows from that of the window
before by the counts of the one character that enters and the one that leaves. Windows at or above the threshold become a span, unless the
token matches the allow-list.

Spans of the patterns and public pieces (UUIDs, dates, named digests) are blanked out before tokens are looked for, so what stands next to one
in the same run is judged on its own. Positions are running sums in rounds of doubling width, and overlaps are looked up by halving, so the cost
of a text of ``n`` characters and ``m`` matches grows with ``n + m log m``.

Defined cases: a null text is empty and has no spans; an empty table gives an empty one; positions count code points; every match of a text is
kept, whatever its number or the length of the text; spans of different kinds may overlap, and what one of them leaves of another keeps an entropy
span away; repeated rows are scanned each on its own; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from palisade.llm.common import let, text_or_empty
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A kind of secret: what to find, and the least length of a match, or of its group ``measured``."""

    kind: str
    pattern: str
    least: int = 0
    measured: int = 0


# Runs of one class are matched from their start only, which gives the same matches as trying every position and takes linear time.
PATTERNS = (
    Pattern("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Pattern("access", r"AKIA[A-Z0-9]{16,}"),
    Pattern("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)

WINDOW = 20
# ``=`` only pads the end of a token.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
# Pieces that look random and are public, by themselves and inside of longer runs.
PUBLIC = Pattern("public", (
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])|(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
    r"|(?<![A-Za-z0-9])(?i:sha(?:1|256|384|512))[-_=:][A-Za-z0-9+/_=-]+"))


@dataclass(frozen=True)
class CharacterClass:
    name: str
    pattern: str
    alphabet: str
    threshold: float  # bits a character


_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The first class whose pattern a token matches is its class. Random text of a class has 3.5, 4.1 and 4.1 bits in windows of 20.
CLASSES = (
    CharacterClass("hex", r"^[0-9a-f]+$", _ALNUM[:16], 3.0),
    CharacterClass("alnum", r"^[0-9A-Za-z]+$", _ALNUM, 3.7),
    CharacterClass("base64", r"^[0-9A-Za-z+/_=-]+$", _ALNUM + "+/_=-", 3.7),
)
# Tokens that look random and are public: slugs with a number, placeholders, one character over and over.
ALLOWED = (r"^[a-z]+([-_][a-z0-9]+)*[-_]?[0-9]{1,8}$", r"(?i)example|placeholder|changeme|redacted|dummy", r"(.)\1{7}")


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima, by ``join``) of an array: every round joins each value with the one twice as far back as the round before."""
    many = F.size(values)
    rounds = F.when(many > 1, F.sequence(F.lit(0), F.ceil(F.log2(many)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def further(held: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(held, lambda x, i: F.when(i >= back, join(x, F.get(held, i - back))).otherwise(x))

    return F.aggregate(rounds, values, further)


def below(ordered: Column, bound: Column) -> Column:
    """How many values of an ascending array are smaller than ``bound``, by halving."""
    def step(at: Column, k: Column) -> Column:
        jump = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.coalesce(F.get(ordered, jump - 1) < bound, F.lit(False)), jump).otherwise(at)

    widths = F.sequence(F.ceil(F.log2(F.size(ordered) + 1)).cast("int"), F.lit(0), F.lit(-1))
    return F.aggregate(widths, F.lit(0), step)


def _pieces(text: Column, pattern: str, group: int = 0) -> Column:
    """``(between, whole, part)``: the text between the matches of a pattern, one more than matches; the matches; the group of each."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
    return F.struct(F.split(text, pattern, -1).alias("between"), whole.alias("whole"), part.alias("part"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order as ``(start, end, match, part)``; ``part`` is the group of that number."""
    def placed(found: Column) -> Column:
        lengths = F.transform(found["whole"], lambda m, i: F.char_length(F.get(found["between"], i)) + F.char_length(m))

        def at(ends: Column) -> Column:
            return F.transform(found["whole"], lambda m, i: F.struct(
                (F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"),
                (F.get(found["part"], i) if group else m).alias("part")))

        return let(running(lengths, lambda a, b: a + b), at)

    return let(_pieces(text, pattern, group), placed)


def blanked(text: Column, kinds: tuple[Pattern, ...]) -> Column:
    """``text`` with blanks for what the patterns match, one kind after the other; all other positions stay."""
    def without(kind: Pattern) -> Callable[[Column], Column]:
        def filled(found: Column) -> Column:
            def blank(i: Column) -> Column:
                whole = F.get(found["whole"], i)
                measured = F.get(found["part"], i) if kind.measured else whole
                return F.coalesce(F.when(F.char_length(measured) >= kind.least, F.repeat(F.lit(" "), F.char_length(whole))).otherwise(whole), F.lit(""))

            return F.array_join(F.transform(found["between"], lambda b, i: F.concat(b, blank(i))), "")

        return filled

    for kind in kinds:
        text = let(_pieces(text, kind.pattern, kind.measured), without(kind))
    return text


def pattern_spans(text: Column, kinds: tuple[Pattern, ...]) -> Column:
    """Spans ``(start, rank, end, kind)`` of all kinds, by start and then as listed."""
    def of(rank: int, kind: Pattern) -> Column:
        kept = F.filter(matches(text, kind.pattern, kind.measured), lambda m: F.char_length(m["part"]) >= kind.least)
        return F.transform(kept, lambda m: _span(m["start"], m["end"], rank, kind.kind))

    return F.sort_array(F.concat(*(of(rank, kind) for rank, kind in enumerate(kinds))))


def _span(start: Column, end: Column, rank: int, kind: str) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))


def _term(count: Column) -> Column:
    """count * log2(count), zero for zero."""
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def entropy_range(token: Column, group: CharacterClass, window: int = WINDOW) -> Column:
    """``(first, last)``: offsets where the first window at the threshold starts and the last ends; ``first`` is null if there is none."""
    width = F.lit(window)
    # The counters of several characters share a long, so that a step changes a few numbers.
    bits = window.bit_length()
    per = 63 // bits
    longs = len(group.alphabet) // per + 1
    shift = lambda k: (k % per) * bits
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), shift(k))
    of = lambda k: F.floor(k / per).cast("int")

    def count(counts: Column, k: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, of(k)), shift(k)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def moved(codes_of: Column, held: Column, at: Column) -> Column:
        def inner(codes: Column) -> Column:
            leaves, enters, full_before = codes["leaves"], codes["enters"], at >= width
            gone = count(held["counts"], leaves)
            total = held["sum"] + F.when(full_before, _term(gone - 1) - _term(gone)).otherwise(F.lit(0.0))
            there = count(held["counts"], enters) - F.when(full_before & (leaves == enters), F.lit(1)).otherwise(F.lit(0))
            total = total + _term(there + 1) - _term(there)
            counts = F.transform(held["counts"], lambda n, k: n + F.when(k == codes["in"], codes["plus"]).otherwise(F.lit(0)) - F.when(
                full_before & (k == codes["out"]), codes["minus"]).otherwise(F.lit(0)))
            full = (at >= window - 1) & (F.log2(width) - total / width >= group.threshold)
            return F.struct(
                counts.alias("counts"), total.alias("sum"),
                F.when(full, F.coalesce(held["first"], at - (window - 1))).otherwise(held["first"]).cast("int").alias("first"),
                F.when(full, at + 1).otherwise(held["last"]).cast("int").alias("last"))

        leaves, enters = F.when(at >= width, F.get(codes_of, at - width)).otherwise(F.lit(0)), F.get(codes_of, at)
        return let(F.struct(
            leaves.alias("leaves"), enters.alias("enters"), of(enters).alias("in"), one(enters).alias("plus"), of(leaves).alias("out"), one(leaves).alias("minus")), inner)

    def ranged(codes_of: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(codes_of) - 1)
        return F.aggregate(places, zero, lambda held, at: moved(codes_of, held, at), lambda held: F.struct(held["first"].alias("first"), held["last"].alias("last")))

    characters = F.filter(F.split(token, ""), lambda c: c != "")
    return let(F.transform(characters, lambda c: F.position(c, F.lit(group.alphabet))), ranged)


def entropy_spans(text: Column, base: Column, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED, rank: int = len(PATTERNS)) -> Column:
    """Spans of kind ``entropy``: runs of windows at their class's threshold, in tokens not allowed, that meet no span of ``base`` (ordered by start)."""
    def suspect(m: Column) -> Column:
        plain = m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]")
        for pattern in allowed:
            plain = plain & ~m["match"].rlike(pattern)
        return plain

    def ranged(m: Column) -> Column:
        found = F.lit(None).cast("struct<first:int,last:int>")
        for group in reversed(CLASSES):
            found = F.when(m["match"].rlike(group.pattern), entropy_range(m["match"], group, window)).otherwise(found)
        return F.struct(m["start"].alias("start"), found.alias("range"))

    def meets(known: Column, s: Column) -> Column:
        # The spans that start before the end of this one meet it if one of them ends behind its start.
        return let(below(known["starts"], s["end"]), lambda n: F.coalesce(F.get(known["ends"], n - 1) > s["start"], F.lit(False)))

    def apart(spans: Column) -> Column:
        known = F.struct(F.transform(base, lambda b: b["start"]).alias("starts"), running(F.transform(base, lambda b: b["end"]), F.greatest).alias("ends"))
        return F.when(F.size(base) == 0, spans).otherwise(let(known, lambda k: F.filter(spans, lambda s: ~meets(k, s))))

    bare = blanked(F.when(F.size(base) > 0, blanked(text, PATTERNS)).otherwise(text), (PUBLIC,))
    ranges = F.filter(F.transform(F.filter(let(bare, lambda t: matches(t, CANDIDATE)), suspect), ranged), lambda r: r["range"]["first"].isNotNull())
    spans = F.transform(ranges, lambda r: _span(r["start"] + r["range"]["first"], r["start"] + r["range"]["last"], rank, "entropy"))
    # Most texts have no token that is long enough.
    return F.when(text.rlike(CANDIDATE), let(spans, apart)).otherwise(F.slice(base, 1, 0))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(documents: DataFrame) -> DataFrame:
    """Per document ``base`` (spans of the patterns) and ``spans`` (those and the entropy spans), each sorted by start."""
    text = documents.select("doc_id", text_or_empty("text").alias("text"))
    based = text.select("doc_id", "text", pattern_spans(F.col("text"), PATTERNS).alias("base"))
    both = let(F.col("base"), lambda base: F.struct(base.alias("base"), F.sort_array(F.concat(base, entropy_spans(F.col("text"), base))).alias("spans")))
    return based.select("doc_id", both.alias("found")).select("doc_id", "found.base", "found.spans")
