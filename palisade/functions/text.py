"""Text expressions: whitespace, names, secrets, evidence and locations. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palisade.catalog import markers

# The characters text splitting treats as white space, and the secret patterns.
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
SECRET_PATTERN = r"(?i)(?:sk|pk|api|key|token|secret|password|passwd|pwd)[-_A-Za-z0-9]{8,}"
ASSIGNED_LITERAL = r"^(.*?=\s*)([rubfRUBF]*)(['\"]{1,3}).*$"
REDACTED = "[REDACTED]"


def strip(value: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(value, f"^{WHITESPACE}|{WHITESPACE}$", "")


def collapse(value: Column) -> Column:
    """Trim and replace every run of white space by one blank."""
    return F.btrim(F.regexp_replace(value, WHITESPACE, " "))


def fold(value: Column) -> Column:
    """Collapsed, case-folded text for comparisons; null counts as empty."""
    return F.replace(F.lower(collapse(F.coalesce(value, F.lit("")))), F.lit("ß"), F.lit("ss"))


def evidence(segment: Column) -> Column:
    return collapse(segment)


def redact(text: Column) -> Column:
    """Hide the literal on the right of an assignment; hide everything when there is none."""
    return (
        F.when(text.isNull() | (text == ""), text)
        .when(text.rlike(ASSIGNED_LITERAL), F.regexp_replace(text, ASSIGNED_LITERAL, "$1$2$3" + REDACTED + "$3"))
        .otherwise(F.lit(REDACTED))
    )


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """True when any of the words is a substring: one alternation instead of a test per word."""
    escaped = "|".join("\\Q" + w + "\\E" for w in words)
    return text.rlike(escaped)


def snake_name(name: Column) -> Column:
    """Break camel case and punctuation into lower-case words joined by underscores."""
    broken = F.regexp_replace(strip(name), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    broken = F.regexp_replace(broken, r"([a-z0-9])([A-Z])", "$1_$2")
    broken = F.regexp_replace(broken, r"[^A-Za-z0-9]+", "_")
    return F.lower(F.btrim(F.regexp_replace(broken, r"_+", "_"), F.lit("_")))


def is_sensitive_name(name: Column) -> Column:
    return contains_any(snake_name(name), markers.SENSITIVE_NAME_WORDS)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character, over the distinct characters only."""
    size = F.char_length(value)
    letters = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))
    shares = F.transform(letters, lambda c: (size - F.char_length(F.replace(value, c, F.lit("")))) / size)
    total = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(size == 0, F.lit(0.0)).otherwise(total)


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | text.startswith(prefix)
    return test


def is_placeholder_secret(value: Column) -> Column:
    return F.lower(strip(value)).isin(*markers.PLACEHOLDER_SECRETS)


def is_probable_secret(value: Column) -> Column:
    """A literal long and opaque enough to be a real credential. Takes the stripped value."""
    lowered = F.lower(value)
    return (
        (F.char_length(value) >= 8)
        & ~starts_with_any(value, markers.SECRET_REFERENCE_PREFIXES)
        & ~starts_with_any(lowered, markers.URL_PREFIXES)
        & (
            value.rlike(SECRET_PATTERN)
            | ((F.char_length(value) >= 16) & ~starts_with_any(lowered, markers.CONNECTION_PREFIXES))
        )
    )


def is_weak_secret(value: Column) -> Column:
    return (F.char_length(value) < 16) | (entropy(value) < 3.0)


def location_text(path: Column, first: Column, last: Column) -> Column:
    """``file``, ``file:line`` or ``file:first-last``."""
    return (
        F.when(first.isNull(), path)
        .when(last.isNull() | (last == first), F.concat(path, F.lit(":"), first.cast("string")))
        .otherwise(F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string")))
    )


def rule_key(rule_id: Column) -> Column:
    return F.upper(strip(F.coalesce(rule_id, F.lit(""))))


def analyzer_key(name: Column) -> Column:
    return F.translate(F.lower(strip(name)), "_ ", "--")


def framework_key(name: Column) -> Column:
    """Lower case, with separators turned into single blanks."""
    spaced = F.translate(F.lower(strip(F.coalesce(name, F.lit("")))), "-_./\\", "     ")
    return collapse(spaced)


def extension_of(filename: Column) -> Column:
    """Lower-cased suffix with its dot; empty for dot files and names without a suffix."""
    return F.lower(F.regexp_extract(filename, r"^.+(\.[^.]+)$", 1))


def path_parameters(path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(path, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)"), 1))


def search_match(fields: list[Column], query: str) -> Column:
    """Case-insensitive substring over the non-empty fields joined by blanks; an empty query matches all."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    joined = F.lower(F.concat_ws(" ", *[F.nullif(f.cast("string"), F.lit("")) for f in fields]))
    return F.contains(joined, F.lit(wanted))
