"""Route path expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palisade.functions.text import strip


def _rooted(part: Column) -> Column:
    return F.when(part.startswith("/"), part).otherwise(F.concat(F.lit("/"), part))


def join_paths(prefix: Column, path: Column) -> Column:
    """Prefix plus path, both rooted; a trailing slash of the path is kept."""
    head = strip(F.coalesce(prefix, F.lit("")))
    tail = strip(F.coalesce(path, F.lit("")))
    head = F.when(head == "", F.lit("")).otherwise(F.rtrim(_rooted(head), F.lit("/")))
    return F.concat(head, F.when(tail == "", F.lit("/")).otherwise(_rooted(tail)))


def loose_path(prefix: Column, path: Column) -> Column:
    """Prefix and path joined by one slash, with no further clean-up."""
    head = F.rtrim(F.coalesce(prefix, F.lit("")), F.lit("/"))
    tail = F.ltrim(F.coalesce(path, F.lit("")), F.lit("/"))
    return (
        F.when((head != "") & (tail != ""), F.concat(head, F.lit("/"), tail))
        .when(head != "", head)
        .when(tail != "", F.concat(F.lit("/"), tail))
        .otherwise(F.lit("/"))
    )


def canonical_path(prefix: Column, path: Column) -> Column:
    """Rooted path without repeated or trailing slashes."""
    joined = loose_path(strip(F.coalesce(prefix, F.lit(""))), strip(F.coalesce(path, F.lit(""))))
    single = F.regexp_replace(_rooted(joined), "/+", "/")
    return F.when(single == "/", single).otherwise(F.rtrim(single, F.lit("/")))


def is_under(path: Column, prefixes: tuple[str, ...]) -> Column:
    """True when the path equals a prefix or lies below it, whatever the case."""
    bare = F.rtrim(F.lower(path), F.lit("/"))
    test = F.lit(False)
    for prefix in prefixes:
        test = test | (bare == prefix) | bare.startswith(prefix + "/")
    return test
