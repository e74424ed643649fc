"""Small functions over texts and values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.datatypes import format_time


def truncate(text: Column, size: int, head: bool = True) -> Column:
    """At most ``size`` characters (3 at least), with ``...`` in the place of what is cut off at the end, or the start."""
    size = max(3, size)
    keep = size - 3
    cut = F.concat(F.substring(text, 1, keep), F.lit("...")) if head else F.concat(F.lit("..."), F.right(text, F.lit(keep)))
    return F.when(F.length(text) > size, cut).otherwise(text)


def as_object(value: Column, kind: str) -> Column:
    """A typed column as the text an object has: times in UTC, truth values in small letters, bytes as UTF-8."""
    if kind.startswith("timestamp") or kind == "date":
        return format_time(value.cast("timestamp"))
    if kind == "binary":
        return F.decode(value, "UTF-8")
    if kind.split("<")[0] in ("array", "map", "struct"):
        raise TypeError(f"a {kind} is no single value")
    return value.cast("string")


def replace_invalid(text: Column) -> Column:
    """Characters that XML can't hold, replaced by U+FFFD."""
    return F.regexp_replace(text, r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "�")


def strip_controls(text: Column) -> Column:
    """Without characters of the Unicode category C."""
    return F.regexp_replace(text, r"\p{C}", "")


def single_blanks(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern, or of its first group."""
    group = 1 if "(" in pattern.replace(r"\(", "").replace("(?:", "") else 0
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def fuzzy_key(value: Column, method: str) -> Column:
    """The key under which values match loosely, by the fuzzy matching of their object type: ``phonetic``,
    ``substring:pattern``, ``[n:]`` without the first n characters, ``[:n]`` the first n."""
    if method == "phonetic":
        return F.soundex(value)
    if method.startswith("substring:"):
        return F.regexp_extract(value, method[len("substring:") :], 0)
    start, _, end = method.strip("[]").partition(":")
    if start:
        return F.substring(value, int(start) + 1, 2**31 - 1)
    return F.substring(value, 1, int(end))


def short_count(n: int) -> str:
    """A number as 12.3k or 1.2M."""
    for size, mark in ((1_000_000_000, "G"), (1_000_000, "M"), (1_000, "k")):
        if n >= size:
            return f"{n / size:.1f}{mark}"
    return str(n)


def noisy_or(confidence: Column) -> Column:
    """The aggregate 1 - (1-a)(1-b)…: the chance that not all of several confirmations are wrong."""
    return F.lit(1.0) - F.product(F.lit(1.0) - confidence)


def chain(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Functions applied one after the other."""

    def run(value: Column) -> Column:
        for step in steps:
            value = step(value)
        return value

    return run
