"""Column expressions over review text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# Fixed values.
NULL_SENTINELS = ("NAN", "NA", "NULL", "")
KEYWORD_INSTRUCTION = (
    "Extract 3 to 5 key drivers or topics from this customer review. "
    "Return ONLY a comma-separated list.\n\nReview:\n"
)
# What Python's own str.strip takes away.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Trim every kind of white space; SQL's own trim takes spaces only."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_empty(text: Column) -> Column:
    """Not null, and nothing but white space."""
    return F.ltrim(text, F.lit(WHITESPACE)) == ""


def is_missing(text: Column, sentinels: tuple[str, ...] = NULL_SENTINELS) -> Column:
    """Null, or one of the spellings of "missing", ignoring case and white space around it."""
    spelled = [s for s in sentinels if s]
    missing = text.isNull()
    if "" in sentinels:
        missing = missing | is_empty(text)
    if spelled:
        # Trimming the end of a text walks all of it, so look at its first letters before.
        shortest = min(map(len, spelled))
        start = F.upper(F.left(F.ltrim(text, F.lit(WHITESPACE)), F.lit(shortest)))
        likely = start.isin(*sorted({s[:shortest] for s in spelled}))
        missing = missing | (likely & F.upper(strip(text)).isin(*spelled))
    return missing


def non_blank(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != "")


def split_words(text: Column) -> Column:
    """Lower-case runs of a-z; every other character separates. May hold empty strings at its ends."""
    return F.split(F.lower(text), "[^a-z]+")


def tokens(text: Column) -> Column:
    return F.filter(split_words(text), lambda t: t != "")


def keyword_prompt(body: Column) -> Column:
    return F.concat(F.lit(KEYWORD_INSTRUCTION), body)


def parse_keywords(csv: Column) -> Column:
    """Comma list to array: every token trimmed, empty ones dropped, null stays null."""
    return F.filter(F.transform(F.split(csv, ","), strip), lambda t: t != "")


def view_name(name: Column) -> Column:
    return F.concat(F.lit("VW_"), F.regexp_replace(F.upper(name), "^VW_", ""))


def contains_ignoring_case(text: Column, part: str) -> Column:
    """``%`` and ``_`` inside ``part`` act as wildcards."""
    return text.ilike(f"%{part}%")


def first_label(text: Column, patterns: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """Label of the first entry one of whose LIKE patterns fits, ignoring case; else ``default``."""
    low = F.lower(text)
    label = F.lit(default).cast("string")
    for name, likes in reversed(patterns):
        fits = reduce(or_, [low.like(like.lower()) for like in likes])
        label = F.when(fits, F.lit(name)).otherwise(label)
    return label


def json_field(record: Column, name: str) -> Column:
    return F.get_json_object(record, f"$.{name}")
