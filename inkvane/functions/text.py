"""Text as Column expressions: the regex catalogue, cleaning and tokenisers. No Python runs per row.

A word character is a letter, a number of any kind or an underscore (``W``), in place of the engine's own ``\\w``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
#: Name: pattern of one match. Fixed values.
PATTERNS = {
    "char": r"(?d).",
    "word": f"{W}+",
    "sent": r"[A-Z][^\.!?]*[\.!?]",
    "upper_char": "[A-Z]",
    "upper_word": f"(?<!{W})[A-Z]{W}+",
    "numeric": "[0-9]",
    "dash": "[-]",
    "group": r"(?U)[A-Z][\p{L}\p{N}_-]*(?:\s+[A-Z][\p{L}\p{N}_-]*)+",
    "is_first_upper": "^[A-Z]",
    "is_last_ponct": "[?.!,:;']$",
    "space_before_ponct": "[ ][?.!,:;']",
}
WORD_LENGTHS = range(1, 11)
#: Punctuation that tokenisers delete: all of ASCII but the dash.
PUNCTUATION = string.punctuation.replace("-", "")


def pattern_of(name: str) -> str:
    """The pattern for a catalogue name, or for words of a length, ``word_N``."""
    if name in PATTERNS:
        return PATTERNS[name]
    head, _, n = name.rpartition("_")
    if head == "word" and n.isdigit() and int(n) in WORD_LENGTHS:
        return f"(?<!{W}){W}{{{n}}}(?!{W})"
    raise ValueError(f"no pattern is named {name!r}")


def match_count(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(pattern_of(name))).cast("double")


def matches(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern_of(name)), F.lit(0))


def mean_length(parts: Column) -> Column:
    """Mean length of an array of strings; 0 for an empty one."""
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return F.when(F.size(parts) == 0, F.lit(0.0)).otherwise(F.try_divide(total.cast("double"), F.size(parts).cast("double")))


def overlap(left: Column, right: Column) -> Column:
    """Number of distinct values that two arrays share."""
    return F.size(F.array_intersect(left, right)).cast("long")


def ratio(left: Column, right: Column) -> Column:
    """left / right; null where right is 0."""
    return F.try_divide(left, right)


def clean(text: Column) -> Column:
    """No white space before punctuation that ends a word, no runs of spaces, none around the text."""
    text = F.regexp_replace(text, r"(?U)\s([?.!,:;'](?:\s|$))", "$1")
    return F.regexp_replace(F.regexp_replace(text, " +", " "), r"(?U)^\s+|\s+$", "")


def plain_tokens(text: Column) -> Column:
    """Tokens of a text without punctuation: split at spaces only, so other white space stays inside a token."""
    bare = F.regexp_replace(F.translate(text, PUNCTUATION, ""), " +", " ")
    return F.split(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""), " ")


def word_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-cased alphabetic tokens, without stop words if a list is given."""
    tokens = F.filter(plain_tokens(F.lower(text)), lambda t: t.rlike(r"^\p{L}+$"))
    return F.array_compact(without(tokens, stop)) if stop else tokens


def without(tokens: Column, stop: list[str]) -> Column:
    words = F.array(*map(F.lit, stop))
    return F.filter(tokens, lambda t: ~F.array_contains(words, t))


def terms(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{W}{{2,}}"), F.lit(0))
