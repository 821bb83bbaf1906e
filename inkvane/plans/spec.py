"""The grammar of feature names, checked before anything runs.

- regex: ``<name>_<type>``, name from the regex catalogue or word_N, type count, avg, overlap or ratio;
- idf: ``<letters>_<type>``, letters of nwldpk, type count, idf, lda or cos;
- tag: ``<tag>_<type>``, type as for regex; ``tags_<idf name>`` for whole tag sequences;
- rank: ``count_<bins>``, ``frac_<bins>`` or ``logcount_<bins>`` over a language model's ranks and probabilities;
- product: names joined by spaces, each perhaps with ``^<power>``.
"""

from __future__ import annotations

from dataclasses import dataclass

from inkvane.functions.tagging import TAGS
from inkvane.functions.text import pattern_of
from inkvane.functions.weights import LETTERS

TYPES = ("count", "avg", "overlap", "ratio")
IDF_TYPES = ("count", "idf", "lda", "cos")
RANK_TYPES = ("count", "frac", "logcount")


@dataclass(frozen=True)
class Feature:
    """A parsed name: what it is about and which type of feature."""

    spec: str
    subject: str
    kind: str


def regex_feature(spec: str) -> Feature:
    name, _, kind = spec.rpartition("_")
    if kind not in TYPES:
        raise ValueError(f"{spec!r}: no type {kind!r}")
    pattern_of(name)
    return Feature(spec, name, kind)


def idf_feature(spec: str) -> Feature:
    parts = spec.split("_")
    letters, kind = parts[0], parts[-1]
    if len(parts) < 2 or kind not in IDF_TYPES:
        raise ValueError(f"{spec!r}: no type {kind!r}")
    if not letters or set(letters) - set(LETTERS):
        raise ValueError(f"{spec!r}: letters are of {LETTERS}")
    return Feature(spec, letters, kind)


def tag_feature(spec: str) -> Feature:
    tag, _, kind = spec.partition("_")
    if tag == "tags":
        return Feature(spec, "tags", idf_feature(kind).spec)
    if tag not in TAGS or kind not in TYPES:
        raise ValueError(f"{spec!r}: no such tag or type")
    return Feature(spec, tag, kind)


def rank_feature(spec: str) -> Feature:
    kind, _, bins = spec.partition("_")
    if kind not in RANK_TYPES or not bins.isdigit() or int(bins) < 1:
        raise ValueError(f"{spec!r}: not <type>_<bins>")
    return Feature(spec, bins, kind)


def product_feature(spec: str) -> list[tuple[str, int]]:
    """(column, power) of each factor."""
    out = []
    for factor in spec.split():
        name, mark, n = factor.partition("^")
        if mark and not n.isdigit():
            raise ValueError(f"{spec!r}: the power {n!r} is no number")
        out.append((name, int(n) if mark else 1))
    if not out:
        raise ValueError("an empty product")
    return out


def unique(specs: list[str] | None) -> list[str]:
    """Specs in order, each once."""
    return list(dict.fromkeys(specs or []))
