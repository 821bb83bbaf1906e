"""Porter's stemmer (1980), for arrays of tokens. The one text function without a built-in form: an Arrow-batched UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and what replaces them if the rest has a measure above 0. Fixed values of steps 2 and 3.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that go if the rest has a measure above 1. Fixed values of step 4.
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize ion".split()


def _kinds(word: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    return _kinds(word).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _replaced(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + table[suffix] if measure(rest) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            rest = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _kinds(rest):
                word = rest
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double_end(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not _short_end(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def stemmed(tokens: Column) -> Column:
    """An array of tokens, each stemmed in lower case; equal tokens of a batch are stemmed once."""

    @F.pandas_udf("array<string>")
    def run(batch):
        seen: dict[str, str] = {}
        return batch.map(lambda ts: None if ts is None else [seen[t] if t in seen else seen.setdefault(t, stem(t.lower())) for t in ts])

    return run(tokens)
