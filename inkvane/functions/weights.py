"""Term weights and powers as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Corpus:
    """Size of the fitted corpus and mean length of its texts in characters."""

    rows: int
    mean_length: float


@dataclass(frozen=True)
class Constants:
    delta: float = 0.1
    b: float = 0.5
    k1: float = 1.0


LETTERS = "nwldpk"


def composed(letters: str, tf: Column, corpus: Corpus, c: Constants = Constants()) -> Column:
    """Weights for non-zero counts: each letter's function, from left to right.

    n: as it is; w: 1 + ln x; l: 1 + ln(1 + ln x); d: x + delta; p: x over one corpus-wide divisor,
    1 - b + b * rows / mean length; k: (k1 + 1) x / (k1 + x).
    """
    x = tf.cast("double")
    for letter in letters:
        if letter == "w":
            x = 1 + F.ln(x)
        elif letter == "l":
            x = 1 + F.ln(1 + F.ln(x))
        elif letter == "d":
            x = x + c.delta
        elif letter == "p":
            x = x / F.lit(1 - c.b + c.b * (corpus.rows / corpus.mean_length))
        elif letter == "k":
            x = (c.k1 + 1) * x / (c.k1 + x)
        elif letter != "n":
            raise ValueError(f"no weight is named {letter!r}")
    return x


def power(column: Column, n: int) -> Column:
    return F.pow(column.cast("double"), F.lit(float(n)))
