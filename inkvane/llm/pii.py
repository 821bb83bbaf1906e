r"""Personal data, with DataFrame functions only.

Regular expressions propose spans, validators confirm them, and context words near a span adjust its score.

- Base kinds, always reported once valid: ``email``; ``ip`` (parts at most 255); ``card`` (14 to 19 digits, Luhn);
  ``phone`` (international, 10 to 15 digits). Matches are leftmost and do not overlap within a kind; one that fails its
  validator is dropped, and nothing else is tried in its place.
- Added kinds, reported from a score of 0.5: ``iban`` and ``iban_grouped`` (in groups of four), confirmed by mod-97;
  ``key`` (headers of private keys and access keys of known forms); ``ssn`` (three groups of digits) and ``secret`` (20 or
  more letters, digits, ``_`` and ``-``, with a letter and a digit), both weak by form: they need a context word before
  them.

The patterns below match what their plain forms would, but begin only where a run of characters begins and never give
back what they took, so a text of any length takes time in proportion to it. Positions come from the lengths of the gaps
between matches: code points, end exclusive.

Null text is empty and has no span. Repeated rows stay; other columns of the documents stay, ``findings`` replaces one
so named; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkvane.llm.common import read

_LOCAL = "A-Za-z0-9._%+-"
#: kind: (guard that any text with a finding passes, a pattern or strings, one of which is in the text in lower case or as it is; pattern)
PATTERNS = {
    "email": (r"@[A-Za-z0-9-]++\.", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"\.[0-9]++\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"),
    "card": (r"[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[ -]?[0-9]){13,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])"),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban_grouped": (r"[A-Z]{2}[0-9]{2} [A-Z0-9]{4} ", r"[A-Z]{2}[0-9]{2}( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?"),
    "key": (("PRIVATE KEY-----", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"-----BEGIN [A-Z ]*PRIVATE KEY-----|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}"),
    "secret": (("token", "secret", "passw", "key", "credential"), r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"),
}
BASE = ("email", "ip", "card", "phone")
#: Score by form and validator, and context words that add CONTEXT to it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "iban_grouped": 0.9, "key": 0.9, "secret": 0.3}
WORDS = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "ip|address|server|host",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|telefon|llamar",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": "ssn|social security",
    "iban_grouped": "iban|bank|account|konto|cuenta|compte",
    "key": "key|secret|token|credential",
    "secret": "token|secret|passw|api.?key|access.?key|credential",
}
CONTEXT, NEAR, LEAST = 0.3, 40, 0.5


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, 1).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4))

    def add(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, acc * 100 + code - 55).otherwise(acc * 10 + code - 48) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: F.when(F.length(p) > 3, False).otherwise(F.concat(F.lit("0"), F.substring(p, 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mod97(F.replace(value, F.lit(" "), F.lit(""))) if kind.startswith("iban") else F.lit(True)


def proposed(kind: str, text: Column) -> tuple[Column, Column]:
    """(matches, gaps) of a kind in a text that passes its guard; else empty arrays."""
    guard, pattern = PATTERNS[kind]
    none = F.array().cast("array<string>")
    if isinstance(guard, tuple):
        whole = F.lower(text) if kind == "secret" else text
        hit = functools.reduce(operator.or_, [whole.contains(part) for part in guard])
    else:
        hit = text.rlike(guard)
    return F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(hit, F.split(text, pattern, -1)).otherwise(none)


def placed(kind: str, matches: Column, gaps: Column) -> Column:
    """Array of (start, end, value, kind) from matches and the gaps before them."""

    def add(acc, x):
        start = acc["at"] + F.length(x["gaps"])
        end = start + F.length(x["matches"])
        span = F.struct(start.alias("start"), end.alias("end"), x["matches"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    both = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("matches"), g.alias("gaps")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    return F.aggregate(both, zero, add, lambda acc: acc["out"])


def findings(docs: DataFrame) -> DataFrame:
    """docs with findings: array of (start, rank, kind, end, value, score) in the order of start, then kind."""
    docs = docs.drop("findings")
    kinds = list(PATTERNS)
    rows = docs.withColumn("__pii_text", F.coalesce(F.col("text"), F.lit("")))
    for k in kinds:
        matches, gaps = proposed(k, F.col("__pii_text"))
        rows = rows.withColumns({f"__pii_m_{k}": matches, f"__pii_g_{k}": gaps})
    rows = rows.withColumns({f"__pii_s_{k}": placed(k, F.col(f"__pii_m_{k}"), F.col(f"__pii_g_{k}")) for k in kinds})
    text = F.col("__pii_text")

    def told(k):
        def tell(s):
            before = F.lower(F.substring(text, F.greatest(s["start"] - NEAR + 1, F.lit(1)), F.least(s["start"], F.lit(NEAR))))
            score = F.lit(SCORES[k]) + F.when(before.rlike(WORDS[k]), F.lit(CONTEXT)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), F.lit(kinds.index(k)).alias("rank"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

        good = F.transform(F.filter(F.col(f"__pii_s_{k}"), lambda s: valid(k, s["value"])), tell)
        return good if k in BASE else F.filter(good, lambda s: s["score"] >= LEAST)

    return rows.withColumn("findings", F.array_sort(F.concat(*map(told, kinds)))).select(*[F.col(f"`{c}`") for c in docs.columns], "findings")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "findings")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    of = lambda k: F.filter("findings", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))


def _oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Za-z0-9]+",
        "ssn": r"[0-9-]+",
        "iban_grouped": PATTERNS["iban_grouped"][1],
        "key": PATTERNS["key"][1],
        "secret": r"[A-Za-z0-9_-]+",
    }
    before = "lower(substring(t, CAST(greatest(start - 39, 1) AS BIGINT), CAST(least(start, 40) AS BIGINT)))"
    finds = " UNION ALL ".join(
        f"SELECT doc_id, t, {i} AS rank, '{k}' AS kind, unnest(list_zip(generate_series(1, len(m)), m)) AS x, m, g FROM "
        f"(SELECT doc_id, t, regexp_extract_all(t, '{p}', 0) AS m, string_split_regex(t, '{p}') AS g FROM d)"
        for i, (k, p) in enumerate(plain.items())
    )
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({finds}),
    s AS (SELECT doc_id, t, rank, kind, x[2] AS v,
                 list_sum(list_transform(g[1:x[1]], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:x[1]-1], lambda y: length(y))), 0) AS start,
                 regexp_replace(x[2], '[^0-9]', '', 'g') AS digits FROM f
          WHERE kind IN ('email', 'ip', 'card', 'phone', 'iban_grouped', 'key') OR (kind = 'secret' AND length(x[2]) >= 20) OR (kind = 'iban' AND regexp_full_match(x[2], '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}'))
             OR (kind = 'ssn' AND regexp_full_match(x[2], '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'))),
    k AS (SELECT doc_id, rank, kind, CAST(start AS BIGINT) AS start, CAST(start + length(v) AS BIGINT) AS stop FROM s WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda y: CASE WHEN length(ltrim(y, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(y, '0') AS INTEGER) END)) <= 255
        WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(generate_series(1, length(digits)), lambda i:
            CASE WHEN i % 2 = 1 THEN CAST(digits[length(digits) - i + 1] AS INTEGER)
                 WHEN CAST(digits[length(digits) - i + 1] AS INTEGER) > 4 THEN 2 * CAST(digits[length(digits) - i + 1] AS INTEGER) - 9
                 ELSE 2 * CAST(digits[length(digits) - i + 1] AS INTEGER) END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
        WHEN 'key' THEN true
        WHEN 'secret' THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND regexp_matches({before}, '{WORDS["secret"]}')
        WHEN 'ssn' THEN regexp_matches({before}, '{WORDS["ssn"]}')
        ELSE list_reduce(list_prepend(0, list_transform(string_split(replace(v, ' ', '')[5:] || v[1:4], ''), lambda c: ascii(c))), lambda a, c:
            (CASE WHEN c >= 65 THEN a * 100 + c - 55 ELSE a * 10 + c - 48 END) % 97) = 1 END)
    SELECT d.doc_id, {", ".join(f"count(CASE WHEN kind = '{b}' THEN 1 END) AS n_{b}" for b in BASE)},
           sha256(coalesce(string_agg(CASE WHEN rank < 4 THEN kind || ':' || start || ':' || stop END, ',' ORDER BY start, rank), '')) AS base_sha256,
           coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
    FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


ORACLE = _oracle()
