"""Mixing sources to target weights, with DataFrame functions only.

Temperature: source i with share s_i of all tokens (words) gets weight s_i**a / sum(s**a). The exponent a is a multiple of
2**-12 in [0, 1], bisected (64 points of the bracket at once) to be the largest that reaches a target entropy, as a
fraction of ln(number of sources), or the smallest that keeps to a repetition limit.

Realised: a source gets ``floor(weight * budget)`` tokens: full passes over its documents, and a part of one more. Its
documents lie in 256 blocks by a hash of doc_id; every pass has its own permutation of the blocks, and the last part
takes blocks in that order until the budget is met, going into the block on the boundary by a second hash digit and then
document by document. So the running sums are over at most 256 rows of a source at two levels and 1/65536 of its
documents at the third: a source with most of all rows is never gathered. The part stays below its budget by less than
the next document. ``place`` in [0, 1) spreads each source's passes and blocks evenly over training.

``budget=None`` covers everything: the smallest budget under which every source has one full pass.

Null source: a source of its own. A document without words costs nothing and comes along with its block; a source
without any word has weight 0 and one full pass. Null doc_ids hash like one another; repeated rows of a doc_id go
together. An empty table gives no rows. All columns of the documents stay, those added are named below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkvane.llm.common import cut, read

HALVINGS, SECTION = 12, 6
MOST_BROADCAST = 100_000
SEED = "mix"
ADDED = ("source_key", "epoch", "place", "weight")


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def doc_hash(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def block_hash(source: Column, epoch: Column, block: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), source, epoch.cast("string"), block).cast("binary"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("n:"))


def exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None) -> float:
    """The exponent for sources (tokens > 0); one of the two targets."""
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def holds(steps: list[int]) -> dict[int, bool]:
        a = F.col("k") / F.lit(float(1 << HALVINGS))
        at = sources.select(share.alias("s"), F.explode(F.array(*map(F.lit, steps))).alias("k")).select("k", "s", F.pow("s", a).alias("w"), F.pow(F.col("s"), a - 1).alias("r"), a.alias("a"))
        z = F.sum("w")
        entropy = F.log(z) - F.first("a") * F.sum(F.col("w") * F.log("s")) / z
        repeats = F.max("r") / F.min("r") if budget is None else F.max("r") / z * (budget / total)
        good = entropy >= target_entropy * math.log(n) - 1e-12 if target_entropy is not None else repeats <= max_repeats + 1e-12
        return {r[0]: r[1] for r in at.groupBy("k").agg(good.alias("good")).collect()}

    top = 1 << HALVINGS
    # Entropy falls with the exponent: the largest that holds. Repetition falls, too: the smallest that holds.
    if target_entropy is not None:
        if holds([top])[top]:
            return 1.0
        low, step = 0, top >> SECTION
        while step:
            ok = holds([low + step * i for i in range(1, 1 << SECTION)])
            low, step = max([low, *(k for k, good in ok.items() if good)]), step >> SECTION
        return low / top
    if not holds([top])[top]:
        return 1.0
    high, step = top, top >> SECTION
    while step:
        ok = holds([high - step * i for i in range(1, 1 << SECTION) if high - step * i >= 0] or [0])
        high, step = min([high, *(k for k, good in ok.items() if good)]), step >> SECTION
    return high / top


def mixture(rows: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """The plan for rows (source, doc_id, n_tokens): source_key, tokens, weight, passes (full ones) and cut_key, to which
    the last part goes; repeats is the number of passes with the part."""
    docs = rows.select(source_key(F.col("source")).alias("source_key"), doc_hash(F.col("doc_id")).alias("hash"), "n_tokens")
    block = F.substring("hash", 1, 2)
    blocks = cut(docs.groupBy("source_key", block.alias("block")).agg(F.sum("n_tokens").alias("tokens")))
    sources = cut(blocks.groupBy("source_key").agg(F.sum("tokens").alias("tokens")))
    live = sources.where("tokens > 0")
    a = exponent(live, target_entropy, max_repeats, budget)
    total = live.agg(F.sum("tokens")).first()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z = live.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    if budget is None:
        budget = live.agg(F.max(F.col("tokens") / weight)).first()[0] or 0.0
    quota = F.floor(weight * F.lit(float(budget)) + F.lit(1e-6))
    plan = live.select("source_key", "tokens", weight.alias("weight"), quota.cast("long").alias("quota"))
    plan = plan.withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("long")).withColumn("part", F.col("quota") - F.col("passes") * F.col("tokens"))

    def boundary(groups: DataFrame, order: list[str]) -> DataFrame:
        """The first group whose tokens go past the part, with the tokens before it."""
        run = F.sum("tokens").over(Window.partitionBy("source_key").orderBy(*order))
        rank = F.row_number().over(Window.partitionBy("source_key").orderBy(*order))
        return groups.withColumns({"run": run}).where("run > part").withColumn("rank", rank).where("rank = 1").withColumn("part", F.col("part") - F.col("run") + F.col("tokens")).drop("run", "rank", "tokens")

    first = blocks.join(plan.select("source_key", "passes", "part"), "source_key").withColumn("b", block_hash(F.col("source_key"), F.col("passes"), F.col("block")))
    first = cut(boundary(first, ["b", "block"]))
    inside = docs.withColumn("block", block).join(small(first.select("source_key", "block", "b", "part")), ["source_key", "block"])
    digits = inside.groupBy("source_key", F.substring("hash", 3, 2).alias("digit")).agg(F.sum("n_tokens").alias("tokens"), F.first("part").alias("part"), F.first("b").alias("b"), F.first("block").alias("block"))
    second = cut(boundary(digits, ["digit"]))
    edge = small(second.select("source_key", F.concat("block", "digit").alias("edge"), "part"))
    leaf = docs.withColumn("edge", F.substring("hash", 1, 4)).join(edge, ["source_key", "edge"])
    leaf = leaf.withColumn("run", F.sum("n_tokens").over(Window.partitionBy("source_key").orderBy("hash"))).where("run <= part").groupBy("source_key").agg(F.max("hash").alias("last"))
    ends = second.join(leaf, "source_key", "left").select("source_key", F.concat("b", F.coalesce("last", F.concat("block", "digit"))).alias("cut_key"))
    plan = plan.join(ends, "source_key", "left").select("source_key", "tokens", "weight", "passes", F.coalesce("cut_key", F.lit("")).alias("cut_key"), (F.col("quota") / F.col("tokens")).alias("repeats"))
    free = sources.where("tokens = 0").select("source_key", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit("").alias("cut_key"), F.lit(1.0).alias("repeats"))
    return cut(plan.union(free))


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is seen to be short."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def realised(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs once for each pass that takes them, with source_key, epoch, place and weight (replacing columns so named)."""
    docs = docs.drop(*ADDED)
    key, digest = source_key(F.col("source")), doc_hash(F.col("doc_id"))
    rows = docs.withColumns({"__mix_source": key, "__mix_hash": digest})
    p = small(plan).select(F.col("source_key").alias("__mix_key"), F.col("passes").alias("__mix_passes"), F.col("cut_key").alias("__mix_cut"), F.col("weight").alias("__mix_weight"), F.col("repeats").alias("__mix_repeats"))
    rows = rows.join(p, F.col("__mix_source") == F.col("__mix_key"))
    block = F.substring("__mix_hash", 1, 2)
    last = F.concat(block_hash(F.col("__mix_source"), F.col("__mix_passes"), block), F.col("__mix_hash")) <= F.col("__mix_cut")
    n = F.col("__mix_passes") + last.cast("long")
    rows = rows.where(n > 0).withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    even = F.conv(F.substring(block_hash(F.col("__mix_source"), F.col("__mix_epoch"), block), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    place = (F.col("__mix_epoch") + even) / F.greatest(F.ceil("__mix_repeats"), F.lit(1))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__mix_source").alias("source_key"), F.col("__mix_epoch").alias("epoch"), place.alias("place"), F.col("__mix_weight").alias("weight"))


def mixed(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> DataFrame:
    counted = docs.select("doc_id", "source", tokens_of(F.col("text")).alias("n_tokens"))
    return realised(docs, mixture(cut(counted), target_entropy, max_repeats, budget))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = cut(docs.select("doc_id", "source", tokens_of(F.col("text")).alias("n_tokens")))
    budget = rows.agg(F.sum("n_tokens")).first()[0] or 0
    out = realised(rows, mixture(rows, target_entropy=0.95, budget=budget))
    return out.select("doc_id", "source", "n_tokens", "epoch", F.round("place", 9).alias("place"), F.round("weight", 9).alias("weight"))


ORACLE = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n_tokens,
                      coalesce('s:' || source, 'n:') AS k, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    t AS (SELECT k, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY k),
    n AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total, count(*) AS sources FROM t),
    g AS (SELECT x / 4096.0::DOUBLE AS a, sum(pow(tokens / total, x / 4096.0::DOUBLE)) AS z,
                 sum(pow(tokens / total, x / 4096.0::DOUBLE) * ln(tokens / total)) AS l, any_value(sources) AS s
          FROM t, n, (SELECT unnest(generate_series(0, 4096)) AS x) GROUP BY x),
    e AS (SELECT max(a) AS a FROM g WHERE ln(z) - a * l / z >= 0.95 * ln(s) - 1e-12),
    w AS (SELECT k, tokens, pow(tokens / total, a) / (SELECT z FROM g, e WHERE g.a = e.a) AS weight, total FROM t, n, e),
    q AS (SELECT k, tokens, weight, CAST(floor(weight * total + 1e-6) AS BIGINT) AS quota FROM w),
    p AS (SELECT *, quota // tokens AS passes, quota % tokens AS part FROM q),
    o AS (SELECT d.*, weight, passes, part, quota, tokens, md5('mix:' || d.k || ':' || passes || ':' || h[1:2]) AS b FROM d JOIN p ON d.k = p.k),
    r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY k ORDER BY b, h) <= part AS more FROM o),
    x AS (SELECT *, unnest(generate_series(0, passes + CAST(more AS BIGINT) - 1)) AS epoch FROM r WHERE passes + CAST(more AS BIGINT) > 0)
    SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS BIGINT) AS epoch,
           round((epoch + CAST('0x' || md5('mix:' || k || ':' || epoch || ':' || h[1:2])[1:8] AS BIGINT) / 4294967296.0::DOUBLE) / greatest(ceil(quota / CAST(tokens AS DOUBLE)), 1), 9) AS place,
           round(weight, 9) AS weight
    FROM x"""
