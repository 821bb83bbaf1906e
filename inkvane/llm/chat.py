r"""Chat formatting: event-sourced reconstruction of conversations, then rendering. DataFrame functions only.

An event log has a row per event: conv_id, seq, kind, turn, role, text. ``kind`` is

- ``message``: the turn has this text and role;
- ``delta``: this text is appended to the turn (streamed output);
- ``edit``: the turn's text is replaced, and all later turns so far are taken back;
- ``regenerate``: as edit, for an answer: its text begins anew with this one;
- ``delete``: the turn and all later turns so far are taken back.

Events are partitioned by conversation and sorted by seq. An event counts unless a later edit, regeneration or deletion
of an earlier turn takes it back; a turn's text is the last event that sets it (message, edit, regenerate) and the
deltas after it. Deltas without such an event make a turn by themselves. ``messages`` folds with windows and one
aggregation per turn, so a long log is sorted and spilled by Spark, never held as one value.

``render`` writes one string for each conversation, for every turn ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line
feed, with spans in code points: where each turn's text lies and whether it is under the loss mask (assistant turns).
Inside roles and texts each ``<``, ``[`` and backslash gets a backslash behind it, which breaks every control string of this and
other templates and is undone by ``unescaped``. A conversation is one value, as long as its texts: that is the output's
unit. ``parsed`` reads it back.

Null text and null role are empty; events with a null turn belong to one turn before all others; a null seq sorts first;
ties of seq are ordered by turn, kind, role and text; equal rows are separate events, so a repeated delta appends twice.
Null conv_id is a conversation of its own. An empty log gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkvane.llm.common import read

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
SETS = ("message", "edit", "regenerate")
TAKES_BACK = ("edit", "regenerate", "delete")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of a log."""
    e = events.select("conv_id", F.col("seq").cast("long").alias("seq"), "kind", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    e = e.withColumn("at", F.row_number().over(conv.orderBy("seq", "turn", "kind", "role", "text")))
    cut = F.when(F.col("kind").isin(*TAKES_BACK), F.col("at"))
    earlier = conv.orderBy(F.coalesce("turn", F.lit(-(2**62)))).rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("back", F.max(cut).over(earlier)).where("back is null or back < at")
    own = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("since", F.max(F.when(F.col("kind").isin(*SETS, "delete"), F.col("at"))).over(own))
    e = e.where("since is null or at >= since")
    parts = F.array_sort(F.collect_list(F.struct("at", "kind", "role", "text")))
    turns = e.groupBy("conv_id", "turn").agg(parts.alias("p")).where((F.element_at("p", 1)["kind"] != "delete") | (F.size("p") > 1))
    kept = F.filter("p", lambda x: x["kind"] != "delete")
    return turns.select("conv_id", "turn", F.element_at(kept, 1)["role"].alias("role"), F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) from (conv_id, turn, role, text); spans: start, end (exclusive), loss of each turn's text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", "turn", escaped(role).alias("r"), escaped(text).alias("x"), (role == LOSS_ROLE).alias("loss"))
    t = t.withColumn("piece", F.concat(F.lit(START), "r", F.lit(MIDDLE), "x", F.lit(END)))
    before = F.sum(F.length("piece")).over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn")))
    t = t.withColumn("start", before - F.length("piece") + F.length("r") + len(START) + len(MIDDLE))
    span = F.struct(F.col("start"), (F.col("start") + F.length("x")).alias("end"), F.col("loss"))
    all_turns = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "piece", span.alias("span"))))
    return t.groupBy("conv_id").agg(all_turns.alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.transform("t", lambda x: x["span"]).alias("spans"))


def parsed(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): turns read back from the string, an array of role, text and loss; loss is what the span covers."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 2)
    head = lambda p: F.substring_index(p, MIDDLE, 1)
    body = lambda p, s: F.substring(p, F.length(head(p)) + len(MIDDLE) + 1, s["end"] - s["start"])
    turn = lambda p, s: F.struct(unescaped(head(p)).alias("role"), unescaped(F.split_part(F.split_part(p, F.lit(MIDDLE), F.lit(2)), F.lit(END), F.lit(1))).alias("text"), F.when(s["loss"], unescaped(body(p, s))).alias("loss"))
    return rendered.withColumn("pieces", pieces).select("conv_id", "formatted", F.zip_with("pieces", "spans", turn).alias("turns"))


def log_of(rows: DataFrame) -> DataFrame:
    """A log of finished turns (conv_id, turn, role, text), as a service would have written it: answers come as streamed
    deltas, two halves, others as messages. Each row is a turn of its own, in the order of turn; equal turns keep their rows."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda n, kind, t: F.struct((F.col("place") * 2 + n).alias("seq"), F.lit(kind).alias("kind"), F.col("place").alias("turn"), F.col("role"), t.alias("text"))
    streamed = F.array(event(0, "delta", F.substring(text, F.lit(1), half)), event(1, "delta", F.substring(text, half + 1, F.length(text))))
    events = F.when(F.col("role") == LOSS_ROLE, streamed).otherwise(F.array(event(0, "message", text)))
    return rows.withColumn("place", place).select("conv_id", F.inline(events))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(probe).alias("text"))
    rows = rows.union(extra)
    read_back = parsed(render(messages(log_of(rows))))
    under = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"].isNotNull()), lambda t: t["loss"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), under.alias("under"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


ORACLE = r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, length(regexp_replace(text, '[^<\[\\]', '', 'g')) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) AS marks FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           CAST(sum(length(role) + length(text) + marks + 33) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id"""
