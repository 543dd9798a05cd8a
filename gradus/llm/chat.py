"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

The log of a conversation has events (conversation, sequence number, message, kind, role, text). The log is dealt by conversation, sorted
by sequence number and folded: a ``delta`` adds to its message, an ``edit`` replaces what the message has, a ``regen`` empties it for the
deltas that follow. The messages, in order of their first event, are rendered with a template that escapes control strings in texts.

Defined results: a null text is empty; a null role is empty; an unknown kind counts as delta; ties of the sequence number go by message,
kind, role, text; equal events each count. A conversation becomes one string, so that one conversation has to fit a row (2 GB); everything
before that is one sort by conversation. Folding and rendering are linear in the conversation's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open role middle text close, for each turn. No escaped text contains one of these or another control string."""

    open: str = "<|turn|>"
    middle: str = "<|text|>"
    close: str = "<|end|>"


#: Control strings of common templates: <|...|>, </s>, <s>, [INST] and [/INST], <<SYS>>. They are broken up after their first character.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one into each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    """Undoes ``escape``: a backslash goes, and one that follows it stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reconstruct(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message", kind: str = "kind", role: str = "role", text: str = "text", dealt: bool = False) -> DataFrame:
    """Rows (conv_id, turns ARRAY<STRUCT<role, text>>): the final messages of each conversation. One shuffle serves both groupings; none
    is needed if the events are ``dealt`` by a column conv_id already."""
    event = F.struct(
        F.col(seq).alias("seq"), F.coalesce(F.col(kind), F.lit("delta")).alias("kind"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    log = events.select(F.col(conv).alias("conv_id"), F.col(message).alias("c_message"), event.alias("c_event"))
    log = log if dealt else log.repartition("conv_id")
    by_message = log.groupBy("conv_id", "c_message").agg(F.array_sort(F.collect_list("c_event")).alias("c_log"))
    resets = F.transform(F.col("c_log"), lambda e, i: F.when(e["kind"].isin("edit", "regen"), i + 1).otherwise(0))
    last = F.greatest(F.array_max(resets), F.lit(1))  # what stands before the last reset does not count
    text_ = F.array_join(F.transform(F.slice("c_log", last, F.size("c_log")), lambda e: F.when(e["kind"] == "regen", F.lit("")).otherwise(e["text"])), "")
    folded = by_message.select("conv_id", F.struct(F.col("c_log")[0]["seq"].alias("seq"), F.col("c_message").alias("message"), F.col("c_log")[0]["role"].alias("role"), text_.alias("text")).alias("c_turn"))
    return folded.groupBy("conv_id").agg(F.array_sort(F.collect_list("c_turn")).alias("c_turns")).select(
        "conv_id", F.transform("c_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def render(chats: DataFrame, template: Template = Template(), learn: str = "assistant") -> DataFrame:
    """Rows (conv_id, formatted, loss_mask): the mask has the spans whose tokens a model learns from, the texts of role ``learn``, as
    STRUCT<turn, offset, length>: code points from the turn's opening mark."""
    t = template
    pieces = F.transform("turns", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text")))
    mask = F.transform("c_pieces", lambda x, i: F.struct(
        i.alias("turn"), (F.lit(len(t.open) + len(t.middle)) + F.length(x["role"])).alias("offset"), F.length(x["text"]).alias("length"), (x["role"] == escape(F.lit(learn))).alias("learn")))
    return chats.select("conv_id", pieces.alias("c_pieces")).select(
        "conv_id",
        F.array_join(F.transform("c_pieces", lambda x: F.concat(F.lit(t.open), x["role"], F.lit(t.middle), x["text"], F.lit(t.close))), "").alias("formatted"),
        F.transform(F.filter(mask, lambda m: m["learn"]), lambda m: F.struct(m["turn"].alias("turn"), m["offset"].alias("offset"), m["length"].alias("length"))).alias("loss_mask"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows (conv_id, turns, loss_texts, formatted): the turns as they stand in the formatted string, and the unescaped text under each
    span of the mask."""
    t = template
    rendered = F.split("formatted", _quoted(t.close), -1)
    cut = formatted.select("conv_id", "formatted", "loss_mask", F.slice(rendered, F.lit(1), F.size(rendered) - 1).alias("c_rendered"))
    role = lambda x: F.substring_index(F.substring(x, len(t.open) + 1, F.length(x)), t.middle, 1)
    return cut.select(
        "conv_id",
        F.transform("c_rendered", lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substring_index(x, t.middle, -1)).alias("text"))).alias("turns"),
        F.transform("loss_mask", lambda m: unescape(F.substring(F.element_at("c_rendered", m["turn"] + 1), m["offset"] + 1, m["length"]))).alias("loss_texts"),
        "formatted",
    )


def _quoted(text: str) -> str:
    return rf"\Q{text}\E"


def as_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of conversations that are kept as one row for each turn: each row is a message of one delta. Rows that share a
    conversation and turn stay messages of their own (a message is told by turn, role, text and a number among equal rows). The result is dealt by conv_id."""
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("seq"), F.col(role).alias("role"), F.col(text).alias("text")).repartition("conv_id")
    number = F.row_number().over(Window.partitionBy("conv_id", "seq", "role", "text").orderBy(F.lit(0)))
    message = F.struct(F.col("seq").alias("s"), F.col("role").alias("r"), F.col("text").alias("t"), number.alias("n"))
    return own.select("conv_id", "seq", message.alias("message"), F.lit("delta").alias("kind"), "role", "text")
