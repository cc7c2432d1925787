"""Chat formatting from event logs, in DataFrame functions only.

Method: a conversation is a log of events. Events are dealt by conversation, sorted by sequence and folded: `message`
starts a message, `delta` appends streamed text to it, `edit` replaces its text, `regenerate` throws its text away (the
deltas after it build the new one). A message's text is what its last message, edit or regenerate event says,
followed by the deltas after that. The final messages are rendered by a template; control strings inside texts are
escaped by a backslash, reversibly, so no text can forge a turn.

The loss mask marks assistant texts as (turn, start, length): start in code points from the start of the turn's mark.

Defined results: null text and null role count as empty; events of one message with the same sequence are ordered
by kind, then text; deltas of a message that never started start it, with the role they name; a null conversation id is
a conversation of its own; messages of one conversation with the same order are ordered by role, then text; repeated
rows of the conversations table are turns each; an empty table gives no conversation; extra columns are ignored. A
conversation is one output row, so its text is bounded by what Spark holds in one row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Openings of control strings in public chat templates.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) from events (conv_id, seq, kind, message, role, text).

    message orders a conversation's messages and may be any orderable type.
    """
    event = F.struct("seq", F.when(F.col("kind") == "message", 0).otherwise(1).alias("late"), "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    logs = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(resets), F.lit(-1))
    said = F.transform("log", lambda e, i: F.when((i < F.col("last")) | (e["kind"] == "regenerate"), "").otherwise(e["text"]))
    role = F.coalesce(F.get(F.filter("log", lambda e: e["role"].isNotNull()), F.lit(0))["role"], F.lit(""))
    return logs.withColumn("last", last).select("conv_id", "message", role.alias("role"), F.array_join(said, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of messages (conv_id, message, role, text)."""
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("turns"))
    parts = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"), escape(t["text"]).alias("text"))))
    spans = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct(i.alias("turn"), F.length(t["head"]).alias("start"), F.length(t["text"]).alias("length"))))
    return parts.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """rendered with turns (role, text) and loss_texts, both read from the formatted text and the mask."""
    marks = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 1)
    seen = rendered.withColumn("_marks", marks)
    turn = lambda s: F.struct(unescape(F.substring_index(s, BODY, 1)).alias("role"), unescape(F.substring_index(F.substring_index(s, BODY, -1), END, 1)).alias("text"))
    under = lambda m: unescape(F.substring(F.concat(F.lit(TURN), F.get("_marks", m["turn"])), m["start"] + 1, m["length"]))
    return seen.withColumns({"turns": F.transform("_marks", turn), "loss_texts": F.transform("loss_mask", under)}).drop("_marks")


def as_events(conversations: DataFrame) -> DataFrame:
    """One `message` event for each row of a table (conv_id, turn, role, text)."""
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.struct("turn", tie.alias("tie")).alias("message"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    return render(fold_events(as_events(conversations)))
