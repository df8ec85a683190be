"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns as context, that reply last
and alone trainable. Turns after the last reply, which no example would hold, make one more example
without a trainable part, so a conversation can be read back whole.

Template: ``<|start|>role<|text|>text<|end|>`` for every turn. Control strings inside roles and texts get a
backslash behind their first character (one more if there are some), which is undone when reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
# What a control string looks like: of this template (<|..|>) and of two others (<s>, </s>, [INST], [/INST]).
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, formatted, loss_start, loss_end, complete``: one row per example.

    ``loss_start`` and ``loss_end`` are code points in ``formatted``; they are equal where nothing is trainable.
    The last example of a conversation is ``complete``: it holds every turn.
    Rows are ordered by turn (null first), then role and text; repeated rows are repeated turns. Null
    role and text count as empty, null conv_id is a conversation. An empty table gives an empty result;
    further columns are ignored. One conversation is put together in one task: it is the unit that
    is formatted, and its examples hold it that many times by definition.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn"),
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(START), escape(role), F.lit(TEXT)).alias("head"),
        escape(text).alias("body"),
    )
    whole = conversations.select("conv_id", turn.alias("_t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    shown = F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("_turns")),
        lambda i: (F.element_at("_turns", i)["role"] == "assistant") | (i == F.size("_turns")),
    )
    placed = whole.select("conv_id", "_turns", shown.alias("_shown"), F.posexplode(ends).alias("example", "_end"))
    last = F.element_at("_turns", F.col("_end"))
    built = placed.select(
        "conv_id",
        "example",
        F.array_join(F.slice("_shown", F.lit(1), F.col("_end")), "").alias("formatted"),
        F.when(last["role"] == "assistant", F.length(last["body"])).otherwise(F.lit(0)).alias("_loss"),
        (F.col("_end") == F.size("_turns")).alias("complete"),
    )
    stop = F.length("formatted") - len(END)
    return built.select(
        "conv_id", "example", "formatted", (stop - F.col("_loss")).alias("loss_start"), stop.alias("loss_end"), "complete"
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example as array of (role, text), unescaped."""
    pieces = F.split(formatted, r"<\|start\|>")
    return F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, start + 1, end - start))


def read_back(made: DataFrame) -> DataFrame:
    """Conversations from their examples: ``conv_id, turns, loss`` (array, one text per trainable example), ``formatted_chars``.

    Only the complete example of a conversation is parsed for its turns. Examples of a conversation
    lie together already, so this shuffles nothing.
    """
    trainable = F.col("loss_end") > F.col("loss_start")
    seen = made.select(
        "conv_id",
        "example",
        F.length("formatted").alias("_chars"),
        F.when(trainable, read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).alias("_loss"),
        F.when(F.col("complete"), read_turns(F.col("formatted"))).alias("_turns"),
    )
    return seen.groupBy("conv_id").agg(
        F.first("_turns", ignorenulls=True).alias("turns"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_loss").isNotNull(), F.struct("example", "_loss")))), lambda x: x["_loss"]
        ).alias("loss"),
        F.sum("_chars").alias("formatted_chars"),
    )
