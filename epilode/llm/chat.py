"""Conversations as one marked-up text with a loss mask, in Spark expressions only.

    <|im_start|>user
    first text<|im_sep|>second text of the same role<|im_end|>
    <|im_start|>assistant
    answer<|im_end|>

Adjacent turns of one role share a block.  Texts and roles cannot forge a mark: `<|`
inside them gets an escape sign, which is itself doubled, so every turn can be read
back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED = "assistant"
_SIGN = "␛"


def escape(text: Column) -> Column:
    """Free a text of `<|`, reversibly."""
    doubled = F.replace(text, F.lit(_SIGN), F.lit(2 * _SIGN))
    return F.replace(doubled, F.lit("<|"), F.lit(f"<{_SIGN}|"))


def unescape(text: Column) -> Column:
    """The inverse of `escape`."""
    opened = F.replace(text, F.lit(f"<{_SIGN}|"), F.lit("<|"))
    return F.replace(opened, F.lit(2 * _SIGN), F.lit(_SIGN))


def escape_role(role: Column) -> Column:
    """A role also has to stay on its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit(f"<{_SIGN}n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(f"<{_SIGN}n"), F.lit("\n")))


def format_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learned: str = LEARNED,
) -> DataFrame:
    """`conv_id, formatted, segments`, a row per conversation.

    `segments` (text, loss) put together are `formatted`; those with `loss` are the loss
    mask: each text of the role `learned`, in order.  Turns are sorted by turn number,
    then role, then text; nulls come first, and repeated rows stay.  Null roles and texts
    count as empty; a null id is a conversation like any other.  Other columns are not
    read.  No rows give no rows.  A conversation is a row, so it has to fit into one.
    """
    cleaned = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    grouped = cleaned.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    turn = F.col("turns")

    def segments(t: Column, at: Column) -> Column:
        first = ~F.get(turn, at - 1)["role"].eqNullSafe(t["role"])
        last = ~F.get(turn, at + 1)["role"].eqNullSafe(t["role"])
        head = F.when(first, F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEPARATOR))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == learned).alias("loss")),
            F.struct(F.when(last, F.lit(END)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
        )

    marked = grouped.select("conv_id", F.flatten(F.transform(turn, segments)).alias("segments"))
    marked = marked.withColumn("segments", F.filter("segments", lambda s: (s["text"] != "") | s["loss"]))
    return marked.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b.startswith(START))

    def turns(block: Column) -> Column:
        line = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(line) + 2, F.length(block))
        role = unescape_role(F.substring(line, F.lit(len(START) + 1), F.length(line)))
        return F.transform(
            F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
