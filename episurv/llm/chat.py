"""Chat formatting with Spark expressions only: collected turns, sorted, merged and joined to one string.

A formatted conversation is a sequence of blocks `<s>[INST]role[/INST]text</s>`. Adjacent turns of one role share a block,
their texts parted by `[SEP]`. Inside roles and texts, a control string gets a backslash after its first character; one
that already has backslashes there gets one more. So no text holds a control string, and taking one backslash away
restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, JOIN, CLOSE = "<s>[INST]", "[/INST]", "[SEP]", "</s>"
#: Control strings, as a pattern for `split`: text segments stand between them.
CONTROLS = r"<s>\[INST\]|\[/INST\]|\[SEP\]|</s>"
#: What escaping and unescaping look for: first character, backslashes, the rest of a control string.
_TAIL = r"(/?s>|/?INST\]|SEP\])"
ESCAPE, ESCAPED = r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3"
UNESCAPE, UNESCAPED = r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, ESCAPED)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, UNESCAPED)


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row a conversation: its id, the formatted string, and the loss mask.

    The mask has a flag for each segment of `split(formatted, CONTROLS)`: true for texts of the assistant. Turns go by
    number, then role, then text (null first); null roles and texts count as empty, a null id is a conversation like any
    other, repeated rows are repeated turns. A conversation is one output row, so its turns meet in one group.
    An empty table gives an empty result; other columns are not read.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    sorted_turns = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def follows(t: Column, i: Column) -> Column:
        """The turn before has the same role: this one is merged into its block."""
        return (i > 0) & (F.get("_turns", i - 1)["role"] == t["role"])

    def piece(t: Column, i: Column) -> Column:
        head = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(""), F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE))
        return F.concat(F.when(follows(t, i), F.lit(JOIN)).otherwise(head), escaped(t["text"]))

    def flags(t: Column, i: Column) -> Column:
        trained = t["role"] == TRAINED
        return F.when(follows(t, i), F.array(trained)).otherwise(F.array(F.lit(False), F.lit(False), trained))

    return sorted_turns.select(
        F.col("_conv").alias(conv),
        F.concat(F.array_join(F.transform("_turns", piece), ""), F.lit(CLOSE)).alias("formatted"),
        F.concat(F.flatten(F.transform("_turns", flags)), F.array(F.lit(False))).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string again: array of (role, text)."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def parts(block: Column) -> Column:
        halves = F.split(F.substring(block, len(OPEN) + 1, 1 << 30), r"\[/INST\]")
        role = unescaped(F.element_at(halves, 1))
        return F.transform(
            F.split(F.element_at(halves, 2), r"\[SEP\]"), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text"))
        )

    return F.flatten(F.transform(blocks, parts))


def read_trained(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    segments = F.arrays_zip(F.split(formatted, CONTROLS).alias("text"), loss_mask.alias("loss"))
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
