"""Conversation history as context for the next question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How many exchanges are recalled and how much of an answer is quoted.
RECALLED, QUOTED = 3, 100
HISTORY_HEAD, ASKED_NOW = "Histórico recente:\n", "\nPergunta atual: "


def exchanges(df: DataFrame, conv: str = "conv_id", turn: str = "turn", block: int = 4096) -> DataFrame:
    """Question and answer pairs, numbered within their conversation.

    `turn` is the position in the conversation, so the answer to turn t is turn t+1 when the
    assistant speaks there. Pairs are numbered by a two-level prefix count: rows within a block of
    turns, plus the sizes of the blocks before it. No task sorts a whole conversation.
    """
    asked = df.filter(F.col("role") == "user").select(conv, F.col(turn).alias("_t"), F.col("text").alias("pergunta"))
    replied = df.filter(F.col("role") == "assistant").select(
        conv, (F.col(turn) - 1).alias("_t"), F.col("text").alias("resposta")
    )
    pairs = asked.join(replied, [conv, "_t"], "left").withColumn("_block", F.floor(F.col("_t") / block))
    answered = F.col("resposta").isNotNull().cast("long")
    within = Window.partitionBy(conv, "_block").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pairs.groupBy(conv, "_block").agg(F.sum(answered).alias("_size"))
    before = Window.partitionBy(conv).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(conv, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        pairs.withColumn("_in_block", F.coalesce(F.sum(answered).over(within), F.lit(0)))
        .join(offsets, [conv, "_block"])
        .select(conv, F.col("_t").alias(turn), "pergunta", "resposta", (F.col("_offset") + F.col("_in_block")).alias("anteriores"))
    )


def with_history(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", recalled: int = RECALLED, quoted: int = QUOTED
) -> DataFrame:
    """Each question with the last answered exchanges before it as one context text.

    An answered exchange is handed to the places that recall it, so a place collects at most
    `recalled` rows however long the conversation is.
    """
    pairs = exchanges(df, conv, turn)
    line = F.concat(
        F.lit("P: "), F.col("pergunta"), F.lit("\nR: "), F.substring("resposta", 1, quoted), F.lit("...\n\n")
    )
    recall = (
        pairs.filter(F.col("resposta").isNotNull())
        .select(
            conv,
            F.explode(F.sequence(F.col("anteriores") + 1, F.col("anteriores") + recalled)).alias("anteriores"),
            F.struct(F.col("anteriores").alias("n"), line.alias("line")).alias("_e"),
        )
        .groupBy(conv, "anteriores")
        .agg(F.sort_array(F.collect_list("_e")).alias("_past"))
    )
    history = F.concat(
        F.lit(HISTORY_HEAD), F.array_join(F.transform("_past", lambda e: e["line"]), ""), F.lit(ASKED_NOW), F.col("pergunta")
    )
    return pairs.join(recall, [conv, "anteriores"], "left").select(
        conv, turn, F.when(F.col("_past").isNull(), F.lit(0)).otherwise(F.size("_past")).alias("lembrados"),
        F.when(F.col("_past").isNull(), F.col("pergunta")).otherwise(history).alias("contexto"),
    )
