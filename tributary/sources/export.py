"""Conversation export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"


def conversation_blocks(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, turn, block)``: the export of each conversation, block by block.

    Blocks joined in turn order are the exported text: every block but the
    first of its conversation starts with the separator.  As rows a very long
    conversation never has to fit one task.
    """
    first = turns.groupBy(conversation).agg(F.min(turn).alias("_first"))
    body = F.concat(F.lit("["), F.upper(role), F.lit("]\n"), F.coalesce(text, F.lit("")))
    return turns.join(first, [conversation]).select(
        conversation,
        turn,
        F.concat(F.when(F.col(turn) == F.col("_first"), "").otherwise(SEPARATOR), body).alias("block"),
    )


def write_conversations(blocks: DataFrame, path: str, conversation: str = "conv_id", turn: str = "turn") -> None:
    """Write the export as text, one directory per conversation.

    Blocks are ranged by (conversation, turn), so file order is turn order and
    a long conversation spans several files.  The line end the writer puts
    after each block is the first one of the separator that follows.
    """
    (
        blocks.repartitionByRange(conversation, turn)
        .sortWithinPartitions(conversation, turn)
        .select(conversation, F.regexp_replace("block", r"^\n(?=\n---\n\n)", "").alias("value"))
        .write.partitionBy(conversation)
        .text(path)
    )
