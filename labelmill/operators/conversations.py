"""Conversation turns: pairs and instruction prompts.

Both work turn by turn. A conversation may be very long, so none is ever gathered in one row;
the rendered pieces keep ``(conv_id, turn)`` and are read in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The instruction marks.
INSTRUCTION_OPEN, INSTRUCTION_CLOSE = "[INST] ", " [/INST]"


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right after it.

    An equi-join on conversation and turn number; long conversations spread over all tasks.
    """
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answered, ["conv_id", "turn"])


def render(turns: DataFrame) -> DataFrame:
    """Add ``piece``: user turns wrapped as an instruction, other turns as they are."""
    wrapped = F.concat(F.lit(INSTRUCTION_OPEN), F.col("text"), F.lit(INSTRUCTION_CLOSE))
    return turns.withColumn("piece", F.when(F.col("role") == "user", wrapped).otherwise(F.col("text")))
