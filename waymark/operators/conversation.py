"""Windows over conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators.ordering import keep_first


def last_turns(turns: DataFrame, n: int = fixed.MAX_TURNS, max_chars: int | None = None) -> DataFrame:
    """The last ``n`` turns of every conversation, roles reduced to two.

    ``max_chars`` cuts the texts; the source's width is ``fixed.MAX_TURN_CHARS``.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    return keep_first(turns, ["conv_id"], [F.desc("turn")], k=n).select(
        "conv_id", "turn", role.alias("role"),
        (text if max_chars is None else F.substring(text, 1, max_chars)).alias("text"),
    )


def last_pair(
    turns: DataFrame, question_chars: int | None = None, answer_chars: int | None = None
) -> DataFrame:
    """Last text that is not the assistant's and last text that is, per conversation.

    The source's widths are ``fixed.LAST_QUESTION_CHARS`` and ``fixed.LAST_ANSWER_CHARS``.
    """
    cut = lambda c, width: F.col(c) if width is None else F.substring(c, 1, width)
    answer = F.col("role").eqNullSafe("assistant")
    text = F.struct("turn", "text")
    last = turns.groupBy("conv_id").agg(
        F.max(F.when(~answer, text)).alias("q"), F.max(F.when(answer, text)).alias("a")
    )
    return last.select(
        "conv_id",
        cut("q.text", question_chars).alias("last_user"),
        cut("a.text", answer_chars).alias("last_assistant"),
    )
