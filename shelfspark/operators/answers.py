"""Folding answer streams and pairing conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import answers as parse
from shelfspark.functions.text import trim_blanks
from shelfspark.operators.scan import dense_ids, fill_forward, ordered_concat


def fold_answers(events: DataFrame) -> DataFrame:
    """Whole answer per stream (stream_id, seq, raw), up to its first closing line."""
    ends = events.where(parse.is_done(F.col("raw"))).groupBy("stream_id").agg(
        F.min("seq").alias("_end")
    )
    pieces = events.join(ends, "stream_id", "left").where(
        F.col("_end").isNull() | (F.col("seq") <= F.col("_end"))
    )
    texts = pieces.select(
        "stream_id", "seq", parse.delta(F.col("raw")).alias("_delta"), "_end"
    )
    whole = ordered_concat(texts, ["stream_id"], "seq", "_delta", "answer")
    return whole.join(ends, "stream_id", "left").select(
        "stream_id", "answer", F.col("_end").isNotNull().alias("done")
    )


def strip_think_stream(chunks: DataFrame) -> DataFrame:
    """Stream chunks (stream_id, seq, content) without thinking, tags possibly rows apart."""
    text = F.coalesce("content", F.lit(""))
    opens = text.contains(parse.THINK_OPEN)
    closes = text.contains(parse.THINK_CLOSE)
    marked = chunks.where(text != "").withColumn(
        "_mark", F.when(closes, False).when(opens, True)
    )
    state = fill_forward(marked, ["stream_id"], "seq", "_mark", "_before", inclusive=False)
    thinking = opens | F.coalesce("_before", F.lit(False))
    rest = F.substring(
        text,
        F.instr(text, parse.THINK_CLOSE) + len(parse.THINK_CLOSE),
        F.length(text),
    )
    shown = F.when(~thinking, text).when(closes, rest)
    return (
        state.withColumn("content", trim_blanks(shown))
        .where("content is not null and content <> ''")
        .drop("_mark", "_before")
    )


def _spoken(conversations: DataFrame, *kept: str) -> DataFrame:
    """Turns of users and assistants with their number ``_no`` in the order of conversations.

    Numbers run over the whole table in one ordered scan, so a very long conversation is many
    tasks; turns of others, and gaps in the turn numbers, leave no gap in them.
    """
    spoken = conversations.where(F.col("role").isin("user", "assistant"))
    rows = spoken.select("conv_id", "turn", "role", "text", *kept)
    return dense_ids(rows, ["conv_id", "turn", "role", "text"], "_no")


def _paired(spoken: DataFrame) -> DataFrame:
    asked = spoken.where("role = 'user'").drop("role").withColumnRenamed("text", "q")
    answered = spoken.where("role = 'assistant'").select(
        "conv_id", (F.col("_no") - 1).alias("_no"), F.col("text").alias("a")
    )
    return asked.join(answered, ["conv_id", "_no"])


def exchanges(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, q, a): a user turn and the assistant turn that comes next.

    System turns between the two, and numbers that are left out, do not part them.
    """
    return _paired(_spoken(conversations)).select("conv_id", "turn", "q", "a")


def with_history(conversations: DataFrame) -> DataFrame:
    """User turns with their history: the last exchange before, if there is one.

    The new pair takes the last one's place, so a history never holds more than one pair. A
    question without an answer is no exchange, and a later question still has the one before.
    """
    spoken = _spoken(conversations)
    pairs = _paired(spoken).select("conv_id", "_no", F.struct("q", "a").alias("_pair"))
    asked = spoken.where("role = 'user'").join(pairs, ["conv_id", "_no"], "left")
    before = fill_forward(asked, ["conv_id"], "_no", "_pair", "_history", inclusive=False)
    none = F.array().cast("array<struct<q:string,a:string>>")
    return before.select(
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        F.when(F.col("_history").isNull(), none).otherwise(F.array("_history")).alias("history"),
    )
