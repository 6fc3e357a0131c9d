"""Parsing of streamed answer lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import trim_blanks

# Fixed values of the line format.
DATA_PREFIX = "data: "
DONE = "[DONE]"
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"


def payload(raw: Column) -> Column:
    return F.substring(raw, F.lit(len(DATA_PREFIX) + 1), F.length(raw))


def is_done(raw: Column) -> Column:
    return F.coalesce(payload(raw).startswith(DONE), F.lit(False))


def delta(raw: Column) -> Column:
    """Answer text of one line; closing lines, bad JSON and missing fields give nothing."""
    return F.when(is_done(raw), "").otherwise(
        F.coalesce(F.get_json_object(payload(raw), "$.answer"), F.lit(""))
    )


def answer_line(text: Column) -> Column:
    return F.concat(F.lit(DATA_PREFIX), F.to_json(F.struct(text.alias("answer"))))


def strip_think(text: Column) -> Column:
    blank = r"[\s\x1c-\x1f]"
    return trim_blanks(F.regexp_replace(text, f"(?sU)<think>.*?</think>{blank}*", ""))


def content_or_reasoning(content: Column, reasoning: Column) -> Column:
    """Content, else reasoning; null when both are empty."""
    return F.coalesce(F.nullif(content, F.lit("")), F.nullif(reasoning, F.lit("")))


def message_content(line: Column) -> Column:
    """``message.content`` of a JSON line; null for bad JSON and empty content."""
    return F.nullif(F.get_json_object(line, "$.message.content"), F.lit(""))
