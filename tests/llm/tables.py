"""Small tables that hold the hard cases."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, salt string, _id string"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven grey cats watch from a warm wall near the river bank".split()


def hard_cases():
    """Nulls in every column, empty and long texts, ties, repeated rows; columns whose names
    the operators use inside."""
    near = " ".join(PROSE * 3)
    rows = [
        (1, "Hello World", "en", "b", 11),
        (2, "hello world", "en", "b", 11),
        (3, "hello world", None, None, None),
        (3, "hello world", None, None, None),
        (4, None, "en", "a", None),
        (5, "", None, "a", 0),
        (6, " \t\n\r ", "fr", None, 5),
        (7, LONG, "en", "c", len(LONG)),
        (8, near, "en", "c", len(near)),
        (9, near + " end", "en", "c", None),
        (10, "É é ß Σς İ 漢字 1234 <|endoftext|>", "fr", "é", 3),
        (11, "one two", "en", "é", 7),
        (12, "%%% *** 123 ---", "de", "d", 15),
        (None, "no id at all here", "en", "d", 17),
    ]
    return [(*row, "n", "s", "i") for row in rows]


def hard_table(spark):
    return spark.createDataFrame(hard_cases(), SCHEMA)


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)
