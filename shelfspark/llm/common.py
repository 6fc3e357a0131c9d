"""Small helpers shared by the operators: texts, words, ids and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: str | Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null stays null.

    ``lower`` does the same for texts without other characters and is faster.
    """
    text = F.col(text) if isinstance(text, str) else text
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def held_out(doc_id: str | Column) -> Column:
    """True for the quarter of documents that no model learns from; false for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def learnable(doc_id: str | Column) -> Column:
    """True for rows a model may learn from: the id is there and not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return doc_id.isNotNull() & ~held_out(doc_id)


def sampled(doc_id: str | Column, rows: int, bound: int) -> Column:
    """True for a share of the ids that leaves about ``bound`` of ``rows`` rows; all if fewer.

    The choice hangs on the id alone, so reruns and both sides of a join agree.
    """
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    if rows <= bound:
        return F.lit(True)
    steps = 1 << 20
    return F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(steps)) < max(1, int(steps * bound / rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found
