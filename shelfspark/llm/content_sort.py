"""Exact duplicates by sorting contents (DataFrame functions only).

Rows are range-partitioned by their normalised text at splitters that Spark samples, each
partition is sorted (to disk when it must), and neighbours are compared in full. So that the
sample of splitters stays small however long texts are, the order is by the front of a text,
then by a hash of the whole, then by the whole text. Texts with
so many copies that they would fill much of a partition are cut into salted runs first, each
run is settled like a text of its own, and the heads of the runs, a bounded number per text,
are compared with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import lower_ascii, shuffle_partitions, text_or_empty, unused
from shelfspark.storage import cut_lineage

#: Characters of a text that splitters are made of.
FRONT = 48


def row_key(doc_id: str | Column, text: str | Column) -> Column:
    """Names a row by its id and its normalised text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    named = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.sha2(F.concat(named, F.lit(":"), lower_ascii(text_or_empty(text))), 256)


def content_sort(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    runs: int | None = None,
) -> DataFrame:
    """Each row with the id of the row that stays among those of equal text.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of
    equal texts the row with the smallest (or ``largest``) id stays; null ids stay last, and of
    rows that agree in id and text one stays. Result: doc_id, keep_id, group_size, kept,
    text_sha256 (of the normalised text), row_key; a row per input row, none for none. Other
    columns are not read. ``runs`` is the number of pieces a frequent text is cut into, the
    number of shuffle partitions by default.
    """
    spark = docs.sparkSession
    runs = runs or shuffle_partitions(spark)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), lower_ascii(text_or_empty(text_column)).alias("norm")
    )
    # Fewer than 8 * runs texts can each hold more than 1 / (8 * runs) of the rows.
    least = docs.count() / (8 * runs)
    counts = rows.groupBy(F.xxhash64("norm").alias("hash")).agg(F.count("*").alias("n"))
    frequent = [r["hash"] for r in counts.where(F.col("n") > max(1, least)).collect()] if least >= 1 else []
    salt = F.pmod(F.xxhash64("doc_id", F.lit("run")), F.lit(runs)).cast("int")
    rows = rows.withColumn("salt", F.when(F.xxhash64("norm").isin(frequent), salt) if frequent else F.lit(None).cast("int"))

    first = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    place = {"front": F.substring("norm", 1, FRONT), "hash": F.xxhash64("norm")}
    salted = ["salt"] if frequent else []
    run = Window.partitionBy(*place, "norm", *salted)
    settled = (
        rows.withColumns(place)
        .repartitionByRange(*place, *salted)
        .withColumn("rank", F.row_number().over(run.orderBy(first)))
        .withColumn("head", F.first("doc_id").over(run.orderBy(first)))
        .withColumn("n", F.count("*").over(run))
        .select(
            "doc_id",
            "salt",
            "rank",
            "head",
            "n",
            F.sha2("norm", 256).alias("text_sha256"),
            F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "norm"), 256).alias("row_key"),
            F.when(F.col("salt").isNotNull() & (F.col("rank") == 1), F.col("norm")).alias("text"),
        )
    )
    if not frequent:
        return _result(settled, F.col("head"), F.col("n"), F.col("rank") == 1)
    settled = cut_lineage(settled)
    text = Window.partitionBy("text")
    best = F.col("head").asc_nulls_last() if keep == "smallest" else F.col("head").desc_nulls_last()
    heads = (
        settled.where("text is not null")
        .withColumn("first_run", F.row_number().over(text.orderBy(best)) == 1)
        .withColumn("keep_id", F.first("head").over(text.orderBy(best)))
        .withColumn("group_size", F.sum("n").over(text))
        .select("text_sha256", "salt", "keep_id", "group_size", "first_run")
    )
    whole = _result(settled.where("salt is null"), F.col("head"), F.col("n"), F.col("rank") == 1)
    cut = settled.where("salt is not null").drop("n", "text").join(heads, ["text_sha256", "salt"])
    return whole.unionByName(
        _result(cut, F.col("keep_id"), F.col("group_size"), F.col("first_run") & (F.col("rank") == 1))
    )


def _result(rows: DataFrame, keep_id: Column, size: Column, kept: Column) -> DataFrame:
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        size.cast("long").alias("group_size"),
        kept.alias("kept"),
        "text_sha256",
        "row_key",
    )


def without_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    (key,) = unused(docs, "row_key")
    stays = content_sort(docs, id_column, text_column, keep).where("kept").select(F.col("row_key").alias(key))
    keyed = docs.withColumn(key, row_key(id_column, text_column))
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).drop(key)
