"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate, fixed by its id, over its quality weight; small
keys come first. Within a source the documents stand in key order and their sizes are summed
along it. A source's target is so many whole epochs, in which every document is taken, and a
remainder that is filled from the front of the order. The order is cut into key bins, so that
a source with most of the rows is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import WORD, text_or_empty, unused
from shelfspark.operators.scan import dense_ids
from shelfspark.storage import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
BINS = 1024


def size_in_words(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def quality(text: str | Column, size: Column) -> Column:
    """Between 0.5 and 1: less for texts with many of the characters ``#*$%&|<>``.

    The lower end keeps the key bins even: a weight near 0 would crowd the last one.
    """
    symbols = F.regexp_count(text_or_empty(text), F.lit(r"[#*$%&|<>]"))
    return F.lit(1.0) / (F.lit(1.0) + F.least(F.lit(1.0), symbols / F.greatest(size, F.lit(1))))


def uniform(doc_id: str | Column, seed: str) -> Column:
    """A number in (0, 1) fixed by the id: 52 bits of a digest."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Sources take the weights in turn, in code point order with null last. ``share`` of all
    sizes is dealt by weight; a target stops at ``cap`` times its source's size and the excess
    is dealt among the others by weight until none is above. Each round is one aggregate over
    the sources; a round fixes at least one source and in practice most that will be.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_ids(per_source, [F.col("source").asc_nulls_last()], "rank")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.select("source", "source_size", turn.alias("weight")))
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, limit = 0.0, F.col("source_size") * F.lit(cap)
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        left = ranked.agg(
            F.sum(F.when(full, limit)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        if not left["weight"]:
            break
        new = (share * total - (left["fixed"] or 0.0)) / left["weight"]
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    bins: int = BINS,
) -> DataFrame:
    """How many words of each document the mix takes.

    Result: doc_id, source, size, source_size, target, taken; a row per input row. A size is the
    number of words; a null text has none and nothing is taken of it. ``taken`` counts repeats:
    as many whole epochs as the target holds, then the front of the key order up to the
    remainder, where the one document that crosses it gives the words up to it, so that a
    source's sum is its target rounded to a word. Equal ids get equal keys and stand
    in order of size. Other columns are not read. Reruns agree.
    """
    text = F.col(text_column)
    size = size_in_words(text)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        size.alias("size"),
        quality(text, size).alias("quality"),
    )
    key = -F.log(uniform("doc_id", seed)) / F.col("quality")
    rows = cut_lineage(rows.withColumn("key", key).withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins)))
    targets = source_targets(rows, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", F.least(epochs, F.lit(int(cap)))).withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    )
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("source", "bin")
        .agg(F.sum("size").alias("bin_size"))
        .withColumn("start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
        .withColumnsRenamed({"source": "s_source", "bin": "s_bin"})
    )
    targets = targets.withColumnRenamed("source", "t_source")
    starts = starts.join(targets, F.col("s_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = summed.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bin") == F.col("s_bin")))
    part = F.least(F.greatest(F.col("rest") - F.col("start") - F.col("ahead"), F.lit(0)), F.col("size"))
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: bool = True, **settings
) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: once for each whole time, with the text cut
    after its last taken word where a document is taken in part; rows of which nothing is
    taken go. Without ``cut`` no text is cut: a document taken in part is taken whole if that
    part is at least half of it, else not, so a source misses its target by at most half a
    document. Columns are those of ``docs``. Rows that share an id must agree in size."""
    same_id, same_size, taken, size, words = unused(docs, "same_id", "same_size", "taken", "size", "words")
    takes = (
        mix(docs, id_column, text_column, **settings)
        .groupBy(F.col("doc_id").alias(same_id), F.col("size").alias(same_size))
        .agg(F.max("taken").alias(taken))
        .where(F.col(taken) > 0)
    )
    sized = docs.withColumn(size, size_in_words(text_column))
    joined = sized.join(takes, F.col(id_column).eqNullSafe(F.col(same_id)) & (F.col(size) == F.col(same_size)))
    times = F.floor(F.col(taken) / F.col(size) + F.lit(0.0 if cut else 0.5))
    whole = F.array_repeat(F.col(size).cast("int"), times.cast("int"))
    rest = F.filter(F.array((F.col(taken) % F.col(size)).cast("int")), lambda n: n > 0)
    text = F.when(F.col(words) == F.col(size), F.col(text_column)).otherwise(_front(F.col(text_column), F.col(words)))
    repeated = joined.withColumn(words, F.explode(F.concat(whole, rest) if cut else whole))
    return repeated.select(*(text.alias(c) if c == text_column else F.col(c) for c in docs.columns))


def _front(text: Column, words: Column) -> Column:
    """``text`` up to the end of its first ``words`` words."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), words), "")
