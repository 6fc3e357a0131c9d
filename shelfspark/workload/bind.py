"""The library's tables, derived from the given parquet tables in Spark.

``sql.py`` states the same derivations in SQL for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.answers import answer_line
from shelfspark.operators.answers import exchanges
from shelfspark.storage import spread

PIECES = 10  # chunks, and vectors, per document


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _user(number):
    return F.concat(F.lit("u"), (number % 5).cast("string"))


def _file_id(number):
    return F.lpad(number.cast("string"), 32, "0")


def users(spark, sf_dir):
    user = _user(F.col("doc_id")).alias("user_id")
    return table(spark, sf_dir, "documents").select(user).distinct().select(
        "user_id", F.concat(F.lit("user "), "user_id").alias("user_name")
    )


def kbs(spark, sf_dir):
    user = _user(F.col("doc_id"))
    return (
        table(spark, sf_dir, "documents")
        .select(user.alias("user_id"), F.col("source").alias("kb_name"))
        .distinct()
        .select(
            F.concat(F.lit("KB_"), "user_id", F.lit("_"), "kb_name").alias("kb_id"),
            "user_id",
            "kb_name",
            F.when(F.col("kb_name") == "src7", 1).otherwise(0).alias("deleted"),
        )
    )


def file_name(doc_id, source):
    ext = (
        F.when(doc_id % 4 == 0, ".txt")
        .when(doc_id % 4 == 1, ".md")
        .when(doc_id % 4 == 2, ".csv")
        .otherwise(".eml")
    )
    return F.concat(source, F.lit("_"), doc_id.cast("string"), ext)


def files(spark, sf_dir):
    return as_files(table(spark, sf_dir, "documents"))


def as_files(documents):
    doc = F.col("doc_id")
    status = (
        F.when(doc % 17 == 0, "red")
        .when(doc % 13 == 0, "yellow")
        .when(doc % 11 == 0, "gray")
        .otherwise("green")
    )
    day = F.lpad((doc % 28 + 1).cast("string"), 2, "0")
    return documents.select(
        _file_id(doc).alias("file_id"),
        F.concat(F.lit("KB_"), _user(doc), F.lit("_"), "source").alias("kb_id"),
        file_name(doc, F.col("source")).alias("file_name"),
        status.alias("status"),
        F.concat(F.lit("202401"), day, F.lit("0930")).alias("timestamp"),
        F.when(doc % 19 == 0, 1).otherwise(0).alias("deleted"),
        F.col("n_chars").alias("file_size"),
        F.lit(-1).cast("bigint").alias("content_length"),
        F.lit(-1).cast("bigint").alias("chunk_size"),
    )


def texts(spark, sf_dir):
    """Whole document texts as (file_id, text)."""
    return as_texts(table(spark, sf_dir, "documents"))


def as_texts(documents):
    return documents.select(
        _file_id(F.col("doc_id")).alias("file_id"), "text"
    )


def chunks(spark, sf_dir):
    """Every whole document cut into ten consecutive chunks; some of short ones are empty."""
    doc, size = F.col("doc_id"), F.length("text")
    begin = F.floor(F.col("chunk_idx") * size / PIECES).cast("int")
    end = F.floor((F.col("chunk_idx") + 1) * size / PIECES).cast("int")
    pieces = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))
    return (
        spread(table(spark, sf_dir, "documents"), "doc_id")
        .select("*", pieces.alias("chunk_idx"))
        .select(
            _user(doc).alias("user_id"),
            F.concat(F.lit("KB_"), _user(doc), F.lit("_"), "source").alias("kb_id"),
            _file_id(doc).alias("file_id"),
            file_name(doc, F.col("source")).alias("file_name"),
            "chunk_idx",
            F.concat(_file_id(doc), F.lit("_"), F.col("chunk_idx").cast("string")).alias(
                "chunk_id"
            ),
            F.substring(F.col("text"), begin + 1, end - begin).alias("content"),
        )
    )


def vectors(spark, sf_dir):
    """A vector for every chunk of every document.

    Chunks take the given embeddings in turn; each further time around an embedding is rotated
    by one place more, so that no two chunks agree by construction.
    """
    embeddings = table(spark, sf_dir, "embeddings")
    n = embeddings.count()
    doc, at = F.col("doc_id"), F.col("doc_id") * PIECES + F.col("chunk_idx")
    turned = F.floor(at / n) % F.size("embedding")
    chunked = table(spark, sf_dir, "documents").select(
        doc, "source", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("chunk_idx")
    )
    return chunked.join(embeddings, at % n == F.col("vec_id")).select(
        _user(doc).alias("user_id"),
        F.concat(F.lit("KB_"), _user(doc), F.lit("_"), "source").alias("kb_id"),
        _file_id(doc).alias("file_id"),
        "chunk_idx",
        F.concat(
            F.slice("embedding", (turned + 1).cast("int"), F.size("embedding")),
            F.slice("embedding", F.lit(1), turned.cast("int")),
        ).alias("embedding"),
    )


def queries(spark, sf_dir):
    """Every vector also asks a question: a benchmark text, with one exchange of history."""
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id"), F.col("text").alias("question")
    )
    n_items = items.count()
    pairs = (
        exchanges(table(spark, sf_dir, "conversations"))
        .groupBy("conv_id")
        .agg(F.min_by(F.struct("q", "a"), "turn").alias("_pair"))
    )
    none = F.array().cast("array<struct<q:string,a:string>>")
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("item_id", F.col("vec_id") % n_items)
        .join(items, "item_id")
        .join(pairs, F.col("conv_id") == F.col("vec_id"), "left")
        .select(
            F.col("vec_id").cast("string").alias("query_id"),
            _user(F.col("vec_id")).alias("user_id"),
            "question",
            F.col("embedding").alias("qvec"),
            F.when(F.col("_pair").isNull(), none).otherwise(F.array("_pair")).alias("history"),
        )
    )


def service_events(spark, sf_dir):
    """Events as outcomes of services; details and latencies are partly missing."""
    return as_service_events(table(spark, sf_dir, "events"))


def as_service_events(events):
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_type").alias("service"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when((F.col("event_type") == "error") | (F.col("value") > 100), "unhealthy")
        .otherwise("healthy")
        .alias("status"),
        F.when(k % 3 != 0, F.concat(F.lit("k="), k.cast("string"))).alias("detail"),
        F.when(k % 4 != 0, F.col("value")).alias("latency_ms"),
    )


SERVICES = ("signup", "click", "error", "purchase", "audit")


def answer_events(spark, sf_dir):
    """Lines of assistant turns as an answer stream, each followed by its closing line."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    stream = F.concat("conv_id", F.lit(":"), "turn").alias("stream_id")
    lines = turns.select(
        stream, F.posexplode(F.split("text", r"(?<=\n)")).alias("seq", "line")
    ).select("stream_id", F.col("seq").cast("bigint").alias("seq"), answer_line(F.col("line")).alias("raw"))
    ends = turns.select(
        stream,
        F.size(F.split("text", r"(?<=\n)")).cast("bigint").alias("seq"),
        F.lit("data: [DONE]\n\n").alias("raw"),
    )
    return lines.unionByName(ends)
