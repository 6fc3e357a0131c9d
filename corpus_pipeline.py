"""The corpus pipeline: from raw documents to encoded ones, in stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but
the last return the columns of ``documents``, others of clashing names included, as they are.
Between stages the rows are written as Parquet to the shared folder and read again, which also
cuts lineage. Every stage reads whole texts of any length, and gives an empty table for an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm.arrow import small_batches
from shelfspark.llm.bpe import digests, encode_decode
from shelfspark.llm.content_sort import without_copies
from shelfspark.llm.langid import in_known_language
from shelfspark.llm.mixing import mixed_documents
from shelfspark.llm.ngram_join import without_near_copies
from shelfspark.llm.queries import tokenizer
from shelfspark.storage import fresh_path

#: Bytes of texts that reach an encoder at once.
BATCH_BYTES = 4 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told: null and empty texts, texts without a
    letter, and those between languages. A null lang or id is no reason; repeated rows stay. With
    no language to learn from every text with a letter stays."""
    return in_known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest id of equal texts, null ids last; a null text equals an empty one. Of
    rows that agree in id and text one stays, whichever comes first if they differ elsewhere."""
    return without_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of documents that near-duplicate links connect. Texts without words
    and rows with a null id stay; rows that share an id are one document."""
    return without_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins whole documents to about the target sizes of their sources. A null
    source is one of its own, the last; texts without words are taken for nothing and go."""
    return mixed_documents(docs, cut=False)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document, each time it is taken; a
    null text is an empty one, null ids and repeated rows have their rows. The digests are stored
    here, so that texts go to the encoders in small batches."""
    path = fresh_path(spark, "digests")
    with small_batches(spark, BATCH_BYTES):
        digests(encode_decode(docs, tokenizer("word_bpe_49k.json"))).write.parquet(path)
    return spark.read.parquet(path)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("encoding", encoding),
]
ORACLE_SQL = None  # languages are learned and ids encoded, which SQL does not express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
