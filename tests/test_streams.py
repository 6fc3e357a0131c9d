"""Streams of given tables that are folders of several files."""

from shelfspark.storage import fresh_path
from shelfspark.workload import streams


def folder(spark, name, rows, schema):
    """A place with table ``name`` as a folder of a file per row."""
    d = fresh_path(spark, "tables")
    spark.createDataFrame(rows, schema).repartition(len(rows)).write.parquet(f"{d}/{name}.parquet")
    return d


def test_answers_of_a_table_in_several_files(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one\ntwo"), (3, 1, "assistant", "open")]
    d = folder(spark, "conversations", rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted(tuple(r) for r in streams.str_answer(spark, d).collect())
    assert got == [("1:1", "one\ntwo", True), ("3:1", "open", False)]


def test_texts_of_a_table_in_several_files(spark):
    rows = [(1, "one. two."), (2, "three.")]
    d = folder(spark, "documents", rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in streams.str_ingest(spark, d).collect())
    assert got == [("1".zfill(32), 0, "one."), ("1".zfill(32), 1, "two."), ("2".zfill(32), 0, "three.")]


def test_files_of_a_table_in_several_files(spark):
    rows = [(1, "src1", 3), (11, "src1", 4), (2, "src1", 5)]
    d = folder(spark, "documents", rows, "doc_id bigint, source string, n_chars bigint")
    got = sorted(tuple(r) for r in streams.str_poll(spark, d).collect())
    assert got == [("KB_u1_src1", True), ("KB_u2_src1", False)]
