"""The registered queries next to their SQL, and the pipeline next to its stages done plainly."""

import pytest

import corpus_pipeline
from shelfspark.llm.queries import QUERIES, SQL
from tests.llm.tables import empty_table, hard_table
from tests.sidebyside import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


PER_DOCUMENT = [name for name in sorted(QUERIES) if name not in ("op11_prefix_trie", "op13_spelling_variants")]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    got = QUERIES[name](spark, SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        assert docs.columns == columns
        if name != "mixture":
            assert all(before[r.doc_id] == r.text for r in after) and len({r.doc_id for r in after}) == len(after)
        if name == "exact_copies":
            assert len({r.text.lower() for r in after}) == len(after)
        if name == "mixture":
            assert all(before[r.doc_id].startswith(r.text) for r in after)
    assert corpus_pipeline.run(spark, SF).count() == len(after)


@pytest.mark.parametrize("table", [hard_table, empty_table])
@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_hard_tables(spark, table, name, stage):
    docs = table(spark)
    got = stage(spark, docs, SF)
    rows = got.collect()
    if name != "encoding":
        assert got.columns == docs.columns
    assert bool(rows) == (table is hard_table)
