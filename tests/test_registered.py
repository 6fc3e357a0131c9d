"""The registered queries: names, and a few of them next to their SQL."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.sidebyside import connect, differences

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))
CHECKED = ("prompts", "agg_total_status", "win_title", "src_links", "agg_service_state", "fts_search")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    assert differences(df, connect(SF), entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"query_id", "prompt", "mean_score", "grounded", "n_sources"}


@pytest.mark.parametrize("left", ["pipeline", "folder", "nothing"])
def test_imports_without_the_training_operators(tmp_path, left):
    """A copy without the optional parts registers the other queries, also if the pipeline's
    file or an emptied folder is left."""
    shutil.copytree(f"{ROOT}/shelfspark", tmp_path / "shelfspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if left == "pipeline":
        (tmp_path / "corpus_pipeline.py").write_text("from shelfspark.llm.queries import tokenizer\n")
    if left == "folder":
        (tmp_path / "shelfspark/llm/__pycache__").mkdir(parents=True)
    asked = "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", asked], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    rest = {q for m in entry.MODULES if not m.__name__.startswith("shelfspark.llm") for q in m.QUERIES}
    assert set(said.stdout.split()) == rest
