"""Exact duplicates against a plain grouping."""

from collections import defaultdict

import pytest

from shelfspark.llm.common import UPPER
from shelfspark.llm.content_sort import content_sort, without_copies
from tests.llm.tables import SCHEMA, empty_table, hard_cases, hard_table

LOWER = str.maketrans(UPPER, UPPER.lower())


def plain(rows, best):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    named = {t: [d for d in ids if d is not None] for t, ids in groups.items()}
    return {t: (best(named[t]) if named[t] else None, len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_hard_cases(spark, keep, best):
    rows = [(r[0], r[1]) for r in hard_cases()]
    want = plain(rows, best)
    got = content_sort(hard_table(spark), keep=keep).collect()
    expected = sorted(((d, *want[(t or "").translate(LOWER)]) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == expected
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_frequent_texts_are_cut_into_runs(spark):
    rows = [(i, "Same" if i % 3 == 0 else f"text {i % 50}" if i % 3 == 1 else "same text that fills a third") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = content_sort(docs, runs=8).collect()
    want = plain(rows, min)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(d, *want[t.lower()]) for d, t in rows}
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)


def test_rows_that_stay_keep_their_columns(spark):
    stays = without_copies(hard_table(spark), keep="largest")
    assert stays.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = [r.doc_id for r in stays.collect()]
    assert sorted(i for i in ids if i is not None) == [3, 5, 6, 7, 8, 9, 10, 11, 12] and None in ids


def test_empty(spark):
    assert content_sort(empty_table(spark)).collect() == []
    assert without_copies(empty_table(spark)).collect() == []
