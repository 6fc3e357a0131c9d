"""Source targets and what the mix takes, against plain computations."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from shelfspark.llm.mixing import mix, mixed_documents
from tests.llm.tables import empty_table, hard_cases, hard_table


def water(sizes, weights, total, cap):
    """Targets by dealing the excess again until none is above."""
    target, open_ = {}, set(sizes)
    while open_:
        rest = total - sum(target.values())
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i * 7 % 90) + "#" * (i % 5), None if i % 11 == 0 else f"s{(i * i) % 6}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(1500))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.size == len(rows[r.doc_id][1].split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # Whole epochs come first: within a source documents differ by less than one epoch.
    for source in sizes:
        own = [r.taken / r.size for r in got if r.source == source]
        assert max(own) - min(own) <= 1 + 1e-9


def test_repeats_and_the_cut_document(spark):
    rows = [(i, f"a{i} b{i} c{i}  d{i} ", "x" if i % 4 else "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    takes = {r.doc_id: r.taken for r in mix(docs).collect()}
    words = defaultdict(int)
    for r in mixed_documents(docs).collect():
        found = re.findall(r"\S+", r.text)
        assert found == rows[r.doc_id][1].split()[: len(found)]
        words[r.doc_id] += len(found)
    assert words == {d: t for d, t in takes.items() if t}


def test_pipeline_cuts_no_document(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(20 + i % 7)), f"s{i // 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    takes = mix(docs).collect()
    assert any(r.taken % r.size for r in takes)
    got = corpus_pipeline.mixture(spark, docs, "").collect()
    assert all(r.text == rows[r.doc_id][1] for r in got)
    times = Counter(r.doc_id for r in got)
    assert all(times[r.doc_id] == int(r.taken / r.size + 0.5) for r in takes)


def test_hard_cases(spark):
    got = mix(hard_table(spark)).collect()
    assert len(got) == len(hard_cases())
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert {r.size for r in got if r.doc_id in (4, 5, 6)} == {0}
    assert mixed_documents(hard_table(spark)).columns == hard_table(spark).columns


def test_empty(spark):
    assert mix(empty_table(spark)).collect() == []
    assert mixed_documents(empty_table(spark)).collect() == []
