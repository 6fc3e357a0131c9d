"""Components of the similarity join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from shelfspark.llm import ngram_join as module
from shelfspark.llm.ngram_join import Block, components, ngram_join, shingles, without_near_copies
from tests.llm.tables import SCHEMA, empty_table, hard_cases, hard_table


def plain(rows):
    """(n_shingles, component) of each id, from all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def changed(words, pick, times):
    words = list(words)
    for _ in range(times):
        at = pick.randrange(len(words))
        words[at : at + pick.choice((0, 1))] = [f"n{pick.randrange(10**6)}"]
    return words


def corpus():
    """Chains of copies of copies, a large group, a passage in many texts, short texts."""
    pick = random.Random(11)
    word = lambda: f"w{pick.randrange(3000)}"
    texts, passage = [], [word() for _ in range(60)]
    for _ in range(40):
        text = [word() for _ in range(pick.randrange(20, 160))]
        for _ in range(pick.randrange(1, 6)):
            texts.append(" ".join(text))
            text = changed(text, pick, max(1, len(text) // 45))
    base = [word() for _ in range(150)]
    texts += [" ".join(changed(base, pick, pick.randrange(0, 9))) for _ in range(120)]
    texts += [" ".join([word() for _ in range(15)] + passage + [word() for _ in range(pick.randrange(8, 25))]) for _ in range(60)]
    texts += ["", None, "a b", "A  b", "a b c", "x y z v w", "x y z v w u", "..."] * 2
    pick.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block_tokens", [1 << 20, 700])
def test_components_are_those_of_all_pairs(spark, block_tokens):
    """Also over many small blocks, some of one text alone."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join(df, block_tokens=block_tokens)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain(rows)


def test_texts_with_shingles_of_their_own_have_no_region(spark):
    """Shared passages make no region for texts that cannot link."""
    rows = spark.createDataFrame(corpus(), "doc_id long, text string")
    signed = {r.doc_id: r for r in module.signatures(rows, 5, 75).collect()}
    texts = dict(corpus())
    counts = defaultdict(int)
    for text in texts.values():
        for h in shingles(text).tolist():
            counts[h] += 1
    for doc_id, row in signed.items():
        own = shingles(texts[doc_id]).tolist()
        first = len(own) - -(-len(own) * 75 // 100) + 1
        alone = sum(counts[h] == 1 for h in own)
        assert row.n_shingles == len(own) and len(row.regions) == max(0, first - alone if own else 0)


def test_texts_and_ids_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_IDS", 0)
    rows = corpus()[:150]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain(rows)


def test_first_shingles_meet():
    """Regions of a block, with counts of a corpus: texts that link share one."""
    pick = np.random.default_rng(2)
    for _ in range(200):
        names = pick.integers(0, 1 << 63, 50, dtype=np.uint64)
        a = pick.integers(0, 50, pick.integers(5, 60))
        b = a.copy()
        b[pick.random(len(b)) < 0.03] = pick.integers(0, 50)
        block = Block(np.concatenate([a, b]).astype(np.uint32), np.array([len(a), len(b)]), names, 5)
        sets = [set(block.id[x:y].tolist()) for x, y in zip(block.edges, block.edges[1:])]
        counts = np.bincount(block.id, minlength=len(block.hashes)) + pick.integers(0, 3, len(block.hashes))
        if 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1]):
            (one, other), _ = block.regions(counts, 75)
            assert set(one.tolist()) & set(other.tolist())


@pytest.mark.parametrize("at_once", [500_000, 0])  # in one task, and by star contraction
def test_components_of_links(spark, at_once):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 99), (99, 98), (98, 100), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), at_once).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 99: 98, 100: 98}
    assert components(spark.createDataFrame([], "a string, b string"), at_once).collect() == []


def test_hard_cases(spark):
    got = ngram_join(hard_table(spark)).collect()
    assert len(got) == len(hard_cases())
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.n_shingles, r.component_id))
    assert by_id[1] == by_id[2] == by_id[3] == {(1, 1)}
    assert by_id[4] == {(0, 4)} and by_id[6] == {(0, 6)} and by_id[9] == {(len(shingles(hard_cases()[9][1])), 8)}
    assert by_id[None] == {(1, None)}
    stays = without_near_copies(hard_table(spark))
    assert stays.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(str(r.doc_id) for r in stays.collect()) == sorted(map(str, (1, 4, 5, 6, 7, 8, 10, 11, 12, None)))


def test_empty(spark):
    assert ngram_join(empty_table(spark)).collect() == []


def test_block_holds_small_numbers():
    """Pairs of a block are 32-bit numbers, and those of windows within one text."""
    names = np.arange(10, 20, dtype=np.uint64)
    tokens = np.array([0, 1, 2, 0, 1, 2, 0, 5, 6, 7], np.uint32)
    block = Block(tokens, np.array([7, 0, 1, 2]), names, 3)
    assert block.doc.dtype == block.id.dtype == np.int32
    assert block.sizes().tolist() == [3, 0, 1, 1] and len(block.hashes) == 5
