"""The automaton's scores next to a plain model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfspark.llm.lm_score import lm_score, packed, unpacked
from tests.llm.tables import LONG, empty_table, hard_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def plain(rows, order):
    """doc_id, n_tokens, n_known, train_tokens, base score and score, by dictionaries."""
    learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    grams = {k: Counter() for k in range(1, order + 1)}
    for text in learned:
        at = ["<", *tokens_of(text)]
        for k in range(1, order + 1):
            grams[k].update(tuple(at[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(at)))
    follow, kinds = defaultdict(int), defaultdict(int)
    for k in range(2, order + 1):
        for gram, n in grams[k].items():
            follow[gram[:-1]] += n
            kinds[gram[:-1]] += 1
    n, v = sum(grams[1].values()), len(grams[1])

    def discount(k):
        once, twice = (sum(c == x for c in grams[k].values()) for x in (1, 2))
        return min(max(once / (once + 2 * twice), 0.1), 0.95) if once and twice else 0.5

    cut = {k: discount(k) for k in range(2, order + 1)}

    def p(gram):
        if len(gram) == 1:
            return (grams[1][gram] + 1) / (n + v + 1)
        context, k = gram[:-1], len(gram)
        if not follow[context]:
            return p(gram[1:])
        return max(grams[k][gram] - cut[k], 0) / follow[context] + cut[k] * kinds[context] / follow[context] * p(gram[1:])

    out = []
    for i, text in rows:
        at = ["<", *tokens_of(text)]
        base = sum(math.log10(p((w,))) for w in at[1:])
        score = sum(math.log10(p(tuple(at[max(0, j - order + 1) : j + 1]))) for j in range(1, len(at)))
        out.append((i, len(at) - 1, sum(grams[1][(w,)] > 0 for w in at[1:]), n, base, score))
    return out


def texts(n, seed):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 40, 300])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "Ab aB É é"), (n + 2, "Ab aB É é")]


def agree(got, rows, order):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(found, sorted(plain(rows, order), key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_equals_a_plain_model(spark, order):
    rows = texts(60, order)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    agree(lm_score(df, order=order).collect(), rows, order)


def test_small_blocks_stretches_and_cut_contexts(spark):
    """Many blocks and shards, contexts cut over shards, long texts walked in stretches."""
    rows = texts(80, 5) + [(1000, LONG[:30_000]), (1001, "the a the b the c the d " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for order in (2, 3):
        agree(lm_score(df, order=order, block_tokens=500, shard_tokens=300, stretch=7).collect(), rows, order)


def test_hard_and_empty_tables(spark):
    docs = hard_table(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    agree(lm_score(docs).collect(), rows, 2)
    assert lm_score(empty_table(spark)).collect() == []


def test_prose_scores_better_than_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm_score(docs).where("held_out").toPandas()
    assert held.score.sum() > held.base_score.sum()


def test_packed_arrays_come_back():
    arrays = [np.arange(1000, dtype=np.uint64) << np.uint64(40), np.array([], np.uint32), np.array([7], np.uint32)]
    for a, b in zip(arrays, unpacked(packed(*arrays)), strict=True):
        assert a.tolist() == b.tolist()
