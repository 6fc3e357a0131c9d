"""The character model of the quality rules against a plain one."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm.char_model import ORDER, Grams, count_grams, halved, symbols_of
from shelfspark.llm.perplexity import quality_rules, score_characters

SCHEMA = "doc_id long, text string, lang string"


def plain(learned, asked):
    """Log perplexities of texts by modified Kneser-Ney over the n-grams of others."""

    def grams(text):
        symbols = symbols_of(text).tolist()
        padded = [0] * (ORDER - 1) + symbols
        return [tuple(padded[i : i + ORDER]) for i in range(len(symbols))]

    levels = {ORDER: collections.Counter(g for t in learned for g in grams(t))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    kinds = len({g[-1] for t in [*learned, *asked] for g in grams(t)})
    cuts = {}
    for k, level in levels.items():
        n = [None, *(sum(c == i for c in level.values()) for i in (1, 2, 3, 4))]
        cuts[k] = [0, 0.5, 0.5, 0.5]
        if all(n[1:]):
            y = n[1] / (n[1] + 2 * n[2])
            cuts[k] = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), m) for i, m in ((1, 0.95), (2, 1.9), (3, 2.85)))]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / kinds
        own = [c for g, c in levels[k].items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        n = levels[k].get(gram, 0)
        left = sum(cuts[k][min(c, 3)] for c in own) / sum(own)
        return (n - cuts[k][min(n, 3)]) / sum(own) + left * p(gram[1:])

    return [-sum(math.log(p(g)) for g in grams(t)) / len(grams(t)) if grams(t) else None for t in asked]


def test_scores_by_the_other_half(spark):
    """Equal to the plain model, with n-grams sent to tasks or joined to blocks, of any script."""
    rnd = random.Random(5)
    words = ["Über", "über", "uber", "漢字", "\U00020000\U0001f600", "a1", "a2", "ΣΑΣ", "x-y", "--"]
    rows = [(i, " ".join(rnd.choices(words[: 6 + i % 5], k=rnd.randrange(1, 30))), "ab"[i % 2]) for i in range(60)]
    rows += [(100, "", "a"), (101, None, "a"), (102, " \n ", "b"), (103, "alone", None), (104, "alone", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    half = {r["doc_id"]: r["half"] for r in halved(df).collect()}
    want = {}
    for lang in ("a", "b", None):
        own = [r for r in rows if r[2] == lang]
        for h in (0, 1):
            asked = [r for r in own if half[r[0]] == h]
            learned = [r[1] or "" for r in own if half[r[0]] != h]
            want |= dict(zip([r[0] for r in asked], plain(learned, [r[1] or "" for r in asked])))
    for most in (4_000_000, 400, 1):
        got = {r["doc_id"]: r["log_ppl"] for r in score_characters(df, group_grams=most).collect()}
        assert got.keys() == want.keys()
        assert {i for i, v in got.items() if v is None} == {i for i, v in want.items() if v is None} == {100, 101, 102}
        assert [v for _, v in sorted(got.items()) if v is not None] == pytest.approx([want[i] for i in sorted(want) if want[i] is not None], rel=1e-5)


def test_every_character_counts_in_its_place(spark):
    """Prose of a script of many letters, and the same with its rarer letters in other places."""
    rnd = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(300)]
    words = ["".join(rnd.sample(letters, 3)) for _ in range(150)]
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(120)]
    tops = [c for c, _ in collections.Counter("".join(texts)).most_common() if c != " "]
    noise = []
    for text in texts[:4]:
        rare = [c for c in text if c in tops[26:]]
        rnd.shuffle(rare)
        noise.append("".join(rare.pop() if c in tops[26:] else c for c in text))
    rows = [(i, t, "zh") for i, t in enumerate([*texts, *noise])]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    prose = [got[i].perplexity for i in range(120)]
    assert min(got[i].perplexity for i in range(120, 124)) > 2 * max(prose)
    assert not any(got[i].kept for i in range(120, 124)) and np.mean([got[i].kept for i in range(120)]) > 0.9


def test_ngrams_of_very_many_characters(spark):
    """More characters than four of them fit 63 bits."""
    text = "".join(chr(c) for c in range(0x21, 0x11000) if not 0xD800 <= c < 0xE000) + " \U0010ffff!"
    symbols = symbols_of(text)
    for placed in (False, True):
        grams = Grams([symbols, symbols[:3], symbols], placed=placed)
        assert grams.counts.sum() == 2 * len(symbols) + 3 and (grams.symbol >= 0).all()
        if placed:
            assert (grams.symbol[grams.which] == np.concatenate([symbols, symbols[:3], symbols])).all()
            assert (grams.context[grams.which[: len(symbols)]] & ((1 << 21) - 1))[1:].tolist() == symbols[:-1].tolist()
    rows = halved(spark.createDataFrame([(1, "ab Ab", "x"), (2, "ab Ab", "x")], SCHEMA)).select("lang", "half", "text")
    counted = count_grams(rows).select("symbol", (F.col("n0") + F.col("n1")).alias("n")).collect()
    assert sorted((r["symbol"], r["n"]) for r in counted) == [(0, 2), (0, 2), (66, 2), (98, 2), (99, 2), (99, 2)]
