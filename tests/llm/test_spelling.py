"""Spelling variants next to brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from shelfspark.llm.spelling import near, spelling_variants
from tests.llm.tables import SCHEMA, empty_table, hard_table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_one(a, b):
    """By trying every edit."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    form, links = {}, {}
    for w in n:
        others = [o for o in n if distance_one(w, o)]
        links[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in sorted(n):
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], links[w], n.get(form[w])))
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(letters, size, seed):
    """Texts over words and their edits, frequencies far apart."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choices(letters, k=rnd.choice([6, 7, 8, 12]))) for _ in range(size)}
    for w in list(words):
        at = rnd.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]}
    words = sorted(words)
    weights = [rnd.paretovariate(0.5) for _ in words]
    return [(i, rnd.choice(" -1一").join(rnd.choices(words, weights, k=400))) for i in range(120)]


@pytest.mark.parametrize("letters", ["abcdefghéÉß", "ab", "àð"])
def test_equals_brute_force(spark, letters):
    """Letters of different groups, and letters of one: then vectors tell nothing apart."""
    rows = variants(letters, 40, len(letters))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling_variants(df)) == plain(rows)


@pytest.mark.parametrize("cell_words", [1, 3, 10])
def test_large_cells_are_split_by_halves(spark, cell_words):
    rows = variants("abà", 30, cell_words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling_variants(df, cell_words=cell_words)) == plain(rows)


def test_chain_of_forms(spark):
    chain = {"letter": 1000, "lettter": 150, "lettterr": 26, "letttterr": 5}
    rows = [(None, " ".join(f"{w} " * n for w, n in chain.items()))]
    got = {r[0]: r[2] for r in found(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == dict.fromkeys(chain, "letter")


@pytest.mark.parametrize("a,b", [("abcdef", "abcdeg"), ("abcdef", "abcdefg"), ("abcdef", "xabcdef"), ("abcdef", "abxcdef"), ("aaaaaa", "aaaaaaa"), ("abcdef", "abdcef"), ("abcdef", "abcdxyf")])
def test_near(a, b):
    assert near(a, b) == distance_one(a, b)


def test_hard_and_empty_tables(spark):
    docs = hard_table(spark)
    five = docs.union(docs).union(docs).union(docs).union(docs)
    assert found(spelling_variants(five)) == plain([(r.doc_id, r.text) for r in five.collect()])
    assert spelling_variants(empty_table(spark)).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, None, "a", "b", 1, "n", "s", "i")], SCHEMA)).collect() == []
