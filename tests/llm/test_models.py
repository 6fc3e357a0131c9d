"""Learned operators: held-out accuracy, and defined results for hard cases."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm.common import held_out
from shelfspark.llm.langid import WordFirst, identify, in_known_language
from shelfspark.llm.perplexity import KneserNey, base_counts, groups_of, ngrams_of, quality_rules, symbols_of
from shelfspark.llm.toxicity import BLOCK, Classifier, features, learn, toxicity
from tests.llm.tables import empty_table, hard_cases, hard_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_of_held_out_texts(docs):
    right = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in identify(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == right[r.doc_id] for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_hard_cases(spark):
    got = identify(hard_table(spark)).collect()
    assert len(got) == len(hard_cases())
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (4, 5, 6, 12))
    assert identify(empty_table(spark)).collect() == []
    kept = in_known_language(hard_table(spark))
    assert kept.columns == hard_table(spark).columns
    assert not {4, 5, 6, 12} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in identify(rows).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_texts_stay_when_no_language_is_known(spark):
    rows = [(1, "some words", None), (2, "12 %", None), (3, None, None), (4, "\u0e01\u0e32", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in in_known_language(docs).collect()) == [1, 4]


def test_toxic_held_out_texts_score_higher(docs, labels):
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity(docs, labels).collect() if r.held_out and toxic.get(r.doc_id) is not None]
    yes = [r.score for r in got if toxic[r.doc_id]]
    no = [r.score for r in got if not toxic[r.doc_id]]
    assert np.mean([a > b for a in yes for b in no]) > 0.85
    assert np.mean([s >= 0.3 for s in no]) < 0.05


def test_toxicity_of_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = learn(docs, labels, "doc_id", "text", "toxic")
    held = docs.join(labels, "doc_id").where(held_out("doc_id") & F.col("text").isNotNull()).orderBy("doc_id")
    clean = [r.text for r in held.where("toxic = 0").collect()]
    passages = [r.text[:2000] for r in held.where("toxic = 1").collect()]
    passages = [p for p in passages if model.score(p) > 0.999][::10]  # clear ones
    assert len(passages) >= 3
    pick = np.random.default_rng(5)
    for size in (300_000, 1_000_000, 5_000_000):
        parts = [clean[i] for i in pick.integers(len(clean), size=size // 1000)]
        ends = np.cumsum([len(p) + 1 for p in parts])
        parts = parts[: int(np.searchsorted(ends, size)) + 1]
        assert model.score("\n".join(parts)) < 0.3
        for passage in passages:
            at = len(parts) // 3
            assert model.score("\n".join([*parts[:at], passage, *parts[at:]])) >= 0.3


def test_windows_cover_texts():
    words = [f"w{i * i % 7919}" for i in range(3000)]
    weights = np.random.default_rng(2).normal(size=1 << 20) * (np.arange(1 << 20) % 3 == 0)
    model = Classifier(weights, 0.5)
    short = " ".join(words)[: 2 * BLOCK - 2]
    assert model.margins(short) == pytest.approx([0.5 + weights[features(short)].sum()])
    text = " ".join(words)
    assert len(model.margins(text)) == -(-len(text) // BLOCK) - 1
    assert model.margins(None) == model.margins(" ") == [0.5]


def invented(rnd, letters, words, n):
    """Texts over words of their own, from a small alphabet."""
    own = ["".join(rnd.choices(letters, k=rnd.choice([2, 3, 5, 8]))) for _ in range(words)]
    return [" ".join(rnd.choices(own, k=rnd.choice([5, 40]))) for _ in range(n)]


def test_a_script_without_blanks(spark):
    """Texts that are one run of letters are learned by their n-grams."""
    rnd = random.Random(4)
    thai = ["".join(rnd.choices(["ภาษา", "ไทย", "เขียน", "ติดกัน", "ไม่มี", "วรรค"], k=30)) for _ in range(120)]
    texts = [(t, "th") for t in thai] + [(t, "en") for t in invented(rnd, "abcdefgh", 300, 400)]
    rows = [(i, text, lang) for i, (text, lang) in enumerate(texts)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)


def test_many_languages(spark):
    """Fifty languages of very different sizes; one of them has two texts alone."""
    rnd = random.Random(5)
    rows = []
    for k in range(50):
        letters = "".join(chr(ord("a") + (7 * k + 3 * j) % 26) for j in range(6 + k % 5))
        rows += [(text, f"l{k:02d}") for text in invented(rnd, letters, 60, 2 if k == 49 else rnd.choice([20, 40]))]
    rows = [(i, text, lang) for i, (text, lang) in enumerate(rows)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.9 * len(held)
    assert sum(got[i].lang_pred == "l49" for i, _ in held) <= 3


def test_scores_equal_plain_sums():
    """The sparse tables next to logarithms of smoothed frequencies, up to what all languages share."""
    counts = [("a", 0, "x", 5), ("a", 0, "y", 1), ("b", 0, "x", 2), ("b", 0, "z", 7), ("a", 1, "q", 3), ("b", 1, "r", 1)]
    model = WordFirst(counts, {"a": 3, "b": 1, "c": 1})

    def plain(language, length, entry):
        own = {(l, e): n for l, k, e, n in counts if k == length}
        total = {l: sum(n for (m, _), n in own.items() if m == l) for l in "abc"}
        average = sum(own.get((l, entry), 0) / total[l] for l in "ab") / 3
        return math.log((own.get((language, entry), 0) + 50 * average) / (total[language] + 50)) - math.log(average)

    for words in (["x"], ["x", "y", "z", "x"], ["q"], ["z", "rrr", "unseen"]):
        want = []
        for language, prior in zip("abc", (0.6, 0.2, 0.2)):
            total = math.log(prior)
            for w in words:
                if w in "xyz":
                    total += plain(language, 0, w)
                else:
                    total += sum(plain(language, 1, g) for g in f"<{w}>" if g in "qr")
            want.append(total)
        assert model.scores(words) == pytest.approx(want)


def test_toxicity_of_hard_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (9, None), (None, 1), (11, 0)], "doc_id long, toxic int")
    got = toxicity(hard_table(spark), labels).collect()
    assert len(got) == len(hard_cases()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = toxicity(hard_table(spark), labels.where("false")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity(empty_table(spark), labels).collect() == []


def plain_base(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts(docs):
    texts = [r.text for r in docs.limit(60).collect()] + [r[1] or "" for r in hard_cases() if r[0] != 7]
    texts += ["a b c d e f g h " * 3, "x " * 20, "l\nl\n\n l\nl \nl", "a b c d e f g h i a b c d e f g h"]
    for text in texts:
        assert base_counts(text) == plain_base(text)


def test_model_is_a_distribution():
    text = "the cat sat on the mat and the dog sat on the cat ### 12 the end of the tale is near now"
    grams = np.concatenate([ngrams_of(symbols_of(t)) for t in (text, text[::-1], "zebra quiz & jazz")])
    model = KneserNey(*np.unique(grams, return_counts=True))
    for context in (0, 5 << 10 | 3, int(grams[7] >> 5), int(grams[20] >> 5)):
        after = np.exp(model.log_probabilities(np.arange(32) + (context << 5)))
        assert after.sum() == pytest.approx(1.0) and (after > 0).all()


def plain_kneser_ney(counts):
    """Probabilities by the textbook's recursion over dicts of tuples."""
    levels = {4: dict(counts)}
    for order in (3, 2, 1):
        levels[order] = {}
        for gram in levels[order + 1]:
            levels[order][gram[1:]] = levels[order].get(gram[1:], 0) + 1

    def discounts(table):
        n = [sum(c == k for c in table.values()) for k in range(5)]
        if not all(n[1:]):
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), top) for k, top in ((1, 0.95), (2, 1.9), (3, 2.85))]

    def probability(gram):
        if not gram:
            return 1 / 32
        table = levels[len(gram)]
        d = discounts(table)
        siblings = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        lower = probability(gram[1:])
        if not siblings:
            return lower
        own = table.get(gram, 0)
        left = sum(d[min(c, 3)] for c in siblings)
        return (max(own - d[min(own, 3)], 0) + left * lower) / sum(siblings)

    return probability


def test_model_is_the_textbooks(docs):
    text = " ".join(r.text[:300] for r in docs.limit(4).collect())
    grams, counts = np.unique(ngrams_of(symbols_of(text)), return_counts=True)
    unpack = lambda g: tuple(int(g) >> s & 31 for s in (15, 10, 5, 0))
    want = plain_kneser_ney({unpack(g): int(c) for g, c in zip(grams, counts)})
    asked = np.concatenate([grams[:40], grams[:20] ^ 3, np.array([0, 1 << 12, 99_999])])
    got = KneserNey(grams, counts).log_probabilities(asked)
    assert got == pytest.approx([math.log(want(unpack(g))) for g in asked])


def test_quality_rules(spark, docs):
    got = quality_rules(docs).collect()
    assert len(got) == docs.count()
    passed = [r for r in got if not r.base_failed]
    assert np.mean([r.kept for r in passed]) > 0.8 and not any(r.kept for r in got if r.base_failed)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def greek(rnd, words, n):
    """Prose over some words, each text with most of its own order."""
    return [" ".join(rnd.choices(words, k=60)) + f" {i}" for i in range(n)]


def test_letters_of_any_alphabet_count(spark):
    """In a Greek text with other letters in the same places the model sees another text."""
    rnd = random.Random(8)
    words = ["και", "το", "είναι", "στην", "θάλασσα", "ημέρα", "λόγος", "άνθρωπος", "πόλη", "νερό", "με", "για", "δρόμος"]
    texts = greek(rnd, words, 80)
    letters = sorted({c for w in words for c in w})
    noise = ["".join(rnd.choice(letters) if c in letters else c for c in t) for t in texts[:3]]
    rows = [(i, t, "el") for i, t in enumerate([*texts, *noise])]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    prose = [r.perplexity for r in got if r.doc_id < 80]
    assert min(r.perplexity for r in got if r.doc_id >= 80) > max(prose)
    assert not any(r.kept for r in got if r.doc_id >= 80) and np.mean([r.kept for r in got if r.doc_id < 80]) > 0.9


def test_letters_beyond_the_most_frequent_are_told_apart(spark):
    """Rare letters, also of another plane, cost more than usual ones in the same places, by their
    shares of the letters that have no class of their own."""
    from shelfspark.llm.perplexity import score

    rnd = random.Random(4)
    texts = ["".join(chr(0x4E00 + rnd.randrange(60)) for _ in range(40)) for _ in range(200)]
    tops = sorted(collections.Counter("".join(texts)).items(), key=lambda x: (-x[1], x[0]))
    words = ["".join(c for c, _ in tops[-3:]), "\u9f98\u9f8d\u9f96", "\U00020000\U0001f600\U0001f602", "\U0001f600" * 3]
    texts += [f"{word} " * 8 for word in words]
    rows = [(i, t, "zh") for i, t in enumerate(texts)]
    got = {r.doc_id: r.log_ppl for r in score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    own = {c for c, _ in tops[:26]}
    count = collections.Counter(c for t in texts for c in t if c != " " and c not in own)

    def within(word):
        of = sum(n for c, n in count.items() if (c < "\U00010000") == (word < "\U00010000"))
        return 8 * sum(math.log(count[c] / of) for c in word) / 32

    for a, b in ((200, 201), (202, 203)):
        assert got[b] - got[a] == pytest.approx(within(words[a - 200]) - within(words[b - 200]))


@pytest.mark.parametrize("group_grams", [4_000_000, 1500])
def test_languages_of_any_number_and_size(spark, group_grams):
    """Ten languages, one of six documents, null and empty ones apart: clean documents stay,
    whether models go out together or in groups."""
    from shelfspark.llm.perplexity import score

    rnd = random.Random(3)
    rows = []
    for k in range(10):
        letters = "".join(chr(ord("a") + (5 * k + 3 * j) % 26) for j in range(9))
        words = ["".join(rnd.choices(letters, k=rnd.choice([2, 4, 7]))) for _ in range(40)]
        rows += [(text, [f"l{k}", None, ""][k - 7 if k > 7 else 0]) for text in greek(rnd, words, 6 if k == 4 else 30)]
    rows = [(i, *row) for i, row in enumerate(rows)] + [(9999, "12 !", "other"), (10000, "", "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if group_grams > 10_000:
        got = quality_rules(df).collect()
        small = [r.kept for r in got if r.lang == "l4"]
        assert len(small) == 6 and all(small) and np.mean([r.kept for r in got]) > 0.9
        assert {r.lang for r in got} >= {None, ""}
    else:
        one = {r.doc_id: r.log_ppl for r in score(df).collect()}
        many = {r.doc_id: r.log_ppl for r in score(df, group_grams=group_grams).collect()}
        assert one.keys() == many.keys()
        assert {k for k, v in one.items() if v is None} == {k for k, v in many.items() if v is None}
        assert [v for v in one.values() if v is not None] == pytest.approx([many[k] for k, v in one.items() if v is not None])


def test_groups_of_languages():
    assert groups_of({"a": 3, "b": 4, "c": 9, "d": 1}, 7) == [["a", "b"], ["c"], ["d"]] and groups_of({}, 5) == []


def test_quality_rules_of_hard_cases(spark):
    got = quality_rules(hard_table(spark)).collect()
    assert len(got) == len(hard_cases())
    none = [r for r in got if r.doc_id in (4, 5, 6)]
    assert all(r.n_words == 0 and r.base_failed and not r.kept and r.perplexity is None for r in none)
    assert quality_rules(empty_table(spark)).collect() == []
