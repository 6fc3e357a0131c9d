"""Language identification by word-first backoff.

A word that the model knows scores each language by the logarithm of its frequency there. An
unseen word backs off to its character n-grams, from the longest length at which any of them
is known down to single characters. A text's language is the one with the highest sum over its
words and the languages' shares of the learned texts.

A language's frequencies are smoothed towards those of all languages together, by a weight that
counts less the more the language has itself: one with few counts is close to the average and
gains nothing from words that it lacks. As the average is the same for all, only an entry's
languages are kept with it, and tables grow with the entries, not with the number of languages
times them.

The model is fitted on at most about ``LEARN_ROWS`` texts. Of a language it keeps the most
frequent words, and n-grams of each length, up to a share of ``ENTRIES`` entries that all
languages divide among them, so its size is bounded. Runs of letters longer than
``LONGEST_WORD`` (all runs, in scripts without blanks) are no words, but learned and scored by
their n-grams.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.arrow import Memo, hold_only, map_texts, slices
from shelfspark.llm.common import held_out, learnable, sampled
from shelfspark.storage import cut_lineage

#: Bound on the rows that the model is fitted on: more are thinned by a hash of their ids.
LEARN_ROWS = 20_000
#: Entries of the model, about, divided evenly; of a language no more than so many words and
#: n-grams of a length.
ENTRIES, WORDS_PER_LANGUAGE, GRAMS_PER_LANGUAGE = 600_000, 50_000, 20_000
LONGEST_GRAM, LONGEST_WORD = 5, 32
#: Occurrences that the average of all languages counts for in each of them.
AVERAGE = 50.0
MEMO_WORDS = 200_000
UNKNOWN = "und"
#: Texts with a lower score are taken for no language.
LEAST_SCORE = 0.5
#: A word: a letter, then letters and the marks that combine with them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams(word: str, length: int) -> list[str]:
    """The n-grams of a word between its ends."""
    ended = f"<{word}>"
    return [ended[i : i + length] for i in range(len(ended) - length + 1)]


class WordFirst:
    """Log frequencies of words and n-grams, less those of all languages together.

    ``tables[length]`` has the rows of entries (0: whole words). ``base[length]`` is what an
    entry gives a language that never has it, and a row adds, from ``starts``, for its own
    languages ``which`` the ``values`` beyond that.
    """

    def __init__(self, counts: list[tuple[str, int, str, int]], texts: dict[str, int]):
        """``counts``: language, length (0: whole word), entry, count; ``texts``: learned per language."""
        self.languages = sorted(texts)
        column = {l: i for i, l in enumerate(self.languages)}
        share = np.array([texts[l] for l in self.languages], float)
        self.prior = np.log(share / share.sum()) if len(share) else share
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
        self.base = np.zeros((LONGEST_GRAM + 1, len(self.languages)))
        starts, which, values = [np.zeros(1, np.int64)], [], []
        rows = at = 0
        for length, table in enumerate(self.tables):
            own = sorted((c for c in counts if c[1] == length), key=lambda c: (c[2], c[0]))
            if not own:
                continue
            language = np.array([column[c[0]] for c in own])
            seen = np.array([c[3] for c in own], float)
            for c in own:
                table.setdefault(c[2], rows + len(table))
            entry = np.array([table[c[2]] for c in own]) - rows
            totals = np.bincount(language, seen, len(self.languages))
            frequency = seen / totals[language]
            average = np.bincount(entry, frequency) / len(self.languages)
            self.base[length] = np.log(AVERAGE / (totals + AVERAGE))
            values.append(np.log1p(seen / (AVERAGE * average[entry])))
            which.append(language)
            starts.append(at + np.cumsum(np.bincount(entry)))
            rows, at = rows + len(table), at + len(own)
        self.starts = np.concatenate(starts)
        self.which = np.concatenate([*which, np.zeros(0, np.int64)]).astype(np.int32)
        self.values = np.concatenate([*values, np.zeros(0)])
        self.memo = Memo(MEMO_WORDS, LONGEST_WORD)

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.memo = Memo(MEMO_WORDS, LONGEST_WORD)

    def _sum(self, rows: np.ndarray) -> np.ndarray:
        """What rows add to the languages."""
        first = self.starts[rows]
        size = self.starts[rows + 1] - first
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
        return np.bincount(self.which[at], self.values[at], len(self.languages))

    def backoff(self, word: str) -> np.ndarray:
        """The scores of an unseen word."""
        for length in range(LONGEST_GRAM, 0, -1):
            table = self.tables[length]
            at = [table[g] for g in grams(word, length) if g in table]
            if at:  # a character is in so many
                return (self._sum(np.array(at)) + len(at) * self.base[length]) / length
        return np.zeros(len(self.languages))

    def scores(self, words: list[str]) -> np.ndarray:
        """Sum over the words, per language."""
        total, at = self.prior.copy(), []
        known, memo = self.tables[0], self.memo
        for word in words:
            row = known.get(word)
            if row is not None:
                at.append(row)
                continue
            own = memo.get(word)
            if own is None:
                own = memo.keep(word, self.backoff(word))
            total += own
        return total + self._sum(np.array(at)) + len(at) * self.base[0] if at else total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        scores = self.scores(words)
        best = int(scores.argmax())
        return self.languages[best], float(1 / np.exp(scores - scores[best]).sum())


def most_frequent(counts: DataFrame, words: int, others: int) -> DataFrame:
    """Of rows (lang, length, entry, n) the most frequent of each language and length, about
    ``words`` whole words or ``others`` n-grams. Entries are not gathered by language: the
    count down to which they stay comes from how many have each count, and of those with that
    count a share by a hash stays."""
    sizes = counts.groupBy("lang", "length", "n").agg(F.count("*").alias("entries"))
    above = Window.partitionBy("lang", "length").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    most = F.when(F.col("length") == 0, words).otherwise(others)
    left = most - F.coalesce(F.sum("entries").over(above), F.lit(0))
    share = sizes.withColumn("share", left / F.col("entries")).where("share > 0").drop("entries")
    # As many rows as there are different counts, whose number is bounded by the learned texts.
    drawn = F.pmod(F.xxhash64("entry"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return counts.join(F.broadcast(share), ["lang", "length", "n"]).where(drawn < F.col("share")).drop("share")


def learn(docs: DataFrame, id_column: str, text_column: str, lang_column: str, bound: int = LEARN_ROWS) -> WordFirst:
    """A model of the texts with a language that are not held out."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    ).where(learnable("doc_id") & F.col("lang").isNotNull())
    rows = rows.where(sampled("doc_id", rows.count(), bound))

    def added(found: Counter, language: str, word: str, n: int) -> None:
        for length in range(1, LONGEST_GRAM + 1):
            for gram in grams(word, length):
                found[language, length, gram] += n

    def columns(found: Counter) -> dict:
        keys = list(found)
        return {"lang": [k[0] for k in keys], "length": [k[1] for k in keys], "entry": [k[2] for k in keys], "n": list(found.values())}

    def count_words(batch):
        found: Counter = Counter()
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word in words_of(text):
                if len(word) <= LONGEST_WORD:
                    found[language, 0, word] += 1
                else:
                    added(found, language, word, 1)
        return columns(found)

    def count_grams(batch):
        found: Counter = Counter()
        for language, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "entry", "n"))):
            added(found, language, word, n)
        return columns(found)

    kind = "lang string, length long, entry string, n long"
    first = map_texts(rows.select("lang", "text"), count_words, kind).groupBy("lang", "length", "entry").agg(F.sum("n").alias("n"))
    first = cut_lineage(first)
    words = first.where("length = 0")
    parts = map_texts(words.select("lang", "entry", "n"), count_grams, kind, text="entry")
    parts = parts.unionByName(first.where("length > 0"))
    parts = parts.groupBy("lang", "length", "entry").agg(F.sum("n").alias("n"))
    texts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # languages are few
    each = ENTRIES // max(1, len(texts))
    own_words = max(1, min(WORDS_PER_LANGUAGE, each // 3))
    own_grams = max(1, min(GRAMS_PER_LANGUAGE, (each - own_words) // LONGEST_GRAM))
    kept = most_frequent(cut_lineage(words.unionByName(parts)), own_words, own_grams)
    table = kept.toArrow()
    counts = list(zip(*(table.column(c).to_pylist() for c in ("lang", "length", "entry", "n"))))
    return WordFirst(counts, texts)


def identify(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    bound: int = LEARN_ROWS,
) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the language's posterior share) of each row.

    Learns from the texts with a language whose id is not held out; language, id and other
    columns are no inputs of a prediction. A null text, one without letters, or any text when
    there is nothing to learn from is ``und`` with score 0. Ties go to the first language by
    code point. Texts are read whole, of any length. A row per input row, repeated rows
    included, none for an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, id_column, text_column, lang_column, bound))

    def of(batch):
        found = [model.value.predict(t) for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "lang_pred": [f[0] for f in found],
            "score": [f[1] for f in found],
        }

    rows = docs.select(
        F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, of, f"doc_id {kind}, held_out boolean, lang_pred string, score double")



def in_known_language(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    least: float = LEAST_SCORE,
    bound: int = LEARN_ROWS,
) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is told with a score of ``least`` or
    more. Rows stay where they lie, without a shuffle; with nothing to learn from, those with a
    letter are kept."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, id_column, text_column, lang_column, bound))

    def kept(batches):
        hold_only(__name__)
        for batch in slices(batches, text_column):
            texts = batch.column(text_column).to_pylist()
            if model.value.languages:
                found = (model.value.predict(t) for t in texts)
                told = [lang != UNKNOWN and score >= least for lang, score in found]
            else:
                told = [LETTERS.search(t or "") is not None for t in texts]
            yield batch.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
