"""Quality rules: base counts, and a character n-gram language model with perplexity bands.

The model of the rules is that of ``char_model``: modified Kneser-Ney of order 4 over all
characters of a language, any number of n-grams. ``score`` has a smaller one, which the rules do
not use.

That smaller model is of order 4 over 32 classes of characters, one for each language: the 26 most frequent letters of the language, lower-cased, and the other letters,
digits, symbols, stops, word ends and the rest. The other letters and the rest are classes of
any number of characters, each of which is told apart by its share of its class: a character's
probability is that of its class after those before it, times its share. Characters and n-grams
are counted in Spark, over every word of every document. There are at most 32 ** 4 n-grams per
language however large the corpus, and a row per character; languages are modelled and scored in
groups whose n-grams and characters together stay under ``GROUP_GRAMS``, so what goes to every
task, sorted arrays with probabilities, has a proven bound, and languages may be any number.

A document's perplexity is compared with those of its language: bands lie so many robust
standard deviations of its logarithm around the median, wider in languages of few documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.arrow import let_go, map_texts, slices
from shelfspark.llm.char_model import groups_of, map_scored
from shelfspark.storage import cut_lineage

ORDER, BITS = 4, 5
CLASSES = 1 << BITS
#: N-grams and characters of the languages that are scored together, unless one language alone has more.
GROUP_GRAMS = 4_000_000
#: A band is wider by this over the number of documents it comes from.
FEW = 5.0
#: Half widths of the bands below and above the median, in robust standard deviations, and the
#: least standard deviation of log perplexity that is assumed.
BELOW, ABOVE, LEAST_SPREAD = 4.0, 4.0, 0.03
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
SYMBOLS = "#*$%&|<>"
END, DIGIT, OTHER_LETTER, SYMBOL, STOP, REST = 0, 27, 28, 29, 30, 31
HASH = np.uint32(0x9E3779B1)  # odd, so distinct n-grams keep distinct hashes


PLANE = 1 << 16


def _folded() -> np.ndarray:
    """The code point of the lower-case letter of each code point of the basic plane."""
    table = np.arange(PLANE, dtype=np.uint16)
    for code in range(PLANE):
        lower = chr(code).lower()
        if len(lower) == 1 and ord(lower) < PLANE:
            table[code] = ord(lower)
    return table


def _classes() -> np.ndarray:
    """The class of each code point of the basic plane, letters not told apart; white space ends
    words."""
    table = np.full(PLANE, REST, np.uint8)
    for code in range(PLANE):
        char = chr(code)
        if char in " \t\n\x0b\x0c\r":
            table[code] = END
        elif char.isdigit():
            table[code] = DIGIT
        elif char.isalpha():
            table[code] = OTHER_LETTER
        elif char in SYMBOLS:
            table[code] = SYMBOL
        elif char in ".,;:!?'\"()-":
            table[code] = STOP
    return table


FOLDED, PLAIN = _folded(), _classes()
LETTERS = PLAIN == OTHER_LETTER
#: Characters that have no class of their own unless they are frequent letters.
SHARED = LETTERS | (PLAIN == REST)
#: N-grams that are held before they are counted.
HELD_GRAMS = 1 << 20


def table_of(alphabet: str) -> np.ndarray:
    """Classes of characters for a language with these frequent letters, 26 at most."""
    first = np.zeros(PLANE, np.uint8)
    for at, letter in enumerate(alphabet[: DIGIT - 1], 1):
        first[ord(letter)] = at
    folded = first[FOLDED]
    return np.where(LETTERS & (folded > 0), folded, PLAIN)


ENGLISH = table_of("abcdefghijklmnopqrstuvwxyz")


def points_of(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def codes_of(text: str) -> np.ndarray:
    """Code points of a text, those beyond the basic plane as its last one, as their classes are."""
    return np.minimum(points_of(text), PLANE - 1)


def symbols_of(text: str, table: np.ndarray = ENGLISH) -> np.ndarray:
    """Classes of a text's characters with one end between words, before the first and after
    the last; empty without words."""
    end = np.array([END], np.uint8)
    kept = np.concatenate([end, table[codes_of(text)], end])
    kept = kept[1:][(kept[1:] != END) | (kept[:-1] != END)]
    return kept if len(kept) and kept.any() else kept[:0]


def shared_of(text: str, table: np.ndarray) -> np.ndarray:
    """The characters of a text whose classes they share with others, letters lower-cased."""
    points = points_of(text)
    shared = points[table[np.minimum(points, PLANE - 1)] >= OTHER_LETTER]
    low = np.minimum(shared, PLANE - 1)
    return np.where(shared < PLANE, FOLDED[low], shared)[SHARED[low]]


def ngrams_of(symbols: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol, as a number; ends stand before the first."""
    padded = np.concatenate([np.zeros(ORDER - 1, np.uint32), symbols.astype(np.uint32)])
    grams = np.zeros(len(symbols), np.uint32)
    for at in range(ORDER):
        grams = (grams << np.uint32(BITS)) | padded[at : at + len(symbols)]
    return grams


class KneserNey:
    """Modified Kneser-Ney with interpolation, from the counts of the highest order.

    Levels hold the probabilities of the n-grams seen, and the weights that contexts leave to
    the lower order, each in an array sorted by hash.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        grams, counts = grams.astype(np.uint32), counts.astype(float)
        self.levels = []  # from order 1 up: hashes, probabilities, context hashes, weights
        tables = [(grams, counts)]
        for order in range(ORDER - 1, 0, -1):  # continuations: how many symbols came before
            lower, counts = np.unique(tables[0][0] & np.uint32((1 << BITS * order) - 1), return_counts=True)
            tables.insert(0, (lower, counts.astype(float)))
        below = np.full(1, 1 / CLASSES)
        for order, (grams, counts) in enumerate(tables, 1):
            discount = self._discounts(counts)
            contexts, at = np.unique(grams >> np.uint32(BITS), return_inverse=True)
            total = np.bincount(at, counts)
            cut = discount[np.minimum(counts, 3).astype(int)]
            weight = np.bincount(at, cut) / total
            lower = below if order == 1 else self._level(order - 1, grams & np.uint32((1 << BITS * (order - 1)) - 1))
            self.levels.append(
                (*_sorted(grams, (counts - cut) / total[at] + weight[at] * lower), *_sorted(contexts, weight))
            )

    @staticmethod
    def _discounts(counts: np.ndarray) -> np.ndarray:
        """For counts 0, 1, 2 and 3 or more; halves where too few small counts tell."""
        n = [0, *(float((counts == k).sum()) for k in (1, 2, 3, 4))]
        if not all(n[1:]):
            return np.array([0, 0.5, 0.5, 0.5])
        y = n[1] / (n[1] + 2 * n[2])
        return np.clip([0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))], 0, [0, 0.95, 1.9, 2.85])

    def _level(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams of an order, seen or not."""
        if not order:
            return np.full(len(grams), 1 / CLASSES)
        hashes, values, contexts, weights = self.levels[order - 1]
        result, seen = _find(hashes, values, grams)
        if not seen.all():
            new = grams[~seen]
            lower = self._level(order - 1, new & np.uint32((1 << BITS * (order - 1)) - 1))
            weight, known = _find(contexts, weights, new >> np.uint32(BITS))
            result[~seen] = np.where(known, weight, 1.0) * lower
        return result

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        return np.log(self._level(ORDER, grams.astype(np.uint32)))


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = keys.astype(np.uint32) * HASH
    order = np.argsort(hashes)
    return hashes[order], values[order]


def _find(hashes: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wanted = keys * HASH
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    seen = hashes[at] == wanted
    return np.where(seen, values[at], 0.0), seen


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)] if "\n" in text else []
    ids: dict[str, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    repeated = 0
    if len(words) > REPEAT_WINDOW and len(ids) < len(words):
        at = (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # scattered, then hashed window by window
        at = (at ^ (at >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at ^= at >> np.uint64(32)
        n = len(words) - REPEAT_WINDOW + 1
        windows = np.zeros(n, np.uint64)
        for i in range(REPEAT_WINDOW):
            windows = windows * np.uint64(0xD6E8FEB86659FD93) + at[i : i + n]
        _, which, often = np.unique(windows, return_inverse=True, return_counts=True)
        twice = (often[which] > 1).astype(np.int64)
        if twice.any():
            edges = np.zeros(len(words) + 1, np.int64)
            edges[:n] += twice
            edges[REPEAT_WINDOW : REPEAT_WINDOW + n] -= twice
            repeated = int((np.cumsum(edges[:-1]) > 0).sum())
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def characters(docs: DataFrame) -> DataFrame:
    """lang, code, letter, n: the characters of rows (lang, text), over all texts, that are
    letters or of the last class; letters lower-cased."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}

        def rows(lang, codes, n):
            letter = LETTERS[np.minimum(codes, PLANE - 1)]
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes.astype(np.int64), "letter": letter, "n": n})

        def handed():
            for lang, own in counts.items():
                at = np.flatnonzero(own)
                yield rows(lang, at, own[at])
            counts.clear()

        for batch in slices(batches):
            for lang, texts in by_language(batch).items():
                own = counts.setdefault(lang, np.zeros(PLANE, np.int64))
                for text in joined(texts):
                    points = points_of(text)
                    inside = points < PLANE
                    own += np.bincount(FOLDED[points[inside]], minlength=PLANE) * SHARED
                    if not inside.all():
                        yield rows(lang, *np.unique(points[~inside], return_counts=True))
            if len(counts) > 100:
                yield from handed()
        yield from handed()
        let_go()

    counted = docs.mapInArrow(run, "lang string, code long, letter boolean, n long")
    return counted.groupBy("lang", "code", "letter").agg(F.sum("n").alias("n"))


def joined(texts: list[str], most: int = 1 << 20) -> Iterator[str]:
    """The texts, many short ones as one."""
    held, size = [], 0
    for text in texts:
        if size + len(text) > most and held:
            yield "".join(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield "".join(held)


def alphabets(counted: DataFrame) -> dict[str, str]:
    """The most frequent letters of each language of rows ``characters``."""
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counted.where("letter").withColumn("at", F.row_number().over(first)).where(F.col("at") < DIGIT).collect()  # 26 a language
    found: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["at"])):
        found[row["lang"]] = found.get(row["lang"], "") + chr(row["code"])
    return found


def shares(counted: DataFrame, letters: dict[str, str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language of rows ``characters`` those that share a class, sorted, with the
    logarithms of their shares of it."""
    table = counted.toArrow()
    langs = table.column("lang").to_numpy()
    codes, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    found = {}
    for lang in sorted(set(langs)):
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(codes[own])]
        kind = table_of(letters.get(lang, ""))[np.minimum(codes[own], PLANE - 1)]
        own, kind = own[kind >= OTHER_LETTER], kind[kind >= OTHER_LETTER]
        total = np.bincount(kind, n[own], CLASSES)
        found[lang] = codes[own], np.log(n[own] / total[kind])
    return found


def by_language(batch) -> dict[str, list[str]]:
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        if text:
            texts.setdefault(lang, []).append(text)
    return texts


class Tables(dict):
    """Class tables of the languages asked for, from their alphabets."""

    def __init__(self, letters: dict[str, str]):
        super().__init__()
        self.letters = letters

    def __missing__(self, lang: str) -> np.ndarray:
        if len(self) > 100:
            self.clear()
        self[lang] = table_of(self.letters.get(lang, ""))
        return self[lang]


def count_ngrams(docs: DataFrame, letters: dict[str, str]) -> DataFrame:
    """lang, gram, n over rows (lang, text): counted in each task, then summed."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        tables = Tables(letters)

        def handed():
            for lang, own in counts.items():
                at = np.flatnonzero(own)
                for first in range(0, len(at), 1 << 16):
                    some = at[first : first + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "gram": some, "n": own[some]})
            counts.clear()

        def add(lang, grams):
            own = counts.setdefault(lang, np.zeros(CLASSES**ORDER, np.int64))
            if len(grams) > 1 << 16:
                own += np.bincount(grams, minlength=CLASSES**ORDER)
            else:
                at, n = np.unique(grams, return_counts=True)
                own[at] += n

        for batch in slices(batches):
            for lang, texts in by_language(batch).items():
                held: list[np.ndarray] = []
                for at, text in enumerate(texts, 1):
                    symbols = symbols_of(text, tables[lang])
                    if len(symbols):
                        held.append(ngrams_of(symbols))
                    if held and (at == len(texts) or sum(map(len, held)) > HELD_GRAMS):
                        add(lang, np.concatenate(held))
                        held = []
                if len(counts) > 16:  # arrays of fixed length, so few at a time
                    yield from handed()
        yield from handed()
        let_go()

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> dict[str, KneserNey]:
    """A model for each language of rows (lang, gram, n)."""
    table = counts.toArrow()
    langs = table.column("lang").to_numpy()
    grams, counts = table.column("gram").to_numpy(), table.column("n").to_numpy()
    models = {}
    for lang in sorted(set(langs)):
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(grams[own])]
        models[lang] = KneserNey(grams[own], counts[own])
    return models


def score(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    group_grams: int = GROUP_GRAMS,
) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, and log_ppl, the mean negative log probability
    of a symbol (null without words). A null language is one of its own, not the empty one: lang
    is ``=`` and its name, or empty for null."""
    rows = _rows(docs, id_column, text_column, lang_column)
    counted = cut_lineage(characters(rows.select("lang", "text")))
    letters = alphabets(counted)
    counts = cut_lineage(count_ngrams(rows.select("lang", "text"), letters))
    both = counts.select("lang").unionAll(counted.select("lang"))
    sizes = {r["lang"]: r["count"] for r in both.groupBy("lang").count().collect()}
    groups = groups_of(sizes, group_grams)
    if len(groups) < 2:
        return _scored(rows, fit(counts), letters, shares(counted, letters))

    def of(group):
        own = F.col("lang").isin(group)
        return _scored(rows.where(own), fit(counts.where(own)), letters, shares(counted.where(own), letters))

    wordless = rows.where(~F.col("lang").isin([x for g in groups for x in g]))
    return reduce(DataFrame.unionByName, [*map(of, groups), _scored(wordless, {}, letters, {})])


def _scored(
    rows: DataFrame, fitted: dict[str, KneserNey], letters: dict[str, str], parts: dict[str, tuple[np.ndarray, np.ndarray]]
) -> DataFrame:
    models = rows.sparkSession.sparkContext.broadcast((fitted, parts))
    own_letters = {lang: letters[lang] for lang in fitted if lang in letters}

    def of(batch):
        langs, texts = batch.column("lang").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        tables = Tables(own_letters)
        log_ppl: list[float | None] = [None] * len(texts)
        fitted, parts = models.value
        for lang in set(langs) & set(fitted):
            at = [i for i, own in enumerate(langs) if own == lang]
            used = [(i, s) for i, s in ((i, symbols_of(texts[i], tables[lang])) for i in at) if len(s)]
            values = np.zeros(CLASSES**ORDER)
            for _, symbols in used:
                values[ngrams_of(symbols)] = 1
            seen = np.flatnonzero(values)  # each looked up once
            values[seen] = fitted[lang].log_probabilities(seen)
            codes, logs = parts.get(lang, (np.zeros(0, np.int64), np.zeros(0)))
            for i, symbols in used:
                within = logs[np.searchsorted(codes, shared_of(texts[i], tables[lang]))]
                log_ppl[i] = float(-(values[ngrams_of(symbols)].sum() + within.sum()) / len(symbols))
        return counted_slice(batch, pa.array(log_ppl, pa.float64()))

    return base_rules(map_texts(rows, of, counted_schema(rows)))


def counted_schema(rows: DataFrame) -> str:
    kind = rows.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


def counted_slice(batch: pa.RecordBatch, log_ppl: pa.Array) -> dict:
    """Columns of ``counted_schema`` for a slice of rows (doc_id, lang, text)."""
    out = [base_counts(t or "") for t in batch.column("text").to_pylist()]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    columns = {name: [o[k] for o in out] for k, name in enumerate(names)}
    return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), **columns, "log_ppl": log_ppl}


def base_rules(counted: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def score_characters(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    group_grams: int = GROUP_GRAMS,
) -> DataFrame:
    """As ``score``, by the n-grams of all characters that other texts have."""
    rows = _rows(docs, id_column, text_column, lang_column)
    return base_rules(map_scored(rows, counted_slice, counted_schema(rows), group_grams))


def _rows(docs: DataFrame, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    """doc_id, lang, text; a null language is one of its own: lang is ``=`` and its name, or empty."""
    lang = F.coalesce(F.concat(F.lit("="), F.col(lang_column).cast("string")), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), lang.alias("lang"), F.col(text_column).alias("text"))


def bands(scored: DataFrame) -> DataFrame:
    """lang, lower and upper log perplexity, from the documents that pass the base rules."""
    passed = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull())
    middle = passed.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("median"))
    off = F.abs(F.col("log_ppl") - F.col("median"))
    spread = (
        passed.join(F.broadcast(middle), "lang")  # a row per language
        .groupBy("lang", "median")
        .agg(F.percentile_approx(off, 0.5, 10_000).alias("off"), F.count("*").alias("n"))
    )
    deviation = F.greatest(1.4826 * F.col("off"), F.lit(LEAST_SPREAD))  # of a normal distribution
    deviation = deviation * (1 + FEW / F.col("n"))
    return spread.select(
        "lang",
        (F.col("median") - BELOW * deviation).alias("lower"),
        (F.col("median") + ABOVE * deviation).alias("upper"),
    )


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lang, perplexity of each row.

    A null text counts as empty: no words, base_failed, not kept, null perplexity. A document
    that passes the base rules is kept if its perplexity lies in its language's band, ends
    included; a null language has a band like any other, apart from an empty one. Texts are
    read whole, of any length, and scored by those of the other half, see ``char_model``. A row
    per input row, repeated rows included, each counted by the model as often as it stands there;
    none for an empty table.
    """
    scored = cut_lineage(score_characters(docs, id_column, text_column, lang_column))
    joined = scored.join(F.broadcast(bands(scored)), "lang", "left")
    inside = F.col("log_ppl").between(F.col("lower"), F.col("upper"))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        F.when(F.col("lang") != "", F.substring("lang", F.lit(2), F.length("lang"))).alias("lang"),
        F.exp("log_ppl").alias("perplexity"),
    )
