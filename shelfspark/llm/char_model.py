"""A character n-gram model of every language, over all its characters.

The model is modified Kneser-Ney with interpolation, of order 4, over the characters themselves:
case, accents, digits, marks and letters of any script and plane are told apart; white space
ends words. Texts are dealt into two halves by their hash, and each is scored by the n-grams of
the other half alone, as random characters would be likely after themselves; equal texts share a
half.

N-grams are counted in Spark and stay in Spark tables, a row for each that occurs, with its count
in each half, 0 included: so all that is asked about has a row, and probabilities come from
joins of a level with the one below. They may be any number. Those of small languages go to all
tasks together, up to a bound that is counted; those of others are joined to the n-grams of
blocks of texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfspark.llm.arrow import let_go, map_texts, slices
from shelfspark.storage import stored

ORDER, BITS = 4, 21
#: Symbols are code points and one, so that 0 ends words.
SYMBOLS, END = 1 << BITS, 0
HALVES = 2
#: Bytes of texts whose n-grams are sorted at once, and those of a block that is joined.
SLICE_BYTES, BLOCK_BYTES = 2 << 20, 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[ord(c) for c in " \t\n\x0b\x0c\r"]] = True


def symbols_of(text: str) -> np.ndarray:
    """A text's symbols with one end between words and after the last; empty without words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.zeros(len(points) + 2, np.uint32)
    padded[1:-1] = np.where(WHITE[np.minimum(points, 255)] & (points < 256), END, points + 1)
    kept = padded[1:][(padded[1:] != END) | (padded[:-1] != END)]
    return kept if len(kept) > 1 else kept[:0]


class Grams:
    """The distinct n-grams of texts: ``context``, the symbols before, and ``symbol``, the last
    one; ``counts``, and ``which`` of them ends at each symbol of the texts if asked for."""

    def __init__(self, texts: list[np.ndarray], placed: bool):
        before = np.zeros(ORDER - 1, np.uint32)
        padded = np.concatenate([x for symbols in texts for x in (before, symbols)])
        lengths = np.array([len(s) for s in texts])
        ends = np.cumsum(lengths + ORDER - 1)
        own = np.ones(len(padded), bool)
        own[(ends - lengths)[:, None] - np.arange(1, ORDER)] = False
        last = np.flatnonzero(own)
        seen = np.zeros(SYMBOLS, bool)
        seen[padded] = True
        alphabet = np.flatnonzero(seen)
        place = np.zeros(SYMBOLS, np.uint32)
        place[alphabet] = np.arange(len(alphabet))
        local = place[padded].astype(np.int64)
        n = len(alphabet)
        pairs = None
        if n**ORDER < 1 << 63:
            keys = np.zeros(len(last), np.int64)
            for back in range(ORDER - 1, -1, -1):
                keys = keys * n + local[last - back]
        else:  # pairs are numbered first
            pairs, number = np.unique(np.concatenate([local[last - 3] * n + local[last - 2], local[last - 1] * n + local[last]]), return_inverse=True)
            keys = number[: len(last)] * len(pairs) + number[len(last) :]
        found = np.unique(keys, return_inverse=placed, return_counts=True)
        self.counts, self.which = found[-1], found[1] if placed else None
        keys = found[0]
        if pairs is None:
            parts = [alphabet[keys // n**back % n] for back in range(ORDER - 1, -1, -1)]
        else:
            parts = [alphabet[x] for pair in np.divmod(keys, len(pairs)) for x in np.divmod(pairs[pair], n)]
        self.context = (parts[0] << 2 * BITS) | (parts[1] << BITS) | parts[2]
        self.symbol = parts[3].astype(np.int32)


def _groups(batch: pa.RecordBatch) -> dict[tuple[str, int], tuple[list[int], list[np.ndarray]]]:
    """Places and symbols of the texts with words of each language and half."""
    found: dict[tuple[str, int], tuple[list[int], list[np.ndarray]]] = {}
    for at, (lang, half, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "half", "text")))):
        symbols = symbols_of(text) if text else ()
        if len(symbols):
            places, texts = found.setdefault((lang, half), ([], []))
            places.append(at)
            texts.append(symbols)
    return found


def _gram_batches(lang: str, grams: Grams, **more: np.ndarray):
    for first in range(0, len(grams.symbol), 1 << 16):
        part = slice(first, first + (1 << 16))
        columns = {"context": grams.context[part], "symbol": grams.symbol[part]} | {k: v[part] for k, v in more.items()}
        yield pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, len(columns["symbol"])), **columns})


def halved(rows: DataFrame) -> DataFrame:
    """Rows (lang, text) with the half that their text is in."""
    return rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(HALVES)).cast("int"))


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, context, symbol, n0, n1: the n-grams of rows (lang, half, text), over all texts, with
    their counts in each half."""

    def run(batches):
        for batch in slices(batches, most=SLICE_BYTES):
            for (lang, half), (_, texts) in _groups(batch).items():
                grams = Grams(texts, placed=False)
                none = np.zeros(len(grams.counts), np.int64)
                yield from _gram_batches(lang, grams, **{f"n{k}": grams.counts if k == half else none for k in range(HALVES)})
        let_go()

    counted = rows.select("lang", "half", "text").mapInArrow(run, "lang string, context long, symbol int, n0 long, n1 long")
    return counted.groupBy("lang", "context", "symbol").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discounts(k: int) -> list:
    """Of counts 1, 2 and 3 or more in a half, from how often small counts occur; halves where too
    few tell."""
    n = [None, *(F.col(f"_n{k}_{c}") for c in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2])
    enough = (n[1] > 0) & (n[2] > 0) & (n[3] > 0) & (n[4] > 0)
    most = (0.95, 1.9, 2.85)
    return [
        F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(m), c - (c + 1) * y * n[c + 1] / n[c]))).otherwise(0.5).alias(f"_d{k}_{c}")
        for c, m in zip((1, 2, 3), most)
    ]


def probabilities(counts: DataFrame) -> DataFrame:
    """lang, context, symbol, p0, p1 of rows ``count_grams``: the logarithm of the probability of
    each n-gram by the counts of either half."""
    halves = range(HALVES)
    levels = [stored(counts, "grams")]
    for order in range(ORDER - 1, 0, -1):  # continuations: how many symbols came before
        shorter = F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
        above = levels[0].select("lang", shorter.alias("context"), "symbol", "n0", "n1")
        level = above.groupBy("lang", "context", "symbol").agg(*(F.count_if(F.col(f"n{k}") > 0).alias(f"n{k}") for k in halves))
        levels.insert(0, stored(level, "grams"))
    below = None
    for order, level in enumerate(levels, 1):
        often = [F.count_if(F.col(f"n{k}") == c).alias(f"_n{k}_{c}") for k in halves for c in (1, 2, 3, 4)]
        few = level.groupBy("lang").agg(F.count(F.lit(1)).alias("_kinds"), *often)
        few = few.select("lang", "_kinds", *(d for k in halves for d in _discounts(k)))
        small = [F.count_if(F.col(f"n{k}") == c).alias(f"_c{k}_{c}") for k in halves for c in (1, 2)]
        large = [F.count_if(F.col(f"n{k}") > 2).alias(f"_c{k}_3") for k in halves]
        contexts = level.groupBy("lang", "context").agg(*(F.sum(f"n{k}").alias(f"_t{k}") for k in halves), *small, *large)
        joined = level.join(contexts, ["lang", "context"]).join(F.broadcast(few), "lang")  # a row per language
        if below is None:
            joined = joined.withColumns({f"_p{k}": 1 / F.col("_kinds") for k in halves})
        else:
            joined = joined.withColumn("_lower", F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 2)) - 1)))
            lower = below.select("lang", F.col("context").alias("_lower"), "symbol", *(F.col(f"p{k}").alias(f"_p{k}") for k in halves))
            joined = joined.join(lower, ["lang", "_lower", "symbol"])

        def own(k):
            n, total, (d1, d2, d3) = F.col(f"n{k}"), F.col(f"_t{k}"), (F.col(f"_d{k}_{c}") for c in (1, 2, 3))
            cut = F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)
            weight = (d1 * F.col(f"_c{k}_1") + d2 * F.col(f"_c{k}_2") + d3 * F.col(f"_c{k}_3")) / total
            return F.when(total > 0, (n - cut) / total + weight * F.col(f"_p{k}")).otherwise(F.col(f"_p{k}")).alias(f"p{k}")

        below = joined.select("lang", "context", "symbol", *map(own, halves))
    return stored(below.select("lang", "context", "symbol", *(F.log(f"p{k}").cast("float").alias(f"p{k}") for k in halves)), "grams")


class Lookup:
    """Logarithms of probabilities, sorted by context and symbol."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, by_half: list[np.ndarray]):
        order = np.lexsort((symbol, context))
        self.contexts, which = np.unique(context[order], return_inverse=True)
        self.keys = (which.astype(np.int64) << BITS) | symbol[order]
        self.by_half = [values[order] for values in by_half]

    def log_probabilities(self, half: int, grams: Grams) -> np.ndarray:
        """By the counts of the other half."""
        at = np.searchsorted(self.contexts, grams.context)
        return self.by_half[1 - half][np.searchsorted(self.keys, (at << BITS) | grams.symbol)].astype(float)


def lookups(table: pa.Table) -> dict[str, Lookup]:
    """Of each language of rows ``probabilities``."""
    langs = table.column("lang").combine_chunks().dictionary_encode()
    codes = langs.indices.to_numpy()
    columns = [table.column(c).to_numpy() for c in ("context", "symbol", "p0", "p1")]
    found = {}
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        own = np.flatnonzero(codes == code)
        context, symbol, *by_half = (c[own] for c in columns)
        found[lang] = Lookup(context, symbol, by_half)
    return found


def log_perplexities(batch: pa.RecordBatch, models: dict[str, Lookup]) -> pa.Array:
    """The mean negative log probability of a symbol of each text; null without words."""
    out: list[float | None] = [None] * batch.num_rows
    for (lang, half), (places, texts) in _groups(batch).items():
        grams = Grams(texts, placed=True)
        values = models[lang].log_probabilities(half, grams)[grams.which]
        lengths = np.array([len(s) for s in texts])
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        for at, value in zip(places, (-sums / lengths).tolist()):
            out[at] = value
    return pa.array(out, pa.float64())


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with the number of a block of texts of bounded size, stored."""
    schema = f"block long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}"

    def run(batches):
        part = TaskContext.get().partitionId()
        for made, batch in enumerate(slices(batches, most=BLOCK_BYTES)):
            block = pa.array(np.full(batch.num_rows, (part << 32) | made, np.int64))
            yield pa.RecordBatch.from_arrays([block, *batch.columns], ["block", *batch.schema.names])

    return stored(rows.mapInArrow(run, schema), "blocks")


def _asked(blocks: DataFrame) -> DataFrame:
    """lang, context, symbol, block: the n-grams of each block."""

    def run(batches):
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                for (lang, _), (_, texts) in _groups(batch.slice(a, b - a)).items():
                    grams = Grams(texts, placed=False)
                    yield from _gram_batches(lang, grams, block=np.full(len(grams.symbol), numbers[a]))

    schema = "lang string, context long, symbol int, block long"
    return blocks.select("block", "lang", "half", "text").mapInArrow(run, schema).distinct()


def groups_of(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Languages in groups whose sizes together are at most ``most``, or one alone."""
    groups: list[list[str]] = []
    total = 0
    for lang in sorted(sizes):
        if not groups or total + sizes[lang] > most:
            groups.append([])
            total = 0
        groups[-1].append(lang)
        total += sizes[lang]
    return groups


def map_scored(rows: DataFrame, of: Callable[[pa.RecordBatch, pa.Array], dict], schema: str, most: int) -> DataFrame:
    """Rows (lang, text, …) through ``of``, which is given a slice of them and the log perplexities
    of its texts. ``most`` n-grams go to every task at once; languages that have more are scored
    in blocks, which n-grams are joined to."""
    rows = halved(rows)
    model = probabilities(count_grams(rows))
    sizes = {r["lang"]: r["count"] for r in model.groupBy("lang").count().collect()}
    spark = rows.sparkSession

    def together(own: DataFrame, grams: DataFrame | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(lookups(grams.toArrow()) if grams is not None else {})
        return map_texts(own, lambda batch: of(batch, log_perplexities(batch, shared.value)), schema, most=SLICE_BYTES)

    def joined(own: DataFrame, grams: DataFrame) -> DataFrame:
        blocks = _in_blocks(own)
        answers = _asked(blocks).join(grams, ["lang", "context", "symbol"])

        def score(texts: pa.Table, given: pa.Table) -> pa.Table:
            models = lookups(given)
            tables = [pa.Table.from_pydict(of(b, log_perplexities(b, models))) for b in texts.combine_chunks().to_batches()]
            return pa.concat_tables([t.select(result.names).cast(result) for t in tables]) if tables else result.empty_table()

        result = to_arrow_schema(T.StructType.fromDDL(schema))
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)

    large = sorted(lang for lang, n in sizes.items() if n > most)
    groups = groups_of({lang: n for lang, n in sizes.items() if n <= most}, most)
    if not large and len(groups) < 2:
        return together(rows, model if groups else None)
    wordless = rows.where(~F.col("lang").isin(list(sizes)))
    parts = [together(rows.where(F.col("lang").isin(g)), model.where(F.col("lang").isin(g))) for g in groups]
    if large:
        own = F.col("lang").isin(large)
        parts.append(joined(rows.where(own), model.where(own)))
    return reduce(DataFrame.unionByName, [*parts, together(wordless, None)])
