"""Toxicity of texts: a linear classifier over character n-grams.

A text's features are the hashed character n-grams it contains. Each is scaled by its naive
Bayes log-count ratio, the logarithm of its share in toxic over its share in other texts, and
a logistic regression is fitted on the scaled features. The ratio is brought towards 0 by two
standard errors, so that the very many n-grams that tell nothing have a ratio of 0: else their
noise would drown the few that do in long texts.

A text is scored by windows of bounded length that cover all of it, as a sum over a whole text
grows with its length. The highest margin of its windows counts, above a level that rises with
the logarithm of their number as fast as the highest of so many windows of clean texts does,
so that a clean text is seldom above it whatever its length.

The classifier is fitted on at most about ``LEARN_ROWS`` labelled texts; counts of features
and the weights are arrays of fixed length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrow import map_texts
from shelfspark.llm.common import held_out, learnable, sampled
from shelfspark.storage import cut_lineage

#: Bound on the labelled rows the classifier is fitted on: more are thinned by a hash of their ids.
LEARN_ROWS = 16_000
BITS = 20
LENGTHS = (3, 4, 5, 6)
SMOOTH = 1.0  # texts of the average share that each class is given besides its own
STANDARD_ERRORS = 2.0
REGULARISATION = 1e-3
#: The regression is fitted in parts of so many rows; their weights are averaged after each round.
PART_ROWS = 4_000
ROUNDS, STEPS, RATE = 4, 50, 0.03
THRESHOLD = 0.3
#: Windows are two neighbouring blocks of so many n-gram starts; so many blocks are hashed at a time.
BLOCK, BLOCKS_AT_ONCE = 1_000, 1_000
#: The rise of the level is the mean excess of clean windows over this quantile; one clean text
#: in 1 / (1 - TAIL) may be above the level.
TAIL = 0.99


def codes_of(text: str | None) -> np.ndarray:
    """Code points of a text; none for an empty one.

    Letters are lower-cased and white space becomes single blanks, also around the text, so
    that n-grams know where words begin and end.
    """
    if not text or not (words := text.lower().split()):
        return np.zeros(0, np.uint32)
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def slots_of(codes: np.ndarray, length: int, bits: int = BITS) -> np.ndarray:
    """The feature of the n-gram that starts at each place."""
    n = max(0, len(codes) - length + 1)
    mixed = np.full(n, length, np.uint32)
    for at in range(length):
        mixed *= np.uint32(0x01000193)
        mixed ^= codes[at : at + n]
        mixed *= np.uint32(0x9E3779B1)
    return mixed >> np.uint32(32 - bits)


def features(text: str | None, bits: int = BITS, lengths=LENGTHS) -> np.ndarray:
    """The features a text has, without order or repeats; none for an empty one."""
    codes = codes_of(text)
    if not len(codes):
        return np.zeros(0, np.int32)
    seen = np.zeros(1 << bits, bool)
    for length in lengths:
        seen[slots_of(codes, length, bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


_scratch: list[np.ndarray] = []


def _marks() -> list[np.ndarray]:
    """For each feature, a place within a block, and whether the block before had it; kept by the
    worker between texts."""
    if not _scratch:
        _scratch.extend((np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, bool)))
    return _scratch


class Classifier:
    """Weights of the features, the intercept, and the rise and start of the level."""

    def __init__(self, weights: np.ndarray, intercept: float, rise: float = 0.0, start: float = 0.0):
        self.weights, self.intercept, self.rise, self.start = weights, intercept, rise, start
        self.known = weights != 0

    def margins(self, text: str | None) -> np.ndarray:
        """The margin of each window; a text of up to two blocks is one window.

        A window's features are those of its two blocks together, so its margin is the sum over
        either less that over the features that both have."""
        codes = codes_of(text)
        blocks = max(1, -(-(len(codes) - LENGTHS[0] + 1) // BLOCK))
        place, seen = _marks()
        alone, common = np.zeros(blocks), np.zeros(blocks)
        last = place[:0]
        for first in range(0, blocks, BLOCKS_AT_ONCE):
            start, stop = first * BLOCK, (first + BLOCKS_AT_ONCE) * BLOCK
            here = min(BLOCKS_AT_ONCE, blocks - first)
            cut = []  # for each length the features that count, by block
            for length in LENGTHS:
                slots = slots_of(codes[start : stop + length - 1], length).astype(np.intp)
                at = np.flatnonzero(self.known[slots])
                edges = np.searchsorted(at, np.arange(here + 1) * BLOCK).tolist()
                slots = slots[at]
                cut.append([slots[a:b] for a, b in zip(edges, edges[1:])])
            for block, parts in enumerate(zip(*cut), first):
                own = np.concatenate(parts)
                order = np.arange(len(own), dtype=np.int32)
                place[own] = order
                own = own[place[own] == order]  # each once
                weights = self.weights[own]
                alone[block] = weights.sum()
                common[block] = weights[seen[own]].sum()
                seen[last], seen[own], last = False, True, own
        seen[last] = False
        if blocks == 1:
            return alone + self.intercept
        return alone[:-1] + alone[1:] - common[1:] + self.intercept

    def score(self, text: str | None) -> float:
        margins = self.margins(text)
        margin = float(margins.max()) - max(0.0, self.start + self.rise * float(np.log(len(margins))))
        with np.errstate(over="ignore"):
            return float(1 / (1 + np.exp(-margin)))


def learn(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, bound: int = LEARN_ROWS) -> Classifier:
    """A classifier of the labelled texts that are not held out."""
    named = (
        labels.where(F.col(label_column).isNotNull() & learnable(id_column))
        .groupBy(F.col(id_column).alias("doc_id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("label"))
    )
    named = named.where(sampled("doc_id", named.count(), bound))  # so few rows may be sent to every task
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    rows = texts.join(F.broadcast(named), "doc_id").select("doc_id", "label", "text")
    rows = cut_lineage(rows.repartition(max(1, -(-min(named.count(), 2 * bound) // PART_ROWS)), "doc_id"))

    def count(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                counts[int(label > 0), features(text)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({"feature": at, "no": counts[0, at], "yes": counts[1, at]})

    size = {r["yes"]: r["count"] for r in rows.groupBy((F.col("label") > 0).alias("yes")).count().collect()}
    yes, no = size.get(True, 0), size.get(False, 0)
    if not yes or not no:  # nothing to tell apart
        return Classifier(np.zeros(1 << BITS), np.inf if yes else -np.inf)
    table = (
        rows.mapInArrow(count, "feature long, no long, yes long")
        .groupBy("feature")
        .agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
        .toArrow()
    )
    counts = np.zeros((2, 1 << BITS))
    counts[:, table.column("feature").to_numpy()] = table.column("no").to_numpy(), table.column("yes").to_numpy()
    ratio = log_count_ratio(counts[1], counts[0], yes, no)
    chosen = np.flatnonzero(ratio)
    if not len(chosen):
        return Classifier(ratio, float(np.log(yes / no)))
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    weights = np.zeros(1 << BITS)
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def has(batch):
        placed = (sent.value[features(t)] for t in batch.column("text").to_pylist())
        return {"label": batch.column("label"), "has": [p[p >= 0] for p in placed]}

    placed = cut_lineage(map_texts(rows.select("label", "text"), has, "label int, has array<int>"))
    weights[chosen], intercept = regression(placed, ratio[chosen], float(np.log(yes / no)))
    weights[chosen] *= ratio[chosen]
    return Classifier(weights, intercept, *level_of(rows, Classifier(weights, intercept)))


def level_of(rows: DataFrame, model: Classifier) -> tuple[float, float]:
    """Rise and start of the level. The highest margin of clean windows rises by the rise when
    there are e times as many: it is the mean excess of the clean texts among rows (label,
    text) over a high quantile, the scale of an exponential tail. The start is where that
    quantile lies below the usual threshold; few windows do not change a score."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def of(batch):
        found = [sent.value.margins(t) for t in batch.column("text").to_pylist()]
        return {"margin": np.concatenate(found)}

    margins = cut_lineage(map_texts(rows.where("label <= 0").select("text"), of, "margin double"))
    level = margins.agg(F.percentile_approx("margin", TAIL, 10_000)).first()[0]
    rise = margins.where(F.col("margin") > level).agg(F.avg(F.col("margin") - level)).first()[0]
    return rise or 0.0, min(0.0, level - float(np.log(THRESHOLD / (1 - THRESHOLD))))


def regression(rows: DataFrame, ratio: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression of rows (label, has), by iterative
    parameter mixing: the task of each partition improves the weights on its own rows, then
    they are averaged."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(ratio)
    model = np.append(np.zeros(len(ratio)), intercept)
    for _ in range(ROUNDS):
        start = context.broadcast(model)

        def improve(batches):
            labels, features = [], []
            for batch in batches:
                labels += batch.column("label").to_pylist()
                features += [row.values.to_numpy() for row in batch.column("has")]
            if labels:
                better = descend(np.array(labels) > 0, features, sent.value, start.value)
                yield pa.RecordBatch.from_pydict({"n": [len(labels)], "model": [better]})

        found = rows.mapInArrow(improve, "n long, model array<double>").toArrow()
        total = sum(found.column("n").to_pylist())
        model = sum(n / total * m.values.to_numpy() for n, m in zip(found.column("n").to_pylist(), found.column("model")))
    return model[:-1], float(model[-1])


def descend(labels: np.ndarray, features: list[np.ndarray], ratio: np.ndarray, model: np.ndarray) -> np.ndarray:
    """``model`` after some steps of Adam on the regularised logistic loss of the rows."""
    row = np.repeat(np.arange(len(labels)), [len(f) for f in features])
    column = np.concatenate(features)
    model, mean, square = model.copy(), np.zeros(len(model)), np.zeros(len(model))
    for step in range(1, STEPS + 1):
        weights = model[:-1] * ratio
        margin = np.bincount(row, weights[column], len(labels)) + model[-1]
        wrong = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / len(labels)
        slope = np.bincount(column, wrong[row], len(ratio)) * ratio + REGULARISATION * model[:-1]
        slope = np.append(slope, wrong.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        model -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return model


def log_count_ratio(in_yes: np.ndarray, in_no: np.ndarray, yes: int, no: int) -> np.ndarray:
    """Shrunken logarithm of the share of ``yes`` texts with a feature over that of ``no`` texts."""
    extra = SMOOTH * (in_yes + in_no) / (yes + no)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log((in_yes + extra) / (yes + SMOOTH)) - np.log((in_no + extra) / (no + SMOOTH))
        error = np.sqrt(1 / (in_yes + extra) + 1 / (in_no + extra))
        sure = np.sign(ratio) * np.maximum(0, np.abs(ratio) - STANDARD_ERRORS * error)
    return np.nan_to_num(sure, nan=0.0)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    bound: int = LEARN_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier) and predicted of each row.

    Learns from labelled texts whose id is not held out; of several labels of an id the
    largest counts, null labels and ids do not. Labels, ids and other columns are no inputs of
    a score. Null and empty texts have no features and score the intercept. A long text scores by its
    highest window, so that neither its length nor clean text around a passage decides. With labels of one
    kind only, or none, every score is that kind (0 if none). A row per input row, repeated
    rows included.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_column, text_column, label_column, bound))

    def of(batch):
        return {
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "score": [model.value.score(t) for t in batch.column("text").to_pylist()],
        }

    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = map_texts(rows, of, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
