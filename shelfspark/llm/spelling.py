"""Spelling variants: words that one inserted, deleted or replaced letter apart.

Letters fall into groups, and a word's vector counts its letters of each group. The words are
arranged in a trie by their length and then by the counts of one group after the other. One
edit changes the counts by one letter too many in a group, one too few in a group, or both: a
search goes down the trie with a budget of one surplus and one deficit, and the words of the
leaves that it reaches are verified.

The first levels of the trie are dealt over tasks: a cell is a length with the counts of the
first groups, and holds what lies below. A word is looked for in its own cell and in those that
one edit of its first groups leads to, with what is left of the budget. As many groups are taken
as make cells small. Words that agree in all groups and are still too many for a cell are
split by the front and by the back half of the word, of which two words that are one edit apart
share one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrow import slices
from shelfspark.llm.common import shuffle_partitions
from shelfspark.storage import fresh_path

#: A letter's group is its code point modulo this.
GROUPS = 16
#: Words of a cell at most, as long as there are groups to split it by.
CELL_WORDS = 20_000
#: Below so many words the trie ends in a leaf.
LEAF = 8
#: Distinct words that a task counts before it hands them on.
MEMO_WORDS = 400_000
LEAST_LETTERS, LEAST_OCCURRENCES, RATIO = 6, 5, 5
#: One in so many distinct (document, run) loses a letter.
DAMAGED = 199
#: Code points above U+00FF are no letters here, so one byte each will do.
RUN = re.compile(b"[a-z\xc0-\xff]{%d,}" % LEAST_LETTERS)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def words_of(doc_id, text: str | None) -> Counter:
    """Words of a text (Latin-1 bytes) and how often it has them, shorter ones left out."""
    runs = RUN.findall(text.encode("latin-1", "replace").translate(LOWER)) if text else []
    found: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(runs).items():
        if doc_id is not None:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if not h % DAMAGED:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LETTERS:
                    continue
        found[run] += n
    return found


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over rows (doc_id, text): counted in each task, then summed."""

    def run(batches):
        memo: Counter = Counter()

        def handed():
            words = [w.decode("latin-1") for w in memo]
            yield pa.RecordBatch.from_pydict({"word": words, "n": pa.array(list(memo.values()), pa.int64())})
            memo.clear()

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                memo.update(words_of(doc_id, text))
                if len(memo) >= MEMO_WORDS:
                    yield from handed()
        if memo:
            yield from handed()

    counts = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_OCCURRENCES)


def vectors(words: list[str]) -> np.ndarray:
    """Letters of each group, a row per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(of * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def with_vectors(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with their letters and group counts."""

    def run(batches):
        for batch in batches:
            own = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {"word": own, "n": batch.column("n"), "letters": pa.array([len(w) for w in own], pa.int32())}
                | {"counts": pa.array(vectors(own).tolist(), pa.list_(pa.int32()))}
            )

    return words.mapInArrow(run, "word string, n long, letters int, counts array<int>")


def near(x: str, y: str) -> bool:
    """Whether y, of other letters or one letter longer, is one edit from x."""
    half = (len(y) - 1) // 2
    if x[:half] != y[:half] and x[-half:] != y[-half:]:
        return False
    longer = len(y) - len(x)
    at = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return (longer == 1 or x != y) and x[at + 1 - longer :] == y[at + 1 :]


def trie(rows: list[int], counts: list[list[int]], level: int):
    """A leaf, a list of words, or a node: what lies below each count of the level's group."""
    if len(rows) <= LEAF or level == len(counts[rows[0]]):
        return rows
    node: dict = {}
    for row in rows:
        node.setdefault(counts[row][level], []).append(row)
    return {count: trie(below, counts, level + 1) for count, below in node.items()}


def reached(node, own: list[int], level: int, surplus: int, deficit: int):
    """Words of the leaves that are at most the given surplus and deficit away, by depth-first
    search; leaves may hold others as well."""
    open_nodes = [(node, level, surplus, deficit)]
    while open_nodes:
        node, level, more, less = open_nodes.pop()
        if type(node) is list:
            yield from node
            continue
        count = own[level]
        if (below := node.get(count)) is not None:
            open_nodes.append((below, level + 1, more, less))
        if more and (below := node.get(count + 1)) is not None:
            open_nodes.append((below, level + 1, 0, less))
        if less and (below := node.get(count - 1)) is not None:
            open_nodes.append((below, level + 1, more, 0))


#: What a row does in a cell: it is one of the cell's words, or is looked for with a budget of
#: surplus and deficit.
MEMBER, EXACT, SURPLUS, DEFICIT = 0, 1, 2, 3
BUDGETS = {MEMBER: (1, 1), EXACT: (0, 0), SURPLUS: (1, 0), DEFICIT: (0, 1)}


def visits(counts: list[int], letters: int, depth: int):
    """Cells (length, first counts) where a word is, or is looked for, and how.

    Longer words are looked for by shorter ones; of two words of one length in different cells
    the one with the smaller counts looks for the other."""
    first, below = counts[:depth], letters - sum(counts[:depth])
    yield MEMBER, letters, first
    yield SURPLUS, letters + 1, first
    for a in range(depth):
        more = [*first[:a], first[a] + 1, *first[a + 1 :]]
        yield EXACT, letters + 1, more
        if below:
            yield DEFICIT, letters, more
        for b in range(a + 1, depth):
            if first[b]:
                yield EXACT, letters, [*more[:b], first[b] - 1, *more[b + 1 :]]


def _cell(letters: int, first: list[int]) -> str:
    return ".".join(map(str, (letters, *first)))


def dealt(words: DataFrame, groups: list[int], depth: int, large: frozenset[str]) -> DataFrame:
    """cell, kind, word, n for every visit of every word. In cells that are ``large`` a word goes
    to the part of its front half and to that of its back half."""

    def run(batches):
        for batch in batches:
            rows = []
            for word, n, letters, counts in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "letters", "counts"))):
                for kind, length, first in visits([counts[g] for g in groups], letters, depth):
                    cell = _cell(length, first)
                    if cell in large:
                        half = (length - 1) // 2
                        rows.append((f"{cell}<{word[:half]}", kind, word, n))
                        rows.append((f"{cell}>{word[-half:]}", kind, word, n))
                    else:
                        rows.append((cell, kind, word, n))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)

    names = ("cell", "kind", "word", "n")
    schema = pa.schema([("cell", pa.string()), ("kind", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    return words.mapInArrow(run, "cell string, kind int, word string, n long")


def near_words(words: DataFrame, cell_words: int) -> DataFrame:
    """word, near, near_n: words (word, n) that are one edit apart, both ways round."""
    rows = _stored(with_vectors(words), "vectors")
    totals = rows.agg(F.count("*"), *(F.sum(F.col("counts")[g]) for g in range(GROUPS))).first()
    if not totals[0]:
        return rows.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    groups = sorted(range(GROUPS), key=lambda g: (-totals[g + 1], g))  # those that tell most apart first
    bound = min(cell_words, max(256, totals[0] // shuffle_partitions(words.sparkSession)))
    ordered = rows.select("letters", F.array(*(F.col("counts")[g] for g in groups)).alias("counts"))
    for depth in range(2, GROUPS + 1):
        cells = ordered.groupBy("letters", F.slice("counts", 1, depth).alias("first")).count()
        if cells.agg(F.max("count")).first()[0] <= bound:
            break
    large = cells.where(F.col("count") > max(bound, cell_words)).collect()  # total words / cell_words at most
    large = frozenset(_cell(r["letters"], r["first"]) for r in large)

    def search(table: pa.Table) -> pa.Table:
        kinds, own, often = (table.column(c).to_pylist() for c in ("kind", "word", "n"))
        counts = vectors(own)[:, groups[depth:]].tolist()
        members = [i for i, kind in enumerate(kinds) if kind == MEMBER]
        found = []
        if members:
            top = trie(members, counts, 0)
            for i, kind in enumerate(kinds):
                for j in reached(top, counts[i], 0, *BUDGETS[kind]):
                    if (kind != MEMBER or own[i] < own[j]) and near(own[i], own[j]):
                        found.append((own[i], own[j], often[j]))
                        found.append((own[j], own[i], often[i]))
        columns = list(map(list, zip(*found))) or [[], [], []]
        return pa.table(dict(zip(("word", "near", "near_n"), columns)), schema)

    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    visited = dealt(rows, groups, depth, large)
    pairs = visited.groupBy("cell").applyInArrow(search, "word string, near string, near_n long")
    return pairs.distinct() if large else pairs


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): where forms lead to in the end. Each round doubles the
    steps taken, and a step makes a word five times as frequent, so rounds are few."""
    found = _stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        found = _stored(found.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), "beyond"), "roots")
        if found.where("beyond is not null").isEmpty():
            return found.drop("beyond")
        found = found.drop("beyond")


def spelling_variants(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cell_words: int = CELL_WORDS
) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word.

    Runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) are lower-cased in A-Z; where 199 divides
    h, the crc32 of ``<id>:<run>``, the run loses the letter at h % length. Words are the
    distinct results with 6 letters and 5 occurrences at least. Words are near if one
    inserted, deleted or replaced letter apart. ``form`` is the most frequent near word (of
    equals the smallest) if it is 5 times as frequent as the word at least, else null; ``root``
    is where forms lead to, the word itself without one.

    A null text has no words; the runs of a row with a null id are left whole. Repeated rows
    count as often as they stand there. Texts are read whole. Other columns are not read; an
    empty table has no words.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    words = _stored(count_words(texts), "words")
    pairs = near_words(words, cell_words)
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    joined = words.join(best, "word", "left")
    often = -F.col("best.less")
    is_form = often >= RATIO * F.col("n")
    named = _stored(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, often).alias("form_n"),
        ),
        "named",
    )
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
