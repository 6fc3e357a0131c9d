"""Scores of texts under an n-gram model that is walked as a weighted backoff automaton.

The model is interpolated absolute discounting over words. Its n-grams of fewer than ``order``
words are the states of an automaton; an n-gram that was seen is an arc, weighted with its
smoothed log probability, from its context to the longest state that ends it. A state without an
arc for the next word fails to the state without its first word, at the log of the weight that
its context leaves to the lower order. A text is read once from left to right: the walk carries
its state and adds up the weights of arcs and failures.

The n-grams of a corpus fit no machine, so the automaton is built in parts:

1. A task encodes its texts in blocks of bounded size over the block's own words. Blocks are
   written once and read for the two steps that follow.
2. Each block asks for its distinct n-grams, with how often its training texts have them. Asked
   n-grams meet in shards by their contexts, where counts add up and contexts learn how many
   words follow them, and how many different ones. Contexts with very many n-grams are cut by
   the following word over all shards. Each shard answers every block.
3. A block builds the part of the automaton that its texts can reach, and walks them.

Words and contexts are named by 64-bit hashes, n-grams by their context and 32 further bits.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfspark.llm.arrow import hold_only, slices
from shelfspark.llm.common import shuffle_partitions
from shelfspark.storage import fresh_path

ORDER = 2
#: Tokens of a block and n-grams of a shard, about; a longer text is a block of its own.
BLOCK_TOKENS, SHARD_TOKENS = 2 << 20, 4 << 20
#: Contexts with so large a share of a block's tokens are named to those who plan the shards.
HEAVY = 1 / 16384
#: Tokens after which a walk is taken up by another one from the state it has reached.
STRETCH = 2048
HELD_OUT_OF, HELD_OUT = 7, 2
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Names of the start and the end of a text, which no word has: words hold no blanks.
START, END = (xxhash.xxh3_64_intdigest(name) for name in (b" start", b" end"))
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed piece, bytes of equal weight together."""
    parts = [np.array([len(arrays), *((len(a) << 4) | a.itemsize for a in arrays)], np.int64).tobytes()]
    parts += [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (n + 1), []
    for head in np.frombuffer(raw, np.int64, n, 8).tolist():
        rows, width = head >> 4, head & 15
        planes = np.frombuffer(raw, np.uint8, rows * width, at).reshape(width, rows)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}"))
        at += rows * width
    return out


class Block:
    """Texts of a block: ``tokens`` over its sorted ``words``, each text with its start and end."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, words: np.ndarray, order: int):
        self.words, self.lengths = words, lengths
        self.starts = np.cumsum(lengths) - lengths
        n = len(tokens)
        at = np.arange(n) - np.repeat(self.starts, lengths)  # 0 is the text's start
        #: ids[k]: of the n-gram of k words that ends at each token, -1 where there is none
        self.ids = [None, tokens.astype(np.int64)]
        #: contexts, following words and hashes of the n-grams of each order
        self.context, self.follower, self.hash = [None, None], [None, None], [None, words]
        for k in range(2, order + 1):
            there = np.flatnonzero(at >= k - 1)
            both = (self.ids[k - 1][there - 1] << 32) | self.ids[1][there]
            found, which = np.unique(both, return_inverse=True)
            context, follower = found >> 32, found & 0xFFFFFFFF
            hashes = _mixed(self.hash[k - 1][context] * STEP + words[follower])
            if k < order:  # contexts are in the order of their hashes
                sorted_ = np.argsort(hashes)
                place = np.empty(len(sorted_), np.int64)
                place[sorted_] = np.arange(len(sorted_))
                context, follower, hashes, which = context[sorted_], follower[sorted_], hashes[sorted_], place[which]
            ids = np.full(n, -1, np.int64)
            ids[there] = which
            self.ids.append(ids)
            self.context.append(context)
            self.follower.append(follower)
            self.hash.append(hashes)

    def heavy(self, order: int):
        """(k, hash, n) of the contexts of n-grams of k words that many tokens follow."""
        for k in range(2, order + 1):
            often = np.bincount(self.ids[k - 1][self.ids[k - 1] >= 0], minlength=len(self.hash[k - 1]))
            for i in np.flatnonzero(often > HEAVY * len(self.ids[1])).tolist():
                yield k, int(self.hash[k - 1][i].view(np.int64)), int(often[i])

    def asked(self, k: int, shards: int, hot: np.ndarray):
        """For each shard that is asked about n-grams of k words: (shard, their ids, contexts)."""
        if k == 1:
            shard = ((self.words >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            order = np.arange(len(shard))
        else:
            names = self.hash[k - 1]
            shard = (((names >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32))[self.context[k]]
            if len(hot):
                follower = self.words[self.follower[k]] & np.uint64(0xFFFFFFFF)
                cut = np.isin(names, hot)[self.context[k]]
                shard = np.where(cut, (follower * np.uint64(shards)) >> np.uint64(32), shard)
            by = np.lexsort((self.context[k], shard)) if k < len(self.hash) - 1 or len(hot) else np.argsort(shard, kind="stable")
            order, shard = by, shard[by]
        edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        for a, b in zip(edges, [*edges[1:], len(shard)]):
            ids = order[a:b]
            if k == 1:
                yield int(shard[a]), ids, ids[:0], ids[:0]
            else:
                own = self.context[k][ids]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                yield int(shard[a]), ids, own[first], np.diff(np.append(first, len(own)))


def blocks_of(docs: DataFrame, order: int, block_tokens: int) -> DataFrame:
    """Rows (doc_id, learn, text) in blocks: their ids, whether they train, lengths, tokens and
    words, and contexts that many n-grams may have."""

    def run(batches):
        hold_only(__name__)
        part = TaskContext.get().partitionId()
        made = 0

        def row(state):
            vocabulary, ids, learn, lengths, pieces = state
            names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
            names = np.concatenate([np.array([START, END], np.uint64), names])
            words, place = np.unique(names, return_inverse=True)
            tokens = place[np.concatenate(pieces)].astype(np.uint32)
            lengths = np.array(lengths, np.int64)
            heavy = Block(tokens, lengths, words, order - 1).heavy(order)
            return {
                "block": (part << 32) | made,
                "doc_ids": ids,
                "learn": learn,
                "n_tokens": len(tokens) - len(ids),
                "lengths": lengths.tolist(),
                "tokens": packed(tokens, words),
                "heavy": [{"k": k, "context": c, "n": n} for k, c, n in heavy],
            }

        def fresh():
            return defaultdict(count(2).__next__), [], [], [], []

        state, size = fresh(), 0
        for batch in slices(batches):
            schema = _block_schema(batch.schema.field("doc_id").type)
            for doc, learn, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "learn", "text"))):
                found = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
                if size and size + len(found) > block_tokens:
                    yield pa.RecordBatch.from_pylist([row(state)], schema)
                    state, size, made = fresh(), 0, made + 1
                vocabulary, ids, learns, lengths, pieces = state
                at = np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found))
                pieces.append(np.concatenate([[0], at, [1]]))
                ids.append(doc)
                learns.append(bool(learn))
                lengths.append(len(found) + 2)
                size += len(found) + 2
        if size:
            yield pa.RecordBatch.from_pylist([row(state)], schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"block long, doc_ids array<{kind}>, learn array<boolean>, n_tokens long, lengths array<long>, tokens binary,"
        " heavy array<struct<k: int, context: long, n: long>>",
    )


def _block_schema(kind: pa.DataType) -> pa.Schema:
    heavy = pa.struct([("k", pa.int32()), ("context", pa.int64()), ("n", pa.int64())])
    return pa.schema(
        [
            ("block", pa.int64()),
            ("doc_ids", pa.list_(kind)),
            ("learn", pa.list_(pa.bool_())),
            ("n_tokens", pa.int64()),
            ("lengths", pa.list_(pa.int64())),
            ("tokens", pa.binary()),
            ("heavy", pa.list_(heavy)),
        ]
    )


def _read(row: dict, order: int) -> Block:
    tokens, words = unpacked(row["tokens"])
    return Block(tokens, np.array(row["lengths"], np.int64), words, order)


def asks(blocks: DataFrame, order: int, shards: int, hot: dict[int, np.ndarray]) -> DataFrame:
    """k, shard, block, blob: what a block asks a shard about n-grams of k words."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _read(row, order)
                trains = np.repeat(np.array(row["learn"], bool), block.lengths)
                out = []
                for k in range(1, order + 1):
                    ids = block.ids[k]
                    counted = trains & (ids >= 0)
                    if k == 1:
                        counted[block.starts] = False  # a start is never read
                    own = np.bincount(ids[counted], minlength=len(block.hash[k])).astype(np.uint32)
                    for shard, asked, contexts, sizes in block.asked(k, shards, hot.get(k, np.zeros(0, np.uint64))):
                        if k == 1:
                            blob = packed(block.words[asked], own[asked])
                        else:
                            followers = block.words[block.follower[k][asked]].astype(np.uint32)
                            blob = packed(block.hash[k - 1][contexts], sizes.astype(np.uint32), followers, own[asked])
                        out.append({"k": k, "shard": shard, "block": row["block"], "blob": blob})
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("k", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
    return blocks.select("block", "learn", "lengths", "tokens").mapInArrow(run, "k int, shard int, block long, blob binary")


STATS = ("tokens", "kinds", "once", "twice")


def answers(asked: DataFrame, hot: dict[int, np.ndarray]) -> DataFrame:
    """k, block, shard, blob: counts of the n-grams that a block has asked a shard for, in order,
    then how many words follow each context and how many different ones. A row without a block
    has the shard's statistics, and what it knows of contexts that are cut over shards."""

    def merge(table: pa.Table) -> pa.Table:
        k, shard = table.column("k")[0].as_py(), table.column("shard")[0].as_py()
        blobs = [unpacked(b) for b in table.column("blob").to_pylist()]
        if k == 1:
            keys = np.concatenate([b[0] for b in blobs])
        else:
            contexts = np.concatenate([b[0] for b in blobs])
            sizes = np.concatenate([b[1] for b in blobs]).astype(np.int64)
            names, which = np.unique(contexts, return_inverse=True)
            keys = _mixed(np.repeat(contexts, sizes) * STEP + np.concatenate([b[2] for b in blobs]))
        own = np.concatenate([b[-1] for b in blobs])
        found, first, place = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(place, own, len(found)).astype(np.int64)
        given = total[place]
        stats = {"tokens": int(total.sum()), "kinds": int((total > 0).sum()), "once": int((total == 1).sum()), "twice": int((total == 2).sum())}
        cut: list[dict] = []
        if k > 1:
            of = np.repeat(which, sizes)[first]
            follow = np.bincount(of, total, len(names)).astype(np.int64)
            kinds = np.bincount(of[total > 0], minlength=len(names))
            for i in np.flatnonzero(np.isin(names, hot.get(k, np.zeros(0, np.uint64)))).tolist():
                cut.append({"context": int(names[i].view(np.int64)), "follow": int(follow[i]), "kinds": int(kinds[i])})
        out = {"k": [], "shard": [], "block": [], "blob": []}
        at = context_at = 0
        for block, b in zip(table.column("block").to_pylist(), blobs):
            parts = [given[at : at + len(b[-1])].astype(np.uint32)]
            at += len(b[-1])
            if k > 1:
                own_contexts = which[context_at : context_at + len(b[0])]
                context_at += len(b[0])
                parts += [follow[own_contexts].astype(np.uint64), kinds[own_contexts].astype(np.uint64)]
            for name, value in (("k", k), ("shard", shard), ("block", block), ("blob", packed(*parts))):
                out[name].append(value)
        for name, value in (("k", k), ("shard", shard), ("block", None), ("blob", None)):
            out[name].append(value)
        rows = len(out["k"]) - 1
        for name in STATS:
            out[name] = [None] * rows + [stats[name]]
        out["cut"] = [None] * rows + [cut]
        return pa.table(out, schema)

    cut_kind = pa.struct([("context", pa.int64()), ("follow", pa.int64()), ("kinds", pa.int64())])
    schema = pa.schema(
        [("k", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())]
        + [(name, pa.int64()) for name in STATS]
        + [("cut", pa.list_(cut_kind))]
    )
    return asked.groupBy("k", "shard").applyInArrow(
        merge,
        "k int, shard int, block long, blob binary, " + ", ".join(f"{s} long" for s in STATS)
        + ", cut array<struct<context: long, follow: long, kinds: long>>",
    )


class Automaton:
    """The part of the automaton that a block's texts can reach.

    States are the n-grams of fewer than ``order`` words that a word of the training texts
    follows, the root among them. ``arc[k]`` holds the weights of the arcs that read the last of
    k words from the state of those before (nan where there is none), ``fail[k]`` those of the
    failure arcs of states of k words, whose suffix states are ``suffix[k]``."""

    def __init__(self, block: Block, counts: list, follow: list, kinds: list, totals: dict):
        order = len(counts) - 1
        tokens, words = totals[1]["tokens"], totals[1]["kinds"]
        probability = (counts[1] + 1.0) / (tokens + words + 1.0)
        self.known = counts[1] > 0
        self.arc, self.fail, self.suffix, self.seen = [None, np.log10(probability)], [None], [None, None], [None, self.known]
        for k in range(2, order + 1):
            n1, n2 = totals[k]["once"], totals[k]["twice"]
            discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 and n2 else 0.5
            state = follow[k] > 0
            weight = np.where(state, discount * kinds[k] / np.maximum(follow[k], 1), 1.0)
            suffix = np.zeros(len(counts[k]), np.int64)
            there = block.ids[k] >= 0
            suffix[block.ids[k][there]] = block.ids[k - 1][there]
            context, seen = block.context[k], counts[k] > 0
            probability = np.where(
                seen,
                (counts[k] - discount) / np.maximum(follow[k][context], 1) + weight[context] * probability[suffix],
                np.nan,
            )
            self.arc.append(np.log10(probability))
            self.fail.append(np.log10(weight))
            self.suffix.append(suffix)
            self.seen.append(seen)
        self.order, self.block = order, block
        self.states = [None] + [follow[k] > 0 for k in range(2, order + 1)]

    def reached(self, at: np.ndarray) -> np.ndarray:
        """Words of the longest state that ends at tokens; 0 for the root."""
        words = np.zeros(len(at), np.int64)
        for k in range(1, self.order):
            ids = self.block.ids[k][at]
            words = np.where((ids >= 0) & self.states[k][ids], k, words)
        return words

    def walk(self, stretch: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the weights that texts meet, and of those at the root alone.

        All texts of the block are walked side by side, a token a step; long ones in stretches,
        each from the state that the one before ends in."""
        ids, lengths, starts = self.block.ids, self.block.lengths, self.block.starts
        pieces = -(-(lengths - 1) // stretch)
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = starts[text] + nth * stretch  # the token whose state a walk sets out from
        steps = np.minimum(stretch, lengths[text] - 1 - nth * stretch)
        by = np.argsort(-steps, kind="stable")
        text, first, steps = text[by], first[by], steps[by]
        total, base = np.zeros(len(text)), np.zeros(len(text))
        level = self.reached(first)  # the state: how many of the last words it holds
        active = len(text)
        for step in range(1, int(steps[0]) + 1 if len(steps) else 1):
            while active and steps[active - 1] < step:
                active -= 1
            at = first[:active] + step
            level = level[:active]
            weight = np.zeros(active)
            for k in range(self.order - 1, 0, -1):  # fail while the state has no arc for the token
                there = level == k
                arc = np.where(there, ids[k + 1][at], 0)
                fails = there & ~self.seen[k + 1][arc]
                weight += np.where(fails, self.fail[k][np.where(fails, ids[k][at - 1], 0)], 0.0)
                level = np.where(fails, k - 1, level)
            for k in range(self.order):  # read the token
                weight += np.where(level == k, self.arc[k + 1][np.where(level == k, ids[k + 1][at], 0)], 0.0)
            own = ids[1][at]
            base[:active] += self.arc[1][own]
            total[:active] += weight
            level = np.where((level == 0) & ~self.known[own], 0, np.minimum(level + 1, self.order - 1))
        n = len(lengths)
        return np.bincount(text, total, n), np.bincount(text, base, n)


def _scored(row: dict, given: dict, order: int, shards: int, hot: dict, totals: dict, cut: dict, stretch: int) -> dict:
    """The texts of a block, walked with what the shards have answered."""
    block = _read(row, order)
    counts, follow, kinds = [None], [None, None], [None, None]
    for k in range(1, order + 1):
        own = np.zeros(len(block.hash[k]), np.int64)
        if k > 1:
            n = len(block.hash[k - 1])
            follow.append(np.zeros(n, np.int64))
            kinds.append(np.zeros(n, np.int64))
        for shard, asked, contexts, _ in block.asked(k, shards, hot.get(k, np.zeros(0, np.uint64))):
            got = unpacked(given[k, shard])
            own[asked] = got[0]
            if k > 1:
                follow[k][contexts], kinds[k][contexts] = got[1], got[2]
        for name, (f, t) in cut.get(k, {}).items():  # contexts that no shard knows in full
            i = int(np.searchsorted(block.hash[k - 1], np.int64(name).view(np.uint64)))
            if i < len(block.hash[k - 1]) and int(block.hash[k - 1][i].view(np.int64)) == name:
                follow[k][i], kinds[k][i] = f, t
        counts.append(own)
    automaton = Automaton(block, counts, follow, kinds, totals)
    score, base = automaton.walk(stretch)
    known = automaton.known[block.ids[1]].astype(np.int64)
    known[block.starts] = 0
    return {
        "doc_id": row["doc_ids"],
        "n_tokens": block.lengths - 1,
        "n_known": np.add.reduceat(known, block.starts) if len(known) else known,
        "base_score": base,
        "score": score,
    }


def lm_score(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    order: int = ORDER,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    stretch: int = STRETCH,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Tokens are words, lower-cased in A-Z, and one end; a null text counts as empty and has the
    end alone. The model learns from rows whose crc32 of the id is not 2 modulo 7; a null id is
    not held out, but no text to learn from either. Repeated rows are learned from and scored as
    often as they stand there. ``n_known`` counts tokens that the training texts have, of which
    there are ``train_tokens``. ``base_score`` is the sum of log10 probabilities of single
    tokens, by adding one; ``score`` that of the model of ``order`` words (2 at least). Texts are
    read whole; one of very many words makes a block by itself, in the memory of its task. A row
    per input row, none for an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    rest = F.crc32(F.col(id_column).cast("string").cast("binary")) % HELD_OUT_OF
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(rest != HELD_OUT, F.lit(False)).alias("learn"),
        F.col(text_column).alias("text"),
    )
    path = fresh_path(spark, "lm-blocks")
    blocks_of(rows, order, block_tokens).write.option("compression", "none").parquet(path)
    blocks = spark.read.parquet(path)
    n = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-n // shard_tokens))
    heavy = blocks.select(F.explode("heavy").alias("h")).groupBy("h.k", "h.context").agg(F.sum("h.n").alias("n"))
    hot = defaultdict(list)
    for r in heavy.where(F.col("n") > n / (4 * shards)).collect():  # 4 * shards an order at most
        hot[r["k"]].append(r["context"])
    hot = {k: np.array(sorted(own), np.int64).view(np.uint64) for k, own in hot.items()}

    asked = asks(blocks, order, shards, hot)
    path = fresh_path(spark, "lm-answers")
    answers(asked, hot).write.option("compression", "none").parquet(path)
    given = spark.read.parquet(path)
    stats = given.where("block is null")
    sums = stats.groupBy("k").agg(*(F.sum(s).alias(s) for s in STATS)).collect()
    totals = {k: dict.fromkeys(STATS, 0) for k in range(1, order + 1)} | {r["k"]: r.asDict() for r in sums}
    cut = defaultdict(dict)
    parts = stats.select("k", F.explode("cut").alias("c")).groupBy("k", "c.context")
    for r in parts.agg(F.sum("c.follow").alias("follow"), F.sum("c.kinds").alias("kinds")).collect():
        cut[r["k"]][r["context"]] = (r["follow"], r["kinds"])
    cut = dict(cut)

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        parts = {(k, s): b for k, s, b in zip(*(own.column(c).to_pylist() for c in ("k", "shard", "blob")))}
        out = [_scored(row, parts, order, shards, hot, totals, cut, stretch) for row in texts.to_pylist()]
        tables = [pa.table({c: pa.array(x, schema.field(c).type) for c, x in o.items()}, schema) for o in out]
        return pa.concat_tables(tables) if tables else schema.empty_table()

    fields = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), *fields.items()])
    scored = (
        blocks.select("block", "doc_ids", "lengths", "tokens")
        .groupBy("block")
        .cogroup(given.where("block is not null").select("block", "k", "shard", "blob").groupBy("block"))
        .applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    )
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT
    return scored.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(totals[1]["tokens"]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
