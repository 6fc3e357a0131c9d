"""Similarity join of word n-gram sets under the Jaccard distance, which is a metric.

Most documents share nothing: their distance to nearly every pivot is 1, where the triangle
inequality tells no two apart. So a pivot's region is first narrowed to the documents whose
distance to it can be below 1 at all, by a shingle they share: documents that link agree in at
least one of the first shingles of either, in an order common to all (rare ones first), so each
such shingle gathers a region. How many documents have a shingle is counted in full: blocks of
documents ask shards of hashes and are answered. A document with more shingles of its own than
it has first ones is in no region, which is so of all that are not mostly copied, and common
passages are first shingles only of documents that consist of them. In each region:

1. the document with the most regions is the pivot, so that neighbouring regions have few
   different ones. Each document is measured against its most usual pivot, and then against
   those of its regions that are not in its component yet; who links is in the pivot's cell;
2. the others are pending. A pair of documents can link only if their distances to the pivot
   differ by the threshold at most: this window tells which documents of the cell a pending
   one must be compared with, across the cell's border;
3. pending documents become pivots of the next level in the same way, over the documents of
   their windows, until none is left or all documents of the region are connected.

Comparisons within a component are never made, as they can add nothing to it; a group of near
copies costs about one comparison a document. Equal sets are one document from the start. A
pair that is due is measured on its texts only if the first shingles that both have in regions
are enough for a link: all shingles of one document up to the end of its first ones are known,
so the intersection has at most those in common and the rest of that document.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfspark.llm.arrow import Memo, held, hold_only, let_go, map_texts, slices, small_batches
from shelfspark.llm.common import shuffle_partitions, unused
from shelfspark.llm.lm_score import packed, unpacked
from shelfspark.storage import cut_lineage, fresh_path

WORDS, PERCENT = 5, 75
#: Words of a block and shingles of a shard, about; a longer text is a block of its own.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 20, 2 << 20
#: Pivots of a region grow by this factor from level to level.
MORE_PIVOTS = 16
#: Ids that may be sent to every task to pick texts; beyond, texts and ids are joined by shuffle.
BROADCAST_IDS = 500_000
#: Links that one task joins to components; more are contracted by joins.
LINKS_AT_ONCE = 500_000
REGION_BITS = 48
MEMO_WORDS = 100_000
#: Bytes that go to a Python worker at once, and of a text slice: batches of whole blocks or of
#: thousands of texts would stand in the JVM and in the worker at the same time.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
STEP = np.uint64(0x9E3779B97F4A7C15)


def _words() -> Memo:
    return held(__name__, "words", lambda: Memo(MEMO_WORDS))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; a shorter text is one shingle."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    known = _words()
    at = np.array([known.get(w) or known.keep(w, xxhash.xxh3_64_intdigest(w)) for w in found], np.uint64)
    return np.unique(_mixed(at, min(words, len(at))))


def linked(common: int, either: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * either


def _signed(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - REGION_BITS)).astype(np.int64)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession, BATCH_BYTES):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Block:
    """The shingles of some texts: ``hashes`` without repeats, sorted, and for each text those it
    has, as pairs of ``doc`` and ``id`` without repeats, sorted."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, names: np.ndarray, words: int):
        hashed, of = [], []
        starts = np.cumsum(lengths) - lengths
        short = (lengths > 0) & (lengths < words)
        at = names[tokens]
        if len(at) >= words:
            owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            inside = owner[: len(at) - words + 1] == owner[words - 1 :]
            hashed.append(_mixed(at, words)[inside])
            of.append(owner[: len(inside)][inside])
            del owner, inside
        for doc in np.flatnonzero(short).tolist():
            hashed.append(_mixed(at[starts[doc] : starts[doc] + lengths[doc]], int(lengths[doc])))
            of.append(np.array([doc], np.int32))
        del at
        every = np.concatenate([*hashed, np.zeros(0, np.uint64)])
        owners = np.concatenate([*of, np.zeros(0, np.int32)])
        del hashed, of
        self.hashes, ids = np.unique(every, return_inverse=True)
        del every
        both = ids | owners.astype(np.int64) << 32
        del ids, owners
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        self.doc, self.id = (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32)
        self.docs = len(lengths)
        #: Where each text's pairs begin, and the end.
        self.edges = np.searchsorted(self.doc, np.arange(self.docs + 1))

    def sizes(self) -> np.ndarray:
        return np.diff(self.edges)

    def shards(self, shards: int) -> np.ndarray:
        """Where the hashes of each shard begin: shards are ranges of hashes."""
        first = np.arange(shards + 1, dtype=object) * (1 << 64) // shards
        return np.append(np.searchsorted(self.hashes, np.array(first[:-1], np.uint64)), len(self.hashes))

    def digests(self) -> list[bytes | None]:
        own = self.hashes[self.id]
        return [blake2b(own[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(self.edges, self.edges[1:])]

    def regions(self, counts: np.ndarray, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The first shingles of each text, rare ones first by the ``counts`` of all texts, less
        those that no other text has; and at which place each stands, from 0."""
        often = counts[self.id]
        order = np.lexsort((self.id, often, self.doc))
        size = self.sizes()
        first = size - -(-size * percent // 100) + 1
        place = np.arange(len(order)) - np.repeat(self.edges[:-1], size)
        chosen = (place < np.repeat(first, size)) & (often[order] > 1)
        kept, place = order[chosen], place[chosen]
        edges = np.searchsorted(self.doc[kept], np.arange(self.docs + 1))
        named = _signed(self.hashes[self.id[kept]])
        spans = list(zip(edges, edges[1:]))
        return [named[a:b] for a, b in spans], [place[a:b] for a, b in spans]


def _mixed(at: np.ndarray, width: int) -> np.ndarray:
    n = len(at) - width + 1
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * STEP + at[i : i + n]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def blocks_of(texts: DataFrame, block_tokens: int) -> DataFrame:
    """Rows (doc_id, text) in blocks: block, doc_ids, n_tokens, and their words, packed."""
    schema = pa.schema(
        [("block", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(texts.schema["doc_id"].dataType)))]
        + [("n_tokens", pa.int64()), ("packed", pa.binary())]
    )

    def run(batches):
        hold_only(__name__)
        part, made = TaskContext.get().partitionId(), 0
        vocabulary, ids, lengths, pieces, size = defaultdict(count().__next__), [], [], [], 0

        def row():
            names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
            tokens = np.concatenate(pieces)
            blob = packed(tokens, np.array(lengths, np.uint32), names)
            one = {"block": (part << 32) | made, "doc_ids": ids, "n_tokens": len(tokens), "packed": blob}
            return pa.RecordBatch.from_pylist([one], schema)

        for batch in slices(batches, most=SLICE_BYTES):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
                if ids and size + len(found) > block_tokens:
                    yield row()
                    vocabulary, ids, lengths, pieces, size = defaultdict(count().__next__), [], [], [], 0
                    made += 1
                pieces.append(np.fromiter(map(vocabulary.__getitem__, found), np.uint32, len(found)))
                ids.append(doc)
                lengths.append(len(found))
                size += len(found)
        if ids:
            yield row()
        del vocabulary, pieces
        let_go()

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(run, f"block long, doc_ids array<{kind}>, n_tokens long, packed binary")


def _read(blob: bytes, words: int) -> Block:
    tokens, lengths, names = unpacked(blob)
    return Block(tokens, lengths.astype(np.int64), names, words)


def in_how_many(blocks: DataFrame, words: int, shards: int) -> DataFrame:
    """block, shard, blob: in how many texts the block's shingles of a shard are, in order.

    A shingle reaches its shard once for each block that has it, with the number of its texts."""

    def ask(batches):
        for batch in batches:
            for name, blob in zip(batch.column("block").to_pylist(), batch.column("packed")):
                block = _read(blob.as_py(), words)
                own = np.bincount(block.id, minlength=len(block.hashes)).astype(np.uint32)
                edges = block.shards(shards)
                out = [
                    {"shard": i, "block": name, "blob": packed(block.hashes[a:b], own[a:b])}
                    for i, (a, b) in enumerate(zip(edges, edges[1:]))
                    if b > a
                ]
                yield pa.RecordBatch.from_pylist(out, schema)
                del block, out
                let_go()

    def merge(table: pa.Table) -> pa.Table:
        asked = [unpacked(b) for b in table.column("blob").to_pylist()]
        _, place = np.unique(np.concatenate([a for a, _ in asked]), return_inverse=True)
        total = np.bincount(place, np.concatenate([n for _, n in asked])).astype(np.uint32)[place]
        edges = np.cumsum([0, *(len(a) for a, _ in asked)])
        blobs = [packed(total[a:b]) for a, b in zip(edges, edges[1:])]
        del asked, place, total
        let_go()
        return pa.table({"shard": table.column("shard"), "block": table.column("block"), "blob": blobs}, schema)

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
    kind = "shard int, block long, blob binary"
    return blocks.select("block", "packed").mapInArrow(ask, kind).groupBy("shard").applyInArrow(merge, kind)


def signatures(texts: DataFrame, words: int, percent: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and the regions of each row (doc_id, text) with the
    places of their shingles.

    How many texts have a shingle is counted in full, so a text of which more than its first
    shingles allow is its own has no region at all, and common passages come last."""
    spark = texts.sparkSession
    blocks = _stored(blocks_of(texts, block_tokens), "blocks")
    n = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-n // SHARD_TOKENS))
    given = in_how_many(blocks, words, shards)
    fields = [("doc_id", to_arrow_type(texts.schema["doc_id"].dataType)), ("n_shingles", pa.int64())]
    lists = [("regions", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))]
    schema = pa.schema([*fields, ("digest", pa.binary()), *lists])

    def sign(own: pa.Table, answers: pa.Table) -> pa.Table:
        by_shard = dict(zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist()))
        tables = []
        for ids, blob in zip(own.column("doc_ids").to_pylist(), own.column("packed")):
            block = _read(blob.as_py(), words)
            counts = [unpacked(by_shard[s])[0] for s in sorted(by_shard)]
            counts = np.concatenate([*counts, np.zeros(0, np.uint32)])
            columns = [ids, block.sizes(), block.digests(), *block.regions(counts, percent)]
            tables.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema))
            del block, counts, columns
        let_go()
        return pa.concat_tables(tables) if tables else schema.empty_table()

    kind = texts.schema["doc_id"].dataType.simpleString()
    both = blocks.select("block", "doc_ids", "packed").groupBy("block").cogroup(given.groupBy("block"))
    return both.applyInArrow(sign, f"doc_id {kind}, n_shingles long, digest binary, regions array<long>, places array<long>")


def needed(n_a, n_b, percent: int):
    """The least intersection of sets of these sizes that link."""
    return F.ceil((n_a + n_b) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-6))


def may_link(n_a, n_b, common, percent: int):
    """Whether sets of these sizes may link with at most ``common`` of their first shingles in
    common: the rest of the larger set is the most that can come to it."""
    less, more = F.least(n_a, n_b), F.greatest(n_a, n_b)
    beyond = F.ceil(more * percent / 100) - 1
    return (100 * less >= percent * more) & (common + beyond >= needed(n_a, n_b, percent))


def may_meet(n_a, place_a, n_b, place_b, percent: int):
    """Whether sets may link of which a region's shingle is the first that both have: what they
    have in common stands at its places or behind. Pairs that link pass in the region of
    their first common shingle, if not in others."""
    return F.least(n_a - place_a, n_b - place_b) >= needed(n_a, n_b, percent)


def promising(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link by their sizes and the regions both are in; ``shared`` has x,
    the number n of its shingles, and its regions with other documents."""
    side = lambda name: shared.select(
        F.col("x").alias(name), F.col("n").alias(f"n_{name}"), F.col("regions").alias(f"regions_{name}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("regions_a", "regions_b"))
    return both.where(may_link(F.col("n_a"), F.col("n_b"), common, percent)).select("a", "b")


def measure(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) with their distance and whether they link."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    ids = _stored(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    needed = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    needed = _stored(needed, "texts")
    with_a = pairs.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text")), "b")

    def of(batch):
        last, own = None, None
        distance, link = [], []
        for one, other in zip(batch.column("text").to_pylist(), batch.column("text_a").to_pylist()):
            if own is None or one != last:  # rows of a pivot lie together
                last, own = one, shingles(one, words)
            theirs = shingles(other, words)
            common = len(np.intersect1d(own, theirs, assume_unique=True))
            either = len(own) + len(theirs) - common
            distance.append(1 - common / either if either else 1.0)
            link.append(bool(either) and linked(common, either, percent))
        return {"a": batch.column("a"), "b": batch.column("b"), "distance": distance, "link": link}

    kind = pairs.schema["a"].dataType.simpleString()
    measured = map_texts(both.select("a", "b", "text_a", "text"), of, f"a {kind}, b {kind}, distance double, link boolean", most=SLICE_BYTES)
    return _stored(measured.groupBy("a", "b").agg(F.min("distance").alias("distance"), F.max("link").alias("link")), "pairs")


def components(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """node, component (its smallest node) of links (a, b).

    Up to ``at_once`` links, which are counted first, one task joins them; more are brought
    together by alternating star contraction, which gives the same."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = _stored(edges, "links")
    if edges.count() > at_once:
        return _contracted(edges)
    kind = edges.schema["a"].dataType

    def join(batches):
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
        nodes = [x for x in parent if root(x) != x]
        columns = {"node": pa.array(nodes, to_arrow_type(kind)), "component": pa.array([root(x) for x in nodes], to_arrow_type(kind))}
        yield pa.RecordBatch.from_pydict(columns)

    name = kind.simpleString()
    return _stored(edges.repartition(1).mapInArrow(join, f"node {name}, component {name}"), "components")


def _contracted(edges: DataFrame) -> DataFrame:
    """node, component of distinct edges (a, b) with a > b, by alternating star contraction."""

    def mark(edges):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()

    before = None
    while before != (now := mark(edges)):
        before = now
        both = edges.union(edges.select("b", "a"))
        least = cut_lineage(both.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, both["a"] == least["of"]).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct())
        least = cut_lineage(large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")))
        joined = large.join(least, large["a"] == least["of"])
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("of", "m"))
        edges = cut_lineage(small.distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def ngram_join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """doc_id, n_shingles and component_id of each row.

    A document's set holds the distinct runs of ``words`` words, lower-cased in A-Z; with fewer
    words the whole is one run; without words, or with a null text, it is empty and linked with
    nothing. Two documents link if their sets' intersection is at least ``percent`` percent of
    the union, as equal sets do. ``component_id`` is the smallest id that links lead to, the
    own one included. Rows that share an id are one document in this. A row with a null id
    takes the component of equal sets, else null. A row per input row, none for an empty table;
    other columns are not read. Texts are read whole; one of very many words makes a block by
    itself, in the memory of its task.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    signed = _stored(signatures(texts, words, percent, block_tokens), "signatures")  # read several times
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    classes = _stored(classes, "classes")
    firsts = signed.where(F.size("regions") > 0).join(classes, "digest").where("doc_id = first")
    found = _connected(firsts, texts.where("doc_id is not null"), words, percent)

    own = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    joined = own.join(found, own["first"] == found["node"], "left")
    component = F.coalesce("component", "first", F.when(F.col("n_shingles") == 0, F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def _connected(firsts: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """node, component of the documents that have links."""
    places = firsts.select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), F.arrays_zip("regions", "places").alias("at"))
    placed = places.select("x", "n", F.explode("at").alias("at")).select("x", "n", F.col("at.regions").alias("region"), F.col("at.places").alias("place"))
    placed = _stored(placed, "places")
    # A region's pivot: of its documents the one with most regions, so that pivots are few.
    joint = placed.groupBy("x").agg(F.count("*").alias("joint"))
    ranked = placed.join(joint, "x")
    pivot = F.max(F.struct("joint", F.xxhash64("x").alias("draw"), "x", "n", "place")).alias("pivot")
    regions = ranked.groupBy("region").agg(F.count("*").alias("size"), pivot).where("size > 1")
    regions = _stored(regions.select("region", F.col("pivot.x").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.place").alias("pivot_place")), "regions")
    members = _stored(placed.join(regions, "region"), "members")

    # Regions of a document with others: their number is bounded by the length of its text.
    shared = members.groupBy("x").agg(F.max("n").alias("n"), F.collect_set("region").alias("regions"))
    shared = _stored(shared, "shared")

    def measured_pairs(pairs):
        """Distance and link of pairs, null and false where they cannot link."""
        hopeful = _stored(promising(pairs, shared, percent), "promising")
        return measure(hopeful, texts, words, percent)

    meets = may_meet(F.col("n"), F.col("place"), F.col("pivot_n"), F.col("pivot_place"), percent)
    due = members.where((F.col("x") != F.col("pivot")) & meets)
    # First each document with the pivot that most of its regions have, which settles most of a
    # group of near copies with a comparison a document.
    usual = due.groupBy("x", "pivot").agg(F.count("*").alias("often"))
    usual = usual.groupBy("x").agg(F.max_by("pivot", F.struct("often", F.col("pivot").cast("string"))).alias("pivot"))
    pairs = _stored(usual.select(F.greatest("x", "pivot").alias("a"), F.least("x", "pivot").alias("b")).distinct(), "level-pairs")
    measured = measured_pairs(pairs)
    links = measured.where("link").select("a", "b")
    known = components(links)

    # The first level: every region's pivot with the members that are not in its component yet.
    def named_by(rows, known, *names):
        for name in names:
            own = known.select(F.col("node").alias(name), F.col("component").alias(f"{name}_component"))
            rows = rows.join(own, name, "left").withColumn(f"{name}_component", F.coalesce(f"{name}_component", name))
        return rows

    apart = F.col("x_component") != F.col("pivot_component")
    open_pairs = named_by(due, known, "x", "pivot").where(apart)
    pairs = open_pairs.select(F.greatest("x", "pivot").alias("a"), F.least("x", "pivot").alias("b")).distinct()
    tried = _stored(pairs.join(measured.select("a", "b"), ["a", "b"], "left_anti"), "level-pairs")
    later = measured_pairs(tried)
    measured = _stored(measured.unionByName(later), "measured")
    links = later.where("link").select("a", "b")
    if not links.isEmpty():
        known = components(links.union(known.select("node", "component")))

    # Regions whose documents are not all of one component: those apart from the pivot are pending.
    state = _stored(named_by(members, known, "x", "pivot"), "state")
    open_regions = state.where(apart).select("region").distinct()
    distances = measured.select("a", "b", "distance")
    rest = state.withColumns({"a": F.greatest("x", "pivot"), "b": F.least("x", "pivot")}).join(open_regions, "region", "left_semi")
    rest = rest.join(distances, ["a", "b"], "left").join(shared.select("x", F.size("regions").alias("joint")), "x")
    own = F.when(F.col("x") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("distance"))
    pending = apart & (F.col("x") != F.col("pivot"))
    rest = _stored(rest.select("region", "x", "n", "place", "joint", own.alias("distance"), pending.alias("pending")), "rest")
    reach = F.lit((100 - percent) / 100 + 1e-9)

    pivots_each = 1
    while True:
        named = rest.join(known.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
        named = _stored(named, "named")
        waiting = F.col("pending")
        state = named.groupBy("region").agg(
            F.count(F.when(waiting, 1)).alias("n_pending"),
            F.min(F.when(waiting, F.col("x"))).alias("least"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        state = _stored(state.where("n_pending > 0 and low != high").drop("low", "high"), "state")
        if state.isEmpty():
            return known
        named = named.join(state, "region")
        share = F.pmod(F.xxhash64("x", F.lit(pivots_each)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        chosen = waiting & ((F.col("x") == F.col("least")) | (share * F.col("n_pending") < pivots_each))
        named = _stored(named.select(*rest.columns, "component", chosen.alias("chosen")), "level")
        pivots = named.where("chosen").select("region", *(F.col(c).alias(f"q_{c}") for c in ("x", "n", "place", "joint", "distance", "component")))
        # Distances that were not measured tell nothing.
        window = F.coalesce(F.abs(F.col("distance") - F.col("q_distance")) <= reach, F.lit(True))
        near = window & may_link(F.col("n"), F.col("q_n"), F.least("joint", "q_joint"), percent)
        near &= may_meet(F.col("n"), F.col("place"), F.col("q_n"), F.col("q_place"), percent)
        pairs = named.join(pivots, "region").where((F.col("component") != F.col("q_component")) & near)
        pairs = pairs.select(F.greatest("x", "q_x").alias("a"), F.least("x", "q_x").alias("b")).distinct()
        pairs = _stored(pairs.join(measured.select("a", "b"), ["a", "b"], "left_anti"), "level-pairs")
        later = measured_pairs(pairs)
        links = later.where("link").select("a", "b")
        if not links.isEmpty():  # components so far stand for all earlier links
            known = components(links.union(known.select("node", "component")))
        measured = _stored(measured.unionByName(later), "measured")
        rest = named.where("not chosen").select(*rest.columns)
        pivots_each *= MORE_PIVOTS


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` but those linked, directly or not, with a smaller id; with all
    their columns. Rows without words and with a null id stay."""
    found = ngram_join(docs, id_column, text_column, words, percent)
    (copy,) = unused(docs, "copy")
    copies = found.where("doc_id != component_id").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(copies, F.col(id_column) == F.col(copy), "left_anti")
