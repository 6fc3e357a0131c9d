"""Prefix trie of conversations, summed over subtrees by the Euler-tour technique.

A conversation is the sequence of its turns (role, text). Conversations that start alike share
nodes of a trie, so a store that keeps each prefix once saves what the others would repeat.

1. Turns become digests and are sorted by conversation over range partitions. Two 64-bit sums
   of digests mixed with their depth name the prefix that ends at a turn. A conversation may lie
   over many partitions: what a partition inherits is one row a partition.
2. Equal prefixes are one node, named by its smallest conversation and its depth.
3. Every node has an enter and an exit arc. The arc after an enter arc is that of the first
   child, or else the own exit; after an exit comes the next sibling's enter, or else the
   parent's exit. This tour is a linked list over all arcs.
4. The list is ranked in the partitions where arcs lie: runs of arcs within a partition become
   one chain each. While more than ``base`` chains remain, chains are spliced out by coin
   tossing (a chain joins its predecessor if the coins say so, a quarter of them a round). The
   rest is ranked at once, and every arc adds its place in its chain.
5. The ranks carry sums of leaves and of savings, so what lies below a node is the difference
   of the prefix sums at its two arcs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import WORD, text_or_empty
from shelfspark.operators.scan import _ranged
from shelfspark.storage import cut_lineage, fresh_path

#: Chains that one task ranks at most; more are spliced first.
BASE = 500_000
#: Characters of joined ids that one row holds on the way to their digest, about.
CHUNK = 1 << 16
ENTER, EXIT = 0, 1


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words and a number of each row that has a conversation.

    Null roles and texts are empty. Rows of one turn number are ordered by their digests, so
    that rows which tie give one order."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return rows.withColumn("seq", F.monotonically_increasing_id())


def borrowed(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its block of ids."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame, block: int = 20, most: int = 3) -> DataFrame:
    """The turns of rebuilt conversations, ordered by (conv_id, own, turn, digest, seq).

    Conversation c gets the first h turns of conversation c - c % block, all if it has fewer
    and none if there is none, then its own turns after its first h; h is ``borrowed``, at most
    ``most``. A conversation without turns has no row here."""
    order = [F.col("turn").asc_nulls_first(), "digest", "seq"]
    # Only the first rows of a conversation reach the shuffle (a limit in each group).
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    heads = _stored(turns.withColumn("at", at).where(F.col("at") <= most), "heads")
    convs = turns.select("conv_id").distinct()
    convs = convs.select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % block).alias("first"),
        borrowed(F.col("conv_id")).alias("h"),
    )
    gone = heads.select("conv_id", "seq", "at").where(F.col("at") <= borrowed(F.col("conv_id")))
    own = turns.join(gone.drop("at"), ["conv_id", "seq"], "left_anti").withColumn("own", F.lit(1))
    taken = heads.select(F.col("conv_id").alias("first"), F.col("at"), "turn", "digest", "words", "seq")
    taken = convs.join(taken, "first").where("at <= h").withColumn("own", F.lit(0))
    columns = ["conv_id", "own", "turn", "digest", "seq", "words"]
    return own.select(*columns).unionByName(taken.select(*columns))


def _mixed(digests: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """64 bits that hang on a digest and its depth."""
    x = digests + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _halves(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = bytes.fromhex("".join(column.to_pylist()))
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def _prefixes(batches, depths: dict, sums: dict):
    """Depth and prefix sums of sorted rows; ``depths`` and ``sums`` hold what each partition
    inherits for its first conversation."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        if last is None:
            part = batch.column("_part")[0].as_py()
            last, depth, total = conv[0], depths.get(part, 0), np.array(sums.get(part, (0, 0)), np.uint64)
        starts = np.concatenate([[True], conv[1:] != conv[:-1]])
        group = np.cumsum(starts) - 1
        first = np.flatnonzero(starts)
        goes_on = conv[0] == last
        at = np.arange(len(conv)) - first[group] + 1
        at += np.where(group == 0, depth if goes_on else 0, 0)
        own = np.stack([_mixed(half, at) for half in _halves(batch.column("digest")).T], 1)
        summed = np.cumsum(own, 0, dtype=np.uint64)
        before = summed[first] - own[first]
        if goes_on:
            before[0] -= total
        key = summed - before[group]
        last, depth, total = conv[-1], int(at[-1]), key[-1]
        yield batch, at, key, key - own


def _inherited(marks: list, add) -> dict:
    """What partitions inherit: ``marks`` has (partition, first, last conversation, amount of the
    last) in order; a conversation that fills a partition adds to what that one inherits."""
    found, running, open_conv = {}, None, None
    for part, first, last, amount in sorted(marks):
        if first == open_conv:
            found[part] = running
        running = add(running, amount) if first == last == open_conv else amount
        open_conv = last
    return found


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, words, the prefix that ends at each turn (k1, k2) and its parent (p1, p2)."""
    order = ["conv_id", "own", F.col("turn").asc_nulls_first(), "digest", "seq"]
    ranged = _ranged(rows, order)
    counts = ranged.groupBy("_part", "conv_id").agg(F.count("*").alias("n"))
    ends = counts.groupBy("_part").agg(F.min("conv_id"), F.max("conv_id"), F.max_by("n", "conv_id")).collect()
    depths = _inherited([tuple(r) for r in ends], lambda a, b: a + b)  # a row per partition

    def last_sums(batches):
        k = None
        for batch, _, key, _ in _prefixes(batches, depths, {}):
            part, k = batch.column("_part")[0].as_py(), key[-1].view(np.int64).tolist()
        if k:
            yield pa.RecordBatch.from_pydict({"part": [part], "k1": [k[0]], "k2": [k[1]]})

    wrap = (1 << 64) - 1
    add = lambda a, b: tuple((x + y) & wrap for x, y in zip(a, b))
    tails = {r["part"]: (r["k1"] & wrap, r["k2"] & wrap) for r in ranged.mapInArrow(last_sums, "part long, k1 long, k2 long").collect()}
    sums = _inherited([(r[0], r[1], r[2], tails[r[0]]) for r in ends], add)

    def run(batches):
        for batch, at, key, above in _prefixes(batches, depths, sums):
            signed = [*key.view(np.int64).T, *above.view(np.int64).T]
            yield pa.RecordBatch.from_pydict(
                {"conv_id": batch.column("conv_id"), "depth": at, "words": batch.column("words")}
                | {name: np.ascontiguousarray(x) for name, x in zip(("k1", "k2", "p1", "p2"), signed)}
            )

    return ranged.mapInArrow(run, "conv_id long, depth long, words long, k1 long, k2 long, p1 long, p2 long")


def _ids_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256: SHA-256 of the ids that end there, ascending, joined by
    commas. Sorted runs of ids are joined first, so the task that digests a node reads a row for
    many ids, one after the other."""
    node = ["depth", "k1", "k2"]

    def chunks(batches):
        open_node, ids, size, first = None, [], 0, None
        out = []

        def done():
            if ids:
                out.append((*open_node, first, ",".join(ids)))

        for batch in batches:
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*node, "conv_id"))):
                if key != open_node or size > CHUNK:
                    done()
                    open_node, ids, size, first = key, [], 0, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield pa.RecordBatch.from_pylist([dict(zip((*node, "first", "ids"), x)) for x in out], kind)
            out.clear()
        done()
        yield pa.RecordBatch.from_pylist([dict(zip((*node, "first", "ids"), x)) for x in out], kind)

    kind = pa.schema([(c, pa.int64()) for c in (*node, "first")] + [("ids", pa.string())])

    def digests(batches):
        open_node, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*node, "ids"))):
                if key != open_node:
                    if open_node:
                        out.append((*open_node, state.hexdigest()))
                    open_node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*node, "ends_sha256"), x)) for x in out], hashes)
        if open_node:
            yield pa.RecordBatch.from_pylist([dict(zip((*node, "ends_sha256"), (*open_node, state.hexdigest())))], hashes)

    hashes = pa.schema([(c, pa.int64()) for c in node] + [("ends_sha256", pa.string())])
    sorted_ends = ends.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    runs = sorted_ends.select(*node, "conv_id").mapInArrow(chunks, "depth long, k1 long, k2 long, first long, ids string")
    runs = runs.repartition(*node).sortWithinPartitions(*node, "first")
    return runs.select(*node, "ids").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def trie_nodes(turns: DataFrame) -> DataFrame:
    """A row per node: conv_id and depth, which name it, parent_conv_id, n_convs, n_children, the
    first child's conv_id, own savings, ends_sha256."""
    node = ["depth", "k1", "k2"]
    found = _stored(prefixes(rebuilt(turns)), "prefixes")
    convs = turns.agg(F.min("conv_id").alias("root"), F.countDistinct("conv_id").alias("n")).first()
    nodes = found.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("words").alias("words"),
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
    )
    ends = found.groupBy("conv_id").agg(F.max(F.struct(*node)).alias("end"))
    ends = turns.select("conv_id").distinct().join(ends, "conv_id", "left")
    ends = ends.select("conv_id", *(F.coalesce(f"end.{c}", F.lit(0)).alias(c) for c in node))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    root = turns.sparkSession.createDataFrame(
        [(0, 0, 0, convs["root"], convs["n"], 0, None, None)] if convs["n"] else [],
        "depth long, k1 long, k2 long, conv_id long, n_convs long, words long, p1 long, p2 long",
    )
    nodes = nodes.select(*root.columns).unionByName(root).join(_ids_digests(ends), node, "left")
    nodes = _stored(nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "nodes")

    # The root, which may have very many children, is known without a join.
    above = nodes.where("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    deep = nodes.where("depth > 1").join(above, ["depth", "p1", "p2"])
    top = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(convs["root"]).cast("long")))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved")
    named = [*("conv_id", "depth", "parent_conv_id", "n_convs"), saved, "ends_sha256"]
    nodes = _stored(deep.select(*named).unionByName(top.select(*named)), "named")
    below = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    below = below.agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    return nodes.join(below, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


class _Places:
    """Finds (conv, depth) among the nodes of a partition."""

    def __init__(self, conv: np.ndarray, depth: np.ndarray):
        self.convs, rank = np.unique(conv, return_inverse=True)
        self.span = int(depth.max()) + 2
        key = rank * self.span + depth
        self.order = np.argsort(key)
        self.keys = key[self.order]

    def __call__(self, conv: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Their places, -1 for those of other partitions."""
        rank = np.minimum(np.searchsorted(self.convs, conv), len(self.convs) - 1)
        key = rank * self.span + depth
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.convs[rank] == conv) & (depth >= 0) & (depth < self.span) & (self.keys[at] == key)
        return np.where(there, self.order[at], -1)


AMOUNTS = ("arcs", "leaves", "saved")


def _contracted(rows: dict, follower: tuple | None) -> dict:
    """Arcs of a partition's nodes as chains. ``rows``: columns sorted by (parent_conv_id, depth,
    conv_id); ``follower``: (parent_conv_id, depth, conv_id) of the first row that comes next.

    For both arcs of each node: the first arc of its chain and the amounts before it there; if
    it is that first arc, also the chain's amounts and the arc that follows the chain."""
    conv, depth, children, child = (rows[c] for c in ("conv_id", "depth", "n_children", "first_child"))
    n = len(conv)
    parent = np.where(depth > 0, rows["parent_conv_id"], -1)
    nodes, at = _Places(conv, depth), np.arange(n)
    # Names of the arcs that follow: conversation and 2 * depth + kind; -1 for the end of the tour.
    to_conv, to_code = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64)
    inner = children > 0
    to_conv[::2] = np.where(inner, child, conv)
    to_code[::2] = np.where(inner, 2 * (depth + 1) + ENTER, 2 * depth + EXIT)
    next_parent, next_depth, next_conv = (np.append(x[1:], 0) for x in (parent, depth, conv))
    if follower:
        next_parent[-1], next_depth[-1], next_conv[-1] = (-1 if follower[0] is None else follower[0]), follower[1], follower[2]
    sibling = (next_parent == parent) & (next_depth == depth) & (depth > 0)
    sibling[-1] &= follower is not None
    to_conv[1::2] = np.where(sibling, next_conv, parent)
    to_code[1::2] = np.where(sibling, 2 * depth + ENTER, 2 * (depth - 1) + EXIT)
    to_code[1::2][depth == 0] = -1
    place = nodes(to_conv, to_code >> 1)
    end = 2 * n
    follows = np.where((place >= 0) & (to_code >= 0), 2 * place + (to_code & 1), end)

    total = np.zeros((end + 1, len(AMOUNTS)), np.int64)
    total[:end, 0] = 1
    total[:end:2, 1] = ~inner
    total[:end:2, 2] = rows["own_saved"]
    jump, tail = np.append(follows, end), np.arange(end + 1)
    while (jump != end).any():
        total += np.where((jump != end)[:, None], total[jump], 0)
        tail = np.where(jump != end, tail[jump], tail)
        jump = jump[jump]
    is_head = np.ones(end + 1, bool)
    is_head[follows] = False
    is_head[end] = False
    heads = np.flatnonzero(is_head)
    head_of = np.empty(end + 1, np.int64)
    head_of[tail[heads]] = heads
    head = head_of[tail[:end]]
    before = total[head] - total[:end]
    code = np.empty(end, np.int64)
    code[::2], code[1::2] = 2 * depth + ENTER, 2 * depth + EXIT
    out = {c: rows[c] for c in ("conv_id", "depth")}
    for kind, side in ((ENTER, "enter"), (EXIT, "exit")):
        own = slice(kind, end, 2)
        last = tail[:end][own]
        out |= {f"{side}_conv": conv[head[own] // 2], f"{side}_code": code[head[own]], f"{side}_first": is_head[:end][own]}
        out |= {f"{side}_to_conv": to_conv[last], f"{side}_to_code": to_code[last]}
        out |= {f"{side}_{a}": before[own, i] for i, a in enumerate(AMOUNTS)}
        out |= {f"{side}_all_{a}": total[:end][own, i] for i, a in enumerate(AMOUNTS)}
    return out


def _spliced(chains: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """``chains`` with about a quarter of them joined to their predecessors, and those: named by
    conv and code, with their predecessor (by_conv, by_code) and the amounts before them there."""
    coin = lambda conv, code: F.pmod(F.xxhash64(conv, code, F.lit(turn)), F.lit(2))
    movers = chains.where(coin("conv", "code") == 0).select(
        F.col("conv").alias("to_conv"), F.col("code").alias("to_code"),
        F.col("to_conv").alias("on_conv"), F.col("to_code").alias("on_code"), *(F.col(a).alias(f"more_{a}") for a in AMOUNTS),
    )
    takers = chains.where((coin("conv", "code") == 1) & (F.col("to_code") >= 0))
    both = _stored(takers.join(movers, ["to_conv", "to_code"]), "spliced")
    gone = both.select(F.col("to_conv").alias("conv"), F.col("to_code").alias("code"), F.col("conv").alias("by_conv"), F.col("code").alias("by_code"), *AMOUNTS)
    longer = both.select("conv", "code", F.col("on_conv").alias("to_conv"), F.col("on_code").alias("to_code"), *((F.col(a) + F.col(f"more_{a}")).alias(a) for a in AMOUNTS))
    touched = both.select("conv", "code").unionByName(gone.select("conv", "code"))
    same = chains.join(touched, ["conv", "code"], "left_anti")
    return _stored(same.select(*longer.columns).unionByName(longer), "chains"), gone


def _ranked(batches):
    """Amounts before each chain, along the list; all chains in one call, a bounded number."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    names = list(zip(columns["conv"], columns["code"]))
    follows = dict(zip(names, zip(columns["to_conv"], columns["to_code"])))
    own = dict(zip(names, zip(*(columns[a] for a in AMOUNTS))))
    at = next(iter(set(names) - set(follows.values())))
    before, out = (0,) * len(AMOUNTS), []
    while at in own:
        out.append((*at, *before))
        before = tuple(x + y for x, y in zip(before, own[at]))
        at = follows[at]
    yield pa.RecordBatch.from_pydict(dict(zip(("conv", "code", *AMOUNTS), map(list, zip(*out)))))


def ranked_chains(chains: DataFrame, base: int = BASE) -> tuple[DataFrame, int]:
    """conv, code and the amounts of the whole list before each chain; and how many there are."""
    rows = first = chains.count()
    gone = []
    while rows > base:
        chains, out = _spliced(chains, len(gone))
        gone.append(out)
        rows = chains.count()
    amounts = ", ".join(f"{a} long" for a in AMOUNTS)
    found = chains.repartition(1).mapInArrow(_ranked, f"conv long, code long, {amounts}")
    for out in reversed(gone):
        by = found.select(F.col("conv").alias("by_conv"), F.col("code").alias("by_code"), *(F.col(a).alias(f"at_{a}") for a in AMOUNTS))
        back = out.join(by, ["by_conv", "by_code"]).select("conv", "code", *((F.col(a) + F.col(f"at_{a}")).alias(a) for a in AMOUNTS))
        found = _stored(found.unionByName(back), "ranked")
    return found, first


def tour(nodes: DataFrame, base: int = BASE) -> DataFrame:
    """``nodes`` with enter_arcs and exit_arcs, the places of their arcs in the tour from 0, and
    n_leaves and saved_tokens of their subtrees."""
    placed = _ranged(nodes, [F.col("parent_conv_id").asc_nulls_first(), "depth", "conv_id"])
    place = F.struct("_pos", "parent_conv_id", "depth", "conv_id")
    firsts = placed.groupBy("_part").agg(F.min(place).alias("row")).orderBy("_part").collect()  # a row per partition
    parts = [r["_part"] for r in firsts]
    followers = {p: tuple(r["row"])[1:] for p, r in zip(parts, firsts[1:])}
    columns = ("conv_id", "depth", "parent_conv_id", "n_children", "first_child", "own_saved")

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            rows = {c: table.column(c).fill_null(-1).to_numpy() for c in columns}
            yield pa.RecordBatch.from_pydict(_contracted(rows, followers.get(table.column("_part")[0].as_py())))

    schema = "conv_id long, depth long"
    for side in ("enter", "exit"):
        schema += f", {side}_conv long, {side}_code long, {side}_first boolean, {side}_to_conv long, {side}_to_code long"
        schema += "".join(f", {side}_{a} long" for a in AMOUNTS) + "".join(f", {side}_all_{a} long" for a in AMOUNTS)
    arcs = _stored(placed.select(*columns, "_part").mapInArrow(run, schema), "arcs")

    def chains_of(side):
        names = {"conv": f"{side}_conv", "code": f"{side}_code", "to_conv": f"{side}_to_conv", "to_code": f"{side}_to_code"}
        names |= {a: f"{side}_all_{a}" for a in AMOUNTS}
        return arcs.where(f"{side}_first").select(*(F.col(of).alias(name) for name, of in names.items()))

    chains = _stored(chains_of("enter").unionByName(chains_of("exit")), "chains")
    found, rows = ranked_chains(chains, base)
    found = cut_lineage(found)
    for side in ("enter", "exit"):
        ahead = found.select(F.col("conv").alias(f"{side}_conv"), F.col("code").alias(f"{side}_code"), *(F.col(a).alias(f"{side}_at_{a}") for a in AMOUNTS))
        arcs = arcs.join(F.broadcast(ahead) if rows <= base else ahead, [f"{side}_conv", f"{side}_code"])
    at = lambda side, amount: F.col(f"{side}_{amount}") + F.col(f"{side}_at_{amount}")
    sums = arcs.select(
        "conv_id",
        "depth",
        at("enter", "arcs").alias("enter_arcs"),
        at("exit", "arcs").alias("exit_arcs"),
        (at("exit", "leaves") - at("enter", "leaves")).alias("n_leaves"),
        (at("exit", "saved") - at("enter", "saved")).alias("saved_tokens"),
    )
    return placed.drop("_part", "_pos").join(sums, ["conv_id", "depth"])


def prefix_trie(conversations: DataFrame, base: int = BASE) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text).

    Result, a row per distinct sequence of first turns, the root with none included: conv_id
    (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (words that members repeat, over the subtree), ends_sha256 (of the
    ids of members without further turns) and the places enter_arcs, exit_arcs in the tour.

    Turns are ordered by number, null first; of one number by content. Null or empty roles and
    texts are empty ones. Repeated rows are repeated turns. Rows with a null conv_id belong to no
    conversation and are left out. Texts of any length are read whole, as a digest and a word
    count. An empty table has no node. Other columns are not read.
    """
    turns = _stored(turns_of(conversations), "turns")
    return tour(trie_nodes(turns), base).drop("own_saved", "first_child")
