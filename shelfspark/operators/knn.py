"""Exact inner-product top-k of many queries against many vectors.

All plans multiply blocks in numpy and keep at most k hits per query and task in a matrix of
heaps, so scored pairs never become rows:

* ``scan``: the queries fit a byte bound that is checked before they are shipped; every
  vector partition is read once, where it lies, without a shuffle.
* ``tile``: any number of queries. Both sides of a user are cut into tiles by hash, and each
  pair of tiles is a cell, whose queries are held while its vectors pass by. There are only as
  many tiles as the cores and the memory for queries need, as every tile of one side is copied
  for the tiles of the other. A user holding most of the vectors is many cells.
* ``search_blocks``: vectors that are kept in blocks with zone statistics, see ``pack_blocks``;
  blocks that cannot reach a query's k-th score are skipped without being read or scored.

Scores are rounded to ten decimals, far below the resolution of float32 vectors, so that
ranks do not depend on how a product was blocked; ties go by file and chunk number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.scan import running_sums
from shelfspark.storage import cut_lineage

SCORE_DECIMALS = 10
#: More than rounding can move a score; candidates are taken with this margin.
MARGIN = 1e-9
QUERY_BYTES = 64 << 20
#: Hits that a task of the scan may leave.
SCAN_HITS = 1_000_000
QUERY_TILE = 4096
VECTOR_TILE = 16384
#: Cells a core, and what a cell's queries with their hits may take; vectors of a cell; bytes of
#: a hit as shuffled.
CELLS, HELD_BYTES, CELL_ROWS, HIT_BYTES = 4, 64 << 20, 500_000, 20
#: Pairs of a cell: what a task takes a minute or so for, however large the tables are.
CELL_PAIRS = 10_000_000_000
#: With more hits a query than this cells are larger by as much, up to four times: every cell of a
#: query shuffles k hits, or copies of its vectors.
CELL_HITS, CELL_MOST = 25, 4
PLAN_ROWS = 500_000
BLOCK_ROWS, PIVOTS, PIVOT_SAMPLE = 4096, 16, 20_000
#: Users that reach the scan as literals.
LITERAL_KEYS = 1000
HIT_SCHEMA = "query_id string, user_id string, file_id string, chunk_idx int, ip double"

_HIT_ARROW = pa.schema(
    [
        ("query_id", pa.string()),
        ("user_id", pa.string()),
        ("file_id", pa.string()),
        ("chunk_idx", pa.int32()),
        ("ip", pa.float64()),
    ]
)

#: Hits as they travel between tasks: a row per query and cell, so that neither names of queries nor
#: a row's overhead come k times, and nothing but queries is sorted.
PACKED_SCHEMA = "query_id string, user_id string, file_ids array<string>, chunk_idxs array<int>, ips array<double>"
_PACKED_ARROW = pa.schema(
    [
        ("query_id", pa.string()),
        ("user_id", pa.string()),
        ("file_ids", pa.list_(pa.string())),
        ("chunk_idxs", pa.list_(pa.int32())),
        ("ips", pa.list_(pa.float64())),
    ]
)
PACKED_HITS = 1 << 16


def _matrix(column) -> np.ndarray:
    """Equal-length Arrow float lists as one float64 matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(values):
        return np.empty((0, 0))
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(np.float64)


def _error(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """What a product in single precision may be off, per query."""
    lengths = np.linalg.norm(queries, axis=1)
    longest = np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0))
    return (vectors.shape[1] + 4) * 2.0**-23 * lengths * longest + 1e-30


def _copies(vectors: np.ndarray, k: int, names: pa.Table) -> np.ndarray | None:
    """Rows without those of which more than k copies come first by name; none if all stay."""
    words = np.ascontiguousarray(vectors).view(np.uint32).astype(np.uint64)
    odd = np.arange(1, words.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    _, which, often = np.unique((words * odd).sum(1), return_inverse=True, return_counts=True)
    many = np.flatnonzero(often[which] > k)
    if not len(many):
        return None
    _, same = np.unique(vectors[many], axis=0, return_inverse=True)
    some = names.take(pa.array(many)).append_column("same", pa.array(same.ravel()))
    by = pa.compute.sort_indices(some, [(c, "ascending") for c in ("same", "file_id", "chunk_idx")]).to_numpy()
    group = same.ravel()[by]
    surplus = many[by[np.arange(len(group)) - np.searchsorted(group, group) >= k]]
    return np.delete(np.arange(len(vectors)), surplus)


class Best:
    """The k best hits of each query so far: scores in a matrix of queries by k, the k-th of a
    row being what a later vector must reach.

    Products are taken in single precision; those that may reach the k-th, by a bound on the
    error, are taken again in double.
    """

    ROWS = 256  # queries that are scored at once
    FIRST, BATCH = 1024, 8192  # vectors that are scored at once, before and after there is a k-th
    # The fewer at once, the more rows of a product have none that reaches the k-th; but the more
    # often hits are merged, which costs with k.
    LEAST, BATCH_HITS = 2048, 80

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.batch = min(self.BATCH, max(self.LEAST, self.BATCH_HITS * k))
        self.single = queries.astype(np.float32)
        self.scores = np.full((len(queries), k), -np.inf)
        self.keys = np.zeros((len(queries), k), np.int64)  # rows of ``named``
        self.named: list[pa.Table] = []
        self.size = 0
        self.fed: list[tuple[pa.Table, np.ndarray]] = []
        self.waiting = self.seen = 0

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def feed(self, names: pa.Table, vectors: np.ndarray) -> None:
        """``add`` for all queries, once enough vectors have come."""
        if not len(vectors):
            return
        self.fed.append((names, vectors))
        self.waiting += len(vectors)
        if self.waiting >= min(self.batch, max(self.FIRST, self.seen)):
            self._flush()

    def _flush(self) -> None:
        if self.fed:
            names = pa.concat_tables([n.select(["file_id", "chunk_idx"]) for n, _ in self.fed]).combine_chunks()
            vectors = np.concatenate([v for _, v in self.fed])
            self.fed, self.waiting = [], 0
            self.add(names, vectors)

    def add(self, names: pa.Table, vectors: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Scores ``vectors``, whose ``names`` are file_id and chunk_idx, for the queries asked."""
        start = 0
        while start < len(vectors):
            size = min(self.batch, max(self.FIRST, self.seen))
            self._add(names.slice(start, size), vectors[start : start + size], asked)
            start += size
            self.seen += size

    def _add(self, names: pa.Table, points: np.ndarray, asked: np.ndarray | None) -> None:
        if len(points) > self.k and (left := _copies(points, self.k, names)) is not None:
            names, points = names.take(pa.array(left)), points[left]
        at = np.arange(len(self.queries)) if asked is None else asked
        with np.errstate(over="ignore", invalid="ignore"):
            error = _error(self.queries[at], points)
        single = bool((error < 1e30).all())  # else too large for it, or not a number
        # A row per vector in memory, as a product of plain matrices is the fastest.
        columns = points.astype(np.float32) if single else points
        used, rows, found = [], [], []
        for first in range(0, len(at), self.ROWS):
            own = at[first : first + self.ROWS]
            scores = (self.single if single else self.queries)[own] @ columns.T
            off = error[first : first + self.ROWS] if single else np.zeros(len(own))
            floor = self.kth()[own] - MARGIN - off
            fresh = np.isneginf(floor)
            if fresh.any() and scores.shape[1] > self.k:
                kth = np.partition(scores[fresh], -self.k, axis=1)[:, -self.k].astype(float)
                floor[fresh] = kth - MARGIN - 2 * off[fresh]
            floor = np.nextafter(floor.astype(scores.dtype), scores.dtype.type(-np.inf))
            some = np.flatnonzero(~(scores.max(1) < floor))
            if not len(some):
                continue
            row, place = np.divmod(np.flatnonzero(scores[some] >= floor[some, None]), scores.shape[1])
            row = own[some[row]]
            # Few rows at a time, as each is a pair of vectors.
            for begin in range(0, len(row), 1 << 16):
                q, v = row[begin : begin + (1 << 16)], place[begin : begin + (1 << 16)]
                exact = np.round(np.einsum("ij,ij->i", self.queries[q], points[v]), SCORE_DECIMALS)
                kept = exact >= self.kth()[q]
                used.append(v[kept])
                rows.append(q[kept])
                found.append(exact[kept])
        if not sum(map(len, rows)):
            return
        some, which = np.unique(np.concatenate(used), return_inverse=True)
        self._merge(names.take(pa.array(some)), np.concatenate(rows), np.concatenate(found), which)

    def _merge(self, names: pa.Table, query, found, which) -> None:
        """Takes hits in; of equal scores the first by name."""
        self.named.append(names.select(["file_id", "chunk_idx"]))
        touched = np.unique(query)
        old, key = self.scores[touched].ravel(), self.keys[touched].ravel()
        there = ~np.isneginf(old)
        query = np.concatenate([np.repeat(touched, self.k)[there], query])
        found = np.concatenate([old[there], found])
        keys = np.concatenate([key[there], which + self.size])
        self.size += names.num_rows
        by = np.lexsort((-found, query))
        query, found, keys = query[by], found[by], keys[by]
        equal = (query[1:] == query[:-1]) & (found[1:] == found[:-1])
        tied = np.flatnonzero(np.concatenate([equal, [False]]) | np.concatenate([[False], equal]))
        if len(tied):
            group = np.cumsum(np.concatenate([[True], ~equal]))[tied]
            held, place = np.unique(keys[tied], return_inverse=True)
            # Names are put in order once each, however many hits have them.
            own = self._all().take(pa.array(held))
            order = pa.compute.sort_indices(own, [("file_id", "ascending"), ("chunk_idx", "ascending")]).to_numpy()
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order))
            keys[tied] = keys[tied][np.lexsort((nth[place], group))]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.scores[query[kept], rank[kept]], self.keys[query[kept], rank[kept]] = found[kept], keys[kept]
        if self.size > 2 * self.scores.size + 100_000:  # let go of names no longer held
            there = ~np.isneginf(self.scores)
            held, place = np.unique(self.keys[there], return_inverse=True)
            self.named, self.size = [self._all().take(pa.array(held))], len(held)
            self.keys[there] = place

    def _all(self) -> pa.Table:
        if len(self.named) > 1:
            self.named = [pa.concat_tables(self.named).combine_chunks()]
        return self.named[0]

    def hits(self, query_ids: np.ndarray, user: str) -> pa.Table:
        self._flush()
        there = ~np.isneginf(self.scores)
        if not there.any():
            return _HIT_ARROW.empty_table()
        names = self._all().take(pa.array(self.keys[there]))
        n = names.num_rows
        ids = pa.array(query_ids[np.nonzero(there)[0]], pa.string())
        users = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([user])).cast(pa.string())
        columns = [ids, users, names.column("file_id").cast(pa.string()), names.column("chunk_idx"), pa.array(self.scores[there])]
        return pa.table(columns, schema=_HIT_ARROW)

    def packed(self, query_ids: np.ndarray, user: str) -> Iterator[pa.RecordBatch]:
        """The hits, a row per query that has any."""
        self._flush()
        step = max(1, PACKED_HITS // self.k)
        for first in range(0, len(self.scores), step):
            scores = self.scores[first : first + step]
            there = ~np.isneginf(scores)
            some = np.flatnonzero(there.any(1))
            if not len(some):
                continue
            names = self._all().take(pa.array(self.keys[first : first + step][there]))
            ends = pa.array(np.append(0, np.cumsum(there.sum(1)[some])), pa.int32())
            values = (names.column("file_id").cast(pa.string()), names.column("chunk_idx"), pa.chunked_array([pa.array(scores[there])]))
            lists = [pa.ListArray.from_arrays(ends, v.combine_chunks()) for v in values]
            ids, users = pa.array(query_ids[first + some], pa.string()), pa.repeat(user, len(some))
            yield pa.RecordBatch.from_arrays([ids, users, *lists], schema=_PACKED_ARROW)


def _objects(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _by_user(rows: list) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Query ids and points of each user."""
    by_user: dict[str, tuple[list, list]] = {}
    for row in rows:
        ids, points = by_user.setdefault(row["user_id"], ([], []))
        ids.append(row["query_id"])
        points.append(row["qvec"])
    return {u: (np.array(ids, dtype=object), np.array(points, np.float32)) for u, (ids, points) in by_user.items()}


def _of_users(vectors: DataFrame, users: list[str]) -> DataFrame:
    """Rows of the users; a few are literals, which the scan takes as a filter."""
    return vectors.where(F.col("user_id").isin(users)) if len(users) <= LITERAL_KEYS else vectors


def _names(table) -> pa.Table:
    return pa.table({"file_id": table.column("file_id"), "chunk_idx": table.column("chunk_idx")})


def _scan(rows: list, vectors: DataFrame, k: int) -> DataFrame:
    packed = _by_user(rows)
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def search(batches):
        best: dict[str, Best] = {}
        for batch in batches:
            users = batch.column("user_id").dictionary_encode()
            codes = users.indices.to_numpy(zero_copy_only=False)
            matrix = _matrix(batch.column("embedding"))
            names = _names(batch)
            for code, user in enumerate(users.dictionary.to_pylist()):
                if user not in shared.value:
                    continue
                if user not in best:
                    best[user] = Best(shared.value[user][1].astype(np.float64), k)
                mine = np.flatnonzero(codes == code)
                best[user].feed(names.take(pa.array(mine)), matrix[mine])
        for user, own in best.items():
            yield from own.hits(shared.value[user][0], user).to_batches(max_chunksize=65536)

    vectors = _of_users(vectors, sorted(packed))
    return vectors.select("user_id", "file_id", "chunk_idx", "embedding").mapInArrow(
        search, HIT_SCHEMA
    )


def _plan(queries: DataFrame, vectors: DataFrame, k: int, query_tile: int, vector_tile: int):
    """A row per user who asks, with its tiles of queries and vectors and the number of its
    first cell; and the number of partitions for the cells.

    A cell costs as many copies of its vectors as there are tiles of queries, and as many hits
    as there are tiles of vectors, so a user's cells, its share by pairs of ``CELLS`` a core or of
    as many as ``CELL_PAIRS`` needs, fewer where hits are many, are divided so that both together are least. Tiles get no
    smaller than asked.
    """
    some = queries.select(F.size("qvec").alias("n")).head()
    dim = max(1, some["n"] if some else 1)
    held = max(1, HELD_BYTES // (12 * dim + 16 * k))
    cells = CELLS * queries.sparkSession.sparkContext.defaultParallelism
    counted = cut_lineage(
        queries.groupBy("user_id").agg(F.count(F.lit(1)).alias("_q"))
        .join(vectors.groupBy("user_id").agg(F.count(F.lit(1)).alias("_v")), "user_id")
    )
    pairs = F.col("_q").cast("double") * F.col("_v")
    total = counted.agg(F.sum(pairs)).first()[0] or 1.0
    larger = min(CELL_MOST, max(1, k // CELL_HITS))
    cells = max(cells, int(-(-total // (CELL_PAIRS * larger))))
    share = F.ceil(pairs * cells / total)
    cheapest = F.sqrt(share * F.col("_q") * k * HIT_BYTES / (F.col("_v") * (4 * dim + 64)))
    q = F.least(F.ceil(F.col("_q") / query_tile), F.greatest(F.round(cheapest).cast("long"), F.ceil(F.col("_q") / held), F.lit(1)))
    v = F.least(F.ceil(F.col("_v") / vector_tile), F.greatest(F.ceil(share / F.col("_qn")), F.ceil(F.col("_v") / (CELL_ROWS * larger))))
    sized = counted.withColumn("_qn", q.cast("long")).withColumn("_vn", v.cast("long"))
    sized = sized.withColumn("_cells", F.col("_qn") * F.col("_vn"))
    plan = cut_lineage(running_sums(sized, ["user_id"], {"_end": "_cells"}))
    users, all_cells, rows = plan.agg(F.count(F.lit(1)), F.sum("_cells"), F.sum(F.col("_v") * F.col("_qn"))).first()
    parts = min(all_cells or 1, max(2 * cells, -(-(rows or 0) // (CELL_ROWS * larger))))
    plan = plan.select("user_id", "_qn", "_vn", (F.col("_end") - F.col("_cells")).alias("_first"))
    return F.broadcast(plan) if users <= PLAN_ROWS else plan, parts


def _tile(queries: DataFrame, vectors: DataFrame, k: int, query_tile: int, vector_tile: int, packed: bool = False):
    # Joined by broadcast up to a counted bound, so that vectors are shuffled once, by cell, and
    # never by user. A cell's queries are held, its vectors pass by.
    plan, parts = _plan(queries, vectors, k, query_tile, vector_tile)
    cell = (F.col("_first") + F.col("_q") * F.col("_vn") + F.col("_v")).alias("_cell")
    asked = (
        queries.select("query_id", "user_id", "qvec")
        .join(plan, "user_id")
        .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_qn")))
        .withColumn("_v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_vn") - 1)))
        .select(cell, F.lit(0).alias("_kind"), "user_id", F.col("query_id").alias("name"), F.lit(0).alias("chunk_idx"), F.col("qvec").alias("point"))
    )
    stored = (
        vectors.select("user_id", "file_id", "chunk_idx", "embedding")
        .join(plan, "user_id")
        .withColumn("_v", F.pmod(F.xxhash64("file_id", "chunk_idx"), F.col("_vn")))
        .withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_qn") - 1)))
        .select(cell, F.lit(1).alias("_kind"), "user_id", F.col("file_id").alias("name"), "chunk_idx", F.col("embedding").alias("point"))
    )

    def meet(batches):
        cell, user, held, best = None, None, [], None

        def hits():
            if best is not None:
                ids = np.concatenate([_objects(h.column("name")) for h in held])
                yield from best.packed(ids, user) if packed else best.hits(ids, user).to_batches(max_chunksize=65536)

        for batch in batches:
            cells, kinds = batch.column("_cell").to_numpy(), batch.column("_kind").to_numpy()
            code = 2 * cells + kinds
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if cells[a] != cell:
                    yield from hits()
                    cell, user, held, best = cells[a], batch.column("user_id")[a].as_py(), [], None
                part = batch.slice(a, b - a)
                if not kinds[a]:
                    held.append(part)
                elif held:
                    if best is None:
                        best = Best(np.concatenate([_matrix(h.column("point")) for h in held]), k)
                    names = pa.table({"file_id": part.column("name"), "chunk_idx": part.column("chunk_idx")})
                    best.feed(names, _matrix(part.column("point")))
        yield from hits()

    both = asked.unionByName(stored).repartitionById(parts, F.pmod("_cell", F.lit(parts)).cast("int"))
    return both.sortWithinPartitions("_cell", "_kind").mapInArrow(meet, PACKED_SCHEMA if packed else HIT_SCHEMA)


def inner_product(x, y):
    """Column form of one score, in double, for checks and single pairs."""
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.round(F.aggregate(products, F.lit(0.0), lambda total, p: total + p), SCORE_DECIMALS)


def right_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Vectors of the configured dimension; others do not belong to the current model."""
    return vectors.where(F.size(column) == dim)


def rank_hits(scored: DataFrame, k: int, merge: int = 0) -> DataFrame:
    """Best k per query as (query_id, user_id, file_id, chunk_idx, dist, rank).

    With ``merge`` the hits of many tasks are first cut to k in that many parts per query, so
    that no task gets k rows of every task for a query.
    """
    order = (F.desc("ip"), "file_id", "chunk_idx")
    best = Window.partitionBy("query_id").orderBy(*order)
    if merge > 1:
        part = F.pmod(F.xxhash64("file_id", "chunk_idx"), F.lit(merge)).cast("int")
        parts = Window.partitionBy("query_id", "_merge").orderBy(*order)
        cut = scored.withColumn("_merge", part).withColumn("_nth", F.row_number().over(parts))
        scored = cut.where(F.col("_nth") <= k).drop("_merge", "_nth")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(
            "query_id", "user_id", "file_id", "chunk_idx", (1 - F.col("ip")).alias("dist"), "rank"
        )
    )


def _small(queries: DataFrame, query_bytes: int, k: int = 0) -> list | None:
    """The queries, if packed they stay under ``query_bytes``; reads no further than that.

    With ``k`` they must stay so with their hits, as each task holds both, and the hits of a
    task be at most ``SCAN_HITS``.
    """
    asked = queries.select("query_id", "user_id", "qvec")
    first = asked.head()
    dim = max(1, len(first["qvec"]) if first else 1)
    if k:
        bound = max(1, min(query_bytes // (12 * dim + 16 * k + 64), SCAN_HITS // k))
    else:
        bound = max(1, query_bytes // (4 * dim + 64))
    rows = asked.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def score(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 100,
    plan: str = "auto",
    query_bytes: int = QUERY_BYTES,
    query_tile: int = QUERY_TILE,
    vector_tile: int = VECTOR_TILE,
    packed: bool = False,
) -> DataFrame:
    """Scored candidates that hold the top k of every query, at most k per block; those of the
    tile plan by ``PACKED_SCHEMA`` if ``packed``."""
    if plan not in ("auto", "scan", "tile"):
        raise ValueError(f"unknown plan {plan!r}")
    rows = None if plan == "tile" else _small(queries, query_bytes, k if plan == "auto" else 0)
    if rows is not None:
        return _scan(rows, vectors, k)
    if plan == "scan":
        raise ValueError("the queries exceed query_bytes; use the tile plan")
    return _tile(queries, vectors, k, query_tile, vector_tile, packed)


def _best_of(rows: pa.Table, group: np.ndarray, k: int) -> pa.RecordBatch:
    """The best k hits of each group of packed rows, in order and ranked; ties go by name."""
    sizes = pa.compute.list_value_length(rows.column("ips")).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    ips = rows.column("ips").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    files = rows.column("file_ids").combine_chunks().flatten()
    chunks = rows.column("chunk_idxs").combine_chunks().flatten()
    own = group[row]
    by = np.lexsort((-ips, own))
    ips, own = ips[by], own[by]
    equal = (own[1:] == own[:-1]) & (ips[1:] == ips[:-1])
    tied = np.flatnonzero(np.concatenate([equal, [False]]) | np.concatenate([[False], equal]))
    if len(tied):
        run = np.cumsum(np.concatenate([[True], ~equal]))[tied]
        at = pa.array(by[tied])
        some = pa.table({"run": run, "file_id": files.take(at), "chunk_idx": chunks.take(at)})
        order = pa.compute.sort_indices(some, [(c, "ascending") for c in ("run", "file_id", "chunk_idx")], null_placement="at_start")
        by[tied] = by[tied][order.to_numpy()]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    kept = rank < k
    by, rank, ips = by[kept], rank[kept], ips[kept]
    at = pa.array(row[by])
    names = [rows.column(c).combine_chunks().take(at) for c in ("query_id", "user_id")]
    values = [*names, files.take(pa.array(by)), chunks.take(pa.array(by)), pa.array(1 - ips), pa.array((rank + 1).astype(np.int32))]
    return pa.RecordBatch.from_arrays(values, ["query_id", "user_id", "file_id", "chunk_idx", "dist", "rank"])


def rank_packed(packed: DataFrame, k: int) -> DataFrame:
    """``rank_hits`` of packed rows: those of a query meet, and pass by."""

    def merge(batches):
        held: list[pa.RecordBatch] = []
        name = None

        def best():
            rows = pa.Table.from_batches(held)
            ids = rows.column("query_id").to_pylist()
            return _best_of(rows, np.cumsum([0, *(a != b for a, b in zip(ids[1:], ids))]), k)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("query_id").to_pylist()
            last = len(ids) - 1  # where the query begins that later batches may go on with
            while last and ids[last - 1] == ids[-1]:
                last -= 1
            if held and (last or ids[0] != name):
                if last:
                    held.append(batch.slice(0, last))
                yield best()
                held = []
            elif last:
                held = [batch.slice(0, last)]
                yield best()
                held = []
            held.append(batch.slice(last))
            name = ids[-1]
        if held:
            yield best()

    sorted_ = packed.repartition("query_id").sortWithinPartitions("query_id")
    return sorted_.mapInArrow(merge, "query_id string, user_id string, file_id string, chunk_idx int, dist double, rank int")


def knn(
    queries: DataFrame, vectors: DataFrame, k: int = 100, merge: int = 0, **options
) -> DataFrame:
    """Top-k hits of every query among all vectors of the same user.

    Hits of the tile plan are packed on their way; ``merge`` is for those of the scan."""
    found = score(queries, vectors, k, packed=True, **options)
    return rank_packed(found, k) if "ips" in found.columns else rank_hits(found, k, merge)


def knn_within_kbs(queries: DataFrame, vectors: DataFrame, k: int = 100, **options) -> DataFrame:
    """Top-k of every query among the vectors of the bases it names in ``kb_ids``.

    Each (query, base) pair is searched as a unit of its own, then the best k are kept. The
    users and bases asked for reach the scan as filters when they are few.
    """
    pairs = queries.select(
        F.explode(F.array_distinct("kb_ids")).alias("_kb"), "query_id", "user_id", "qvec"
    )
    units = pairs.select(
        F.to_json(F.struct("query_id", "_kb")).alias("query_id"),
        F.concat_ws("\u0001", "user_id", "_kb").alias("user_id"),
        "qvec",
    )
    asked = pairs.select("user_id", F.col("_kb").alias("kb_id")).distinct()
    few = asked.limit(LITERAL_KEYS + 1).collect()
    if len(few) <= LITERAL_KEYS:
        for key in ("user_id", "kb_id"):
            vectors = vectors.where(F.col(key).isin(sorted({r[key] for r in few})))
    base = F.concat_ws("\u0001", "user_id", "kb_id")
    bases = vectors.select(base.alias("user_id"), "file_id", "chunk_idx", "embedding")
    found = score(units, bases, k, **options).select(
        F.get_json_object("query_id", "$.query_id").alias("query_id"), "file_id", "chunk_idx", "ip"
    )
    return rank_hits(found.join(queries.select("query_id", "user_id"), "query_id"), k)


# --- vectors kept in blocks -------------------------------------------------------

ZONES = "max_norm double, low array<double>, high array<double>, rest array<double>"
BLOCK_SCHEMA = (
    "user_id string, block string, n int, file_ids array<string>, chunk_idxs array<int>, vectors binary, " + ZONES
)


def choose_pivots(vectors: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """``n`` directions that lie far apart, of about ``sample`` vectors at most."""
    rows = vectors.count()
    share = F.pmod(F.xxhash64("file_id", "chunk_idx"), F.lit(1 << 20)) < max(1, int((1 << 20) * sample / max(rows, 1)))
    some = (vectors if rows <= sample else vectors.where(share)).orderBy("file_id", "chunk_idx")
    points = _matrix(some.select("embedding").toArrow().column("embedding"))
    norms = np.linalg.norm(points, axis=1) if len(points) else np.zeros(0)
    points = points[norms > 0] / norms[norms > 0][:, None] if len(points) else points
    chosen: list[np.ndarray] = []
    nearest = np.full(len(points), -np.inf)
    for _ in range(min(n, len(points))):
        at = int(np.argmin(nearest)) if chosen else 0
        if chosen and nearest[at] > 1 - MARGIN:
            break
        chosen.append(points[at])
        nearest = np.maximum(nearest, points @ points[at])
    return np.array(chosen)


def pack_blocks(vectors: DataFrame, pivots: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of a user's vectors that lie near one pivot and have like norms, with zone
    statistics: the largest norm, and per pivot the range of the projections on it and the
    largest length beside it. Rows are range-partitioned, so a hot user is many tasks.
    """

    def placed(batches):
        for batch in batches:
            points = _matrix(batch.column("embedding"))
            near = (points @ pivots.T).argmax(1) if len(pivots) and len(points) else np.zeros(len(points))
            columns = {f.name: batch.column(f.name) for f in batch.schema}
            yield pa.RecordBatch.from_pydict(
                columns | {"_cell": near.astype(np.int32), "_norm": np.linalg.norm(points, axis=1) if len(points) else np.zeros(0)}
            )

    def packed(batches):
        held: list[pa.RecordBatch] = []
        key, size, made = None, 0, 0

        def block():
            table = pa.Table.from_batches(held)
            points = _matrix(table.column("embedding"))
            norm = np.linalg.norm(points, axis=1)
            along = points @ pivots.T if len(pivots) else np.zeros((len(points), 0))
            beside = np.sqrt(np.maximum(norm[:, None] ** 2 - along**2, 0))
            name = f"{key[1]}-{table.column('_part')[0].as_py()}-{made}"
            row = {
                "user_id": key[0], "block": name, "n": len(points),
                "file_ids": table.column("file_id").to_pylist(), "chunk_idxs": table.column("chunk_idx").to_pylist(),
                "vectors": points.astype(np.float32).tobytes(), "max_norm": float(norm.max()),
                "low": along.min(0).tolist(), "high": along.max(0).tolist(), "rest": beside.max(0).tolist(),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            users, cells = batch.column("user_id").to_pylist(), batch.column("_cell").to_pylist()
            start = 0
            for at in range(batch.num_rows):
                own = (users[at], cells[at])
                if own != key or size == block_rows:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    if held:
                        yield block()
                        made += 1
                    held, key, size, start = [], own, 0, at
                size += 1
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if held:
            yield block()

    schema = pa.schema(
        [("user_id", pa.string()), ("block", pa.string()), ("n", pa.int32()), ("file_ids", pa.list_(pa.string()))]
        + [("chunk_idxs", pa.list_(pa.int32())), ("vectors", pa.binary()), ("max_norm", pa.float64())]
        + [(name, pa.list_(pa.float64())) for name in ("low", "high", "rest")]
    )
    rows = vectors.select("user_id", "file_id", "chunk_idx", "embedding")
    rows = rows.mapInArrow(placed, "user_id string, file_id string, chunk_idx int, embedding array<float>, _cell int, _norm double")
    order = ["user_id", "_cell", F.desc("_norm"), "file_id", "chunk_idx"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(packed, BLOCK_SCHEMA)


def upper_bounds(queries: np.ndarray, pivots: np.ndarray, zone: dict) -> np.ndarray:
    """What no vector of a block can score above, per query: by Cauchy and Schwarz, |q| |x|; and
    for every pivot p the product along p and that of what lies beside it."""
    norms = np.linalg.norm(queries, axis=1)
    bound = norms * zone["max_norm"]
    if len(pivots):
        along = queries @ pivots.T
        beside = np.sqrt(np.maximum(norms[:, None] ** 2 - along**2, 0))
        by_pivot = np.maximum(along * np.array(zone["low"]), along * np.array(zone["high"])) + beside * np.array(zone["rest"])
        bound = np.minimum(bound, by_pivot.min(1))
    return bound + MARGIN


def search_blocks(
    queries: DataFrame, blocks: DataFrame, pivots: np.ndarray, k: int = 100, skipped=None, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """Scored candidates that hold the top k of every query, from packed ``blocks``.

    First every query scores the block with its highest bound, which gives it a k-th score to
    start from. A pass over the zones alone finds the blocks that some query may need; if they
    are few, they reach the scan by name. Each task then scores a block only for queries whose
    k-th score so far it may reach. ``skipped``, an accumulator, counts pairs of a query and a
    block of its user that were not scored.
    """
    rows = _small(queries, query_bytes)
    if rows is None:
        raise ValueError("the queries exceed query_bytes; use the tile plan")
    packed = {u: (ids, points.astype(np.float64)) for u, (ids, points) in _by_user(rows).items()}
    context = blocks.sparkSession.sparkContext
    shared = context.broadcast(packed)
    blocks = _of_users(blocks, sorted(packed))
    zones = ("user_id", "block", "n", "max_norm", "low", "high", "rest")

    def opened(row):
        names = pa.table({"file_id": pa.array(row["file_ids"], pa.string()), "chunk_idx": pa.array(row["chunk_idxs"], pa.int32())})
        return names, np.frombuffer(row["vectors"], np.float32).reshape(row["n"], -1).astype(np.float64)

    def likely(batches):
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["user_id"] in shared.value:
                    points = shared.value[row["user_id"]][1]
                    top, block = best.setdefault(row["user_id"], (np.full(len(points), -np.inf), np.full(len(points), "", object)))
                    bound = upper_bounds(points, pivots, row)
                    block[bound > top] = row["block"]
                    np.maximum(top, bound, out=top)
        for user, (top, block) in best.items():
            out = {"user_id": [user] * len(top), "query": range(len(top)), "bound": top, "block": block.tolist()}
            yield pa.RecordBatch.from_pydict(out)

    tops = blocks.select(*zones).mapInArrow(likely, "user_id string, query long, bound double, block string")
    tops = tops.groupBy("user_id", "query").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    first: dict[tuple[str, str], list[int]] = {}
    for r in tops.collect():  # a row per query, of which there are few
        first.setdefault((r["user_id"], r["block"]), []).append(r["query"])
    homes = context.broadcast(first)

    def start(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = homes.value.get((row["user_id"], row["block"]))
                if own:
                    best = Best(shared.value[row["user_id"]][1], k)
                    best.add(*opened(row), asked=np.array(own))
                    yield pa.RecordBatch.from_pydict(
                        {"user_id": [row["user_id"]] * len(own), "query": own, "kth": best.kth()[own]}
                    )

    named = sorted({block for _, block in first})
    seeds = blocks.where(F.col("block").isin(named)) if len(named) <= LITERAL_KEYS else blocks
    floors = {u: np.full(len(points), -np.inf) for u, (_, points) in packed.items()}
    for r in seeds.mapInArrow(start, "user_id string, query long, kth double").collect():
        floors[r["user_id"]][r["query"]] = r["kth"]
    floors = context.broadcast(floors)

    def needed(batches):
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                if row["user_id"] in shared.value:
                    points = shared.value[row["user_id"]][1]
                    asked = upper_bounds(points, pivots, row) >= floors.value[row["user_id"]] - MARGIN
                    if asked.any():
                        names.append(row["block"])
                    elif skipped is not None:
                        skipped.add(len(asked))
            yield pa.RecordBatch.from_pydict({"block": pa.array(names, pa.string())})

    wanted = [r["block"] for r in blocks.select(*zones).mapInArrow(needed, "block string").limit(LITERAL_KEYS + 1).collect()]
    if len(wanted) <= LITERAL_KEYS:
        blocks = blocks.where(F.col("block").isin(wanted))
    counts_all = len(wanted) > LITERAL_KEYS  # then blocks that no query needs are met again

    def search(batches):
        best: dict[str, Best] = {}
        for batch in batches:
            heads = batch.select(list(zones)).to_pylist()
            for at, head in enumerate(heads):
                user = head["user_id"]
                if user not in shared.value:
                    continue
                points = shared.value[user][1]
                own = best.setdefault(user, Best(points, k))
                reach = np.maximum(own.kth(), floors.value[user])
                asked = np.flatnonzero(upper_bounds(points, pivots, head) >= reach - MARGIN)
                if skipped is not None and (len(asked) or not counts_all):
                    skipped.add(len(points) - len(asked))
                if len(asked):
                    own.add(*opened(batch.slice(at, 1).to_pylist()[0]), asked=asked)
        for user, own in best.items():
            yield from own.hits(shared.value[user][0], user).to_batches(max_chunksize=65536)

    return blocks.select(*zones, "file_ids", "chunk_idxs", "vectors").mapInArrow(search, HIT_SCHEMA)


def knn_blocks(queries: DataFrame, blocks: DataFrame, pivots: np.ndarray, k: int = 100, **options) -> DataFrame:
    """Top-k hits of every query among the blocks of the same user."""
    return rank_hits(search_blocks(queries, blocks, pivots, k, **options), k)


def within_distance(hits: DataFrame, max_distance: float = 1.1) -> DataFrame:
    """Hits at most ``max_distance`` away; a query with none keeps all its hits."""
    per_query = Window.partitionBy("query_id")
    near = F.col("dist") <= max_distance
    return (
        hits.withColumn("_any", F.max(near).over(per_query))
        .where(near | ~F.col("_any"))
        .drop("_any")
    )
