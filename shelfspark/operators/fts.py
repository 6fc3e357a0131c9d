"""Token search over chunks: a stored positional index and searches that read part of it.

Chunks are numbered in ingest order (file, then chunk), and numbers fall into ranges of
``RANGE``. The index holds one row per token and range, with the chunks of the range that have
the token and where, so a frequent token is many rows, and lists that are met for a query are
never longer than a range. Rows are sorted by token within buckets, which are folders: a search
reads the buckets of the tokens asked for, and only the columns it needs. The vocabulary is kept
apart in sorted blocks for searches by the beginning of a token.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import tokens
from shelfspark.operators.scan import dense_ids, explode_rows
from shelfspark.storage import cut_lineage, spread

FIELDS = ("content", "file_id", "file_name", "chunk_id")
#: Chunks of a range, buckets of the index, terms of a block of the vocabulary.
RANGE, BUCKETS, BLOCK_TERMS = 4096, 64, 1024
#: Positions of a field start here times the field's number.
FIELD_SPAN = 1 << 40
#: Tokens that are sent along with the scan; more are joined by shuffle.
FEW_TOKENS = 100_000
#: Numbers of candidate chunks that are sent along with them.
FEW_CHUNKS = 2_000_000
#: Prefixes that reach the vocabulary's scan as ranges.
FEW_PREFIXES = 200
#: Prefixes that are sent to the blocks of the vocabulary at once.
MOST_PREFIXES = 100_000


def index(chunks: DataFrame) -> DataFrame:
    """Token arrays per chunk and field: (chunk_id, file_id, chunk_idx, <field>_tokens...)."""
    return spread(chunks, "chunk_id").select(
        "chunk_id",
        "file_id",
        "chunk_idx",
        *(tokens(F.col(name)).alias(f"{name}_tokens") for name in FIELDS),
    )


def postings(indexed: DataFrame) -> DataFrame:
    """Every occurrence: (token, field, pos, chunk_id)."""
    per_field = [
        explode_rows(
            indexed.select(
                "chunk_id", F.lit(name).alias("field"), F.col(f"{name}_tokens").alias("_tokens")
            ),
            "_tokens",
            "token",
            "pos",
        )
        for name in FIELDS
    ]
    whole = per_field[0]
    for part in per_field[1:]:
        whole = whole.unionByName(part)
    return whole.select("token", "field", "pos", "chunk_id")


def bucket(token):
    return F.pmod(F.crc32(token.cast("binary")), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class TokenIndex:
    """A stored index: ``postings``, ``terms`` and ``chunks`` under a folder.

    postings: bucket, token, range, docs (places in the range, ascending) and positions, a list
    per doc. terms: first, last and terms of a block of the sorted vocabulary. chunks: no,
    chunk_id, file_id, chunk_idx. ``gone`` has no, the chunks that a search must not find.
    """

    spark: SparkSession
    path: str
    gone: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def without_files(self, file_ids: DataFrame) -> TokenIndex:
        """The index once the files are gone; what is stored stays as it is."""
        gone = self.chunks.join(file_ids.select("file_id").distinct(), "file_id", "left_semi").select("no")
        gone = gone if self.gone is None else gone.union(self.gone).distinct()
        return replace(self, gone=cut_lineage(gone))


_POSTINGS = "bucket int, token string, range long, docs array<int>, positions array<array<long>>"


#: Tokens of a row that is grouped in a task, rows that are grouped there at once, and
#: occurrences that are merged at once.
RUN_TOKENS, RUN_ROWS, MERGE_AT = 512, 4000, 1 << 20
_RUNS = "token string, range long, docs array<int>, counts array<int>, at array<long>"
_RUNS_ARROW = pa.schema(
    [("token", pa.string()), ("range", pa.int64()), ("docs", pa.list_(pa.int32()))]
    + [("counts", pa.list_(pa.int32())), ("at", pa.list_(pa.int64()))]
)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places at which one of the columns changes, the first included."""
    changed = np.zeros(max(0, len(columns[0]) - 1), bool)
    for column in columns:
        changed |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def _lengths(lists) -> np.ndarray:
    return pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _list(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of all values, that begin at the starts."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _runs(batches):
    """Tokens (no, base, tokens) to a row per token and range of some texts: their places, how
    often each has the token and where."""
    for whole in batches:
        for first in range(0, whole.num_rows, RUN_ROWS):
            batch = whole.slice(first, RUN_ROWS)
            lists = batch.column("tokens")
            n = _lengths(lists)
            words = lists.flatten().dictionary_encode()
            code = words.indices.to_numpy()
            if not len(code):
                continue
            no = np.repeat(batch.column("no").to_numpy(), n)
            at = np.repeat(batch.column("base").to_numpy() - (np.cumsum(n) - n), n) + np.arange(len(code))
            order = np.lexsort((at, no, code))
            code, no, at = code[order], no[order], at[order]
            docs, keys = _starts(code, no), _starts(code, no // RANGE)
            of_key = np.searchsorted(docs, keys)
            yield pa.RecordBatch.from_arrays(
                [
                    words.dictionary.take(pa.array(code[keys])),
                    pa.array(no[keys] // RANGE),
                    _list(of_key, pa.array((no[docs] % RANGE).astype(np.int32))),
                    _list(of_key, pa.array(np.diff(np.append(docs, len(code))).astype(np.int32))),
                    _list(keys, pa.array(at)),
                ],
                schema=_RUNS_ARROW,
            )


def _key(table: pa.Table) -> np.ndarray:
    """Numbers of the tokens and ranges of sorted rows."""
    n = table.num_rows
    changed = np.zeros(n, bool)
    for name in ("bucket", "token", "range"):
        column = table.column(name).combine_chunks()
        changed[1:] |= pa.compute.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(changed)


def _merged(table: pa.Table, key: np.ndarray) -> pa.RecordBatch:
    """Sorted runs of whole tokens and ranges as a row for each."""
    lists = {c: table.column(c).combine_chunks() for c in ("docs", "counts", "at")}
    doc, counts, at = (lists[c].flatten().to_numpy() for c in ("docs", "counts", "at"))
    doc, of = np.repeat(doc, counts), np.repeat(key, _lengths(lists["at"]))
    order = np.lexsort((at, doc, of))
    doc, of, at = doc[order], of[order], at[order]
    docs, keys = _starts(of, doc), _starts(of)
    of_key = np.searchsorted(docs, keys)
    head = table.select(["bucket", "token", "range"]).take(pa.array(_starts(key))).combine_chunks()
    columns = [head.column(c).combine_chunks() for c in ("bucket", "token", "range")]
    columns += [_list(of_key, pa.array(doc[docs])), _list(of_key, _list(docs, pa.array(at)))]
    return pa.RecordBatch.from_arrays(columns, schema=_POSTINGS_ARROW)


def _grouped(batches):
    """Sorted runs (bucket, token, range, docs, counts, at) as a row per token and range."""
    held: list[pa.RecordBatch] = []
    waiting, enough = 0, MERGE_AT
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            held.append(batch.slice(first, 1000))
            waiting += len(held[-1].column("at").flatten())
            if waiting < enough:
                continue
            table = pa.Table.from_batches(held)
            key = _key(table)
            done = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if done:
                yield _merged(table.slice(0, done), key[:done])
                held = table.slice(done).to_batches()
                waiting = sum(len(h.column("at").flatten()) for h in held)
            enough = waiting + MERGE_AT
    if held:
        table = pa.Table.from_batches(held)
        yield _merged(table, _key(table))


_POSTINGS_ARROW = pa.schema(
    [("bucket", pa.int32()), ("token", pa.string()), ("range", pa.int64())]
    + [("docs", pa.list_(pa.int32())), ("positions", pa.list_(pa.list_(pa.int64())))]
)


def _vocabulary(batches):
    """Sorted distinct tokens as blocks."""
    held: list[str] = []
    for batch in batches:
        held += batch.column("token").to_pylist()
        while len(held) >= BLOCK_TERMS:
            yield pa.RecordBatch.from_pylist([{"first": held[0], "last": held[BLOCK_TERMS - 1], "terms": held[:BLOCK_TERMS]}])
            held = held[BLOCK_TERMS:]
    if held:
        yield pa.RecordBatch.from_pylist([{"first": held[0], "last": held[-1], "terms": held}])


def store(chunks: DataFrame, path: str) -> TokenIndex:
    """Index of ``chunks`` (chunk_id, file_id, chunk_idx, content, file_name) written to ``path``.

    Occurrences are range-partitioned by token and range, so those of a frequent token are many
    tasks.
    """
    spark = chunks.sparkSession
    names = chunks.select("chunk_id", "file_id", "chunk_idx")
    dense_ids(names, ["file_id", "chunk_idx", "chunk_id"], "no").write.parquet(f"{path}/chunks")
    numbers = spark.read.parquet(f"{path}/chunks").select("chunk_id", "no")
    indexed = index(chunks).join(numbers, "chunk_id")
    parts = []
    for i, name in enumerate(FIELDS):
        # In the outer form, as in ``explode_rows``; an empty array has one empty row.
        every = F.sequence(F.lit(0), F.greatest(F.size("_tokens") - 1, F.lit(0)), F.lit(RUN_TOKENS))
        rows = indexed.select("no", F.col(f"{name}_tokens").alias("_tokens"))
        rows = rows.select("no", "_tokens", F.explode_outer(every).alias("_begin"))
        parts.append(
            rows.select(
                "no",
                (F.col("_begin").cast("long") + F.lit(i * FIELD_SPAN)).alias("base"),
                F.coalesce(F.slice("_tokens", F.col("_begin") + 1, F.lit(RUN_TOKENS)), F.array().cast("array<string>")).alias("tokens"),
            )
        )
    runs = reduce(DataFrame.unionByName, parts).mapInArrow(_runs, _RUNS)
    key = ["bucket", "token", "range"]
    placed = runs.select(bucket(F.col("token")).alias("bucket"), "*")
    ranged = placed.repartitionByRange(*key).sortWithinPartitions(*key)
    ranged.mapInArrow(_grouped, _POSTINGS).write.partitionBy("bucket").parquet(f"{path}/postings")
    found = TokenIndex(spark, path)
    terms = found.postings.select("token").distinct().repartitionByRange("token").sortWithinPartitions("token")
    terms.mapInArrow(_vocabulary, "first string, last string, terms array<string>").write.parquet(f"{path}/terms")
    return found


def _folded(queries: DataFrame, column: str) -> DataFrame:
    """Distinct folded terms per query."""
    return queries.select(
        "query_id",
        F.array_distinct(F.flatten(F.transform(column, tokens))).alias("terms"),
    )


def _of_tokens(postings: DataFrame, asked: DataFrame, few: bool = True) -> DataFrame:
    """Rows of the asked tokens (and ranges, if given) joined with ``asked``, by broadcast if
    these are ``few``. Only their buckets are read."""
    asked = asked.withColumn("bucket", bucket(F.col("token")))
    wanted, n = asked.agg(F.collect_set("bucket"), F.count("*")).first()  # at most BUCKETS
    read = postings.where(F.col("bucket").isin(wanted)) if len(wanted) < BUCKETS else postings
    keys = [c for c in ("bucket", "token", "range") if c in asked.columns]
    return read.join(F.broadcast(asked) if few and n <= FEW_TOKENS else asked, keys).drop("bucket")


def _match_any(index: TokenIndex, asked: DataFrame) -> DataFrame:
    """(query_id, range, docs) of chunks that have any of a query's tokens."""
    found = _of_tokens(index.postings.select("bucket", "token", "range", "docs"), asked)
    # Lists of a range meet: at most RANGE places of each of a query's tokens.
    return found.groupBy("query_id", "range").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))


def _met(lists):
    """Places that all lists have."""
    rest = F.slice(lists, 2, F.size(lists))
    return F.aggregate(rest, F.get(lists, F.lit(0)), lambda a, b: F.array_intersect(a, b))


def _match_all(index: TokenIndex, terms: DataFrame) -> DataFrame:
    """(query_id, range, docs) of chunks that have every term.

    The rarest term of a query names the ranges in which the others are met at all, so of a
    frequent one only those are joined.
    """
    asked = cut_lineage(terms.select("query_id", F.size("terms").alias("_n"), F.explode("terms").alias("token")))
    sizes = index.postings.select("bucket", "token", "range", F.size("docs").alias("n"))
    sizes = _of_tokens(sizes, asked.select("token").distinct()).groupBy("token").agg(F.sum("n").alias("n"))
    counted = asked.join(sizes, "token")  # a term that no chunk has: no chunk has all
    ranked = counted.groupBy("query_id", "_n").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"), F.count("*").alias("_known")
    )
    rarest = cut_lineage(ranked.where("_known = _n").drop("_known"))
    lists = index.postings.select("bucket", "token", "range", "docs")
    first = cut_lineage(_of_tokens(lists, rarest))
    rest = asked.join(rarest.select("query_id", F.col("token").alias("_rarest")), "query_id").where("token != _rarest")
    needed = rest.select("query_id", "token").join(first.select("query_id", "range"), "query_id")
    others = _of_tokens(lists, needed).groupBy("query_id", "range").agg(F.collect_list("docs").alias("_others"))
    met = first.join(others, ["query_id", "range"], "left")
    every = F.coalesce(F.size("_others"), F.lit(0)) == F.col("_n") - 1
    lists = F.concat(F.array("docs"), F.coalesce("_others", F.array().cast("array<array<int>>")))
    return met.where(every).select("query_id", "range", _met(lists).alias("docs")).where(F.size("docs") > 0)


def _match_phrase(index: TokenIndex, phrases: DataFrame) -> DataFrame:
    """Chunks in which a field has the terms side by side, in order.

    Only candidates that have all terms are looked at: the places of the i-th word, less i, are
    met over the words of the phrase.
    """
    phrases = cut_lineage(phrases)
    terms = phrases.select("query_id", F.array_distinct("phrase").alias("terms"))
    candidates = cut_lineage(_match_all(index, terms))
    words = phrases.select("query_id", F.size("phrase").alias("_n"), F.posexplode("phrase").alias("_i", "token"))
    # Places are long, so they are never sent for each query: candidates go to where they lie.
    sought = words.join(candidates.select("query_id", "range", F.col("docs").alias("_both")), "query_id")
    chunks = sought.agg(F.sum(F.size("_both"))).first()[0] or 0
    held = _of_tokens(index.postings, sought, few=chunks <= FEW_CHUNKS)
    place = F.transform("_both", lambda doc: F.get("positions", (F.array_position("docs", doc) - 1).cast("int")))
    started = F.transform(place, lambda at: F.transform(at, lambda x: x - F.col("_i")))
    pairs = held.select("query_id", "range", "_n", F.explode(F.arrays_zip(F.col("_both").alias("doc"), started.alias("starts"))).alias("p"))
    met = pairs.groupBy("query_id", "range", "p.doc").agg(F.collect_list("p.starts").alias("_lists"), F.first("_n").alias("_n"))
    kept = met.where((F.size("_lists") == F.col("_n")) & (F.size(_met(F.col("_lists"))) > 0))
    return kept.groupBy("query_id", "range").agg(F.collect_list("doc").alias("docs"))


def grown(index: TokenIndex, prefixes: DataFrame) -> DataFrame:
    """``prefixes`` (query_id, term) with every ``token`` of the vocabulary that a term begins.

    A block holds terms in order, so what a prefix begins there is found by bisection; blocks
    outside all prefixes are not read when these are few.
    """
    if prefixes.schema["query_id"].dataType.simpleString() != "string":
        raise TypeError("query_id of searches by prefix is a string")
    asked = cut_lineage(prefixes.select("query_id", "term").distinct())
    parts = max(1, -(-asked.count() // MOST_PREFIXES))
    part = F.pmod(F.xxhash64("term"), F.lit(parts))
    found = [_begun(index, asked.where(part == i).collect()) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _begun(index: TokenIndex, asked: list) -> DataFrame:
    by_term: dict[str, list] = {}
    for row in asked:
        by_term.setdefault(row["term"], []).append(row["query_id"])
    ordered = sorted(by_term)
    blocks = index.terms
    if len(ordered) <= FEW_PREFIXES:
        inside = F.lit(False)
        for term in ordered:
            inside = inside | ((F.col("last") >= term) & (F.substring("first", 1, len(term)) <= term))
        blocks = blocks.where(inside)
    shared = index.spark.sparkContext.broadcast((ordered, by_term))
    schema = pa.schema([(c, pa.string()) for c in ("query_id", "term", "token")])

    def run(batches):
        terms_asked, queries = shared.value
        for batch in batches:
            rows = []
            for block in batch.column("terms").to_pylist():
                for term in terms_asked[: bisect_right(terms_asked, block[-1])]:
                    for token in block[bisect_left(block, term) :]:
                        if not token.startswith(term):
                            break
                        rows += [{"query_id": q, "term": term, "token": token} for q in queries[term]]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return blocks.select("terms").mapInArrow(run, "query_id string, term string, token string")


def _match_prefix(index: TokenIndex, terms: DataFrame) -> DataFrame:
    """Chunks in which, for every term, some token starts with it."""
    wanted = terms.select("query_id", F.size("terms").alias("_n"), F.explode("terms").alias("term"))
    asked = cut_lineage(grown(index, wanted))
    found = _of_tokens(index.postings.select("bucket", "token", "range", "docs"), asked)
    lists = found.groupBy("query_id", "term", "range").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))
    sizes = wanted.select("query_id", "_n").distinct()
    met = lists.groupBy("query_id", "range").agg(F.collect_list("docs").alias("_lists")).join(sizes, "query_id")
    return met.where(F.size("_lists") == F.col("_n")).select("query_id", "range", _met(F.col("_lists")).alias("docs")).where(F.size("docs") > 0)


def _lists(index: TokenIndex, queries: DataFrame, mode: str) -> DataFrame:
    """(query_id, range, docs) of matching chunks, those without and gone left out."""
    terms = _folded(queries, "terms").where(F.size("terms") > 0)
    if mode == "all":
        found = _match_all(index, terms)
    elif mode == "any":
        found = _match_any(index, terms.select("query_id", F.explode("terms").alias("token")))
    elif mode == "phrase":
        phrases = queries.select(
            "query_id", F.flatten(F.transform("terms", tokens)).alias("phrase")
        ).where(F.size("phrase") > 0)
        found = _match_phrase(index, phrases)
    elif mode == "prefix":
        found = _match_prefix(index, terms)
    else:
        raise ValueError(f"unknown mode {mode!r}")

    def less(found, others, keys):
        others = others.withColumnRenamed("docs", "_less")
        rest = F.array_except("docs", F.coalesce("_less", F.array().cast("array<int>")))
        return found.join(others, keys, "left").withColumn("docs", rest).drop("_less").where(F.size("docs") > 0)

    if "without" in queries.columns:
        barred = _folded(queries, "without").select("query_id", F.explode("terms").alias("token"))
        found = less(found, _match_any(index, barred), ["query_id", "range"])
    if index.gone is not None:
        places = index.gone.select(F.floor(F.col("no") / RANGE).alias("range"), (F.col("no") % RANGE).cast("int").alias("doc"))
        found = less(found, places.groupBy("range").agg(F.collect_list("doc").alias("docs")), ["range"])
    return found


def _numbers(lists: DataFrame) -> DataFrame:
    rows = lists.select("query_id", "range", F.explode("docs").alias("doc"))
    return rows.select("query_id", (F.col("range") * RANGE + F.col("doc")).alias("no"))


def match(index: TokenIndex, queries: DataFrame, mode: str = "all") -> DataFrame:
    """(query_id, chunk_id) of matching chunks, unlimited.

    ``queries`` has query_id, ``terms`` and optionally ``without`` (arrays of strings).
    Modes: ``all`` and ``any`` of the terms, ``phrase`` (side by side), ``prefix``.
    """
    found = _numbers(_lists(index, queries, mode))
    return found.join(index.chunks.select("no", "chunk_id"), "no").select("query_id", "chunk_id")


def search(index: TokenIndex, queries: DataFrame, limit: int = 50, mode: str = "all") -> DataFrame:
    """The first ``limit`` matches of each query in ingest order (file, then chunk).

    Ranges are in ingest order too: those behind enough matches are dropped before their
    chunks become rows.
    """
    sized = _lists(index, queries, mode).withColumn("_size", F.size("docs"))
    along = Window.partitionBy("query_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    near = sized.withColumn("_ahead", F.coalesce(F.sum("_size").over(along), F.lit(0))).where(F.col("_ahead") < limit)
    places = F.posexplode(F.slice(F.array_sort("docs"), 1, limit)).alias("_at", "_doc")
    rows = near.select("query_id", "range", "_ahead", places)
    kept = rows.select(
        "query_id",
        (F.col("range") * RANGE + F.col("_doc")).alias("no"),
        (F.col("_ahead") + F.col("_at") + 1).cast("int").alias("rank"),
    ).where(F.col("rank") <= limit)
    return kept.join(index.chunks, "no").select("query_id", "chunk_id", "file_id", "chunk_idx", "rank")


def delete(indexed: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Index rows that remain once the files are gone."""
    return indexed.join(file_ids.select("file_id"), "file_id", "left_anti")
