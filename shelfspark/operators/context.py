"""From hits to contexts: neighbours under a budget, runs, order, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.config import EMBED_VERSION, Settings
from shelfspark.functions.names import is_tabular
from shelfspark.storage import cut_lineage


def attach_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the name and text of their chunk; hits without a chunk are dropped."""
    known = chunks.select("file_id", "chunk_idx", "file_name", "content")
    return hits.join(known, ["file_id", "chunk_idx"])


def reach(centres: DataFrame, sizes: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Chunks that each centre (file_id, chunk_idx) takes in, itself included, as ``idx``.

    Neighbours come in the order +1, -1, +2, -2, ... and stop at the first that exceeds
    the character budget. Sizes are not negative, so that greedy walk equals a running sum
    with a cut. The result does not depend on the query, so hits on the same chunk share it;
    only sizes travel here, never the texts.
    """
    window = cfg.context_window
    pages = centres.select(
        "file_id",
        F.col("chunk_idx").alias("centre"),
        F.explode(
            F.sequence(
                F.floor((F.col("chunk_idx") - window + 1) / window),
                F.floor((F.col("chunk_idx") + window - 1) / window),
            )
        ).alias("_page"),
    )
    paged = sizes.select(
        "file_id",
        F.col("chunk_idx").alias("idx"),
        F.floor(F.col("chunk_idx") / window).alias("_page"),
        "size",
    )
    offset = F.col("idx") - F.col("centre")
    walk = (
        Window.partitionBy("file_id", "centre")
        .orderBy("_step")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        pages.join(paged, ["file_id", "_page"])
        .where(F.abs(offset) < window)
        .withColumn("_step", 2 * F.abs(offset) + (offset < 0).cast("int"))
        .withColumn("_sum", F.sum("size").over(walk))
        .where((F.col("_sum") <= cfg.context_chars) | (F.col("_step") == 0))
        .select("file_id", F.col("centre").alias("chunk_idx"), "idx")
    )


def with_runs(df: DataFrame, keys: list[str], idx: str, out: str = "run_start") -> DataFrame:
    """Mark maximal runs of consecutive numbers per key by their first number."""
    along = Window.partitionBy(*keys).orderBy(idx)
    marked = df.withColumn("_island", F.col(idx) - F.row_number().over(along))
    whole = Window.partitionBy(*keys, "_island")
    return marked.withColumn(out, F.min(idx).over(whole)).drop("_island")


def locate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their file name and whether it is tabular; hits without a chunk are dropped."""
    known = chunks.select("file_id", "chunk_idx", "file_name")
    return hits.join(known, ["file_id", "chunk_idx"]).withColumn(
        "tabular", is_tabular(F.col("file_name"))
    )


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """Characters per chunk; a stored ``size`` column spares reading the texts."""
    size = F.col("size") if "size" in chunks.columns else F.length("content")
    return chunks.select("file_id", "chunk_idx", size.alias("size"))


def members(located: DataFrame, chunks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Chunks of every context, by number only: tabular hits alone, others with their reach."""
    keys = ["query_id", "file_id"]
    alone = located.where("tabular").select(
        *keys, F.col("chunk_idx").alias("idx"), "dist", "rank",
        F.col("chunk_idx").alias("run_start"), "tabular",
    )
    prose = located.where(~F.col("tabular"))
    centres = prose.select("file_id", "chunk_idx").distinct()
    spread = reach(centres, chunk_sizes(chunks), cfg)
    own = F.col("idx") == F.col("chunk_idx")
    widened = (
        prose.join(spread, ["file_id", "chunk_idx"])
        .groupBy(*keys, "idx")
        .agg(F.min(F.when(own, F.col("dist"))).alias("dist"))
    )
    runs = with_runs(widened, keys, "idx")
    return alone.unionByName(
        runs.select(*keys, "idx", "dist", F.lit(0).alias("rank"), "run_start",
                    F.lit(False).alias("tabular"))
    )


def merge_runs(parts: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per context: text in chunk order, the hit chunks as kernel, the best score.

    A context holds at most the reach of k hits, so collecting it is bounded. Scores of
    widened contexts have four decimals; ``arrival`` columns keep the order of arrival.
    """
    listed = F.array_sort(
        F.collect_list(F.struct("idx", "content", F.col("dist").isNotNull().alias("hit")))
    )
    similarity = 1 - F.coalesce(F.col("_dist"), F.lit(cfg.no_hit_distance))
    return (
        parts.groupBy("query_id", "file_id", "run_start", "tabular")
        .agg(
            F.first("file_name").alias("file_name"),
            F.max("idx").alias("run_end"),
            F.min("dist").alias("_dist"),
            F.min("rank").alias("arrival_rank"),
            listed.alias("_parts"),
        )
        .select(
            "query_id",
            "file_id",
            "file_name",
            "run_start",
            "run_end",
            F.array_join(F.transform("_parts", lambda p: p["content"]), " ").alias("content"),
            F.array_join(
                F.transform(F.filter("_parts", lambda p: p["hit"]), lambda p: p["content"]), "|"
            ).alias("kernel"),
            F.when(F.col("tabular"), similarity).otherwise(F.round(similarity, 4)).alias("score"),
            F.when(F.col("tabular"), 0).otherwise(1).alias("arrival"),
            "arrival_rank",
        )
    )


def contexts(hits: DataFrame, chunks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Tabular hits as they are, other hits widened and merged.

    The located hits (k narrow rows per query) are read several times below, so they are
    checkpointed: the search behind them runs once. Chunk texts are joined once, at the end,
    and only for the chunks that are part of a context.
    """
    located = cut_lineage(locate(hits, chunks))
    texts = chunks.select("file_id", F.col("chunk_idx").alias("idx"), "file_name", "content")
    return merge_runs(members(located, chunks, cfg).join(texts, ["file_id", "idx"]), cfg)


ARRIVAL = ("arrival", "arrival_rank", "file_id", "run_start")


def tag(found: DataFrame, queries: DataFrame, embed_version: str = EMBED_VERSION) -> DataFrame:
    """Stamp each context with the question it answers and the embedding version."""
    asked = queries.select("query_id", F.col("question").alias("retrieval_query"))
    return found.join(asked, "query_id").withColumn("embed_version", F.lit(embed_version))


def above(found: DataFrame, min_score: float | None) -> DataFrame:
    """Optional strict score filter; zero and none leave everything in."""
    return found.where(F.col("score").cast("double") > min_score) if min_score else found


def deduplicate(found: DataFrame, order=ARRIVAL) -> DataFrame:
    """Keep the first context of each text per query."""
    first = Window.partitionBy("query_id", "content").orderBy(*order)
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def in_order(found: DataFrame, score: str = "score", order=ARRIVAL) -> DataFrame:
    """Position of each context by score, best first; ties keep the arrival order."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), *order)
    return found.withColumn("position", F.row_number().over(best))


def rerank(
    ordered: DataFrame,
    queries: DataFrame,
    scored: DataFrame | None,
    cfg: Settings = Settings(),
) -> DataFrame:
    """Replace scores by rerank scores where reranking applies, and order again.

    ``scored`` has (query_id, file_id, run_start, rerank_score); none means disabled. A
    query is reranked if it asks for it, is short enough and has more than one context;
    if any of its scores is missing, the scorer failed and its order stays.
    """
    if scored is None:
        return ordered
    asks = F.col("rerank") if "rerank" in queries.columns else F.lit(True)
    wants = queries.select(
        "query_id", (asks & (F.length("question") <= cfg.rerank_query_chars)).alias("_wants")
    )
    keys = ["query_id", "file_id", "run_start"]
    per_query = Window.partitionBy("query_id")
    complete = F.count("rerank_score").over(per_query) == F.count(F.lit(1)).over(per_query)
    several = F.count(F.lit(1)).over(per_query) > 1
    return (
        ordered.join(scored.select(*keys, "rerank_score"), keys, "left")
        .join(wants, "query_id")
        .withColumn("_use", F.col("_wants") & complete & several)
        .withColumn("score", F.when(F.col("_use"), F.col("rerank_score")).otherwise(F.col("score")))
        .transform(lambda df: in_order(df, order=("position",)))
        .drop("_use", "_wants", "rerank_score")
    )


def sources(found: DataFrame) -> DataFrame:
    """The seven fields shown for a retrieved text, with their defaults."""

    def field(name, default):
        column = F.col(name) if name in found.columns else F.lit(None)
        return F.coalesce(column, default).alias(name)

    return found.select(
        "query_id",
        field("file_id", F.lit("")),
        field("file_name", F.lit("")),
        F.col("content"),
        field("retrieval_query", F.lit("")),
        field("kernel", F.col("content")),
        field("score", F.lit(0.0)),
        field("embed_version", F.lit("v2")),
    )


def group_sources(ordered: DataFrame) -> DataFrame:
    """Group the contexts of a query by file name, in first-seen order; unnamed stay apart.

    A query has at most k contexts, so each group is bounded.
    """
    name = F.nullif(F.coalesce("file_name", F.lit("")), F.lit(""))
    unnamed = F.concat(F.lit("__unnamed_"), F.col("position"), F.lit("__"))
    listed = F.array_sort(F.collect_list(F.struct("position", "content", "score")))
    first = Window.partitionBy("query_id").orderBy("_first")
    return (
        ordered.withColumn("_key", F.coalesce(name, unnamed))
        .groupBy("query_id", "_key")
        .agg(
            F.first(F.coalesce("file_name", F.lit(""))).alias("file_name"),
            F.min_by("file_id", "position").alias("file_id"),
            F.min("position").alias("_first"),
            listed.alias("chunks"),
        )
        .withColumn("group_no", F.row_number().over(first))
        .drop("_key", "_first")
    )
