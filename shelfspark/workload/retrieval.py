"""Queries over vectors, contexts and prompts, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from shelfspark import models
from shelfspark.config import Settings
from shelfspark.functions import names
from shelfspark.functions import tokens as tok
from shelfspark.operators import catalog, context, knn, pack
from shelfspark.operators.answers import exchanges
from shelfspark.operators.scan import dense_ids
from shelfspark.plans import retrieve
from shelfspark.plans.answer import answer
from shelfspark.sources import sinks
from shelfspark.storage import cut_lineage, fresh_path
from shelfspark.workload import bind
from shelfspark.workload.sql import budgeted, registry, retrieval

K = 5
MEAN = 0.49
FAR = 0.7
TEMPLATE = "{context}\n---\n{question}\n"
CFG = replace(Settings(), top_k=K, min_mean_score=MEAN, prompt_template=TEMPLATE)
SMALL = replace(CFG, token_window=1200)
TEMPLATE_TOKENS = len(TEMPLATE) // 4 + 3
PARTS = {**retrieval(K), **budgeted(CFG.token_window, TEMPLATE_TOKENS)}
TIGHT = budgeted(SMALL.token_window, TEMPLATE_TOKENS)

PARTS["prompts"] = f"""
SELECT q.query_id, q.question, q.hq, q.ha, coalesce(m.mean, 0) AS mean,
       coalesce(m.mean, 0) >= {MEAN} AS grounded,
       CASE WHEN coalesce(m.mean, 0) >= {MEAN}
            THEN replace(replace('{{context}}' || chr(10) || '---' || chr(10) || '{{question}}'
                                 || chr(10), '{{question}}', q.question),
                         '{{context}}', coalesce(m.body, ''))
            ELSE q.question END AS prompt,
       CAST(CASE WHEN coalesce(m.mean, 0) >= {MEAN} THEN m.n ELSE 0 END AS INTEGER) AS n_sources
FROM queries q LEFT JOIN (
  SELECT query_id, avg(score) AS mean, count(*) AS n,
         string_agg(content, chr(10) ORDER BY position) AS body
  FROM packed GROUP BY query_id) m ON m.query_id = q.query_id"""
PARTS["rerankable"] = """
SELECT o.*, q.question, length(q.question) <= 300 AS short_enough,
       count(*) OVER (PARTITION BY o.query_id) AS n_contexts,
       round(length(o.content) % 97 / 97.0, 6) AS fresh_score
FROM ordered o JOIN queries q ON q.query_id = o.query_id"""

QUERIES, SQL, register = registry(PARTS)


def hits(spark, d, k=K, **options):
    return knn.knn(bind.queries(spark, d), bind.vectors(spark, d), k, **options)


def near(spark, d):
    return knn.within_distance(hits(spark, d), CFG.max_distance)


def located(spark, d):
    return context.locate(near(spark, d), bind.chunks(spark, d))


def found(spark, d):
    return context.contexts(near(spark, d), bind.chunks(spark, d), CFG)


def ordered(spark, d):
    return retrieve.ordered_contexts(found(spark, d))


def packed(spark, d, cfg=CFG):
    return pack.pack_tokens(ordered(spark, d), bind.queries(spark, d), cfg)


def _shown(df):
    return df.select(
        "query_id", "file_id", "chunk_idx", F.round("dist", 10).alias("dist"),
        F.col("rank").cast("bigint").alias("rank"),
    )


_HITS = "SELECT query_id, file_id, chunk_idx, round(dist, 10) AS dist, rank FROM {0}"


# --- search ---------------------------------------------------------------------


@register(
    "join_knn",
    """SELECT query_id, count(*) AS n_hits, round(max(ip), 6) AS best, round(avg(ip), 6) AS mean
       FROM ranked WHERE rank <= 100 GROUP BY query_id""",
)
def join_knn(spark, d):
    return hits(spark, d, 100, plan="tile").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.round(F.max(1 - F.col("dist")), 6).alias("best"),
        F.round(F.avg(1 - F.col("dist")), 6).alias("mean"),
    )


@register("topk_ip", _HITS.format("hits"), retrieval(100))
def topk_ip(spark, d):
    return _shown(hits(spark, d, 100))


@register("win_topk", _HITS.format("hits"))
def win_topk(spark, d):
    return _shown(hits(spark, d, plan="tile", query_tile=64, vector_tile=128))


@register("knn_blocks", _HITS.format("hits"))
def knn_blocks(spark, d):
    """The search over vectors that are kept in blocks with zones."""
    vectors = bind.vectors(spark, d)
    pivots = knn.choose_pivots(vectors)
    path = fresh_path(spark, "blocks")
    knn.pack_blocks(vectors, pivots, 256).write.partitionBy("user_id").parquet(path)
    return _shown(knn.knn_blocks(bind.queries(spark, d), spark.read.parquet(path), pivots, K))


@register("sort_hits", _HITS.format("hits") + " ORDER BY query_id, dist, rank")
def sort_hits(spark, d):
    return _shown(hits(spark, d)).orderBy("query_id", "dist", "rank")


@register("flt_threshold_fallback", _HITS.format("near"), retrieval(K, FAR))
def flt_threshold_fallback(spark, d):
    return _shown(knn.within_distance(hits(spark, d), FAR))


@register(
    "join_scope",
    """SELECT query_id, file_id, chunk_idx, round(1 - ip, 10) AS dist, rank FROM (
         SELECT query_id, file_id, chunk_idx, ip, row_number() OVER (
                  PARTITION BY query_id ORDER BY ip DESC, file_id, chunk_idx) AS rank
         FROM scored WHERE kb_id IN (SELECT kb_id FROM kbs WHERE kb_name < 'src2'))
       WHERE rank <= 5""",
)
def join_scope(spark, d):
    owned = catalog.user_kbs(bind.kbs(spark, d)).where("kb_name < 'src2'")
    wanted = owned.groupBy("user_id").agg(F.collect_set("kb_id").alias("kb_ids"))
    scoped = bind.queries(spark, d).join(wanted, "user_id")
    return _shown(knn.knn_within_kbs(scoped, bind.vectors(spark, d), K))


@register(
    "fn_inner_product",
    """SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]),
                                                CAST(embedding AS DOUBLE[])), 6) AS ip
       FROM embeddings""",
)
def fn_inner_product(spark, d):
    ip = knn.inner_product(F.col("embedding"), F.col("embedding"))
    return bind.table(spark, d, "embeddings").select("vec_id", F.round(ip, 6).alias("ip"))


@register("flt_dim", "SELECT file_id, chunk_idx FROM vectors WHERE len(embedding) = 64")
def flt_dim(spark, d):
    return knn.right_dimension(bind.vectors(spark, d), 64).select("file_id", "chunk_idx")


@register(
    "join_hit_meta",
    """SELECT h.query_id, h.file_id, h.chunk_idx, c.file_name, c.content
       FROM hits h JOIN chunks c ON c.file_id = h.file_id AND c.chunk_idx = h.chunk_idx""",
)
def join_hit_meta(spark, d):
    return context.attach_chunks(hits(spark, d), bind.chunks(spark, d)).select(
        "query_id", "file_id", "chunk_idx", "file_name", "content"
    )


@register(
    "prj_score_norm",
    """SELECT query_id, rank, round(dist, 10) AS dist, round(1 - dist, 4) AS score FROM hits""",
)
def prj_score_norm(spark, d):
    return hits(spark, d).select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("dist", 10).alias("dist"),
        F.round(1 - F.col("dist"), 4).alias("score"),
    )


@register(
    "fn_chunk_id",
    """SELECT file_id || '_' || CAST(chunk_idx AS VARCHAR) AS chunk_id,
              CAST(chunk_idx AS INTEGER) AS parsed FROM vectors""",
)
def fn_chunk_id(spark, d):
    composed = names.chunk_id(F.col("file_id"), F.col("chunk_idx"))
    return bind.vectors(spark, d).select(
        composed.alias("chunk_id"), names.chunk_index(composed).alias("parsed")
    )


@register(
    "win_next_id",
    """SELECT file_id, chunk_idx, row_number() OVER (ORDER BY file_id, chunk_idx) - 1 AS id
       FROM chunks""",
)
def win_next_id(spark, d):
    rows = bind.chunks(spark, d).select("file_id", "chunk_idx")
    return dense_ids(rows, ["file_id", "chunk_idx"], "id")


# --- contexts -------------------------------------------------------------------


@register(
    "prj_tabular_split",
    """SELECT query_id, file_id, chunk_idx, tabular, CASE WHEN tabular THEN content ELSE '' END
              AS kernel, CASE WHEN tabular THEN round(1 - dist, 6) ELSE 0 END AS score
       FROM named""",
)
def prj_tabular_split(spark, d):
    kept = context.attach_chunks(near(spark, d), bind.chunks(spark, d))
    tabular = names.is_tabular(F.col("file_name"))
    return kept.select(
        "query_id", "file_id", "chunk_idx", tabular.alias("tabular"),
        F.when(tabular, F.col("content")).otherwise("").alias("kernel"),
        F.when(tabular, F.round(1 - F.col("dist"), 6)).otherwise(0.0).alias("score"),
    )


@register(
    "join_neighbors",
    """SELECT a.file_id, a.chunk_idx, b.chunk_idx AS idx FROM chunks a JOIN chunks b
       ON b.file_id = a.file_id AND b.chunk_idx BETWEEN a.chunk_idx - 199 AND a.chunk_idx + 199
       JOIN vectors v ON v.file_id = a.file_id AND v.chunk_idx = a.chunk_idx""",
)
def join_neighbors(spark, d):
    unlimited = replace(CFG, context_chars=1 << 30)
    centres = bind.vectors(spark, d).select("file_id", "chunk_idx")
    return context.reach(centres, context.chunk_sizes(bind.chunks(spark, d)), unlimited)


@register(
    "win_context_budget",
    """SELECT file_id, centre AS chunk_idx, idx FROM (
         SELECT a.file_id, a.chunk_idx AS centre, b.chunk_idx AS idx,
                sum(length(b.content)) OVER (PARTITION BY a.file_id, a.chunk_idx
                  ORDER BY 2 * abs(b.chunk_idx - a.chunk_idx)
                           + CASE WHEN b.chunk_idx < a.chunk_idx THEN 1 ELSE 0 END) AS total
         FROM chunks a JOIN chunks b ON b.file_id = a.file_id
          AND b.chunk_idx BETWEEN a.chunk_idx - 199 AND a.chunk_idx + 199)
       WHERE total <= 800 OR idx = centre""",
)
def win_context_budget(spark, d):
    chunks = bind.chunks(spark, d)
    return context.reach(
        chunks.select("file_id", "chunk_idx"), context.chunk_sizes(chunks), CFG
    )


@register("set_neighbors", "SELECT query_id, file_id, idx FROM kept")
def set_neighbors(spark, d):
    rows = cut_lineage(located(spark, d))
    parts = context.members(rows, bind.chunks(spark, d), CFG)
    return parts.where(~F.col("tabular")).select("query_id", "file_id", "idx")


@register(
    "win_islands",
    """SELECT file_id, chunk_idx, min(chunk_idx) OVER (PARTITION BY file_id, island) AS run_start
       FROM (SELECT file_id, chunk_idx, chunk_idx - row_number() OVER (
               PARTITION BY file_id ORDER BY chunk_idx) AS island
             FROM chunks WHERE length(content) % 3 <> 0)""",
)
def win_islands(spark, d):
    rows = bind.chunks(spark, d).where(F.length("content") % 3 != 0)
    return context.with_runs(rows, ["file_id"], "chunk_idx").select(
        "file_id", "chunk_idx", "run_start"
    )


@register(
    "agg_run_best",
    "SELECT query_id, file_id, run_start, run_end, score FROM found WHERE arrival = 1",
)
def agg_run_best(spark, d):
    return found(spark, d).where("arrival = 1").select(
        "query_id", "file_id", "run_start", "run_end", "score"
    )


@register(
    "agg_run_text",
    "SELECT query_id, file_id, run_start, content, kernel FROM found WHERE arrival = 1",
)
def agg_run_text(spark, d):
    return found(spark, d).where("arrival = 1").select(
        "query_id", "file_id", "run_start", "content", "kernel"
    )


@register(
    "set_union_docs",
    """SELECT query_id, file_id, run_start, content, kernel, round(score, 6) AS score FROM found""",
)
def set_union_docs(spark, d):
    return found(spark, d).select(
        "query_id", "file_id", "run_start", "content", "kernel", F.round("score", 6).alias("score")
    )


@register(
    "prj_tag_query",
    """SELECT f.query_id, f.file_id, f.run_start, q.question AS retrieval_query,
              'openai_compatible_v1' AS embed_version
       FROM found f JOIN queries q ON q.query_id = f.query_id""",
)
def prj_tag_query(spark, d):
    return context.tag(found(spark, d), bind.queries(spark, d)).select(
        "query_id", "file_id", "run_start", "retrieval_query", "embed_version"
    )


@register(
    "flt_cosine",
    "SELECT query_id, file_id, run_start, round(score, 6) AS score FROM found WHERE score > 0.45",
)
def flt_cosine(spark, d):
    return context.above(found(spark, d), 0.45).select(
        "query_id", "file_id", "run_start", F.round("score", 6).alias("score")
    )


@register(
    "flt_nan",
    """SELECT query_id, file_id, run_start FROM found
       WHERE run_start % 4 NOT IN (1, 2)""",
)
def flt_nan(spark, d):
    start = F.col("run_start") % 4
    broken = found(spark, d).withColumn(
        "score",
        F.when(start == 1, "NaN").when(start == 2, "none").otherwise(F.col("score").cast("string")),
    )
    return pack.drop_nan(broken).select("query_id", "file_id", "run_start")


DEDUP = "SELECT query_id, file_id, run_start, content FROM unique_found"


@register("agg_dedup", DEDUP)
def agg_dedup(spark, d):
    return context.deduplicate(found(spark, d)).select(
        "query_id", "file_id", "run_start", "content"
    )


@register(
    "win_first_seen",
    """SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text""",
)
def win_first_seen(spark, d):
    # One row per text over the whole table: an aggregate combines equal texts before the shuffle.
    return bind.table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@register("sort_retrieval", "SELECT query_id, position, file_id, run_start FROM ordered")
def sort_retrieval(spark, d):
    return ordered(spark, d).select(
        "query_id", F.col("position").cast("bigint").alias("position"), "file_id", "run_start"
    )


@register(
    "sort_rerank",
    """SELECT query_id, file_id, run_start, round(final, 6) AS score, row_number() OVER (
                PARTITION BY query_id ORDER BY final DESC, position) AS position
       FROM (SELECT *, CASE WHEN short_enough AND n_contexts > 1 THEN fresh_score ELSE score END
                       AS final FROM rerankable)""",
)
def sort_rerank(spark, d):
    rows = cut_lineage(ordered(spark, d))
    scored = rows.select(
        "query_id", "file_id", "run_start",
        F.round((F.length("content") % 97) / 97.0, 6).alias("rerank_score"),
    )
    return context.rerank(rows, bind.queries(spark, d), scored, CFG).select(
        "query_id", "file_id", "run_start", F.round("score", 6).alias("score"),
        F.col("position").cast("bigint").alias("position"),
    )


@register(
    "flt_rerank_gate",
    """SELECT query_id, bool_or(short_enough AND n_contexts > 1) AS reranked FROM rerankable
       GROUP BY query_id""",
)
def flt_rerank_gate(spark, d):
    rows = cut_lineage(ordered(spark, d))
    scored = rows.select("query_id", "file_id", "run_start", F.lit(-1.0).alias("rerank_score"))
    result = context.rerank(rows, bind.queries(spark, d), scored, CFG)
    return result.groupBy("query_id").agg(F.bool_or(F.col("score") == -1).alias("reranked"))


@register(
    "udf_rerank",
    """SELECT query_id, file_id, run_start,
              round(length(content) / (length(content) + length(question)), 6) AS rerank_score
       FROM rerankable""",
)
def udf_rerank(spark, d):
    pairs = ordered(spark, d).join(bind.queries(spark, d).select("query_id", "question"), "query_id")
    scored = models.rerank_scores(
        pairs, lambda q, passages: [len(p) / (len(p) + len(q)) for p in passages]
    )
    return scored.select(
        "query_id", "file_id", "run_start", F.round("rerank_score", 6).alias("rerank_score")
    )


@register(
    "fn_pair_format",
    """SELECT e.vec_id, '<Instruct>: Judge.' || chr(10) || '<Query>: ' || b.text || chr(10)
              || '<Document>: ' || d.text AS pair
       FROM embeddings e JOIN benchmark b ON b.item_id = e.vec_id % (SELECT count(*) FROM benchmark)
       JOIN documents d ON d.doc_id = e.vec_id""",
)
def fn_pair_format(spark, d):
    asked = bind.queries(spark, d).select(F.col("query_id").cast("bigint").alias("vec_id"), "question")
    documents = bind.table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return asked.join(documents, "vec_id").select(
        "vec_id", tok.rerank_pair(F.col("question"), F.col("text"), "Judge.").alias("pair")
    )


@register(
    "fn_sigmoid",
    "SELECT event_id, round(1 / (1 + exp(-(value / 100 - 1))), 6) AS p FROM events",
)
def fn_sigmoid(spark, d):
    return bind.table(spark, d, "events").select(
        "event_id", F.round(tok.sigmoid(F.col("value") / 100 - 1), 6).alias("p")
    )


@register(
    "fn_yes_prob",
    """SELECT event_id, round(exp(value / 100) / (exp(value / 100) + exp(1.5)), 6) AS p
       FROM events""",
)
def fn_yes_prob(spark, d):
    return bind.table(spark, d, "events").select(
        "event_id", F.round(tok.yes_probability(F.col("value") / 100, F.lit(1.5)), 6).alias("p")
    )


@register(
    "snk_sources",
    """SELECT f.query_id, f.file_id, f.file_name, f.content, q.question AS retrieval_query,
              f.kernel, round(f.score, 6) AS score, 'openai_compatible_v1' AS embed_version
       FROM ordered f JOIN queries q ON q.query_id = f.query_id""",
)
def snk_sources(spark, d):
    tagged = context.tag(ordered(spark, d), bind.queries(spark, d))
    return context.sources(tagged).withColumn("score", F.round("score", 6))


@register(
    "agg_group_sources",
    """SELECT query_id, file_name, min(file_id) AS file_id,
              row_number() OVER (PARTITION BY query_id ORDER BY min(position)) AS group_no,
              string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS members_shown
       FROM ordered GROUP BY query_id, file_name""",
)
def agg_group_sources(spark, d):
    listed = F.transform("chunks", lambda c: c["position"].cast("string"))
    return context.group_sources(ordered(spark, d)).select(
        "query_id", "file_name", "file_id", F.col("group_no").cast("bigint").alias("group_no"),
        F.array_join(listed, ",").alias("members_shown"),
    )


# --- budget and prompts -----------------------------------------------------------


@register("fn_budget", "SELECT query_id, CAST(budget AS BIGINT) AS budget FROM budgets")
def fn_budget(spark, d):
    budget = tok.context_budget(F.col("question"), F.col("history"), CFG)
    return bind.queries(spark, d).select("query_id", budget.cast("bigint").alias("budget"))


@register(
    "win_token_budget", "SELECT query_id, position, content FROM packed", TIGHT
)
def win_token_budget(spark, d):
    return packed(spark, d, SMALL).select(
        "query_id", F.col("position").cast("bigint").alias("position"), "content"
    )


@register(
    "fn_trim_middle",
    """SELECT doc_id, CASE WHEN rest > 0 THEN substring(text, (n - rest) // 2 + 1, rest) ELSE ''
              END AS trimmed
       FROM (SELECT doc_id, text, n, n - greatest(0, CAST(ceil((n - (4 * (left_over - 3) + 3))
                    / 100.0) AS BIGINT)) * 100 AS rest
             FROM (SELECT doc_id, text, length(text) AS n, doc_id % 300 - 5 AS left_over
                   FROM documents))""",
)
def fn_trim_middle(spark, d):
    left = (F.col("doc_id") % 300 - 5).cast("int")
    return bind.table(spark, d, "documents").select(
        "doc_id", tok.trim_middle(F.col("text"), left).alias("trimmed")
    )


@register("fn_num_tokens", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS n FROM documents")
def fn_num_tokens(spark, d):
    return bind.table(spark, d, "documents").select(
        "doc_id", tok.count_tokens(F.col("text")).alias("n")
    )


@register(
    "fn_msg_tokens",
    """SELECT conv_id, turn, CAST(length(q) // 4 + length(a) // 4 + 3 AS INTEGER) AS n FROM pairs""",
)
def fn_msg_tokens(spark, d):
    return exchanges(bind.table(spark, d, "conversations")).select(
        "conv_id", "turn", tok.count_message_tokens(F.array("q", "a")).alias("n")
    )


@register(
    "agg_tokens",
    """SELECT file_id, CAST(sum(length(content) // 4) AS BIGINT) AS n_tokens FROM chunks
       GROUP BY file_id""",
)
def agg_tokens(spark, d):
    return bind.chunks(spark, d).groupBy("file_id").agg(
        F.sum(tok.count_tokens(F.col("content"))).alias("n_tokens")
    )


@register(
    "agg_mean_score",
    """SELECT q.query_id, round(coalesce(avg(p.score), 0), 6) AS mean_score
       FROM queries q LEFT JOIN packed p ON p.query_id = q.query_id GROUP BY q.query_id""",
)
def agg_mean_score(spark, d):
    means = pack.mean_scores(packed(spark, d), bind.queries(spark, d))
    return means.select("query_id", F.round("mean_score", 6).alias("mean_score"))


@register(
    "fn_prompt",
    """SELECT conv_id, turn, replace(replace('参考：{context}问：{question}', '{question}', q),
                                     '{context}', a) AS prompt FROM pairs""",
)
def fn_prompt(spark, d):
    template = "参考：{context}问：{question}"
    return exchanges(bind.table(spark, d, "conversations")).select(
        "conv_id", "turn", tok.prompt(F.col("q"), F.col("a"), template).alias("prompt")
    )


@register("fn_gate", "SELECT query_id, grounded, n_sources FROM prompts")
def fn_gate(spark, d):
    return prompts(spark, d).select("query_id", "grounded", "n_sources")


@register(
    "fn_messages",
    """SELECT query_id, CAST(CASE WHEN hq IS NULL THEN 2 ELSE 4 END AS INTEGER) AS n_messages,
              'system=You are a helpful assistant.|' || CASE WHEN hq IS NULL THEN ''
                ELSE 'user=' || hq || '|assistant=' || ha || '|' END
              || 'user=' || question AS shown FROM queries""",
)
def fn_messages(spark, d):
    messages = tok.chat_messages(F.col("question"), F.col("history"))
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return bind.queries(spark, d).select(
        "query_id", F.size(messages).alias("n_messages"), F.array_join(lines, "|").alias("shown")
    )


@register(
    "prompts",
    """SELECT query_id, prompt, round(mean, 6) AS mean_score, grounded, n_sources FROM prompts""",
)
def prompts(spark, d):
    queries = cut_lineage(bind.queries(spark, d))  # derived by joins, read several times
    return retrieve.grounded_prompts(
        queries, bind.vectors(spark, d), bind.chunks(spark, d), CFG
    ).select(
        "query_id", "prompt", F.round("mean_score", 6).alias("mean_score"), "grounded", "n_sources"
    )


def _echo(messages):
    if len(messages) > 2:
        raise RuntimeError(f"{len(messages)} messages")
    return "Answer: " + messages[-1]["content"]


@register(
    "udf_answer",
    """SELECT query_id, CASE WHEN hq IS NOT NULL THEN 'LLM Error: 4 messages' ELSE 'Answer: ' || prompt END
              AS answer, question AS history_question FROM prompts""",
)
def udf_answer(spark, d):
    answered = answer(
        bind.queries(spark, d), bind.vectors(spark, d), bind.chunks(spark, d), _echo, CFG
    )
    last = F.element_at("history", -1)
    return answered.select("query_id", "answer", last["q"].alias("history_question"))


@register(
    "snk_qa_log",
    """SELECT p.query_id, p.prompt, CAST(o.n AS INTEGER) AS n_retrieved,
              p.n_sources FROM prompts p
       JOIN (SELECT query_id, count(*) AS n FROM ordered GROUP BY query_id) o
         ON o.query_id = p.query_id""",
)
def snk_qa_log(spark, d):
    queries = bind.queries(spark, d)
    rows = cut_lineage(context.tag(ordered(spark, d), queries))
    kept = pack.pack_tokens(rows, queries, CFG)
    asked = pack.build_prompts(kept, queries, CFG)
    log = sinks.answer_log(asked, rows, pack.kept_sources(kept, asked))
    path = fresh_path(spark, "answer-log")
    sinks.write_answer_log(log, path)
    back = spark.read.schema(
        "query_id string, prompt string, retrieval_documents string, source_documents string"
    ).json(path)
    return back.select(
        "query_id",
        "prompt",
        F.json_array_length("retrieval_documents").alias("n_retrieved"),
        F.json_array_length("source_documents").alias("n_sources"),
    )
