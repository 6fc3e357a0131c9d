"""Queries over answers, conversations and service events, batch and streaming, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import answers as parse
from shelfspark.functions import tokens as tok
from shelfspark.operators import answers, health
from shelfspark.storage import fresh_path
from shelfspark.streaming import jobs
from shelfspark.workload import bind, texts
from shelfspark.workload.sql import registry

_STATE = """
SELECT s.service, coalesce(l.status, 'unknown') AS status, coalesce(l.detail, '') AS detail,
       coalesce(strftime(l.last_check, '%Y-%m-%d %H:%M:%S'), '') AS last_check,
       coalesce(strftime(l.last_success, '%Y-%m-%d %H:%M:%S'), '') AS last_success,
       coalesce(l.latency_ms, -1) AS latency_ms
FROM (SELECT unnest(['signup', 'click', 'error', 'purchase', 'audit']) AS service) s
LEFT JOIN (
  SELECT service, arg_max(status, seq) AS status, max(ts) AS last_check,
         arg_max(detail, seq) FILTER (WHERE detail IS NOT NULL) AS detail,
         arg_max(latency_ms, seq) FILTER (WHERE latency_ms IS NOT NULL) AS latency_ms,
         max(ts) FILTER (WHERE status = 'healthy') AS last_success
  FROM service_events GROUP BY service) l ON l.service = s.service"""
_WINDOWS = """
SELECT service, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS period,
       count(*) AS n, count(*) FILTER (WHERE status = 'unhealthy') AS failures,
       round(avg(CASE WHEN status = 'unhealthy' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate,
       round(coalesce(avg(latency_ms), -1), 6) AS mean_latency_ms
FROM service_events {0} GROUP BY service, date_trunc('minute', ts)"""
_OP = "CASE event_type WHEN 'click' THEN 'submit' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'finish' ELSE 'none' END"
_REPLIES = """
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS stream_id, text AS answer,
       TRUE AS done FROM conversations WHERE role = 'assistant'"""

QUERIES, SQL, register = registry()


def stream(spark, d, name):
    """The table as a stream of its file, or of the files of its folder.

    The path is a pattern, as a stream's plain path must be a folder.
    """
    schema = bind.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def _finish(query):
    query.awaitTermination()


def _paths(spark, name):
    return fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")


# --- answers and conversations ------------------------------------------------------


@register("agg_answer", _REPLIES)
def agg_answer(spark, d):
    return answers.fold_answers(bind.answer_events(spark, d))


def reply_stream(conversations):
    """Lines of assistant turns as answer lines, the closing line first; some streams have none.

    Every turn also tells, without a stream, that an hour has passed.
    """
    turns = conversations.where("role = 'assistant'")
    name = F.concat("conv_id", F.lit(":"), "turn").alias("stream_id")
    lines = F.transform(F.split("text", r"(?<=\n)"), lambda line: parse.answer_line(line))
    closing = F.struct(F.size(lines).alias("seq"), F.lit("data: [DONE]\n\n").alias("raw"))
    numbered = F.transform(lines, lambda line, at: F.struct(at.alias("seq"), line.alias("raw")))
    every = F.concat(F.when(F.col("conv_id") % 7 != 3, F.array(closing)).otherwise(F.array().cast("array<struct<seq:int,raw:string>>")), numbered)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    later = turns.select(
        F.lit(None).cast("string").alias("stream_id"), F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("raw"),
        (start + F.expr("INTERVAL 1 HOUR")).alias("ts"),
    )
    rows = turns.select(name, F.explode(every).alias("line"))
    return rows.select("stream_id", F.col("line.seq").cast("bigint").alias("seq"), "line.raw", start.alias("ts")).unionByName(later)


@register(
    "str_answer",
    """SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS stream_id, text AS answer,
              conv_id % 7 <> 3 AS done FROM conversations WHERE role = 'assistant'""",
)
def str_answer(spark, d):
    path, checkpoint = _paths(spark, "answers")
    _finish(jobs.answers(reply_stream(stream(spark, d, "conversations")), path, checkpoint))
    return jobs.read_answers(spark, path).select("stream_id", "answer", "done")


@register(
    "fn_sse_parse",
    """SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS stream_id,
              CASE role WHEN 'user' THEN text WHEN 'assistant' THEN '' ELSE '' END AS delta,
              role = 'assistant' AS done FROM conversations""",
)
def fn_sse_parse(spark, d):
    raw = (
        F.when(F.col("role") == "user", parse.answer_line(F.col("text")))
        .when(F.col("role") == "assistant", "data: [DONE]\n\n")
        .otherwise(F.concat(F.lit('data: {"answer": '), "text"))
    )
    return bind.table(spark, d, "conversations").select(
        F.concat("conv_id", F.lit(":"), "turn").alias("stream_id"),
        parse.delta(raw).alias("delta"),
        parse.is_done(raw).alias("done"),
    )


@register("fn_strip_think", "SELECT conv_id, turn, trim(a) AS shown FROM pairs")
def fn_strip_think(spark, d):
    thought = F.concat(F.lit("<think>"), "q", F.lit("</think>\n \n"), "a")
    return answers.exchanges(bind.table(spark, d, "conversations")).select(
        "conv_id", "turn", parse.strip_think(thought).alias("shown")
    )


@register(
    "fn_stream_think",
    """SELECT conv_id, turn * 3 + 2 AS seq, trim(text) AS content FROM conversations
       WHERE role = 'assistant'
       UNION ALL SELECT conv_id, turn * 3 + 1, trim(text) FROM conversations
       WHERE role = 'system'""",
)
def fn_stream_think(spark, d):
    turn, body = F.col("turn"), F.col("text")
    user = F.col("role") == "user"
    # A user turn opens a thought, thinks, and an assistant turn closes it before its text.
    opening = F.when(user, F.concat(F.lit("<think>"), body)).otherwise(F.lit(""))
    middle = F.when(F.col("role") == "system", body).otherwise(F.when(user, body).otherwise(""))
    closing = F.when(F.col("role") == "assistant", F.concat(body, F.lit("</think>"), body))
    closing = closing.otherwise(F.when(F.col("role") == "system", "").otherwise("..."))
    chunks = bind.table(spark, d, "conversations").select(
        F.col("conv_id").alias("stream_id"),
        F.posexplode(F.array(opening, middle, closing)).alias("part", "content"),
        turn.alias("turn"),
    )
    numbered = chunks.select(
        "stream_id", (F.col("turn") * 3 + F.col("part")).alias("seq"), "content"
    )
    return answers.strip_think_stream(numbered).select(
        F.col("stream_id").alias("conv_id"), "seq", "content"
    )


@register(
    "fn_reasoning",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'thought ' || text ELSE text END AS shown
       FROM conversations WHERE text <> '' """,
)
def fn_reasoning(spark, d):
    content = F.when(F.col("role") == "user", "").otherwise(F.col("text"))
    reasoning = F.concat(F.lit("thought "), "text")
    return bind.table(spark, d, "conversations").select(
        "conv_id", "turn", parse.content_or_reasoning(content, reasoning).alias("shown")
    )


@register(
    "fn_ollama_line",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN text ELSE '' END AS shown
       FROM conversations""",
)
def fn_ollama_line(spark, d):
    good = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message")))
    line = F.when(F.col("role") == "user", good).otherwise(F.concat(good, F.lit("}{")).substr(2, 9))
    return bind.table(spark, d, "conversations").select(
        "conv_id", "turn", F.coalesce(parse.message_content(line), F.lit("")).alias("shown")
    )


@register(
    "win_history",
    """SELECT conv_id, turn, text AS question, coalesce(pair.q, '') AS last_q,
              coalesce(pair.a, '') AS last_a, pair IS NULL AS first_question
       FROM (SELECT *, last_value(CASE WHEN role = 'user' AND next_role = 'assistant'
                                       THEN {'q': text, 'a': next_text} END IGNORE NULLS) OVER (
                      PARTITION BY conv_id ORDER BY turn, role, text
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pair FROM spoken)
       WHERE role = 'user'""",
)
def win_history(spark, d):
    last = F.get("history", F.lit(0))
    return answers.with_history(bind.table(spark, d, "conversations")).select(
        "conv_id", "turn", "question",
        F.coalesce(last["q"], F.lit("")).alias("last_q"),
        F.coalesce(last["a"], F.lit("")).alias("last_a"),
        (F.size("history") == 0).alias("first_question"),
    )


@register(
    "fn_next_history",
    """SELECT u.conv_id, u.turn, CAST(1 AS INTEGER) AS n_pairs, u.text AS last_q, 'ok' AS last_a
       FROM conversations u WHERE u.role = 'user'""",
)
def fn_next_history(spark, d):
    asked = answers.with_history(bind.table(spark, d, "conversations"))
    after = tok.next_history(F.col("history"), F.col("question"), F.lit("ok"))
    last = F.element_at(after, -1)
    return asked.select(
        "conv_id", "turn", F.size(after).alias("n_pairs"), last["q"].alias("last_q"),
        last["a"].alias("last_a"),
    )


# --- services -------------------------------------------------------------------


def _time(name):
    shown = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(shown, F.lit("")).alias(name)


def _state(df):
    return df.select(
        "service", "status", "detail", _time("last_check"), _time("last_success"),
        F.coalesce("latency_ms", F.lit(-1.0)).alias("latency_ms"),
    )


@register("agg_service_state", _STATE)
def agg_service_state(spark, d):
    return _state(health.service_state(bind.service_events(spark, d), bind.SERVICES))


@register(
    "join_service_dim",
    """SELECT s.service, coalesce(l.seen, FALSE) AS seen
       FROM (SELECT unnest(['signup', 'click', 'error', 'purchase', 'audit']) AS service) s
       LEFT JOIN (SELECT DISTINCT service, TRUE AS seen FROM service_events) l
         ON l.service = s.service""",
)
def join_service_dim(spark, d):
    state = health.service_state(bind.service_events(spark, d), bind.SERVICES)
    return state.select("service", (F.col("status") != "unknown").alias("seen"))


@register(
    "agg_overall",
    """SELECT CASE WHEN bool_or(status = 'unhealthy') THEN 'degraded' ELSE 'ok' END AS status
       FROM (SELECT service, arg_max(status, seq) AS status FROM service_events
             WHERE service <> 'view' GROUP BY service)""",
)
def agg_overall(spark, d):
    return health.overall(health.service_state(bind.service_events(spark, d), bind.SERVICES))


@register(
    "fn_uptime",
    """SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0, 1)
              AS uptime FROM events""",
)
def fn_uptime(spark, d):
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return bind.table(spark, d, "events").select(
        "event_id", health.uptime(start, F.col("ts").cast("timestamp")).alias("uptime")
    )


def _windows(df):
    return df.select(
        "service",
        F.date_format("period.start", "yyyy-MM-dd HH:mm:ss").alias("period"),
        "n",
        "failures",
        F.round("failure_rate", 6).alias("failure_rate"),
        F.round(F.coalesce("mean_latency_ms", F.lit(-1.0)), 6).alias("mean_latency_ms"),
    )


@register("agg_service_window", _WINDOWS.format(""))
def agg_service_window(spark, d):
    return _windows(health.outcome_windows(bind.service_events(spark, d)))


def _task_events(events):
    op = F.expr(_OP)
    return events.select(F.col("event_id").alias("event_seq"), op.alias("op"))


@register(
    "str_queue",
    f"""SELECT event_seq, op,
              CAST(sum(CASE op WHEN 'submit' THEN 1 WHEN 'start' THEN -1 ELSE 0 END)
                   OVER (ORDER BY event_seq) AS BIGINT) AS pending,
              CAST(sum(CASE op WHEN 'start' THEN 1 WHEN 'finish' THEN -1 ELSE 0 END)
                   OVER (ORDER BY event_seq) AS BIGINT) AS active,
              4 AS max_workers
       FROM (SELECT event_id AS event_seq, {_OP} AS op FROM events)""",
)
def str_queue(spark, d):
    return health.task_gauge(_task_events(bind.table(spark, d, "events")))


@register(
    "str_queue_now",
    f"""SELECT CAST(sum(CASE op WHEN 'submit' THEN 1 WHEN 'start' THEN -1 ELSE 0 END) AS BIGINT)
                AS pending,
              CAST(sum(CASE op WHEN 'start' THEN 1 WHEN 'finish' THEN -1 ELSE 0 END) AS BIGINT)
                AS active, 4 AS max_workers
       FROM (SELECT {_OP} AS op FROM events)""",
)
def str_queue_now(spark, d):
    path, checkpoint = _paths(spark, "gauge")
    _finish(jobs.task_gauge(_task_events(stream(spark, d, "events")), path, checkpoint))
    return jobs.last_batch(spark, path)


def service_stream(spark, d):
    return bind.as_service_events(stream(spark, d, "events"))


@register("str_service_state", _STATE)
def str_service_state(spark, d):
    path, checkpoint = _paths(spark, "services")
    _finish(jobs.service_state(service_stream(spark, d), path, checkpoint, bind.SERVICES))
    return _state(jobs.read_service_state(spark, path, bind.SERVICES))


@register(
    "str_service_window",
    _WINDOWS.format(
        """WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE
             <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE
                 FROM service_events)"""
    ),
)
def str_service_window(spark, d):
    path, checkpoint = _paths(spark, "windows")
    _finish(jobs.service_windows(service_stream(spark, d), path, checkpoint))
    return _windows(spark.read.parquet(path))


@register("str_ingest", "SELECT file_id, chunk_idx, content FROM final_chunks", texts.PARTS)
def str_ingest(spark, d):
    path, checkpoint = _paths(spark, "chunks")
    arriving = bind.as_texts(stream(spark, d, "documents"))
    _finish(jobs.ingest(arriving, path, checkpoint))
    return spark.read.parquet(path).select("file_id", "chunk_idx", "content")


@register(
    "str_poll",
    """SELECT kb_id, bool_or(status = 'gray') AS pending FROM files GROUP BY kb_id""",
)
def str_poll(spark, d):
    path, checkpoint = _paths(spark, "pending")
    arriving = bind.as_files(stream(spark, d, "documents"))
    steps = arriving.select(
        "kb_id",
        "file_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("seq"), F.lit("gray").alias("status")),
                F.struct(F.lit(1).alias("seq"), F.col("status")),
            )
        ).alias("step"),
    ).select("kb_id", "file_id", "step.seq", "step.status")
    _finish(jobs.pending(steps, path, checkpoint))
    return jobs.read_pending(spark, path)
