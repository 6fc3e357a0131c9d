"""Answer streams, conversations, service state and the streaming jobs."""

from datetime import datetime

from pyspark.sql import functions as F

from shelfspark import models
from shelfspark.functions import answers as parse
from shelfspark.operators import answers, health
from shelfspark.storage import fresh_path
from shelfspark.streaming import jobs

EVENTS = "service string, ts timestamp, seq bigint, status string, detail string, latency_ms double"


def at(minute, second=0):
    return datetime(2024, 1, 1, 0, minute, second)


ROWS = [
    ("llm", at(3), 3, "unhealthy", None, None),
    ("llm", at(1), 1, "healthy", "ok", 12.0),
    ("llm", at(2), 2, "healthy", None, 15.0),
    ("rerank", at(1), 4, "disabled", "off", None),
    ("mystery", at(1), 5, "unhealthy", "x", 1.0),
]


def test_service_state(spark):
    state = {r["service"]: r for r in health.service_state(spark.createDataFrame(ROWS, EVENTS)).collect()}
    assert len(state) == 7
    llm = state["llm"]
    assert (llm["status"], llm["detail"], llm["latency_ms"]) == ("unhealthy", "ok", 15.0)
    assert (llm["last_check"], llm["last_success"]) == (at(3), at(2))
    assert state["gpu"]["status"] == "unknown" and state["gpu"]["detail"] == ""


def test_overall(spark):
    def overall(rows):
        state = health.service_state(spark.createDataFrame(rows, EVENTS))
        return health.overall(state).head()["status"]

    assert overall(ROWS) == "degraded"
    assert overall([r for r in ROWS if r[0] == "rerank"]) == "ok"


def test_fold_answers(spark):
    rows = [
        ("a", 2, 'data: {"answer": "lo"}'), ("a", 1, 'data: {"answer": "Hel"}'), ("a", 3, "data: [DONE]\n\n"),
        ("a", 4, 'data: {"answer": "late"}'), ("b", 1, "data: {bad"), ("b", 2, 'data: {"answer": "x"}'),
        ("b", 3, 'data: {"other": 1}'),
    ]
    df = spark.createDataFrame(rows, "stream_id string, seq bigint, raw string")
    got = {r["stream_id"]: (r["answer"], r["done"]) for r in answers.fold_answers(df).collect()}
    assert got == {"a": ("Hello", True), "b": ("x", False)}


def think_model(chunks):
    inside, out = False, []
    for text in chunks:
        if not text:
            continue
        inside = inside or "<think>" in text
        if inside:
            if "</think>" not in text:
                continue
            text, inside = text.split("</think>", 1)[1], False
        if text.strip():
            out.append(text.strip())
    return out


def test_think_stream(spark):
    streams = {
        "a": ["<think>hm", "still", "so</think> Yes", " and", ""],
        "b": ["plain", "</think> odd", "x<think>y</think>z", "<think>", "never closed"],
        "c": ["</think>t<think>u", "v", "</think>"],
    }
    df = spark.createDataFrame(
        [(k, i, t) for k, ts in streams.items() for i, t in enumerate(ts)],
        "stream_id string, seq int, content string",
    )
    got = answers.strip_think_stream(df).orderBy("stream_id", "seq").collect()
    for key, chunks in streams.items():
        assert [r["content"] for r in got if r["stream_id"] == key] == think_model(chunks)
    one = spark.createDataFrame([("<think>a\nb</think> \n c <think>d</think>",)], "t string")
    assert one.select(parse.strip_think(F.col("t"))).head()[0] == "c"


def test_history(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
            (1, 4, "user", "q3"), (1, 5, "assistant", "a3"), (1, 6, "user", "q4"),
            (2, 0, "user", "x"), (2, 1, "system", "s"), (2, 5, "assistant", "y"), (2, 6, "system", "t"), (2, 9, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): [tuple(p) for p in r["history"]] for r in answers.with_history(df).collect()}
    first = {(1, 1): [], (1, 3): [("q1", "a1")], (1, 4): [("q1", "a1")], (1, 6): [("q3", "a3")]}
    assert got == {**first, (2, 0): [], (2, 9): [("x", "y")]}


def test_embed_retries_and_errors(spark):
    from dataclasses import replace

    from shelfspark.config import Settings

    cfg = replace(Settings(), embed_batch=2, embed_delay_seconds=0.0)

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[len(t)] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "bad", "c", "dddd"])], "i int, content string")
    got = {r["i"]: r for r in models.embed(df.coalesce(1), model, cfg=cfg).collect()}
    assert got[4]["embedding"] == [4.0] and got[0]["embedding_error"] is None
    assert got[2]["embedding"] is None and got[3]["embedding_error"] == "down"


def test_rerank_default_and_answers(spark):
    pairs = spark.createDataFrame([("q", "what", "c")], "query_id string, question string, content string")
    assert models.rerank_scores(pairs).head()["rerank_score"] == 0.5
    assert models.rerank_scores(pairs, lambda q, p: 1 / 0).head()["rerank_score"] is None
    chats = spark.createDataFrame([([("user", "hi")],)], "messages array<struct<role:string,content:string>>")
    assert models.generate(chats, lambda m: m[0]["content"] + "!").head()["answer"] == "hi!"
    assert models.generate(chats, lambda m: m[9]).head()["answer"].startswith("LLM Error: ")


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_streams_over_two_arrivals(spark):
    src, out, mark = (fresh_path(spark, n) for n in ("src", "out", "mark"))
    for rows in (ROWS[:2], ROWS[2:]):
        arrive(spark, src, rows, EVENTS)
        stream = spark.readStream.schema(EVENTS).parquet(src)
        jobs.service_state(stream, out, mark).awaitTermination()
    streamed = jobs.read_service_state(spark, out).orderBy("service").collect()
    assert streamed == health.service_state(spark.createDataFrame(ROWS, EVENTS)).orderBy("service").collect()


def test_ingest_stream_takes_a_file_once(spark):
    src, out, mark = (fresh_path(spark, n) for n in ("texts", "chunks", "mark"))
    schema = "file_id string, text string"
    for rows in ([("a", "one. two."), ("a", "one. two.")], [("a", "again."), ("b", "three.")]):
        arrive(spark, src, rows, schema)
        jobs.ingest(spark.readStream.schema(schema).parquet(src), out, mark).awaitTermination()
    got = sorted((r["chunk_id"], r["content"]) for r in spark.read.parquet(out).collect())
    assert got == [("a_0", "one."), ("a_1", "two."), ("b_0", "three.")]


LINES = "stream_id string, seq bigint, raw string, ts timestamp"


def line(stream, seq, text, minute=0):
    from datetime import datetime, timedelta

    raw = "data: [DONE]\n\n" if text is None else f'data: {{"answer": "{text}"}}\n\n'
    return (stream, seq, raw, datetime(2024, 1, 1) + timedelta(minutes=minute))


def test_answer_streams(spark):
    """Out of order, repeated, never ending and incomplete streams; each has one final record."""
    src, out, mark = (fresh_path(spark, n) for n in ("lines", "answers", "mark"))
    arrivals = [
        [line("order", 2, None), line("order", 1, "b"), line("twice", 0, "x"), line("twice", 0, "y"),
         line("endless", 0, "so "), line("endless", 1, "far"), line("gap", 0, "g"), line("gap", 2, "p"), line("gap", 3, None)],
        [line("order", 0, "a", 1), line("twice", 1, None, 1), line("twice", 1, None, 1), line("silent", 0, None, 2)],
        [line("twice", 0, "z", 5), line("order", 2, None, 5), (None, 0, "", line("", 0, None, 30)[3])],
        [line("late", 0, None, 40), (None, 0, "", line("", 0, None, 90)[3])],
    ]
    for rows in arrivals:
        arrive(spark, src, rows, LINES)
        jobs.answers(spark.readStream.schema(LINES).parquet(src), out, mark, 600).awaitTermination()
    got = sorted(((r["stream_id"], r["answer"], r["done"], r["error"]) for r in jobs.read_answers(spark, out).collect()))
    assert got == [
        ("endless", "so far", False, "no closing line"),
        ("gap", "g", False, "piece 1 is missing"),
        ("late", "", True, None),
        ("order", "ab", True, None),
        ("silent", "", True, None),
        ("twice", "x", True, None),
    ]


def test_one_bad_picture_harms_no_other(spark):
    images = spark.createDataFrame([("a", b"one|two"), ("b", b""), ("c", b"x")], "file_id string, image binary")

    def model(raw):
        if not raw:
            raise ValueError("blank")
        return raw.decode().split("|")

    got = sorted(((r["file_id"], r["line_no"], r["text"], r["error"]) for r in models.recognise(images, model).collect()), key=str)
    assert got == [("a", 0, "one", None), ("a", 1, "two", None), ("b", None, None, "ValueError: blank"), ("c", 0, "x", None)]


def test_models_are_not_run_again_for_a_filter(spark):
    pairs = spark.createDataFrame([("q", "what", "c")], "query_id string, question string, content string")
    scored = models.rerank_scores(pairs, lambda q, p: [0.9] * len(p)).where("rerank_score > 0.5 and rerank_score < 1")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("score(question") == 1


def test_ingest_stream_carries_titles_and_statuses(spark):
    """Parts over two batches: titles go on, red and yellow are reached, a replay changes nothing."""
    from dataclasses import replace

    from shelfspark.config import Settings

    src, out, mark, index = (fresh_path(spark, n) for n in ("texts", "chunks", "mark", "index"))
    cfg = replace(Settings(), title_enhance=True, embed_attempts=1, embed_batch=1)
    files = spark.createDataFrame(
        [(f, "u", "k", f"{f}.txt") for f in ("a", "bad", "lost")], "file_id string, user_id string, kb_id string, file_name string"
    )

    def model(texts):
        if any("worse" in t for t in texts):
            raise RuntimeError("cannot embed")
        return [[1.0, 2.0] for _ in texts]

    def store(vectors):
        vectors.where("file_id != 'lost'").write.mode("append").parquet(index)
        return spark.read.parquet(index).select("file_id").distinct()

    schema = "file_id string, part int, text string"
    arrivals = [
        [("a", 0, "第一章标题\n\n内容在这里。"), ("bad", 0, "fine."), ("lost", 0, "one.")],
        [("a", 1, "后面的内容也很长。"), ("a", 0, "again."), ("bad", 1, "worse.")],
    ]
    for rows in arrivals:
        arrive(spark, src, rows, schema)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.ingest(stream, out, mark, cfg, files, model, store).awaitTermination()
    got = {(r["file_id"], r["chunk_idx"]): r["content"] for r in spark.read.parquet(out).collect()}
    own = [got[k] for k in sorted(got) if k[0] == "a"]
    assert sorted(k[1] for k in got if k[0] == "a") == list(range(len(own)))
    assert own[-1] == "下文与(第一章标题)有关。后面的内容也很长。"
    assert {r["file_id"]: r["status"] for r in jobs.read_status(spark, out).collect()} == {"a": "green", "bad": "red", "lost": "yellow"}
    assert {r["file_id"] for r in spark.read.parquet(f"{out}-vectors").collect()} == {"a", "bad"}


def test_small_batches_are_handed_over_in_runs(monkeypatch):
    """A task hands its threads runs of batches, in order, however small a batch is."""
    from concurrent.futures import ThreadPoolExecutor
    from dataclasses import replace
    from types import SimpleNamespace

    import pyarrow as pa

    from shelfspark.config import Settings

    handed = []

    class Pool(ThreadPoolExecutor):
        def submit(self, *args, **options):
            handed.append(1)
            return super().submit(*args, **options)

    monkeypatch.setattr(models, "ThreadPoolExecutor", Pool)
    frame = SimpleNamespace(schema=SimpleNamespace(fields=[]), mapInArrow=lambda run, schema: run)
    run = models.embed(frame, lambda texts: [[float(t)] for t in texts], cfg=replace(Settings(), embed_batch=1))
    (got,) = run(iter([pa.RecordBatch.from_pydict({"content": [str(i) for i in range(5000)]})]))
    assert got.column("embedding").to_pylist() == [[float(i)] for i in range(5000)]
    assert len(handed) < 100
