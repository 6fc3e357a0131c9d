"""Inputs that once lost data or failed a whole job."""

import pytest
from pyspark.sql import functions as F

from shelfspark.config import Settings
from shelfspark.functions.names import truncate_name
from shelfspark.functions.text import html_text
from shelfspark.functions.tokens import context_budget
from shelfspark.operators import dml
from shelfspark.plans import ingest
from shelfspark.sources import documents, tables
from shelfspark.storage import fresh_path
from shelfspark.streaming import jobs
from shelfspark.workload import office
from tests.test_events import arrive


def test_later_parts_of_a_file_are_taken(spark):
    src, out, mark = (fresh_path(spark, n) for n in ("texts", "chunks", "mark"))
    schema = "file_id string, part int, text string"
    batches = (
        [("a", 0, "one. two."), ("b", 0, "b. first."), ("b", 0, "a. second.")],
        [("a", 1, "three."), ("a", 0, "again.")],
        [("a", 2, "four."), ("c", 0, "five.")],
    )
    for rows in batches:
        arrive(spark, src, rows, schema)
        jobs.ingest(spark.readStream.schema(schema).parquet(src), out, mark).awaitTermination()
    got = sorted((r["chunk_id"], r["content"]) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a_0", "one."),
        ("a_1", "two."),
        ("a_2", "three."),
        ("a_3", "four."),
        ("b_0", "a."),
        ("b_1", "second."),
        ("c_0", "five."),
    ]


def written(spark, *lines):
    path = fresh_path(spark, "csv")
    for text in lines:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def cells(rows):
    return sorted([[c["value"] for c in r["cells"]] for r in rows.collect()], key=str)


def test_both_csv_readers_agree_on_ragged_rows(spark):
    text = 'a,b,c\n1,2,3\n4,5\n6,,7\n"x,y",z'
    table = tables.csv_table(spark, written(spark, text))
    single = tables.csv_files(spark.createDataFrame([("f", text)], "file_id string, text string"))
    assert cells(table) == cells(single)


def test_surplus_cells_and_other_headers_are_errors(spark):
    with pytest.raises(Exception, match="more cells"):
        tables.csv_table(spark, written(spark, "a,b\n1,2,3")).collect()
    with pytest.raises(Exception, match="header does not conform"):
        tables.csv_table(spark, written(spark, "a,b\n1,2", "b,a\n3,4")).collect()


def test_a_broken_file_harms_no_other(spark):
    good = office.word_file("fine") if hasattr(office, "word_file") else None
    files = [("bad", b"no zip at all")] + ([("good", good)] if good else [])
    parts = documents.word_parts(spark.createDataFrame(files, "file_id string, content binary"))
    assert [r["file_id"] for r in documents.failures(parts).collect()] == ["bad"]
    assert "bad" not in {r["file_id"] for r in documents.word_documents(parts).collect()}
    slides = documents.slide_parts(spark.createDataFrame([("bad", b"x")], "file_id string, content binary"))
    assert documents.slide_documents(slides).collect() == []
    books = tables.xlsx_files(spark.createDataFrame([("bad", b"x")], "file_id string, content binary"))
    assert books.collect() == []
    texts = spark.createDataFrame([("bad", "a,b\n1,2,3"), ("good", "a\n1")], "file_id string, text string")
    assert [r["file_id"] for r in tables.csv_files(texts).collect()] == ["good"]


def test_unknown_charset_of_a_mail():
    raw = b"Subject: s\nContent-Type: text/plain; charset=x-none\n\nbody"
    assert documents.mail_text(raw) == "Subject: s\n\nbody"


def test_default_charsets(spark):
    texts = {
        "für Größe über die Straße": "latin-1",
        "l'été à la forêt, où ça déçoit": "latin-1",
        "el niño pequeñó acción": "latin-1",
        "这是一个中文的文件，内容很多": "gb18030",
        "plain": "ascii",
    }
    rows = [(t, bytearray(t.encode(c))) for t, c in texts.items()]
    got = spark.createDataFrame(rows, "want string, raw binary").select("want", documents.decode_text(F.col("raw")).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_lines_of_a_large_picture_stay_in_their_shape(spark):
    parts = spark.createDataFrame([("f", 0, "text", "a", None), ("f", 2, "text", "c", None)], documents.PARTS_SCHEMA)
    lines = spark.createDataFrame([("f", 1, 5, "b"), ("f", 1, 250_000, "b2")], "file_id string, pos bigint, line_no int, text string")
    assert documents.slide_documents(parts, lines).head()["text"] == "a\n\nb\n\nb2\n\nc"


def test_only_the_users_files_are_cleaned(spark):
    kbs = spark.createDataFrame([("k1", "u1", 0), ("k2", "u2", 0)], "kb_id string, user_id string, deleted int")
    files = spark.createDataFrame(
        [("f1", "k1", "a", "gray", "t", 0), ("f2", "k2", "b", "gray", "t", 0)],
        "file_id string, kb_id string, file_name string, status string, timestamp string, deleted int",
    )
    assert [r["file_id"] for r in dml.clean_by_status(files, kbs, "gray", "u1", 1).collect()] == ["f1"]


def test_recognised_text_of_pictures_stays_whole(spark):
    rows = [("f", 0, "one. two.", False), ("f", 1, "ocr a. ocr b.", True)]
    raw = spark.createDataFrame(rows, "file_id string, part int, text string, whole boolean")
    got = [r["content"] for r in ingest.chunk_texts(raw).orderBy("chunk_idx").collect()]
    assert got == ["one.", "two.", "ocr a. ocr b."]


def test_files_whose_vectors_are_not_stored_are_yellow(spark):
    raw = spark.createDataFrame([("f", "one."), ("g", "two.")], "file_id string, text string")
    files = spark.createDataFrame(
        [(f, "u", "k", f"{f}.txt") for f in "fgh"], "file_id string, user_id string, kb_id string, file_name string"
    )
    plan = ingest.ingest(raw, files, lambda texts: [[1.0, 0.0]] * len(texts), store=lambda v: v.where("file_id = 'f'"))
    _, vectors, outcome = plan
    assert {r["file_id"]: r["status"] for r in outcome.collect()} == {"f": "green", "g": "yellow", "h": "red"}
    assert [r["file_id"] for r in vectors.collect()] == ["f"]
    assert "MapInPandas" not in vectors._jdf.queryExecution().executedPlan().toString()


def test_one_counter_for_the_whole_budget(spark):
    cfg = Settings()
    rows = spark.createDataFrame([("abcdefgh", [("qq", "aaa")])], "q string, h array<struct<q:string,a:string>>")
    got = rows.select(context_budget(F.col("q"), F.col("h"), cfg, len).alias("n")).head()["n"]
    fixed = cfg.token_window - cfg.answer_tokens - cfg.offcut_tokens
    assert got == fixed - (len(cfg.prompt_template) + 3) - (8 + 3) - (5 + 3)


def test_a_tag_ends_behind_its_quoted_values(spark):
    pages = [("<p title=\"a>b\" x='c>d'>x</p>", "x"), ("<p don't>y</p> it's", "y it's"), ("<a href=x>z</a>", "z"), ("<b =>w</b>", "w")]
    got = spark.createDataFrame(pages, "html string, want string").select("want", html_text(F.col("html")).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_long_names_are_cut_as_before(spark):
    names = ["a" * n + ".txt" for n in (190, 201, 230, 3000)] + ["é" * 150 + ".md", "漢" * 900 + ".csv"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", truncate_name(F.col("n"), F.lit("20240101")).alias("t"))
    for row in got.collect():
        stem, ext = row["n"].rsplit(".", 1)
        want = row["n"]
        while len(want.encode()) > 200:
            stem = stem[:-4] if len(stem) > 4 else ""
            want = f"{stem}_20240101.{ext}"
        assert row["t"] == want
