"""Files of all kinds to texts, with an error row for each that cannot be read."""

import pytest
from pyspark.sql import functions as F

from shelfspark.config import Settings
from shelfspark.plans.files import folder_files, read_files, read_folder
from shelfspark.plans.ingest import ingest
from shelfspark.sources import documents, tables
from shelfspark.storage import fresh_path
from shelfspark.workload import office


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    (path / "sub").mkdir()
    files = {
        "a.TXT": "中文".encode(),
        "b.md": "plain".encode(),
        "c.csv": b'k,v\n1,"x, y"\n2,\n',
        "ragged.csv": b"k\n1,2\n",
        "d.eml": b"Subject: hi\nContent-Type: text/plain\n\nbody",
        "e.docx": office.word_file(["one", "two"], b"pic|ture"),
        "broken.docx": b"no zip",
        "f.PPTX": office.slide_file([["s1"], ["s2"]]),
        "g.xlsx": office.workbook({"first": [["k"], ["v"]], "second": [["k"], ["w"], ["x"]]}),
        "broken.xlsx": b"PK no",
        "h.png": b"seen",
        "blurred.jpg": b"!",
        "i.pdf": b"%PDF",
        "j.zip": b"PK",
        "sub/k.txt": b"deep",
    }
    for name, content in files.items():
        (path / name).write_bytes(content)
    return str(path)


def ocr(raw):
    if raw == b"!":
        raise ValueError("blurred")
    return raw.decode().split("|")


RULE = "-" * 24


def texts(df, names):
    rows = df.join(names, "file_id").collect()
    good = {(r["file_name"], r["part"]): r["text"] for r in rows if r["error"] is None}
    return good, {r["file_name"]: r["error"] for r in rows if r["error"] is not None}


def test_folder(spark, folder):
    names = folder_files(spark, folder).select("file_id", "file_name")
    good, bad = texts(read_folder(spark, folder, ocr=ocr), names)
    row = lambda text: f"{RULE}\n{text}\n{RULE}"
    assert good == {
        ("a.TXT", 0): "中文", ("b.md", 0): "plain", ("k.txt", 0): "deep",
        ("c.csv", 0): row("k: 1 & v: x, y"), ("c.csv", 1): row("k: 2 & v: x, y"),
        ("d.eml", 0): "Subject: hi\n\nbody", ("e.docx", 0): "one\n\ntwo", ("e.docx", 1): "pic\nture",
        ("f.PPTX", 0): "s1\n\ns2", ("g.xlsx", 0): row("k: v"), ("g.xlsx", 1): row("k: w"), ("g.xlsx", 2): row("k: x"),
        ("h.png", 0): "seen",
    }
    assert set(bad) == {"ragged.csv", "broken.docx", "broken.xlsx", "blurred.jpg", "i.pdf", "j.zip"}
    assert bad["blurred.jpg"] == "ValueError: blurred" and "more cells" in bad["ragged.csv"] and "no parser" in bad["j.zip"]


def test_a_table_of_files_gives_the_same(spark, folder):
    files = folder_files(spark, folder)
    key = lambda df: sorted((r["file_id"], r["part"], r["text"] or "", r["error"] or "") for r in df.collect())
    assert key(read_files(files, ocr)) == key(read_folder(spark, folder, ocr=ocr))


def test_only_files_of_a_kind_are_opened(spark, folder):
    assert {r["file_name"] for r in folder_files(spark, folder, "image").collect()} == {"h.png", "blurred.jpg"}
    assert {r["file_name"] for r in folder_files(spark, folder, "text").collect()} == {"a.TXT", "b.md", "k.txt"}


def test_scanned_pages_and_metadata(spark, folder):
    files = folder_files(spark, folder)
    pdf = files.where("file_name = 'i.pdf'").head()["file_id"]
    lines = spark.createDataFrame([(pdf, 1, 0, "one"), (pdf, 2, 0, "two")], "file_id string, page int, line_no int, text string")
    read = read_files(files, ocr, lines).where(F.col("file_id") == pdf).head()
    assert read["text"] == "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo"
    assert read["metadata"] == {"filename": "i.pdf", "filetype": "pdf", "page_count": "2"}
    rows = read_files(files, ocr).where("metadata['row'] = '1'").collect()
    assert rows and all(r["metadata"]["source"] == r["file_id"] for r in rows)


def test_statuses_of_an_ingest(spark, folder):
    """Broken and unsupported files end red, files that the store loses yellow, others green."""
    files = folder_files(spark, folder).withColumns({"kb_id": F.lit("k"), "user_id": F.lit("u")})
    read = read_files(files, ocr).where("error is null").select("file_id", "part", "text", "whole")
    lost = files.where("file_name in ('a.TXT', 'g.xlsx')").select("file_id")
    path = fresh_path(spark, "vectors")

    def store(vectors):
        vectors.join(lost, "file_id", "left_anti").write.parquet(path)
        return spark.read.parquet(path).select("file_id").distinct()

    _, vectors, outcome = ingest(read, files, lambda ts: [[1.0] for _ in ts], Settings(), store=store)
    status = {r["file_name"]: r["status"] for r in outcome.join(files, "file_id").collect()}
    red = {"ragged.csv", "broken.docx", "broken.xlsx", "blurred.jpg", "i.pdf", "j.zip"}
    assert {n for n, s in status.items() if s == "red"} == red
    assert {n for n, s in status.items() if s == "yellow"} == {"a.TXT", "g.xlsx"}
    assert vectors.join(lost, "file_id", "left_semi").isEmpty()


def test_ragged_file_harms_no_other(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv").write_text("k,v\n1,2,3\n4,5\n")
    rows = tables.csv_table(spark, str(tmp_path))
    assert [r["row"] for r in rows.where("cells is not null").collect()] == [0]
    (failed,) = tables.failures(rows).collect()
    assert failed["file_id"].endswith("b.csv") and "more cells" in failed["error"]
    assert tables.row_documents(rows).count() == 1


def test_office_files_are_opened_once(spark):
    opened = spark.sparkContext.accumulator(0)

    def reader(content):
        opened.add(1)
        if content == b"bad":
            raise ValueError("bad")
        yield "text", content.decode(), None

    rows = [("a", b"one"), ("b", b"two"), ("c", b"bad")]
    parts = documents._parts(spark.createDataFrame(rows, "file_id string, content binary"), reader)
    texts = sorted(tuple(r) for r in documents.slide_documents(parts).collect())
    failed = [tuple(r) for r in documents.failures(parts).collect()]
    assert (texts, failed, opened.value) == ([("a", "one"), ("b", "two")], [("c", "ValueError: bad")], 3)


def test_files_are_read_once(spark):
    """What gives the contents runs once a table file, and what gives the texts once in an ingest."""
    ran = spark.sparkContext.accumulator(0)

    def given(value):
        ran.add(1)
        return value

    again = F.udf(given, "string")
    rows = spark.createDataFrame([("f", "a.csv", "k,v\n1,2\n3,\n"), ("g", "b.csv", "k\n1,2\n")], "file_id string, file_name string, body string")
    files = rows.select("file_id", "file_name", again("body").cast("binary").alias("content"))
    read = read_files(files)
    got = {(r["file_id"], r["part"]): r["text"] for r in read.where("error is null").collect()}
    assert got.keys() == {("f", 0), ("f", 1)} and ran.value == 2
    before = ran.value
    raw = spark.createDataFrame([("f", 0, "one. two."), ("f", 1, "three."), ("g", 0, "four.")], "file_id string, part int, text string")
    raw = raw.select("file_id", "part", again("text").alias("text"))
    owned = rows.select("file_id", "file_name", F.lit("k").alias("kb_id"), F.lit("u").alias("user_id"))
    chunks, _, outcome = ingest(raw, owned.withColumn("file_name", F.lit("a.txt")), lambda texts: [[1.0]] * len(texts))
    assert sorted((r["chunk_id"], r["content"]) for r in chunks.collect()) == [("f_0", "one."), ("f_1", "two."), ("f_2", "three."), ("g_0", "four.")]
    assert {r["file_id"]: (r["chunk_size"], r["status"]) for r in outcome.collect()} == {"f": (3, "green"), "g": (1, "green")}
    assert ran.value - before == 3
