"""Catalogue, state changes, scans and sources on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import names
from shelfspark.operators import catalog, dml, fts, scan
from shelfspark.schema import FILE_EVENTS, require_columns
from shelfspark.sources import documents, tables, web
from shelfspark.storage import fresh_path
from shelfspark.workload import office


@pytest.fixture(scope="module")
def catalogue(spark):
    users = spark.createDataFrame([("u1", "A"), ("u2", "B")], "user_id string, user_name string")
    kbs = spark.createDataFrame(
        [("k1", "u1", "one", 0), ("k2", "u1", "two", 1), ("k3", "u2", "three", 0), ("k4", "u1", "empty", 0)],
        "kb_id string, user_id string, kb_name string, deleted int",
    )
    files = spark.createDataFrame(
        [("f1", "k1", "a.txt", "green", 0), ("f2", "k1", "b.txt", "gray", 0), ("f3", "k1", "c.txt", "red", 1),
         ("f4", "k2", "d.txt", "green", 0), ("f5", "k3", "e.txt", "yellow", 0)],
        "file_id string, kb_id string, file_name string, status string, deleted int",
    )
    return users, kbs, files


def test_total_status_counts_zeros(catalogue):
    _, kbs, files = catalogue
    rows = {r["kb_key"]: r[2:] for r in catalog.total_status(files, kbs).collect()}
    assert rows == {"onek1": (1, 0, 0, 1), "threek3": (0, 1, 0, 0), "emptyk4": (0, 0, 0, 0)}


def test_ownership_ignores_deleted_bases(catalogue):
    _, kbs, files = catalogue
    owned = {r["file_id"] for r in catalog.owned_files(files, kbs, "u1").collect()}
    assert owned == {"f1", "f2", "f4"}


def test_register_and_missing(spark, catalogue):
    users, kbs, _ = catalogue
    incoming = spark.createDataFrame(
        [("n1", "u1", "k1"), ("n2", "u1", "k2"), ("n3", "u9", "k1")], "f string, user_id string, kb_id string"
    )
    got = {r["f"]: r["msg"] for r in catalog.register_files(incoming, kbs, users).collect()}
    assert got == {
        "n1": "success", "n2": "invalid kb_id, please check ['k2']", "n3": "invalid user_id, please check...",
    }
    asked = incoming.select("user_id", "kb_id")
    assert {tuple(r) for r in catalog.missing_kbs(asked, kbs).collect()} == {("u1", "k2"), ("u9", "k1")}


def test_soft_upload(spark, catalogue):
    _, _, files = catalogue
    incoming = spark.createDataFrame(
        [("k1", "a.txt"), ("k1", "c.txt"), ("k1", "new"), ("k1", "new")], "kb_id string, file_name string"
    )
    taken = sorted(r["file_name"] for r in catalog.accept_uploads(incoming, files).collect())
    assert taken == ["c.txt", "new", "new"]
    assert catalog.accept_uploads(incoming, files, "strong").count() == 4


def test_swap_and_clean(spark, catalogue):
    _, kbs, files = catalogue
    asked = files.select("file_id")
    swapped = {r["file_id"]: r["status"] for r in dml.swap_status(files, asked, "gray", "red").collect()}
    assert swapped["f2"] == "red" and swapped["f1"] == "green"
    gone = dml.clean_by_status(files, kbs, "gray", "u1", 5).collect()
    assert [(r["file_id"], r["op"], r["seq"]) for r in gone] == [("f2", "delete", 5)]
    _, inside = dml.delete_kb_events(kbs, files, spark.createDataFrame([("u2", "k1"), ("u1", "k1")], "user_id string, kb_id string"), 7)
    assert {r["file_id"] for r in inside.collect()} == {"f1", "f2", "f3"}


def test_fold_keeps_last_known_attributes(spark):
    rows = [
        ("f", "k", 3, "update", None, "green", None, None, 40, None),
        ("f", "k", 1, "add", "a.txt", "gray", "202401010000", None, None, None),
        ("f", "k", 2, "update", None, None, None, 12, None, None),
        ("g", "k", 4, "add", "b.txt", "gray", "202401010000", None, None, None),
        ("g", "k", 5, "delete", None, None, None, None, None, None),
    ]
    folded = {r["file_id"]: r for r in dml.fold_files(spark.createDataFrame(rows, FILE_EVENTS)).collect()}
    f = folded["f"]
    assert (f["status"], f["file_size"], f["content_length"], f["chunk_size"], f["deleted"]) == ("green", 12, 40, -1, 0)
    assert folded["g"]["deleted"] == 1


def test_required_columns(spark):
    with pytest.raises(ValueError):
        require_columns(spark.createDataFrame([("x",)], "file_id string"), "files")


def test_names(spark):
    cases = {
        "a%2Fb（全角）.txt": "a_b全角.txt", "100%": "100%", "a+b": "a+b", "%E4%B8%AD.md": "中.md", "x%zz": "x%zz",
    }
    df = spark.createDataFrame([(c,) for c in cases], "n string")
    assert {r[0]: r[1] for r in df.select("n", names.clean_name(F.col("n"))).collect()} == cases
    exts = {"a.tar.gz": ".gz", ".bashrc": "", "..a.b": ".b", "plain": "", "d.x/plain": "", "a.": "."}
    df = spark.createDataFrame([(c,) for c in exts], "n string")
    assert {r[0]: r[1] for r in df.select("n", names.extension(F.col("n"))).collect()} == exts
    for name in ("中" * 80 + ".md", "b" * 196 + ".txt", "c" * 197 + ".txt", ".hidden" + "d" * 300):
        got = spark.createDataFrame([(name,)], "n string").select(
            names.truncate_name(F.col("n"), F.lit("1700000000"))
        ).head()[0]
        stem, ext = (name, "") if name.startswith(".h") else (name.rsplit(".", 1)[0], "." + name.rsplit(".", 1)[1])
        want, stem_left = name, stem
        while len(want.encode()) > 200:
            stem_left = stem_left[:-4]
            want = f"{stem_left}_1700000000{ext}"
        assert got == want


def test_fill_forward_over_blocks(spark):
    rows = [("a", i, "v" + str(i) if i in (2, 3, 17) else None) for i in range(40)] + [("b", 5, None)]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    for inclusive in (True, False):
        got = {
            (r["k"], r["n"]): r["out"]
            for r in scan.fill_forward(df, ["k"], "n", "v", "out", inclusive, block_rows=4).collect()
        }
        last = None
        for _, n, v in rows[:40]:
            before, last = last, v or last
            assert got[("a", n)] == (last if inclusive else before)
        assert got[("b", 5)] is None


def test_dense_ids_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"), F.lit(2).alias("two"))
    ids = {r["n"]: r["i"] for r in scan.dense_ids(df, ["n"], "i", 5).collect()}
    assert ids == {n: n + 5 for n in range(1000)}
    sums = {r["n"]: r["s"] for r in scan.running_sums(df, ["n"], {"s": "two"}).collect()}
    assert sums == {n: 2 * (n + 1) for n in range(1000)}


def test_ordered_concat_in_blocks(spark):
    df = spark.createDataFrame([("k", i, str(i)) for i in range(50)], "k string, n int, t string")
    got = scan.ordered_concat(df, ["k"], "n", "t", "out", ",", block_rows=7).head()["out"]
    assert got == ",".join(map(str, range(50)))


def test_csv_rows(spark):
    text = 'name , age,note\nAlice, 30 ,x\n"Bob, B",, \n\nCara\n'
    rows = tables.csv_files(spark.createDataFrame([("f", text)], "file_id string, text string"))
    docs = [r["text"].split("\n")[1] for r in tables.row_documents(rows).orderBy("row").collect()]
    assert docs == [
        "name: Alice & age: 30 & note: x",
        "name: Bob, B & age:  30  & note: ",
        "name: Cara & age:  30  & note:  ",
    ]
    short = tables.csv_files(spark.createDataFrame([("f", "a,b\n1\n")], "file_id string, text string"))
    assert "b: None" in tables.row_documents(short).head()["text"]
    kept = tables.row_documents(rows, "name ", ("note",)).orderBy("row").collect()
    assert kept[0]["metadata"]["source"] == "Alice" and kept[0]["metadata"]["note"] == "x"
    assert "note" not in kept[0]["text"]
    with pytest.raises(Exception, match="not found"):
        tables.row_documents(rows, "absent").collect()


def test_csv_table_numbers_rows_over_splits(spark):
    path = fresh_path(spark, "csv")
    spark.range(3000).select("id", F.concat(F.lit("v"), "id").alias("v")).coalesce(1).write.csv(path, header=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.csv(path, header=True).rdd.getNumPartitions() > 1
        rows = tables.csv_table(spark, path)
        got = {r["row"]: r["cells"][0]["value"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i: str(i) for i in range(3000)}


def test_xlsx(spark):
    book = office.workbook({"S": [["n", "age"], ["Al", 30], [None, None], ["Bo", None]], "T": [["x"], [True]], "E": []})
    rows = tables.xlsx_files(spark.createDataFrame([("b", book)], "file_id string, content binary"))
    got = sorted((r["sheet"], r["text"].split("\n")[1]) for r in tables.row_documents(rows).collect())
    assert got == [("S", "n: Al & age: 30.0"), ("S", "n: Bo & age: 30.0"), ("T", "x: True")]


def test_office_without_images(spark):
    word = spark.createDataFrame([("w", office.word_file(["a", "b"]))], "file_id string, content binary")
    assert documents.word_documents(documents.word_parts(word)).head()["text"] == "a\n\nb"
    show = spark.createDataFrame(
        [("s", office.slide_file([[" x ", ""], ["y"]])), ("e", office.slide_file([[]]))],
        "file_id string, content binary",
    )
    parts = documents.slide_parts(show)
    got = {r["file_id"]: r["text"] for r in documents.slide_documents(parts).collect()}
    assert got["s"] == "x\n\ny"


def test_mail(spark):
    multi = (
        b"Subject: Hi\r\nContent-Type: multipart/alternative; boundary=B\r\n\r\n--B\r\n"
        b"Content-Type: text/plain; charset=gbk\r\n\r\n" + "正文".encode("gbk") + b"\r\n--B\r\n"
        b"Content-Type: text/html\r\n\r\n<p>no</p>\r\n--B--\r\n"
    )
    df = spark.createDataFrame([("m", multi), ("n", b"From: a\r\n\r\nbody")], "file_id string, content binary")
    got = {r["file_id"]: r["text"] for r in documents.mail_documents(df).collect()}
    assert got == {"m": "Subject: Hi\n\n正文", "n": "body"}


def test_decode(spark):
    df = spark.createDataFrame([("中文".encode(),), ("中文".encode("gb18030"),)], "c binary")
    assert [r[0] for r in df.select(documents.decode_text(F.col("c"))).collect()] == ["中文"] * 2


def test_links_and_crawl(spark):
    html = '<a href="a/#x">1</a><a class=c href=\'/b\'>2</a><A HREF=http://o/>3</A><a>4</a><a href="a/?q=1&amp;r">5</a>'
    pages = spark.createDataFrame([("http://h/", html)], "url string, html string")
    got = {r["dst"] for r in web.links(pages).collect()}
    assert got == {"http://h/a/", "http://h/b", "http://h/", "http://h/a/?q=1&r"}
    edges = spark.createDataFrame(
        [("r/", "r/a/"), ("r/", "r/x"), ("r/a/", "r/a/b/"), ("r/a/b/", "r/a/"), ("r/a/", "r/a/y"),
         ("r/x", "r/x/never"), ("r/a/b/", "r/a/b/z")],
        "src string, dst string",
    )
    roots = spark.createDataFrame([("r/",)], "root string")

    def walk(**options):
        return {r["url"]: (r["depth"], r["n_emitted"]) for r in web.crawl(edges, roots, **options).collect()}

    full = {"r/": (0, 1), "r/a/": (1, 2), "r/x": (1, 1), "r/a/b/": (2, 2), "r/a/y": (2, 1), "r/a/b/z": (3, 1)}
    assert walk() == full and walk(max_depth=0) == full
    assert walk(max_depth=1) == {"r/": (0, 1), "r/a/": (1, 1), "r/x": (1, 1)}
    assert walk(exclude=("r/a/b",))["r/a/b/"] == (2, 1)


def test_token_search(spark):
    chunks = spark.createDataFrame(
        [("f1", 0, "a.txt", "f1_0", "Hello wörld"), ("f1", 1, "a.txt", "f1_1", "foo bar hello"),
         ("f2", 0, "hello.md", "f2_0", "bar foo")],
        "file_id string, chunk_idx int, file_name string, chunk_id string, content string",
    )
    index = fts.store(chunks, fresh_path(spark, "test-index"))

    def found(terms, mode="all", without=None):
        row = ("q", terms) if without is None else ("q", terms, without)
        schema = "query_id string, terms array<string>" + ("" if without is None else ", without array<string>")
        queries = spark.createDataFrame([row], schema)
        return sorted(r["chunk_id"] for r in fts.search(index, queries, 50, mode).collect())

    assert found(["HELLO"]) == ["f1_0", "f1_1", "f2_0"]
    assert found(["hello", "foo"]) == ["f1_1", "f2_0"]
    assert found(["world", "foo"], "any") == ["f1_0", "f1_1", "f2_0"]
    assert found(["foo bar"], "phrase") == ["f1_1"]
    assert found(["wo", "hel"], "prefix") == ["f1_0"]
    assert found(["hello"], without=["foo"]) == ["f1_0"]
    assert found(["absent"]) == []


def plain_matches(rows, terms, mode, without=()):
    """chunk_id of rows (file_id, chunk_idx, file_name, chunk_id, content), by looking at all."""
    split = re.compile(r"[^\W_]+").findall
    out = []
    for file_id, _, name, chunk_id, content in sorted(rows):
        fields = [split(x.lower()) for x in (content, file_id, name, chunk_id)]
        held = {t for f in fields for t in f}
        words = [w for t in terms for w in split(t.lower())]
        phrase = any(f[i : i + len(words)] == words for f in fields for i in range(len(f)))
        fits = {
            "all": all(w in held for w in words),
            "any": any(w in held for w in words),
            "phrase": phrase,
            "prefix": all(any(h.startswith(w) for h in held) for w in words),
        }
        if words and fits[mode] and not any(w in held for w in without):
            out.append(chunk_id)
    return out


@pytest.fixture(scope="module")
def many_chunks(spark):
    rnd = random.Random(5)
    words = ["the", "a"] * 20 + [f"w{i}" for i in range(40)] + ["zz", "zebra", "zeal"]
    rows = [
        (f"f{i // 7:03d}", i % 7, f"name {i % 3}", f"c{i}", " ".join(rnd.choices(words, k=rnd.choice([0, 3, 30]))))
        for i in range(300)
    ]
    rows.append(("f999", 0, "", "last", "a b a b a zebra " * 50))
    chunks = spark.createDataFrame(rows, "file_id string, chunk_idx int, file_name string, chunk_id string, content string")
    return rows, fts.store(chunks, fresh_path(spark, "test-index"))


@pytest.mark.parametrize("mode", ["all", "any", "phrase", "prefix"])
def test_stored_index_equals_a_look_at_all(spark, many_chunks, mode):
    rows, index = many_chunks
    asked = {
        "rare": ["zebra", "the"], "common": ["the", "a"], "words": ["w1 w2"], "again": ["a b a"], "none": ["absent the"],
        "short": ["z", "w1"], "empty": [""], "name": ["name 1"],
    }
    queries = spark.createDataFrame(list(asked.items()), "query_id string, terms array<string>")
    order = {r[3]: i for i, r in enumerate(sorted(rows))}
    whole, first = {}, {}
    for r in fts.match(index, queries, mode).collect():
        whole.setdefault(r["query_id"], []).append(r["chunk_id"])
    for r in sorted(fts.search(index, queries, 5, mode).collect(), key=lambda r: r["rank"]):
        first.setdefault(r["query_id"], []).append(r["chunk_id"])
    for name, terms in asked.items():
        want = plain_matches(rows, terms, mode)
        assert sorted(whole.get(name, []), key=order.get) == want, name
        assert first.get(name, []) == want[:5], name


def test_search_after_files_are_gone(spark, many_chunks):
    rows, index = many_chunks
    gone = spark.createDataFrame([("f999",), ("f003",), ("f100",)], "file_id string")
    queries = spark.createDataFrame([("q", ["the"])], "query_id string, terms array<string>")
    left = index.without_files(gone.limit(2)).without_files(gone)
    found = sorted(r["chunk_id"] for r in fts.match(left, queries).collect())
    assert found == sorted(plain_matches([r for r in rows if r[0] not in ("f999", "f003", "f100")], ["the"], "all"))


def test_search_reads_the_buckets_asked_for(spark, many_chunks):
    _, index = many_chunks
    asked = spark.createDataFrame([("zebra",)], "token string")
    plan = fts._of_tokens(index.postings.select("bucket", "token", "docs"), asked)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text and "positions" not in text
    files = {r[0] for r in plan.select(F.input_file_name()).distinct().collect()}
    assert all("bucket=" in f for f in files) and len(files) == 1
    blocks = fts.grown(index, spark.createDataFrame([("q", "ze")], "query_id string, term string"))
    assert sorted(r["token"] for r in blocks.collect()) == ["zeal", "zebra"]
    assert "GreaterThanOrEqual(last,ze)" in blocks._jdf.queryExecution().executedPlan().toString()


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("中文".encode())
    (tmp_path / "b.csv").write_text("k\nv\n")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    files = documents.binary_files(spark, str(tmp_path))
    kinds = {r["file_name"]: r["kind"] for r in files.select("file_name", "kind").collect()}
    assert kinds == {"a.TXT": "text", "b.csv": "csv", "c.bin": None}
    assert [r["file_name"] for r in documents.unsupported(files).collect()] == ["c.bin"]
    read = documents.by_kind(files, "text").select(documents.decode_text(F.col("content")).alias("t"))
    assert read.head()["t"] == "中文"


def test_sheets_hold_dates_and_types(spark):
    """Date styles, a custom format, times, gaps, repeated and missing names."""
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    styles = f"""<styleSheet xmlns="{main}"><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>
        <numFmt numFmtId="165" formatCode="0.00&quot;d&quot;"/></numFmts>
        <cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>"""
    plain = office.workbook({"s": [["day", "day", None, "n", "x"], [45293, 45293.5, "a", 1, 2.5], [45294, None, "b", None, 3]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            body = old.read(name).decode()
            for at, style in (("A2", 1), ("A3", 1), ("B2", 2), ("E2", 3), ("E3", 3)):
                body = body.replace(f'r="{at}"', f'r="{at}" s="{style}"')
            new.writestr(name, body)
        new.writestr("xl/styles.xml", styles)
    files = spark.createDataFrame([("f", out.getvalue())], "file_id string, content binary")
    rows = [[(c["name"], c["value"]) for c in r["cells"]] for r in tables.xlsx_files(files).orderBy("row").collect()]
    assert rows == [
        [("day", "2024-01-02 00:00:00"), ("day.1", "2024-01-02 12:00:00"), ("Unnamed: 2", "a"), ("n", "1.0"), ("x", "2.5")],
        [("day", "2024-01-03 00:00:00"), ("day.1", ""), ("Unnamed: 2", "b"), ("n", ""), ("x", "3.0")],
    ] or rows == [
        [("day", "2024-01-02"), ("day.1", "2024-01-02 12:00:00"), ("Unnamed: 2", "a"), ("n", "1.0"), ("x", "2.5")],
        [("day", "2024-01-03"), ("day.1", ""), ("Unnamed: 2", "b"), ("n", ""), ("x", "3.0")],
    ]


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_ends_over_splits(spark, tmp_path, seed):
    """A file cut into many splits, line ends and commas inside quotes, next to one reader."""
    import csv
    import io

    rnd = random.Random(seed)
    cell = lambda: "".join(rnd.choices(['a', 'bc', ',', '"', "\n", "\r\n", " ", "é"], k=rnd.choice([0, 1, 5, 40])))
    rows = [[str(i), cell(), cell()] for i in range(400)]
    out = io.StringIO(newline="")
    end = "\r\n" if seed % 2 else "\n"
    csv.writer(out, lineterminator=end).writerows([["k", "a", "b"], *rows])
    (tmp_path / "t.csv").write_bytes(out.getvalue().encode())
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 400)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        table = tables.csv_table(spark, str(tmp_path), multi_line=True)
        got = [[c["value"] for c in r["cells"]] for r in table.orderBy("row").collect()]
        splits = tables.csv_records(spark, str(tmp_path)).select("_split").distinct().count()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == rows and splits > 5


def test_visited_pages_are_rewritten_a_logarithmic_number_of_times(spark, monkeypatch):
    one = spark.createDataFrame([("r", "u0")], "root string, url string")
    for bound in (200_000, 0):  # sent to the runs, or joined by shuffle
        monkeypatch.setattr(web, "BROADCAST_PAGES", bound or 1)
        visited = web.Visited()
        for i in range(24):
            pages = spark.createDataFrame([("r", f"u{i}")], "root string, url string")
            assert [r["url"] for r in visited.unseen(pages, 2 if not bound else 1).collect()] == [f"u{i}"]
            visited.add(pages, 1)
            assert len(visited.runs) <= 6
        assert visited.rewritten <= 24 * 6 and visited.unseen(one, 1).isEmpty()


def test_crawl_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"r/{'a/' * i}", f"r/{'a/' * (i + 1)}") for i in range(30)], "src string, dst string")
    got = web.crawl(edges, spark.createDataFrame([("r/",)], "root string")).collect()
    assert {len(r["url"].split("a/")) - 1: r["depth"] for r in got} == {i: i for i in range(31)}


def test_places_of_a_phrase_are_not_sent_for_each_query(spark, many_chunks, monkeypatch):
    """Rows with places are asked for by token and range of candidates, not by token alone."""
    _, index = many_chunks
    asked, plain = [], fts._of_tokens

    def seen(postings, wanted, *more, **options):
        if "positions" in postings.columns:
            asked.append(set(wanted.columns))
        return plain(postings, wanted, *more, **options)

    monkeypatch.setattr(fts, "_of_tokens", seen)
    word = index.postings.select("token").head()["token"]
    queries = spark.createDataFrame([("q", [word, word])], "query_id string, terms array<string>")
    fts.match(index, queries, "phrase").collect()
    assert asked and all("range" in columns for columns in asked)


def test_runs_of_tasks_merge_to_rows():
    """Tokens of many texts in several batches, of several ranges, next to a dictionary."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = [
        {"no": rng.randrange(3) * fts.RANGE + rng.randrange(5), "base": 1000 * i, "tokens": rng.choices("abcd", k=rng.randrange(6))}
        for i in range(400)
    ]
    want = {}
    for r in rows:
        for i, token in enumerate(r["tokens"]):
            places = want.setdefault((token, r["no"] // fts.RANGE), {})
            places.setdefault(r["no"] % fts.RANGE, []).append(r["base"] + i)
    schema = pa.schema([("no", pa.int64()), ("base", pa.int64()), ("tokens", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 90], schema) for i in range(0, 400, 90)]
    runs = pa.Table.from_batches(list(fts._runs(batches)))
    runs = runs.append_column("bucket", pa.array([0] * runs.num_rows, pa.int32()))
    runs = runs.sort_by([("token", "ascending"), ("range", "ascending")])
    for enough in (1, 1 << 20):
        fts.MERGE_AT, before = enough, fts.MERGE_AT
        got = [r for b in fts._grouped(runs.to_batches(max_chunksize=7)) for r in b.to_pylist()]
        fts.MERGE_AT = before
        assert {(r["token"], r["range"]): dict(zip(r["docs"], r["positions"])) for r in got} == want
        assert len(got) == len(want) and all(r["docs"] == sorted(r["docs"]) for r in got)
