"""Splitting, titles and page texts against plain models."""

import re

from pyspark.sql import functions as F

from shelfspark.config import Settings
from shelfspark.functions import text
from shelfspark.plans import ingest

TEXTS = [
    "他说：“你好。”然后走了！真的吗？？是的……好吧。价格是3.5元；很贵",
    "第一句。第二句！第三句？”第四句；" + "很长的没有标点的句子" * 15 + "，然后是逗号，" + "再长一点" * 30,
    "plain words " * 30 + "\n\nnext  line   with gaps " * 8,
    "x" * 250,
    "a.b,c;d!e?f " * 20 + "　\n",
    "",
    "   \n ",
    "one\n\ntwo\nthree......four",
]


def cut(pattern, body):
    return re.sub(pattern, lambda m: m.group(1) + "\n" + m.group(2), body)


def model(body, limit=100):
    for pattern in text.FIRST_BOUNDARIES:
        body = cut(pattern, body)
    pieces = body.rstrip().split("\n")
    for pattern in (text.CLAUSE_BOUNDARY, text.GAP_BOUNDARY, text.SPACE_BOUNDARY):
        pieces = [
            part
            for piece in pieces
            for part in (cut(pattern, piece).split("\n") if len(piece) > limit else [piece])
        ]
    return [p for p in pieces if p]


def test_sentence_pieces(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", text.sentence_pieces(F.col("t")).alias("p")).collect()
    for row in rows:
        assert row["p"] == model(row["t"])


def test_pdf_mode_drops_newlines(spark):
    df = spark.createDataFrame([("一\n\n\n\n二\t三 四",)], "t string")
    assert df.select(text.pdf_normalise(F.col("t"))).head()[0] == "一 二 三 四"


TITLES = {
    "第一章 总则": True,
    "": False,
    "一" * 20 + "a": False,
    "标题" * 10: True,
    "12345": False,
    "一二三": False,
    "Introduction,": False,
    "概述。": False,
    "*** ---": False,
    "   ": False,
    "A1 报告": True,
    "..... ab": False,
    "ab_": True,
}


def test_titles(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "t string")
    found = {r[0]: r[1] for r in df.select("t", text.is_title(F.col("t"))).collect()}
    assert found == TITLES


def test_titles_carry_over_parts(spark):
    raw = spark.createDataFrame(
        [("f", 0, "前言\n说明文字在这里，结束。"), ("f", 1, "接着说，完。\n第二章\n内容，完。"), ("g", 0, "没有，标题。")],
        "file_id string, part int, text string",
    )
    rows = ingest.enhance_titles(raw).orderBy("file_id", "part", "piece_idx").collect()
    shown = [(r["file_id"], r["content"], r["category"]) for r in rows]
    assert shown == [
        ("f", "前言", "cn_Title"),
        ("f", "下文与(前言)有关。说明文字在这里，结束。", None),
        ("f", "下文与(前言)有关。接着说，完。", None),
        ("f", "第二章", "cn_Title"),
        ("f", "下文与(第二章)有关。内容，完。", None),
        ("g", "没有，标题。", None),
    ]


def test_token_pieces():
    assert text.token_pieces("  short text \n") == ["short text"]
    assert text.token_pieces(" ") == []
    long = ". ".join("w" * 99 for _ in range(60))
    pieces = text.token_pieces(long, limit=100, overlap=50)
    assert all(len(p) // 4 <= 100 + p.count(".") for p in pieces)  # parts are rounded down each
    assert all(b.split(". ")[0].strip(". ") in a for a, b in zip(pieces, pieces[1:]))
    unbroken = "y" * 1000
    assert text.token_pieces(unbroken, limit=100) == [unbroken]
    plain = text.token_pieces("ab cd " * 200, limit=20, overlap=0)
    assert "".join("".join(plain).split()) == "abcd" * 200


def test_token_split_matches_its_helper(spark):
    bodies = ["short", "z " * 2000, "第一句。" * 900]
    df = spark.createDataFrame([(bodies,)], "p array<string>")
    got = df.select(text.token_split(F.col("p"), 400, 200)).head()[0]
    assert got == [t for b in bodies for t in text.token_pieces(b, 400, 200)]


def test_chunks_number_over_parts(spark):
    raw = spark.createDataFrame(
        [("f", 0, "一。二。"), ("f", 1, "  "), ("f", 2, "三。"), ("g", 0, "四。")],
        "file_id string, part int, text string",
    )
    rows = ingest.chunk_texts(raw).orderBy("file_id", "chunk_idx").collect()
    assert [(r["chunk_id"], r["content"]) for r in rows] == [
        ("f_0", "一。"), ("f_1", "二。"), ("f_2", "三。"), ("g_0", "四。"),
    ]


def test_ingest_statuses(spark):
    raw = spark.createDataFrame(
        [("a", "fine text."), ("b", "boom."), ("c", "never read.")], "file_id string, text string"
    )
    files = spark.createDataFrame(
        [("a", "k", "u", "a.txt"), ("b", "k", "u", "b.md"), ("c", "k", "u", "c.zip"), ("d", "k", "u", "d.txt")],
        "file_id string, kb_id string, user_id string, file_name string",
    )

    def embedder(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, 0.0]] * len(texts)

    from dataclasses import replace

    cfg = replace(Settings(), embed_batch=1, embed_attempts=1)
    _, vectors, outcome = ingest.ingest(raw, files, embedder, cfg)
    statuses = {r["file_id"]: r["status"] for r in outcome.collect()}
    assert statuses == {"a": "green", "b": "red", "c": "red", "d": "red"}
    assert [r["file_id"] for r in vectors.collect()] == ["a"]


def test_html_text(spark):
    page = "<p>a &amp; b<script>x<1</script><!-- c --><style>s</style><br>d&copy;</p>"
    df = spark.createDataFrame([(page,), ("plain",)], "h string")
    assert [r[0] for r in df.select(text.html_text(F.col("h"))).collect()] == ["a & bd©", "plain"]


def split_model(body, limit, overlap, marks=text.TOKEN_SEPARATORS):
    """The recursive split written over again with lists."""

    def size(t):
        return len(t) // 4

    def join(parts):
        packs, held = [], []
        for part in parts:
            if held and sum(map(size, held)) + size(part) > limit:
                packs.append("".join(held))
                while held and (
                    sum(map(size, held)) > overlap
                    or (sum(map(size, held)) + size(part) > limit and sum(map(size, held)) > 0)
                ):
                    held = held[1:]
            held = held + [part]
        packs.append("".join(held))
        return [p.strip() for p in packs if p.strip()]

    mark, rest = marks[-1], ()
    for i, candidate in enumerate(marks):
        if candidate in body:
            mark, rest = candidate, marks[i + 1 :]
            break
    parts = [p for p in re.split(f"(?={re.escape(mark)})", body) if p]
    out, run = [], []
    for part in parts:
        if size(part) < limit:
            run.append(part)
            continue
        if run:
            out += join(run)
            run = []
        out += split_model(part, limit, overlap, rest) if rest else [part]
    return out + (join(run) if run else [])


def test_token_pieces_against_model():
    import random

    rng = random.Random(5)
    alphabet = "abc中文 \n.。!?；;、，, "
    for _ in range(400):
        body = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400)))
        limit = rng.choice([5, 9, 20])
        overlap = rng.choice([0, 2, limit // 2])
        assert text.token_pieces(body, limit, overlap) == split_model(body, limit, overlap), body
