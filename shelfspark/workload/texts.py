"""Queries over texts, sources and the token index, with their SQL."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import models
from shelfspark.config import Settings
from shelfspark.functions import names, text
from shelfspark.operators import fts
from shelfspark.operators.scan import ordered_concat
from shelfspark.plans import ingest
from shelfspark.plans.files import read_files
from shelfspark.sources import documents, tables, web
from shelfspark.storage import cut_lineage, fresh_path
from shelfspark.workload import bind, office
from shelfspark.workload.sql import registry

CFG = Settings()
NL = "chr(10)"


def _break_sql(column: str, pattern: str) -> str:
    return f"regexp_replace({column}, '{pattern}', '\\1' || {NL} || '\\2', 'g')"


def _refine_sql(pieces: str, pattern: str) -> str:
    return (
        f"flatten(list_transform({pieces}, lambda x: CASE WHEN length(x) > 100 "
        f"THEN string_split({_break_sql('x', pattern)}, {NL}) ELSE [x] END))"
    )


def _pieces_sql(column: str) -> str:
    for pattern in text.FIRST_BOUNDARIES:
        column = _break_sql(column, pattern)
    pieces = f"string_split(regexp_replace({column}, '\\s+\\z', ''), {NL})"
    for pattern in (text.CLAUSE_BOUNDARY, text.GAP_BOUNDARY, text.SPACE_BOUNDARY):
        pieces = _refine_sql(pieces, pattern)
    return f"list_filter({pieces}, lambda x: x <> '')"


_TITLE = r"""length(content) > 0 AND NOT regexp_matches(content, '[^\p{L}\p{N}_\s]\z')
  AND length(content) <= 20
  AND (length(regexp_replace(content, '\s', '', 'g')) = 0
       OR length(regexp_replace(content, '\P{L}', '', 'g'))
          >= 0.5 * length(regexp_replace(content, '\s', '', 'g')))
  AND NOT regexp_matches(content, '\A\p{N}+\z')
  AND regexp_matches(substring(content, 1, 5), '[\p{L}\p{N}]')"""
_WORDS = "regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}]+')"

PARTS = {
    "piece_lists": f"SELECT file_id, {_pieces_sql('text')} AS list FROM texts",
    "pieces": """
        SELECT file_id, CAST(i AS INTEGER) AS piece_idx, list[i + 1] AS content
        FROM (SELECT file_id, list, unnest(range(len(list))) AS i FROM piece_lists)""",
    "final_chunks": """
        SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY piece_idx) - 1
                             AS INTEGER) AS chunk_idx, trim(content) AS content
        FROM pieces WHERE trim(content) <> ''""",
    "home_pages": r"""
        SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') || '/' AS url, html FROM pages""",
    "hrefs": """
        SELECT DISTINCT url, replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)),
                                     '&amp;', '&') AS href
        FROM (SELECT url, html FROM pages UNION ALL SELECT url, html FROM home_pages)""",
    "link_edges": r"""
        SELECT DISTINCT url AS src, string_split(dst, '#')[1] AS dst FROM (
          SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS dst FROM hrefs)
        WHERE starts_with(dst, url)""",
    "folder_edges": r"""
        SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') || '/' AS src,
               regexp_extract(url, '^[a-z]+://[^/?#]*/[^/?#]*') || '/' AS dst FROM pages
        UNION
        SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*/[^/?#]*') || '/' AS src,
               string_split(url, '#')[1] AS dst FROM pages""",
    "site_edges": """
        SELECT src, dst FROM folder_edges WHERE starts_with(dst, src)
        UNION SELECT src, dst FROM link_edges""",
    "doc_words": f"SELECT file_id, {_WORDS.format('text')} AS list FROM texts",
    "doc_tokens": "SELECT DISTINCT file_id, unnest(list) AS token FROM doc_words",
    "item_words": f"SELECT item_id, {_WORDS.format('text')} AS list FROM benchmark",
    "item_tokens": "SELECT DISTINCT item_id, unnest(list) AS token FROM item_words",
}

QUERIES, SQL, register = registry(PARTS)


# --- splitting ------------------------------------------------------------------


def pieces(spark, d):
    return ingest.split_sentences(bind.texts(spark, d), CFG)


@register("fn_sentence_split", "SELECT file_id, piece_idx, content FROM pieces")
def fn_sentence_split(spark, d):
    return pieces(spark, d).select("file_id", "piece_idx", "content")


@register(
    "fn_pdf_normalise",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '\n{{3,}}', {NL}, 'g'), '\s', ' ', 'g')
               AS text FROM documents""",
)
def fn_pdf_normalise(spark, d):
    return bind.table(spark, d, "documents").select(
        "doc_id", text.pdf_normalise(F.col("text")).alias("text")
    )


@register("fn_token_split")
def fn_token_split(spark, d):
    """Production pieces of whole texts: default counter, with overlap."""
    cut = text.token_split(F.array("text"), CFG.chunk_tokens, CFG.chunk_overlap_tokens)
    return bind.texts(spark, d).select("file_id", F.posexplode(cut).alias("pos", "content"))


@register(
    "fn_token_split_whole",
    r"""SELECT file_id, regexp_replace(text, '\s', '', 'g') AS content, true AS fits FROM texts""",
)
def fn_token_split_whole(spark, d):
    """Pieces without overlap, put together again without blanks, are the text without
    blanks; a piece has at most the tokens asked for, or no place to cut it. The counter
    leaves no text without a token, as such texts are repeated in the next piece."""
    cut = text.token_split(F.array("text"), CFG.chunk_tokens, 0, lambda t: -(-len(t) // 4))
    fits = F.forall(
        "cut", lambda p: (F.length(p) <= 4 * CFG.chunk_tokens) | ~F.trim(p).rlike(r"\s")
    )
    return (
        bind.texts(spark, d)
        .select("file_id", cut.alias("cut"))
        .select(
            "file_id",
            F.regexp_replace(F.array_join("cut", ""), r"\s", "").alias("content"),
            fits.alias("fits"),
        )
    )


@register("win_chunk_idx", "SELECT file_id, chunk_idx, content FROM final_chunks")
def win_chunk_idx(spark, d):
    return ingest.chunk_texts(bind.texts(spark, d), CFG).select("file_id", "chunk_idx", "content")


@register("fn_is_title", f"SELECT file_id, piece_idx, {_TITLE} AS title FROM pieces")
def fn_is_title(spark, d):
    return pieces(spark, d).select(
        "file_id", "piece_idx", text.is_title(F.col("content")).alias("title")
    )


@register("flt_title", f"SELECT file_id, piece_idx, content FROM pieces WHERE {_TITLE}")
def flt_title(spark, d):
    return pieces(spark, d).where(text.is_title(F.col("content"))).select(
        "file_id", "piece_idx", "content"
    )


@register(
    "win_title",
    f"""SELECT file_id, piece_idx, CASE WHEN is_title THEN 'cn_Title' ELSE '' END AS category,
              CASE WHEN is_title OR last IS NULL THEN content
                   ELSE '下文与(' || last || ')有关。' || content END AS content
       FROM (SELECT *, last_value(CASE WHEN is_title THEN content END IGNORE NULLS) OVER (
                      PARTITION BY file_id ORDER BY piece_idx
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
             FROM (SELECT file_id, piece_idx, content, {_TITLE} AS is_title FROM pieces))""",
)
def win_title(spark, d):
    return ingest.enhance_titles(bind.texts(spark, d), CFG).select(
        "file_id", "piece_idx", F.coalesce("category", F.lit("")).alias("category"), "content"
    )


# --- sources --------------------------------------------------------------------

ENDINGS = ("md", "TXT", "pdf", "jpg", "PNG", "jpeg", "docx", "xlsx", "pptx", "eml", "csv", "zip")


@register(
    "src_dispatch",
    """SELECT name, CASE WHEN starts_with(name, 'http') THEN 'url'
              WHEN regexp_matches(lower(name), '[.](md|txt)$') THEN 'text'
              WHEN regexp_matches(lower(name), '[.]pdf$') THEN 'pdf'
              WHEN regexp_matches(lower(name), '[.](jpg|png|jpeg)$') THEN 'image'
              WHEN regexp_matches(lower(name), '[.](docx|xlsx|pptx|eml|csv)$')
              THEN regexp_extract(lower(name), '[.]([a-z]+)$', 1) ELSE 'unsupported' END AS kind
       FROM (SELECT source || CAST(doc_id AS VARCHAR) || '.' || ['md', 'TXT', 'pdf', 'jpg', 'PNG',
               'jpeg', 'docx', 'xlsx', 'pptx', 'eml', 'csv', 'zip'][doc_id % 12 + 1] AS name
             FROM documents UNION ALL SELECT url FROM pages)""",
)
def src_dispatch(spark, d):
    endings = F.array(*(F.lit(e) for e in ENDINGS))
    ending = F.element_at(endings, (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    stored = bind.table(spark, d, "documents").select(
        F.concat("source", "doc_id", F.lit("."), ending).alias("name")
    )
    listed = stored.unionByName(bind.table(spark, d, "pages").select(F.col("url").alias("name")))
    kind = names.parser_kind(F.col("name"), F.col("name").startswith("http"))
    return listed.select("name", F.coalesce(kind, F.lit("unsupported")).alias("kind"))


@register("src_text", "SELECT doc_id, text FROM documents")
def src_text(spark, d):
    raw = F.when(F.col("lang") == "de", F.encode("text", "ISO-8859-1")).otherwise(
        F.encode("text", "UTF-8")
    )
    return bind.table(spark, d, "documents").select(
        "doc_id", documents.decode_text(raw).alias("text")
    )


_CSV_ROWS = """
SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS file_id,
       row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row,
       c_name AS name,
       CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN '  '
            ELSE c_mktsegment || ', ' END AS segment,
       CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment END
         AS note
FROM customer"""


def customer_rows(spark, d):
    key = F.col("c_custkey")
    segment = (
        F.when(key % 3 == 0, "").when(key % 5 == 0, "  ")
        .otherwise(F.concat("c_mktsegment", F.lit(", ")))
    )
    note = F.when(key % 7 != 0, F.concat("c_nationkey", F.lit("-"), "c_mktsegment"))
    return bind.table(spark, d, "customer").select(
        F.concat(F.lit("n"), "c_nationkey").alias("file_id"), key.alias("key"),
        F.col("c_name").alias("name"), segment.alias("segment"), note.alias("note"),
    )


@register(
    "src_csv_rows",
    f"""SELECT file_id, row, repeat('-', 24) || {NL} || 'name: ' || name || ' & segment: '
              || CASE WHEN segment <> '' THEN trim(segment) ELSE coalesce(last_segment, '') END
              || ' & note: ' || coalesce(note, last_note, 'None') || {NL} || repeat('-', 24)
              AS text
       FROM (SELECT *, last_value(nullif(segment, '') IGNORE NULLS) OVER w AS last_segment,
                    last_value(note IGNORE NULLS) OVER w AS last_note
             FROM customer_rows
             WINDOW w AS (PARTITION BY file_id ORDER BY row
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    {"customer_rows": _CSV_ROWS},
)
def src_csv_rows(spark, d):
    quoted = F.concat(F.lit('"'), "segment", F.lit('"'))
    line = F.concat(
        "name", F.lit(","), quoted, F.coalesce(F.concat(F.lit(","), "note"), F.lit(""))
    )
    lines = customer_rows(spark, d).select("file_id", "key", line.alias("line"))
    body = ordered_concat(lines, ["file_id"], "key", "line", "body", "\n")
    files = body.select(
        "file_id", F.concat(F.lit(" name ,segment,note\n"), "body", F.lit("\n")).alias("text")
    )
    return tables.row_documents(tables.csv_files(files)).select("file_id", "row", "text")


@register(
    "src_csv_table",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS source, repeat('-', 24) || {NL} || 'key: '
              || CAST(p_partkey AS VARCHAR) || ' & name: ' || p_name || ' & brand: ' || p_brand
              || {NL} || repeat('-', 24) AS text, p_type AS kind FROM part""",
)
def src_csv_table(spark, d):
    path = fresh_path(spark, "parts-csv")
    bind.table(spark, d, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
    ).write.csv(path, header=True)
    rows = tables.csv_table(spark, path)
    return tables.row_documents(rows, "key", ("kind",)).select(
        F.col("metadata")["source"].alias("source"), "text", F.col("metadata")["kind"].alias("kind")
    )


@register(
    "win_ffill",
    """SELECT user_id, event_id, CASE WHEN value % 2 >= 1 THEN event_type
              ELSE coalesce(last_type, '') END AS shown
       FROM (SELECT *, last_value(CASE WHEN value % 2 >= 1 THEN event_type END IGNORE NULLS) OVER (
                      PARTITION BY user_id ORDER BY event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_type
             FROM events)""",
)
def win_ffill(spark, d):
    shown = F.when(F.col("value") % 2 >= 1, F.col("event_type")).otherwise("")
    cells = F.array(F.struct(F.lit("type").alias("name"), shown.alias("value")))
    rows = bind.table(spark, d, "events").select(
        F.col("user_id").alias("file_id"), F.lit("").alias("sheet"),
        F.col("event_id").alias("row"), cells.alias("cells"),
    )
    return tables.filled_cells(rows).select(
        F.col("file_id").alias("user_id"), F.col("row").alias("event_id"), "shown"
    )


@F.pandas_udf(T.BinaryType())
def _workbooks(rows: pd.Series) -> pd.Series:
    head = ["key", "name", "balance"]

    def one(suppliers):
        sheets = {"even": [head], "odd": [head]}
        for s in suppliers:
            name = "odd" if s["s_suppkey"] % 2 else "even"
            sheets[name].append([int(s["s_suppkey"]), s["s_name"], float(s["s_acctbal"])])
            sheets[name].append([None, None, None])
        return office.workbook(sheets)

    return rows.map(one)


@register(
    "src_xlsx_rows",
    f"""SELECT 'w' || CAST(s_suppkey // 50 AS VARCHAR) AS file_id,
              CASE WHEN s_suppkey % 2 = 1 THEN 'odd' ELSE 'even' END AS sheet,
              repeat('-', 24) || {NL} || 'key: ' || CAST(CAST(s_suppkey AS DOUBLE) AS VARCHAR)
              || ' & name: ' || s_name || ' & balance: ' || CAST(s_acctbal AS VARCHAR)
              || {NL} || repeat('-', 24) AS text FROM supplier""",
)
def src_xlsx_rows(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal")))
    files = (
        bind.table(spark, d, "supplier")
        .groupBy(F.concat(F.lit("w"), F.floor(F.col("s_suppkey") / 50)).alias("file_id"))
        .agg(rows.alias("rows"))  # at most fifty suppliers a workbook
        .select("file_id", _workbooks("rows").alias("content"))
    )
    return tables.row_documents(tables.xlsx_files(files)).select("file_id", "sheet", "text")


@register(
    "src_eml",
    f"""SELECT doc_id, 'Subject: ' || source || ' ' || lang || {NL} || {NL} || text AS text
       FROM documents""",
)
def src_eml(spark, d):
    head = F.concat(
        F.lit("From: a@example.com\r\nTo: b@example.com\r\nSubject: "), "source", F.lit(" "), "lang",
        F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\n"
              "Content-Transfer-Encoding: base64\r\n\r\n"),
    )
    mail = F.encode(F.concat(head, F.base64(F.encode("text", "UTF-8"))), "UTF-8")
    files = bind.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), mail.alias("content"))
    return documents.mail_documents(files).select(F.col("file_id").alias("doc_id"), "text")


@F.pandas_udf(T.BinaryType())
def _word_files(texts: pd.Series, images: pd.Series) -> pd.Series:
    return pd.Series(
        [office.word_file(t.split("\n"), i.encode()) for t, i in zip(texts, images, strict=True)]
    )


@F.pandas_udf(T.BinaryType())
def _slide_files(texts: pd.Series, images: pd.Series) -> pd.Series:
    def one(body, image):
        lines = body.split("\n")
        return office.slide_file(
            [lines[i : i + 5] for i in range(0, len(lines), 5)], image.encode()
        )

    return pd.Series([one(t, i) for t, i in zip(texts, images, strict=True)])


def office_files(spark, d, build):
    image = F.concat("source", F.lit("|"), "lang")
    return bind.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"), build("text", image).alias("content")
    )


def read_image(raw: bytes) -> list[str]:
    return raw.decode().split("|")


@register(
    "src_docx",
    rf"""SELECT CAST(doc_id AS VARCHAR) AS file_id, 0 AS part,
              regexp_replace(replace(text, {NL}, {NL} || {NL}), '\A\s+|\s+\z', '', 'g') AS text
       FROM documents
       UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, source || {NL} || lang FROM documents""",
)
def src_docx(spark, d):
    parts = documents.word_parts(office_files(spark, d, _word_files))
    lines = models.recognise(parts.where("kind = 'image'"), read_image).where("error is null")
    return documents.word_documents(parts, lines).drop("whole")


@register(
    "src_pptx",
    rf"""SELECT d.file_id, coalesce(l.body || {NL} || {NL}, '') || d.source || {NL} || {NL} || d.lang
               AS text
       FROM (SELECT CAST(doc_id AS VARCHAR) AS file_id, source, lang FROM documents) d
       LEFT JOIN (SELECT file_id, string_agg(trim(line), {NL} || {NL} ORDER BY i) AS body
             FROM (SELECT file_id, i, list[i + 1] AS line FROM (
                     SELECT CAST(doc_id AS VARCHAR) AS file_id, string_split(text, {NL}) AS list,
                            unnest(range(len(string_split(text, {NL})))) AS i FROM documents))
             WHERE trim(line) <> '' GROUP BY file_id) l ON l.file_id = d.file_id""",
)
def src_pptx(spark, d):
    parts = documents.slide_parts(office_files(spark, d, _slide_files))
    lines = models.recognise(parts.where("kind = 'image'"), read_image).where("error is null")
    return documents.slide_documents(parts, lines)


_LINES = f"""
SELECT doc_id, CAST(i AS INTEGER) AS line_no, list[i + 1] AS text FROM (
  SELECT doc_id, string_split(text, {NL}) AS list,
         unnest(range(len(string_split(text, {NL})))) AS i FROM documents)"""


@register(
    "udf_ocr",
    """SELECT doc_id, line_no, text, NULL AS error FROM doc_lines WHERE doc_id % 50 <> 7
       UNION ALL SELECT doc_id, NULL, NULL, 'ValueError: blurred' FROM documents WHERE doc_id % 50 = 7""",
    {"doc_lines": _LINES},
)
def udf_ocr(spark, d):
    """Lines of pictures; the model fails on some, which harms no other."""
    images = bind.table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 50 == 7, F.lit("blurred").cast("binary")).otherwise(F.encode("text", "UTF-8")).alias("image"),
    )

    def model(raw):
        if raw == b"blurred":
            raise ValueError("blurred")
        return raw.decode().split("\n")

    return models.recognise(images, model)


def doc_lines(spark, d):
    return bind.table(spark, d, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    )


@register(
    "src_ocr_pages",
    f"""SELECT doc_id, string_agg('--- Page ' || CAST(page AS VARCHAR) || ' ---' || {NL} || body,
                                 {NL} || {NL} ORDER BY page) AS text
       FROM (SELECT doc_id, line_no // 20 + 1 AS page, string_agg(text, {NL} ORDER BY line_no)
                    AS body FROM doc_lines GROUP BY doc_id, line_no // 20 + 1)
       GROUP BY doc_id""",
    {"doc_lines": _LINES},
)
def src_ocr_pages(spark, d):
    page = (F.floor(F.col("line_no") / 20) + 1).cast("int")
    lines = doc_lines(spark, d).select(F.col("doc_id").alias("file_id"), page.alias("page"), "line_no", "text")
    return documents.page_documents(lines).select(F.col("file_id").alias("doc_id"), "text")


@register("src_ocr_image", "SELECT doc_id, text FROM documents")
def src_ocr_image(spark, d):
    lines = doc_lines(spark, d).withColumnRenamed("doc_id", "file_id")
    return documents.image_documents(lines).select(F.col("file_id").alias("doc_id"), "text")


# --- pages ----------------------------------------------------------------------


@register(
    "src_html",
    r"""SELECT url, replace(replace(replace(replace(
              regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
                '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'),
                '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
                '(?s)<!--.*?-->', '', 'g'), '(?s)<[a-zA-Z/!][^>]*>', '', 'g'),
              '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text
       FROM pages""",
)
def src_html(spark, d):
    return web.page_texts(bind.table(spark, d, "pages")).select("url", "text")


def all_pages(spark, d):
    pages = bind.table(spark, d, "pages").select("url", "html")
    homes = pages.select(F.concat(web.origin(F.col("url")), F.lit("/")).alias("url"), "html")
    return pages.unionByName(homes)


@register("src_links", "SELECT src, dst FROM link_edges")
def src_links(spark, d):
    return web.links(all_pages(spark, d))


def site_edges(spark, d):
    url = F.col("url")
    home = F.concat(web.origin(url), F.lit("/"))
    folder = F.concat(F.regexp_extract(url, r"\A[a-z]+://[^/?#]*/[^/?#]*", 0), F.lit("/"))
    pages = bind.table(spark, d, "pages")
    upper = pages.select(home.alias("src"), folder.alias("dst"))
    lower = pages.select(folder.alias("src"), F.substring_index(url, "#", 1).alias("dst"))
    folders = upper.unionByName(lower).where(F.col("dst").startswith(F.col("src")))
    return folders.unionByName(web.links(all_pages(spark, d))).distinct()


def _roots(spark, d):
    return bind.table(spark, d, "pages").select(
        F.concat(web.origin(F.col("url")), F.lit("/")).alias("root")
    ).distinct()


@register(
    "join_crawl",
    """SELECT root, url, CAST(min(depth) AS INTEGER) AS depth, CAST(1 AS INTEGER) AS n_emitted
       FROM (SELECT DISTINCT url AS root, url, 0 AS depth FROM home_pages
             UNION ALL SELECT h.url, e.dst, 1 FROM (SELECT DISTINCT url FROM home_pages) h
             JOIN site_edges e ON e.src = h.url)
       GROUP BY root, url""",
)
def join_crawl(spark, d):
    return web.crawl(site_edges(spark, d), _roots(spark, d), max_depth=1)


def src_crawl(spark, d):
    return web.crawl(site_edges(spark, d), _roots(spark, d))


register(
    "src_crawl",
    """SELECT root, url, CAST(min(depth) AS INTEGER) AS depth,
              CAST(CASE WHEN min(depth) > 0 AND ends_with(url, '/') THEN 2 ELSE 1 END AS INTEGER)
                AS n_emitted
       FROM walked GROUP BY root, url""",
    {
        "level0": "SELECT DISTINCT url AS root, url, 0 AS depth FROM home_pages",
        "level1": """SELECT DISTINCT l.root, e.dst AS url, 1 AS depth FROM level0 l
                     JOIN site_edges e ON e.src = l.url""",
        "level2": """SELECT DISTINCT l.root, e.dst AS url, 2 AS depth FROM level1 l
                     JOIN site_edges e ON e.src = l.url WHERE ends_with(l.url, '/')""",
        "level3": """SELECT DISTINCT l.root, e.dst AS url, 3 AS depth FROM level2 l
                     JOIN site_edges e ON e.src = l.url WHERE ends_with(l.url, '/')""",
        "level4": """SELECT DISTINCT l.root, e.dst AS url, 4 AS depth FROM level3 l
                     JOIN site_edges e ON e.src = l.url WHERE ends_with(l.url, '/')""",
        "walked": """SELECT * FROM level0 UNION ALL SELECT * FROM level1
                     UNION ALL SELECT * FROM level2 UNION ALL SELECT * FROM level3
                     UNION ALL SELECT * FROM level4""",
    },
)(src_crawl)


# --- embedding and ingest -----------------------------------------------------------


def _counts(texts):
    if any("Ö" in t for t in texts):
        raise RuntimeError("cannot embed")
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@register(
    "udf_embed",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS v1,
              CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS v2
       FROM documents""",
)
def udf_embed(spark, d):
    rows = bind.table(spark, d, "documents").select("doc_id", "text")
    embedded = models.embed(
        rows, lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts], text="text"
    )
    vector = F.col("embedding")
    return embedded.select(
        "doc_id", vector[0].cast("double").alias("v1"), vector[1].cast("double").alias("v2")
    )


@register(
    "ingest_outcome",
    """SELECT f.file_id, f.kb_id, CAST(coalesce(c.n_chars, 0) AS BIGINT) AS content_length,
              coalesce(c.n_chunks, 0) AS chunk_size,
              CASE WHEN coalesce(c.bad, FALSE) THEN 'red' ELSE 'green' END AS status
       FROM files f LEFT JOIN (
         SELECT file_id, sum(length(content)) AS n_chars, count(*) AS n_chunks,
                bool_or(contains(content, 'Ö')) AS bad
         FROM final_chunks GROUP BY file_id) c ON c.file_id = f.file_id""",
)
def ingest_outcome(spark, d):
    files = bind.files(spark, d).select(
        "file_id", "kb_id", F.lit("u").alias("user_id"),
        F.concat("file_id", F.lit(".txt")).alias("file_name"),
    )
    single = replace(CFG, embed_batch=1, embed_attempts=1)
    _, _, outcome = ingest.ingest(bind.texts(spark, d), files, _counts, single)
    return outcome


# --- files of all kinds ---------------------------------------------------------

KINDS = ("txt", "md", "csv", "eml", "docx", "pptx", "xlsx", "png", "docx", "zip", "csv", "png")


@F.pandas_udf(T.BinaryType())
def _file_bytes(numbers: pd.Series, texts: pd.Series, images: pd.Series) -> pd.Series:
    """A file of the kind that stands at its number; the last ones cannot be read."""

    def one(number, text, image):
        kind = number % len(KINDS)
        if kind in (0, 1):
            return text.encode()
        if kind == 2:
            quoted = text.replace('"', '""')
            return f'id,body\n{number},"x{quoted}x"\n{number + 1},\n'.encode()
        if kind == 3:
            return f"Subject: {image}\nContent-Type: text/plain; charset=utf-8\n\n{number}".encode()
        if kind == 4:
            return office.word_file([f"w{number}"], image.encode())
        if kind == 5:
            return office.slide_file([[f"s{number}"]], image.encode())
        if kind == 6:
            return office.workbook({"a": [["k", "v"], [number, "one"]], "b": [["k"], ["x"], ["y"]]})
        if kind == 7:
            return image.encode()
        if kind == 10:
            return b"a,b\n1,2,3\n"
        return b"broken" if kind in (8, 11) else text.encode()

    return pd.Series([one(*row) for row in zip(numbers, texts, images, strict=True)])


def mixed_files(spark, d):
    """A file of some kind for each document."""
    doc = F.col("doc_id")
    endings = F.array(*(F.lit(e) for e in KINDS))
    ending = F.element_at(endings, (doc % len(KINDS) + 1).cast("int"))
    return bind.table(spark, d, "documents").select(
        F.lpad(doc.cast("string"), 32, "0").alias("file_id"),
        F.concat(F.col("source"), F.lit("_"), doc.cast("string"), F.lit("."), ending).alias("file_name"),
        F.concat(F.lit("KB_u"), (doc % 5).cast("string"), F.lit("_"), "source").alias("kb_id"),
        F.concat(F.lit("u"), (doc % 5).cast("string")).alias("user_id"),
        _file_bytes(doc, "text", F.concat("source", F.lit("|"), "lang")).alias("content"),
    )


def read_or_blurred(raw: bytes) -> list[str]:
    if raw == b"broken":
        raise ValueError("blurred")
    return read_image(raw)


_RULED = f"repeat('-', 24) || {NL} || {{0}} || {NL} || repeat('-', 24)"
_FILE_TEXTS = f"""
SELECT doc_id, part, text FROM (
  SELECT doc_id, doc_id % 12 AS kind, 0 AS part, text FROM documents WHERE doc_id % 12 < 2
  UNION ALL SELECT doc_id, 2, 0, {_RULED.format("'id: ' || doc_id || ' & body: x' || text || 'x'")} FROM documents
  UNION ALL SELECT doc_id, 2, 1, {_RULED.format("'id: ' || (doc_id + 1) || ' & body: x' || text || 'x'")} FROM documents
  UNION ALL SELECT doc_id, 3, 0, 'Subject: ' || source || '|' || lang || {NL} || {NL} || doc_id FROM documents
  UNION ALL SELECT doc_id, 4, 0, 'w' || doc_id FROM documents
  UNION ALL SELECT doc_id, 4, 1, source || {NL} || lang FROM documents
  UNION ALL SELECT doc_id, 5, 0, 's' || doc_id || {NL} || {NL} || source || {NL} || {NL} || lang FROM documents
  UNION ALL SELECT doc_id, 6, 0, {_RULED.format("'k: ' || doc_id || ' & v: one'")} FROM documents
  UNION ALL SELECT doc_id, 6, 1, {_RULED.format("'k: x'")} FROM documents
  UNION ALL SELECT doc_id, 6, 2, {_RULED.format("'k: y'")} FROM documents
  UNION ALL SELECT doc_id, 7, 0, source || {NL} || lang FROM documents)
WHERE doc_id % 12 = kind"""


@register(
    "ingest_files",
    """SELECT lpad(CAST(doc_id AS VARCHAR), 32, '0') AS file_id, CAST(part AS BIGINT) AS part, text, FALSE AS failed
       FROM file_texts
       UNION ALL SELECT lpad(CAST(doc_id AS VARCHAR), 32, '0'), 0, NULL, TRUE FROM documents WHERE doc_id % 12 > 7""",
    {"file_texts": _FILE_TEXTS},
)
def ingest_files(spark, d):
    """Files of all kinds to texts, broken and unsupported ones among them."""
    files = mixed_files(spark, d).select("file_id", "file_name", "content")
    return read_files(files, read_or_blurred).select("file_id", "part", "text", F.col("error").isNotNull().alias("failed"))


@register(
    "ingest_vectors",
    """SELECT lpad(CAST(d.doc_id AS VARCHAR), 32, '0') AS file_id,
              CASE WHEN d.doc_id % 12 > 7 OR coalesce(t.bad, FALSE) THEN 'red'
                   WHEN d.doc_id % 13 = 5 AND (d.doc_id % 12 > 1 OR c.file_id IS NOT NULL) THEN 'yellow' ELSE 'green' END AS status
       FROM documents d
       LEFT JOIN (SELECT doc_id, bool_or(contains(text, 'Ö')) AS bad FROM file_texts GROUP BY doc_id) t ON t.doc_id = d.doc_id
       LEFT JOIN (SELECT DISTINCT file_id FROM final_chunks) c ON c.file_id = lpad(CAST(d.doc_id AS VARCHAR), 32, '0')""",
    {"file_texts": _FILE_TEXTS},
)
def ingest_vectors(spark, d):
    """Files to vectors in a store that loses some files: red, yellow and green ones."""
    files = mixed_files(spark, d)
    read = read_files(files.select("file_id", "file_name", "content"), read_or_blurred)
    texts = read.where("error is null").select("file_id", "part", "text", "whole")
    path = fresh_path(spark, "vectors")

    def store(vectors):
        kept = vectors.where(F.col("file_id").cast("bigint") % 13 != 5)
        kept.write.mode("append").partitionBy("user_id").parquet(path)
        return spark.read.schema(vectors.schema).parquet(path).select("file_id").distinct()

    single = replace(CFG, embed_batch=1, embed_attempts=1)
    _, _, outcome = ingest.ingest(texts, files.select("file_id", "file_name", "kb_id", "user_id"), _counts, single, store=store)
    return outcome.select("file_id", "status")


# --- token search -----------------------------------------------------------------


def doc_chunks(spark, d):
    """Each document as one chunk."""
    return bind.texts(spark, d).select(
        "file_id", F.lit(0).alias("chunk_idx"), F.lit("").alias("file_name"),
        F.concat("file_id", F.lit("_0")).alias("chunk_id"), F.col("text").alias("content"),
    )


_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark, d):
    """The index as searches find it: written by the first of an application that needs it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        path = fresh_path(spark, "token-index")
        fts.store(doc_chunks(spark, d), path)
        _STORED[key] = path
    return fts.TokenIndex(spark, _STORED[key])


def _items(spark, d):
    return bind.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array("text").alias("terms")
    )


@register(
    "fts_index",
    """SELECT token, count(*) AS n, count(DISTINCT file_id) AS n_files FROM (
         SELECT file_id, unnest(list) AS token FROM doc_words) GROUP BY token""",
)
def fts_index(spark, d):
    """Occurrences and files of each token, from the lists that the index keeps."""
    in_content = F.transform("positions", lambda at: F.size(F.filter(at, lambda x: x < fts.FIELD_SPAN)))
    held = stored_index(spark, d).postings.select("token", F.filter(in_content, lambda n: n > 0).alias("ns"))
    return held.where(F.size("ns") > 0).groupBy("token").agg(
        F.sum(F.aggregate("ns", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("n"),
        F.sum(F.size("ns")).alias("n_files"),
    )


def _ranked_sql(body: str) -> str:
    return f"""SELECT query_id, file_id, rank FROM (
         SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY file_id) AS rank
         FROM ({body})) WHERE rank <= 50"""


def _ranked(df):
    return df.select("query_id", "file_id", F.col("rank").cast("bigint").alias("rank"))


@register(
    "fts_search",
    _ranked_sql("""SELECT m.item_id AS query_id, m.file_id FROM (
          SELECT q.item_id, t.file_id, count(*) AS n FROM item_tokens q
          JOIN doc_tokens t ON t.token = q.token GROUP BY q.item_id, t.file_id) m
        JOIN (SELECT item_id, count(*) AS n FROM item_tokens GROUP BY item_id) w
          ON w.item_id = m.item_id AND w.n = m.n"""),
)
def fts_search(spark, d):
    return _ranked(fts.search(stored_index(spark, d), _items(spark, d)))


@register(
    "limit_fts",
    _ranked_sql("""SELECT DISTINCT q.item_id AS query_id, t.file_id FROM item_tokens q
                   JOIN doc_tokens t ON t.token = q.token"""),
)
def limit_fts(spark, d):
    return _ranked(fts.search(stored_index(spark, d), _items(spark, d), mode="any"))


@register(
    "fts_phrase",
    """SELECT i.item_id AS query_id, w.file_id FROM item_words i JOIN doc_words w
       ON contains(' ' || array_to_string(w.list, ' ') || ' ',
                   ' ' || array_to_string(i.list, ' ') || ' ')""",
)
def fts_phrase(spark, d):
    found = fts.match(stored_index(spark, d), _items(spark, d), "phrase")
    return found.select("query_id", F.expr("substring(chunk_id, 1, 32)").alias("file_id"))


@register(
    "fts_prefix",
    """SELECT DISTINCT p.part AS query_id, t.file_id
       FROM (SELECT DISTINCT substring(token, 1, 4) AS part FROM item_tokens
             WHERE length(token) > 4) p
       JOIN doc_tokens t ON starts_with(t.token, p.part)""",
)
def fts_prefix(spark, d):
    item = _items(spark, d).select(F.explode(text.tokens(F.col("terms")[0])).alias("token"))
    parts = item.where(F.length("token") > 4).select(F.substring("token", 1, 4).alias("query_id"))
    asked = parts.distinct().withColumn("terms", F.array("query_id"))
    found = fts.match(stored_index(spark, d), asked, "prefix")
    return found.select("query_id", F.expr("substring(chunk_id, 1, 32)").alias("file_id"))


@register(
    "fts_without",
    """SELECT DISTINCT b.lang AS query_id, t.file_id FROM (
         SELECT 'de' AS lang, 'und' AS term, 'der' AS barred
         UNION ALL SELECT 'fr', 'les', 'pour' UNION ALL SELECT 'es', 'los', 'para') b
       JOIN doc_tokens t ON t.token = b.term
       WHERE NOT EXISTS (SELECT 1 FROM doc_tokens x
                         WHERE x.file_id = t.file_id AND x.token = b.barred)""",
)
def fts_without(spark, d):
    rows = [("de", ["und"], ["der"]), ("fr", ["les"], ["pour"]), ("es", ["los"], ["para"])]
    asked = spark.createDataFrame(
        rows, "query_id string, terms array<string>, without array<string>"
    )
    found = fts.match(stored_index(spark, d), asked, "all")
    return found.select("query_id", F.expr("substring(chunk_id, 1, 32)").alias("file_id"))


@register(
    "fts_delete",
    """SELECT file_id FROM files WHERE status <> 'red'""",
)
def fts_delete(spark, d):
    gone = bind.files(spark, d).where("status = 'red'")
    return fts.delete(fts.index(doc_chunks(spark, d)), gone).select("file_id")


@register(
    "fts_search_gone",
    _ranked_sql("""SELECT DISTINCT q.item_id AS query_id, t.file_id FROM item_tokens q
                   JOIN doc_tokens t ON t.token = q.token
                   JOIN files f ON f.file_id = t.file_id AND f.status <> 'red'"""),
)
def fts_search_gone(spark, d):
    """A search of the stored index after files are gone."""
    gone = bind.files(spark, d).where("status = 'red'")
    return _ranked(fts.search(stored_index(spark, d).without_files(gone), _items(spark, d), mode="any"))
