"""Files of a folder, or of a table, to texts in one job: each goes to the parser of its kind.

A file that cannot be read harms no other: it has an error row in place of texts, and its
ingest ends red.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.names import PARSERS, base_name, parser_kind
from shelfspark.models import recognise
from shelfspark.sources import documents, tables
from shelfspark.storage import stored

SUPPORTED = ", ".join(ending for _, endings in PARSERS for ending in endings)


def folder_files(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file_id, file_name, content) of a folder's files, of one kind or of all.

    The files of a kind are listed by their endings, so reading kind by kind opens every file
    once. ``file_id`` is a hash of the path. Files without a byte are left out by the reader.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if kind is not None:
        letters = ("".join(f"[{c}{c.upper()}]" for c in ending) for ending in dict(PARSERS)[kind])
        reader = reader.option("pathGlobFilter", f"*.{{{','.join(letters)}}}")
    return reader.load(path).select(
        F.md5(F.col("path").cast("binary")).alias("file_id"), base_name(F.col("path")).alias("file_name"), "content"
    )


def _row(text: Column | str, part: Column | None = None, whole: Column | None = None, **metadata: Column) -> list[Column]:
    named = [x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))]
    return [
        "file_id",
        (F.lit(0) if part is None else part).cast("bigint").alias("part"),
        (F.col(text) if isinstance(text, str) else text).alias("text"),
        (F.lit(False) if whole is None else whole).alias("whole"),
        F.create_map(*named).alias("metadata") if named else F.expr("cast(map() as map<string,string>)").alias("metadata"),
        F.lit(None).cast("string").alias("error"),
    ]


def _errors(df: DataFrame, error: Column) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "file_id", F.lit(0).cast("bigint").alias("part"), none.cast("string").alias("text"), F.lit(False).alias("whole"),
        none.cast("map<string,string>").alias("metadata"), error.alias("error"),
    )


def _typed(df: DataFrame, files: DataFrame, filetype: str, **more: str) -> DataFrame:
    named = {"filename": F.col("file_name"), "filetype": F.lit(filetype)} | {k: F.col(c) for k, c in more.items()}
    return df.join(files.select("file_id", "file_name"), "file_id").select(*_row("text", **named))


def _parsed(kind: str, files: DataFrame, ocr: Callable[[bytes], Sequence[str]] | None, page_lines: DataFrame | None) -> list[DataFrame]:
    """Text and error rows of files of one kind."""
    if kind == "text":
        read = files.select("file_id", documents.decode_text(F.col("content")).alias("text"))
        return [
            read.where(F.col("text").isNotNull()).select(*_row("text")),
            _errors(read.where(F.col("text").isNull()), F.lit("no charset fits")),
        ]
    if kind in ("csv", "xlsx"):
        if kind == "csv":
            texts = files.select("file_id", documents.decode_text(F.col("content")).alias("text"))
            rows = tables.csv_files(texts, errors=True)
        else:
            rows = tables.xlsx_files(files, errors=True)
        rows = stored(rows, "rows")  # each file is read once, its rows several times below
        numbered = tables.place_sheets(tables.row_documents(rows))
        none = F.lit(None).cast("string").alias("error")
        texts = numbered.select("file_id", F.col("part").cast("bigint").alias("part"), "text", F.lit(False).alias("whole"), "metadata", none)
        return [texts, _errors(tables.failures(rows), F.col("error"))]
    if kind == "eml":
        read = documents.mail_documents(files)
        texts = read.where("error is null").drop("error")
        return [texts.select(*_row("text")), _errors(read.where("error is not null"), F.col("error"))]
    if kind in ("docx", "pptx"):
        parts = documents.word_parts(files) if kind == "docx" else documents.slide_parts(files)
        images = parts.where("kind = 'image'")
        read = recognise(images, ocr) if ocr else None
        lines = None if read is None else read.where("line_no is not null").drop("error")
        if kind == "docx":
            texts = documents.word_documents(parts, lines).select(*_row("text", F.col("part"), F.col("whole")))
        else:
            texts = documents.slide_documents(parts, lines).select(*_row("text"))
        return [texts, _errors(documents.failures(parts), F.col("error"))]
    if kind == "image" and ocr:
        read = recognise(files.withColumnRenamed("content", "image").drop("file_name"), ocr)
        texts = documents.image_documents(read.where("line_no is not null"))
        return [_typed(texts, files, "image"), _errors(read.where("error is not null"), F.col("error"))]
    if kind == "pdf" and page_lines is not None:
        counts = page_lines.groupBy("file_id").agg(F.max("page").alias("page_count"))
        texts = documents.page_documents(page_lines.join(files.select("file_id"), "file_id", "left_semi"), counts)
        blank = files.join(page_lines.select("file_id").distinct(), "file_id", "left_anti")
        return [_typed(texts, files, "pdf", page_count="page_count"), _errors(blank, F.lit("no recognised page"))]
    return [_errors(files, F.lit(f"{kind} needs text recognition"))]


def read_files(
    files: DataFrame | Callable[[str | None], DataFrame],
    ocr: Callable[[bytes], Sequence[str]] | None = None,
    page_lines: DataFrame | None = None,
) -> DataFrame:
    """(file_id, part, text, whole, metadata, error) of files (file_id, file_name, content).

    ``files`` is a table, or a function from a kind to the table of its files (None: all), as
    ``folder_files`` gives. ``ocr`` reads pictures, ``page_lines`` (file_id, page, line_no, text)
    has what was recognised in scanned pages. A file of no supported kind, one that its parser
    cannot read and one that needs a model which is not given have a row with an ``error``.
    """
    if isinstance(files, DataFrame):
        kind = parser_kind(F.col("file_name"))
        of = lambda name: files.where(kind == name)
        listed = files
    else:
        of, listed = files, files(None)
    rows = [df for name, _ in PARSERS for df in _parsed(name, of(name), ocr, page_lines)]
    other = listed.select("file_id", "file_name").where(parser_kind(F.col("file_name")).isNull())
    rows.append(_errors(other, F.lit(f"no parser for this ending; there are some for {SUPPORTED}")))
    return reduce(DataFrame.unionByName, rows)


def read_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """``read_files`` over a folder."""
    return read_files(lambda kind: folder_files(spark, path, kind), **options)
