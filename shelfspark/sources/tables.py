"""Row-shaped files: every row becomes one text of ``name: value`` pairs."""

from __future__ import annotations

import csv
import io
import logging
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import trim_blanks
from shelfspark.operators.scan import fill_forward

log = logging.getLogger(__name__)

# Fixed value: the line around a row.
RULE = "-" * 24
CELLS = "array<struct<name:string,value:string>>"
RAGGED = "_ragged_record"
ROWS_SCHEMA = f"file_id string, sheet string, row bigint, cells {CELLS}"
_CELL_ARROW = pa.struct([("name", pa.string()), ("value", pa.string())])
_ROWS_ARROW = pa.schema([("file_id", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(_CELL_ARROW))])
#: Rows, and characters or bytes of files, that go out together.
OUT_ROWS, OUT_SIZE = 10_000, 4 << 20


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, _split, _at, record) of UTF-8 CSV files whose quoted cells may hold line ends.

    Files are read in splits, line by line. A line end is inside quotes if the number of quotes
    before it is odd, and the parity before a split is that of the splits before it together: one
    row a split. A record's lines then meet under the line that it starts with, wherever its end
    lies. Quotes stand around cells, and doubled inside them.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("_line"),
        (F.regexp_count("value", F.lit('"')) % 2).alias("_odd"),
    )
    inside = Window.partitionBy("file_id", "_split").orderBy("_at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = lines.withColumn("_before", F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2)
    # In a split that starts inside quotes the lines that start records are the other ones.
    parts = local.groupBy("file_id", "_split").agg(
        (F.sum("_odd") % 2).alias("_parity"),
        F.max(F.when(F.col("_before") == 0, F.col("_at"))).alias("_last0"),
        F.max(F.when(F.col("_before") == 1, F.col("_at"))).alias("_last1"),
    )
    along = Window.partitionBy("file_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    known = parts.withColumn("_start", F.coalesce(F.sum("_parity").over(along), F.lit(0)) % 2)
    last = F.when(F.col("_start") == 0, F.col("_last0")).otherwise(F.col("_last1"))
    known = known.withColumn("_last", F.when(last.isNotNull(), F.struct("_split", last.alias("_at"))))
    known = known.withColumn("_open", F.last("_last", ignorenulls=True).over(along)).select("file_id", "_split", "_start", "_open")
    placed = local.join(known, ["file_id", "_split"])
    starts = F.when((F.col("_before") + F.col("_start")) % 2 == 0, F.col("_at"))
    own = F.last(starts, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    keyed = placed.withColumn("_own", own).select(
        "file_id",
        F.when(F.col("_own").isNotNull(), F.struct(F.col("_split"), F.col("_own").alias("_at"))).otherwise(F.col("_open")).alias("_key"),
        F.struct("_split", "_at", "_line").alias("_part"),
    )
    records = keyed.groupBy("file_id", "_key").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda part: part["_line"]), "\n")
    return records.select(
        "file_id", F.col("_key._split").alias("_split"), F.col("_key._at").alias("_at"),
        F.regexp_replace(whole, r"\r\z", "").alias("record"),
    )


def _table_rows(spark: SparkSession, path: str, multi_line: bool, options: dict) -> tuple[list[str], DataFrame]:
    """The header's names, and raw rows with a column for records of another length."""
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAGGED, **options}

    def schema(names):
        return T.StructType([T.StructField(n, T.StringType()) for n in (*names, RAGGED)])

    if multi_line and options["encoding"].upper() in ("UTF-8", "UTF8"):
        records = csv_records(spark, path).where("record != ''")
        first = records.where("_split = 0").groupBy("file_id").agg(F.min(F.struct("_at", "record")).alias("_head"))
        heads = [r[0] for r in first.select("_head.record").distinct().limit(2).collect()]
        if len(heads) > 1:
            raise ValueError("the files have different headers")
        names = next(csv.reader(io.StringIO(heads[0], newline=""))) if heads else []
        body = records.join(first.select("file_id", F.col("_head._at").alias("_first")), "file_id")
        body = body.where((F.col("_split") > 0) | (F.col("_at") > F.col("_first")))
        places = [f"_c{i}" for i in range(len(names))]
        parsed = F.from_csv("record", schema(places).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {**options, "multiLine": "true"})
        rows = body.select("file_id", "_split", "_at", parsed.alias("_row")).select("file_id", "_split", "_at", "_row.*")
        return names, rows.toDF("file_id", "_split", "_at", *names, RAGGED)
    options |= {"header": True, "multiLine": multi_line}
    names = spark.read.csv(path, **options).columns
    raw = spark.read.csv(path, schema=schema(names), enforceSchema=False, **options)
    return names, raw.withColumns(
        {
            "file_id": F.col("_metadata.file_path"),
            "_split": F.col("_metadata.file_block_start"),
            "_at": F.monotonically_increasing_id(),
        }
    )


def csv_table(
    spark: SparkSession, path: str, multi_line: bool = False, encoding: str = "UTF-8"
) -> DataFrame:
    """Rows of large CSV files with one shared header, read in splits.

    Rows are numbered by split and position, so one very large file is still numbered by
    many tasks, also with ``multi_line``, where quoted cells may hold line ends (UTF-8 only, see
    ``csv_records``; a file in another encoding is one task then). As in ``csv_files`` an empty
    cell is empty and a missing trailing one null, and a file with a row of more cells than the
    header has an error row in place of its rows. A file with another header is an error of the
    whole, and so is it if no file is left.
    """
    names, raw = _table_rows(spark, path, multi_line, {"encoding": encoding})
    # A record whose number of cells is not the header's comes with its own text as well.
    cells = F.regexp_count(F.regexp_replace(f"`{RAGGED}`", '"[^"]*"', ""), F.lit(",")) + 1
    width = F.when(F.col(f"`{RAGGED}`").isNull(), len(names)).otherwise(cells)
    sized = raw.withColumn(RAGGED, width)
    placed = sized.select(
        F.array(
            *(
                F.struct(
                    F.lit(n).alias("name"),
                    F.when(F.col(f"`{RAGGED}`") > i, F.coalesce(f"`{n}`", F.lit(""))).alias("value"),
                )
                for i, n in enumerate(names)
            )
        ).alias("cells"),
        "file_id",
        "_split",
        "_at",
        # The reader tells bad records only where it reads all cells.
        ((F.col(f"`{RAGGED}`") > len(names)) & (F.length(F.concat_ws("", *(f"`{n}`" for n in names))) >= 0)).alias("_many"),
    )
    flagged = placed.groupBy("file_id").agg(F.max("_many").alias("_many"))
    many = flagged.where("_many").select("file_id")
    rows = number_rows(placed.drop("_many")).join(many, "file_id", "left_anti")
    none = F.broadcast(flagged.agg(F.min("_many").alias("_none")))  # one row
    message = "a row has more cells than the header"
    failed = many.crossJoin(none).select(
        "file_id",
        F.when(F.col("_none"), F.raise_error(F.lit(message))).otherwise(f"ValueError: {message}").alias("sheet"),
        F.lit(-1).cast("bigint").alias("row"),
        F.lit(None).cast(CELLS).alias("cells"),
    )
    return rows.select("file_id", F.lit("").alias("sheet"), "row", "cells").unionByName(failed)


def number_rows(placed: DataFrame) -> DataFrame:
    """Row numbers from zero per file, counted per split and carried over the splits."""
    splits = placed.groupBy("file_id", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy("file_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = splits.select(
        "file_id", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("file_id", "_split").orderBy("_at")
    return (
        placed.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(offsets, ["file_id", "_split"])
        .withColumn("row", F.col("_before") + F.col("_pos"))
        .drop("_split", "_at", "_pos", "_before")
    )


def _csv_rows(text: str) -> Iterator[list[dict]]:
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=",", quotechar='"')
    header = next(reader, None)
    for values in reader:
        if not values:
            continue
        if len(values) > len(header):
            raise ValueError("a row has more cells than the header")
        padded = values + [None] * (len(header) - len(values))
        merged = dict(zip(header, padded, strict=True))
        yield [{"name": n, "value": v} for n, v in merged.items()]


def _sheet_rows(sheet: str, text: str) -> list[tuple]:
    """(sheet, row, cells) of a sheet's rows."""
    return [(sheet, at, cells) for at, cells in enumerate(_csv_rows(text))]


def _readable(read: Callable[[], list[tuple]]) -> list[tuple]:
    """All rows of a file, or one error row if any part of it cannot be read."""
    try:
        return read()
    except (ValueError, KeyError, IndexError, TypeError, csv.Error, zipfile.BadZipFile, ET.ParseError) as error:
        log.warning("unreadable file: %s", error)
        return [(f"{type(error).__name__}: {error}", -1, None)]


def _file_rows(files: DataFrame, column: str, read: Callable[[str | bytes | None], list[tuple]]) -> DataFrame:
    """Rows of the files whose ``column`` each is read; many small files go out together."""

    def batch(held):
        ids, sheets, rows, cells = zip(*held)
        kinds = [pa.array(values, field.type) for values, field in zip((ids, sheets, rows, cells), _ROWS_ARROW)]
        return pa.RecordBatch.from_arrays(kinds, schema=_ROWS_ARROW)

    def parse(batches):
        held, size = [], 0
        for files in batches:
            for file_id, content in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
                for row in _readable(lambda: read(content)):
                    held.append((file_id, *row))
                    if len(held) >= OUT_ROWS:
                        yield batch(held)
                        held, size = [], 0
                size += len(content or ())
                if size >= OUT_SIZE and held:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return files.select("file_id", column).mapInArrow(parse, ROWS_SCHEMA)


def failures(rows: DataFrame) -> DataFrame:
    """(file_id, error) of the files that could not be read; their rows have no cells."""
    return rows.where(F.col("cells").isNull()).select("file_id", F.col("sheet").alias("error"))


def place_sheets(rows: DataFrame) -> DataFrame:
    """``part`` numbers the rows of a file (file_id, sheet, row) over its sheets, by their names.

    Rows per sheet are counted first, so only counts of sheets meet in a file."""
    sizes = rows.groupBy("file_id", "sheet").agg((F.max("row") + 1).alias("_n"))
    before = Window.partitionBy("file_id").orderBy("sheet").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file_id", "sheet", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, ["file_id", "sheet"]).withColumn("part", F.col("_start") + F.col("row")).drop("_start")


def csv_files(texts: DataFrame, errors: bool = False) -> DataFrame:
    """Rows of many small CSV files (file_id, text), each with a header of its own.

    A file with a row of more cells than its header has no rows; with ``errors`` it has an error
    row, see ``failures``, so its ingest ends red.
    """

    rows = _file_rows(texts, "text", lambda text: _sheet_rows("", text or ""))
    return rows if errors else rows.where(F.col("cells").isNotNull())


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column_number(address: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", address).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


# Number formats of dates and times that need no code in a workbook.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(_MAIN + "numFmt")}

    def shows_date(number: int) -> bool:
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", codes.get(number, ""))
        return number in DATE_FORMATS if number not in codes else bool(re.search("[dmhysDMHYS]", bare))

    styles = root.find(_MAIN + "cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else ()) if shows_date(int(xf.get("numFmtId", 0)))}


def _as_date(number: float, first: datetime):
    """A serial number as a day and time, to the millisecond; fractions of a day as a time."""
    moment = first + timedelta(milliseconds=round(number * 86_400_000))
    return moment.time() if 0 <= number < 1 else moment


def _cell_value(cell, shared: list[str], dates: set[int], first: datetime):
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
    value = cell.find(_MAIN + "v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return value.text == "1"
    if kind == "d":
        return datetime.fromisoformat(value.text)
    if kind == "n":
        number = float(value.text)
        if int(cell.get("s", 0)) in dates:
            return _as_date(number, first)
        return int(number) if number.is_integer() else number
    return value.text


def _sheets(content: bytes) -> Iterator[tuple[str, list[list]]]:
    """(name, rows of cell values) of a workbook, in workbook order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        listed = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in listed:
            root = ET.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in root]
        links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in links.iter(_PKG + "Relationship")}
        workbook = ET.fromstring(book.read("xl/workbook.xml"))
        dates = _date_styles(book)
        since_1904 = any(p.get("date1904") in ("1", "true") for p in workbook.iter(_MAIN + "workbookPr"))
        first = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
        for sheet in workbook.iter(_MAIN + "sheet"):
            target = targets[sheet.get(_REL + "id")]
            path = target.lstrip("/") if target.startswith("/") else "xl/" + target
            rows = []
            for row in ET.fromstring(book.read(path)).iter(_MAIN + "row"):
                cells = {}
                for at, cell in enumerate(row.iter(_MAIN + "c")):
                    ref = cell.get("r")
                    cells[_column_number(ref) if ref else at] = _cell_value(cell, shared, dates, first)
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            width = max((len(r) for r in rows), default=0)
            yield sheet.get("name"), [r + [None] * (width - len(r)) for r in rows]


def _sheet_csv(rows: list[list]) -> str:
    """A sheet as CSV text: typed per column, rows that are empty throughout left out."""
    if not rows:
        return ""
    header, *body = [["" if v is None else v for v in row] for row in rows]
    names = [str(n) if n != "" else f"Unnamed: {i}" for i, n in enumerate(header)]
    columns = {i: _typed_column([row[i] for row in body]) for i in range(len(names))}
    frame = pd.DataFrame(columns, index=range(len(body)))
    frame.columns = _distinct(names)
    return frame.dropna(how="all").to_csv(index=False)


# Texts that stand for an empty cell.
EMPTY = {
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
}


def _typed_column(values: list) -> pd.Series:
    """Cells of one column: numbers if all that are filled are, dates likewise, else as they are."""
    cells = [None if isinstance(v, str) and v in EMPTY else v for v in values]
    filled = [v for v in cells if v is not None]
    if filled and all(isinstance(v, datetime) for v in filled):
        return pd.Series(pd.to_datetime(pd.Series(cells, dtype=object)))
    if filled and all(isinstance(v, str) for v in filled):
        numbers = pd.to_numeric(pd.Series(cells, dtype=object), errors="coerce")
        if numbers.notna().sum() == len(filled):
            return numbers
    if filled and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in filled):
        whole = len(filled) == len(cells) and all(isinstance(v, int) for v in filled)
        return pd.Series(cells, dtype="int64" if whole else "float64")
    return pd.Series(cells, dtype=object)


def _distinct(names: list[str]) -> list[str]:
    """Repeated names get a number from the second on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
    return out


def xlsx_files(files: DataFrame, errors: bool = False) -> DataFrame:
    """Rows of all sheets of workbooks (file_id, content BINARY); with ``errors`` a broken one has
    an error row, see ``failures``, else none."""

    def read(content):
        return [row for sheet, values in _sheets(content) for row in _sheet_rows(sheet, _sheet_csv(values))]

    rows = _file_rows(files, "content", read)
    return rows if errors else rows.where(F.col("cells").isNotNull())


def filled_cells(rows: DataFrame) -> DataFrame:
    """Cells in long form (file_id, sheet, row, pos, name, value, shown).

    ``shown`` is the stripped value; an empty cell shows the last non-empty raw value of its
    column, and a cell that is absent with nothing before it shows ``None``.
    """
    cells = rows.select(
        "file_id", "sheet", "row", F.posexplode("cells").alias("pos", "cell")
    ).select("file_id", "sheet", "row", "pos", "cell.name", "cell.value")
    known = cells.withColumn("_given", F.nullif("value", F.lit("")))
    filled = fill_forward(known, ["file_id", "sheet", "pos"], "row", "_given", "_last")
    shown = F.when(F.col("_given").isNotNull(), trim_blanks(F.col("value"))).otherwise(
        F.coalesce("_last", "value", F.lit("None"))
    )
    return filled.withColumn("shown", shown).drop("_given", "_last")


def row_documents(
    rows: DataFrame, source_column: str | None = None, metadata_columns: tuple[str, ...] = ()
) -> DataFrame:
    """One text per row, with ``source``, row number and metadata columns.

    A named source or metadata column that a row lacks is an error.
    """
    shown = filled_cells(rows)
    if metadata_columns:
        shown = shown.withColumn("_kept", ~F.col("name").isin(*metadata_columns))
    else:
        shown = shown.withColumn("_kept", F.lit(True))
    pair = F.concat(trim_blanks(F.col("name")), F.lit(": "), F.col("shown"))
    listed = F.array_sort(
        F.collect_list(F.when(F.col("_kept"), F.struct("pos", pair.alias("text"))))
    )

    def named(column):
        return F.max(F.when(F.col("name") == column, F.coalesce("value", F.lit(""))))

    def required(column, alias):
        message = F.concat(F.lit(f"column {column!r} not found in "), "file_id")
        return F.coalesce(F.col(alias), F.raise_error(message))

    wanted = {f"_m{i}": c for i, c in enumerate(metadata_columns)}
    if source_column is not None:
        wanted["_source"] = source_column
    body = F.array_join(F.transform("_cells", lambda c: c["text"]), " & ")
    documents = shown.groupBy("file_id", "sheet", "row").agg(
        listed.alias("_cells"), *(named(c).alias(alias) for alias, c in wanted.items())
    )
    metadata = [F.lit("row"), F.col("row").cast("string")]
    for i, column in enumerate(metadata_columns):
        metadata += [F.lit(column), required(column, f"_m{i}")]
    source = F.col("file_id") if source_column is None else required(source_column, "_source")
    return documents.select(
        "file_id",
        "sheet",
        "row",
        F.concat(F.lit(RULE + "\n"), body, F.lit("\n" + RULE)).alias("text"),
        F.map_concat(
            F.create_map(F.lit("source"), source), F.create_map(*metadata)
        ).alias("metadata"),
    )
