"""File names, ids, sizes and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.config import TABULAR_EXTENSIONS

# Which parser reads which file ending.
PARSERS = (
    ("text", ("md", "txt")),
    ("pdf", ("pdf",)),
    ("image", ("jpg", "png", "jpeg")),
    ("docx", ("docx",)),
    ("xlsx", ("xlsx",)),
    ("pptx", ("pptx",)),
    ("eml", ("eml",)),
    ("csv", ("csv",)),
)


def parser_kind(path: Column, is_url: Column | bool = False) -> Column:
    """Parser for a file, from the URL flag or the ending; null when unsupported."""
    flag = F.lit(is_url) if isinstance(is_url, bool) else is_url
    kind = F.when(flag, "url")
    for name, endings in PARSERS:
        kind = kind.when(F.lower(path).rlike(rf"\.({'|'.join(endings)})\z"), name)
    return kind


def is_tabular(file_name: Column) -> Column:
    """Row-shaped files, whose hits are not widened with neighbours."""
    return F.substring_index(F.lower(F.coalesce(file_name, F.lit(""))), ".", -1).isin(
        *TABULAR_EXTENSIONS
    )


def valid_user_id(user_id: Column) -> Column:
    return F.coalesce(user_id.rlike(r"\A[A-Za-z][A-Za-z0-9_]*\n?\z"), F.lit(False))


def valid_file_id(file_id: Column) -> Column:
    return F.coalesce(file_id.rlike(r"\A[0-9a-f]{32}\z"), F.lit(False))


def clean_name(raw: Column) -> Column:
    """Percent-decode (a plus stays a plus), drop full-width marks, flatten slashes."""
    stray = F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.url_decode(F.replace(stray, F.lit("+"), F.lit("%2B")))
    return F.replace(
        F.regexp_replace(decoded, "[！-～　-〿]", ""), F.lit("/"), F.lit("_")
    )


def extension(name: Column) -> Column:
    """Last dot and what follows; leading dots belong to the stem."""
    return F.regexp_extract(name, r"(?s)\A(?:.*/)?\.*[^./][^/]*?(\.[^./]*)\z", 1)


def truncate_name(name: Column, stamp: Column, max_bytes: int = 200) -> Column:
    """Names over ``max_bytes`` lose four characters of the stem at a time until they fit."""
    ext = extension(name)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    tail = F.concat(F.lit("_"), stamp, ext)
    # What fits has at most ``max_bytes`` characters, so no fewer cuts need to be tried.
    last = F.greatest(F.lit(1), F.ceil(F.length(stem) / 4).cast("int"))
    first = F.greatest(F.lit(1), F.ceil((F.length(stem) - max_bytes) / 4).cast("int"))
    steps = F.sequence(F.least(first, last), last)
    shortened = F.transform(
        steps,
        lambda n: F.concat(
            F.substring(stem, F.lit(1), F.greatest(F.lit(0), F.length(stem) - 4 * n)), tail
        ),
    )
    fitting = F.filter(shortened, lambda s: F.octet_length(s) <= max_bytes)
    return F.when(F.octet_length(name) > max_bytes, F.coalesce(F.get(fitting, F.lit(0)), tail)
                  ).otherwise(name)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def chunk_id(file_id: Column, chunk_idx: Column) -> Column:
    return F.concat(file_id, F.lit("_"), chunk_idx.cast("string"))


def chunk_index(chunk: Column) -> Column:
    """Number after the last underscore of a chunk id."""
    return F.substring_index(chunk, "_", -1).cast("int")


def stable_id(*parts: Column) -> Column:
    """32 hex digits from a natural key, so that reruns agree."""
    return F.md5(F.concat_ws("\u0001", *parts))


def stable_kb_id(*parts: Column) -> Column:
    return F.concat(F.lit("KB"), stable_id(*parts))


def time_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def display_date(stamp: Column, symbol: str = "-") -> Column:
    """``YYYYmmdd...`` as year, month and day; empty stays empty."""
    parts = [F.substring(stamp, start, size) for start, size in ((1, 4), (5, 2), (7, 2))]
    joined = F.concat(parts[0], F.lit(symbol), parts[1], F.lit(symbol), parts[2])
    return F.when(F.coalesce(stamp, F.lit("")) == "", "").otherwise(joined)


def display_size(size: Column) -> Column:
    """Bytes for display; unknown sizes are negative."""
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(size < 0, "未知")
        .when(size < kb, F.concat(size.cast("string"), F.lit("B")))
        .when(size < mb, F.format_string("%.2fKB", size / kb))
        .when(size < gb, F.format_string("%.2fMB", size / mb))
        .otherwise(F.format_string("%.2fG", size / gb))
    )


# Messages shown for a file status.
STATUS_MESSAGES = {
    "gray": "正在上传中，请耐心等待",
    "red": "文件处理失败，请检查文件类型（支持md/txt/pdf/jpg/png/jpeg/docx/xlsx/pptx/eml/csv），"
    "图片和PDF需要PaddleOCR支持",
    "yellow": "faiss插入失败，请稍后再试",
    "green": "上传成功",
}
STATUS_LABELS = {
    "loading": "上传中",
    "red": "解析失败",
    "gray": "上传成功待解析",
    "green": "解析成功",
    "yellow": "解析失败",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(""))


def status_message(status: Column) -> Column:
    return _lookup(status, STATUS_MESSAGES)


def status_label(status: Column, error_text: Column) -> Column:
    """Display label; a failed file shows its own error text when it has one."""
    own = (status == "red") & (F.coalesce(error_text, F.lit("")) != "")
    return F.when(own, error_text).otherwise(_lookup(status, STATUS_LABELS))


def download_target(
    file_id: Column, user_id: Column, file_name: Column, deleted: Column
) -> tuple[Column, Column]:
    """(outcome, target) of a download request, given the looked-up file (null if absent)."""
    outcome = (
        F.when(~valid_file_id(file_id) | user_id.isNull(), "file not found")
        .when(deleted != 0, "file deleted")
        .when(file_name.startswith("http"), "redirect")
        .when(
            (F.coalesce(file_name, F.lit("")) == "")
            | file_name.contains("..")
            | file_name.contains("/")
            | file_name.contains("\\"),
            "invalid file name",
        )
        .otherwise("file")
    )
    target = F.when(outcome == "redirect", file_name).when(
        outcome == "file", F.concat_ws("/", user_id, file_id, file_name)
    )
    return outcome, F.coalesce(target, F.lit(""))
