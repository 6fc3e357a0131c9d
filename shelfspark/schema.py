"""Table schemas and the required-column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

USERS = T.StructType().add("user_id", "string").add("user_name", "string")
KBS = (
    T.StructType()
    .add("kb_id", "string")
    .add("user_id", "string")
    .add("kb_name", "string")
    .add("deleted", "integer")
)
FILES = (
    T.StructType()
    .add("file_id", "string")
    .add("kb_id", "string")
    .add("file_name", "string")
    .add("status", "string")
    .add("timestamp", "string")
    .add("deleted", "integer")
    .add("file_size", "long")
    .add("content_length", "long")
    .add("chunk_size", "long")
)
FILE_EVENTS = (
    T.StructType()
    .add("file_id", "string")
    .add("kb_id", "string")
    .add("seq", "long")
    .add("op", "string")
    .add("file_name", "string")
    .add("status", "string")
    .add("timestamp", "string")
    .add("file_size", "long")
    .add("content_length", "long")
    .add("chunk_size", "long")
)
KB_EVENTS = (
    T.StructType()
    .add("kb_id", "string")
    .add("user_id", "string")
    .add("seq", "long")
    .add("op", "string")
    .add("kb_name", "string")
)
RAW_DOCS = (
    T.StructType()
    .add("file_id", "string")
    .add("file_name", "string")
    .add("part", "integer")
    .add("text", "string")
    .add("metadata", T.MapType(T.StringType(), T.StringType()))
)
CHUNKS = (
    T.StructType()
    .add("user_id", "string")
    .add("kb_id", "string")
    .add("file_id", "string")
    .add("file_name", "string")
    .add("chunk_idx", "integer")
    .add("chunk_id", "string")
    .add("content", "string")
)
VECTORS = (
    T.StructType()
    .add("user_id", "string")
    .add("kb_id", "string")
    .add("file_id", "string")
    .add("chunk_idx", "integer")
    .add("embedding", T.ArrayType(T.FloatType()))
)
SERVICE_EVENTS = (
    T.StructType()
    .add("service", "string")
    .add("ts", "timestamp")
    .add("seq", "long")
    .add("status", "string")
    .add("detail", "string")
    .add("latency_ms", "double")
)

TABLES = {
    "users": USERS,
    "kbs": KBS,
    "files": FILES,
    "file_events": FILE_EVENTS,
    "kb_events": KB_EVENTS,
    "raw_docs": RAW_DOCS,
    "chunks": CHUNKS,
    "vectors": VECTORS,
    "service_events": SERVICE_EVENTS,
}


def missing_columns(df: DataFrame, required) -> set[str]:
    """Required column names that ``df`` lacks (a schema lookup, no job)."""
    return set(required) - set(df.columns)


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """Return ``df`` unchanged, or raise if a column of ``table`` is missing."""
    missing = missing_columns(df, TABLES[table].names)
    if missing:
        raise ValueError(f"table {table!r} lacks columns {sorted(missing)}")
    return df
