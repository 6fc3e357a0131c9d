"""State changes as appended events, folded to the current state.

No table format with updates is assumed: a change is a row, and the state is an aggregate
that combines on the map side, so files with very many events cost no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.catalog import files_by_status, live
from shelfspark.schema import FILE_EVENTS, KB_EVENTS

FILE_ATTRIBUTES = (
    "kb_id", "file_name", "status", "timestamp", "file_size", "content_length", "chunk_size",
)


def _latest(value: str) -> Column:
    """Last non-null value along ``seq``."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq")))


def fold_files(events: DataFrame) -> DataFrame:
    """Current files from their add, update and delete events, attribute by attribute."""
    sizes = ("file_size", "content_length", "chunk_size")
    folded = events.groupBy("file_id").agg(
        *(_latest(name).alias(name) for name in FILE_ATTRIBUTES),
        F.max((F.col("op") == "delete").cast("int")).alias("deleted"),
    )
    return folded.withColumns({name: F.coalesce(name, F.lit(-1)) for name in sizes})


def fold_kbs(events: DataFrame) -> DataFrame:
    """Current bases; the last rename wins, and only renames by the owner count."""
    return events.groupBy("kb_id", "user_id").agg(
        _latest("kb_name").alias("kb_name"),
        F.max((F.col("op") == "delete").cast("int")).alias("deleted"),
    )


def _event(df: DataFrame, schema, op: str, seq: int) -> DataFrame:
    return df.select(
        *(
            F.lit(op).alias("op")
            if f.name == "op"
            else F.lit(seq).cast("bigint").alias("seq")
            if f.name == "seq"
            else F.col(f.name).cast(f.dataType)
            if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        )
    )


def file_update_events(changes: DataFrame, seq: int) -> DataFrame:
    """Update events from rows of file_id and any of the file attributes."""
    return _event(changes, FILE_EVENTS, "update", seq)


def add_file_events(registered: DataFrame, seq: int) -> DataFrame:
    """Add events of the files that were accepted (``msg`` is success); they wait for ingest."""
    accepted = registered.where("msg = 'success'").withColumn("status", F.lit("gray"))
    return _event(accepted, FILE_EVENTS, "add", seq)


def add_kb_events(kbs: DataFrame, users: DataFrame, incoming: DataFrame, seq: int) -> DataFrame:
    """Add events of incoming (user_id, kb_id, kb_name) bases with a known user and a new id."""
    fresh = incoming.join(users.select("user_id"), "user_id", "left_semi").join(kbs.select("kb_id"), "kb_id", "left_anti")
    return _event(fresh.dropDuplicates(["kb_id"]), KB_EVENTS, "add", seq)


def delete_file_events(files: DataFrame, asked: DataFrame, seq: int) -> DataFrame:
    """Delete events for asked (kb_id, file_id) rows that exist."""
    hit = files.select("kb_id", "file_id").join(
        asked.select("kb_id", "file_id"), ["kb_id", "file_id"], "left_semi"
    )
    return _event(hit, FILE_EVENTS, "delete", seq)


def delete_kb_events(
    kbs: DataFrame, files: DataFrame, asked: DataFrame, seq: int
) -> tuple[DataFrame, DataFrame]:
    """Delete events for asked (user_id, kb_id) bases of that owner, and for their files."""
    hit = kbs.select("kb_id", "user_id").join(
        asked.select("user_id", "kb_id"), ["user_id", "kb_id"], "left_semi"
    )
    inside = files.select("kb_id", "file_id").join(hit.select("kb_id"), "kb_id", "left_semi")
    return _event(hit, KB_EVENTS, "delete", seq), _event(inside, FILE_EVENTS, "delete", seq)


def rename_kb_events(kbs: DataFrame, asked: DataFrame, seq: int) -> DataFrame:
    """Rename events for asked (user_id, kb_id, kb_name) rows of the owner."""
    owned = kbs.select("user_id", "kb_id")
    return _event(asked.join(owned, ["user_id", "kb_id"], "left_semi"), KB_EVENTS, "rename", seq)


def swap_status(files: DataFrame, asked: DataFrame, old: str, new: str) -> DataFrame:
    """Files with the status of the asked ones changed, where it is ``old``."""
    marked = asked.select("file_id", F.lit(True).alias("_asked")).distinct()
    changed = F.col("_asked").isNotNull() & (F.col("status") == old)
    return (
        files.join(marked, "file_id", "left")
        .withColumn("status", F.when(changed, F.lit(new)).otherwise(F.col("status")))
        .drop("_asked")
    )


def stage_status(parsed: Column, embedded: Column, indexed: Column | None) -> Column:
    """Final status of a file from how far its ingest came; waiting while not indexed."""
    status = F.when(~parsed | ~embedded, "red")
    if indexed is None:
        return status.otherwise("gray")
    return status.when(~indexed, "yellow").otherwise("green")


def clean_by_status(
    files: DataFrame,
    kbs: DataFrame,
    status: str,
    user_id: str,
    seq: int,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Delete events (with names) for a user's live files in ``status``.

    Without ``asked`` (user_id, kb_id) rows, all live bases of the user are cleaned.
    """
    bases = live(kbs).where(F.col("user_id") == user_id).select("user_id", "kb_id")
    if asked is not None:
        bases = bases.join(asked, ["user_id", "kb_id"], "left_semi")
    hit = files_by_status(files, status).join(bases.select("kb_id"), "kb_id", "left_semi")
    return _event(hit, FILE_EVENTS, "delete", seq)


def delete_vectors(vectors: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Vectors (or chunks) that remain once the files are gone."""
    return vectors.join(file_ids.select("file_id"), "file_id", "left_anti")


def delete_kb_vectors(vectors: DataFrame, kb_ids: DataFrame) -> DataFrame:
    """Every file with a chunk in the given bases goes, whole."""
    gone = vectors.join(kb_ids.select("kb_id"), "kb_id", "left_semi").select("file_id").distinct()
    return delete_vectors(vectors, gone)


def present_files(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked file ids that have vectors."""
    held = vectors.select("file_id").distinct()
    return held.join(asked.select("file_id"), "file_id", "left_semi")


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors without a chunk and chunks without a vector."""
    keys = ["user_id", "file_id", "chunk_idx"]
    left = vectors.select(*keys).join(chunks.select(*keys), keys, "left_anti")
    right = chunks.select(*keys).join(vectors.select(*keys), keys, "left_anti")
    return left.withColumn("lacks", F.lit("chunk")).unionByName(
        right.withColumn("lacks", F.lit("vector"))
    )
