"""Users, knowledge bases and files: lookups, ownership and status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.config import FILE_STATUSES
from shelfspark.functions import names


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted") == 0)


def user_exists(asked: DataFrame, users: DataFrame) -> DataFrame:
    """Asked user ids that are known."""
    return asked.join(users.select("user_id"), "user_id", "left_semi")


def user_kbs(kbs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Live bases, of one user or of all."""
    found = live(kbs).select("user_id", "kb_id", "kb_name")
    return found if user_id is None else found.where(F.col("user_id") == user_id)


def kb_names(kbs: DataFrame, asked: DataFrame) -> DataFrame:
    """Owner and name of the asked bases that are live."""
    return user_kbs(kbs).join(asked.select("kb_id"), "kb_id", "left_semi")


def missing_kbs(asked: DataFrame, kbs: DataFrame) -> DataFrame:
    """Asked (user_id, kb_id) pairs that are not a live base of that user, each once."""
    owned = live(kbs).select("user_id", "kb_id")
    return asked.select("user_id", "kb_id").distinct().join(owned, ["user_id", "kb_id"], "left_anti")


def owned_files(files: DataFrame, kbs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Live files in bases of the user; a deleted base still counts as owned."""
    owners = kbs.select("kb_id", "user_id")
    if user_id is not None:
        owners = owners.where(F.col("user_id") == user_id).select("kb_id")
        return live(files).join(owners, "kb_id", "left_semi")
    return live(files).join(owners, "kb_id", "left_semi")


def list_files(files: DataFrame, kbs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Files as listed to their owner, with the message for their status."""
    return owned_files(files, kbs, user_id).select(
        "kb_id",
        "file_id",
        "file_name",
        "status",
        F.col("file_size").alias("bytes"),
        "content_length",
        "timestamp",
        names.status_message(F.col("status")).alias("msg"),
    )


def files_by_status(files: DataFrame, status: str) -> DataFrame:
    return live(files).where(F.col("status") == status).select("kb_id", "file_id", "file_name")


def existing_files(asked: DataFrame, files: DataFrame, kbs: DataFrame) -> DataFrame:
    """Asked (user_id, kb_id, file_id) rows whose live file lies in a base of that user."""
    known = live(files).select("kb_id", "file_id", "status")
    owners = kbs.select("user_id", "kb_id")
    return (
        asked.join(owners, ["user_id", "kb_id"], "left_semi")
        .join(known, ["kb_id", "file_id"])
        .select("user_id", "kb_id", "file_id", "status")
    )


def accept_uploads(incoming: DataFrame, files: DataFrame, mode: str = "soft") -> DataFrame:
    """Uploads that are taken: in soft mode a name live in the base is refused.

    Two equal names within one upload are both taken.
    """
    if mode != "soft":
        return incoming
    taken = live(files).select("kb_id", "file_name")
    return incoming.join(taken, ["kb_id", "file_name"], "left_anti")


def lineage(files: DataFrame, kbs: DataFrame, users: DataFrame) -> DataFrame:
    """Owner, name and deletion flag per file; deleted files and bases included."""
    owners = kbs.select("kb_id", "user_id").join(users.select("user_id"), "user_id")
    return files.select("file_id", "kb_id", "file_name", "deleted").join(owners, "kb_id").select(
        "file_id", "user_id", "file_name", "deleted"
    )


def downloads(
    asked: DataFrame, files: DataFrame, kbs: DataFrame, users: DataFrame
) -> DataFrame:
    """What each asked file id resolves to: a path, a redirect, or why not."""
    found = asked.join(lineage(files, kbs, users), "file_id", "left")
    outcome, target = names.download_target(
        F.col("file_id"), F.col("user_id"), F.col("file_name"), F.col("deleted")
    )
    return found.select("file_id", outcome.alias("outcome"), target.alias("target"))


def total_status(files: DataFrame, kbs: DataFrame) -> DataFrame:
    """Per live base of a user, the live files in each status; zeros included.

    Files are counted by base before they meet the bases, so a base holding most files
    sends one row per map task.
    """
    counts = live(files).groupBy("kb_id").agg(
        *(F.count_if(F.col("status") == status).alias(status) for status in FILE_STATUSES)
    )
    return live(kbs).join(counts, "kb_id", "left").select(
        "user_id",
        F.concat("kb_name", "kb_id").alias("kb_key"),
        *(F.coalesce(status, F.lit(0)).alias(status) for status in FILE_STATUSES),
    )


def status_totals(files: DataFrame, kbs: DataFrame) -> DataFrame:
    """Per base, the number of listed files in each status that occurs."""
    return owned_files(files, kbs).groupBy("kb_id", "status").agg(
        F.count(F.lit(1)).alias("n_files")
    )


def status_map(files: DataFrame, kbs: DataFrame) -> DataFrame:
    """The same as one map per base."""
    entries = F.array_sort(F.collect_list(F.struct("status", "n_files")))
    return status_totals(files, kbs).groupBy("kb_id").agg(
        F.map_from_entries(entries).alias("total")
    )


def any_pending(files: DataFrame, kbs: DataFrame) -> DataFrame:
    """Per base, whether a listed file is still waiting."""
    return owned_files(files, kbs).groupBy("kb_id").agg(
        F.bool_or(F.col("status") == "gray").alias("pending")
    )


def file_stats(chunks: DataFrame) -> DataFrame:
    """Characters and number of chunks per file."""
    return chunks.groupBy("file_id").agg(
        F.sum(F.length("content")).alias("content_length"),
        F.count(F.lit(1)).alias("chunk_size"),
    )


def add_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming users whose id is new, one row each."""
    fresh = incoming.groupBy("user_id").agg(F.min("user_name").alias("user_name"))
    return fresh.join(users.select("user_id"), "user_id", "left_anti")


# What a refused file is answered with.
UNKNOWN_USER = "invalid user_id, please check..."
UNKNOWN_KB = ("invalid kb_id, please check ['", "']")


def register_files(incoming: DataFrame, kbs: DataFrame, users: DataFrame) -> DataFrame:
    """Outcome of adding files: accepted, or refused because of the user or the base."""
    known = users.select("user_id", F.lit(True).alias("_user"))
    owned = live(kbs).select("user_id", "kb_id", F.lit(True).alias("_kb"))
    joined = incoming.join(known, "user_id", "left").join(owned, ["user_id", "kb_id"], "left")
    message = (
        F.when(F.col("_user").isNull(), UNKNOWN_USER)
        .when(F.col("_kb").isNull(), F.concat(F.lit(UNKNOWN_KB[0]), "kb_id", F.lit(UNKNOWN_KB[1])))
        .otherwise("success")
    )
    return joined.withColumn("msg", message).drop("_user", "_kb")
