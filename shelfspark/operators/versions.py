"""Catalogue and vector tables that change: snapshots with deltas, ordered conditional changes,
and deletions as bitmaps of positions.

Everything here is a folder of Parquet files on shared storage. A folder that Spark has not
finished, one without its success mark, is not read, so a job that dies halfway changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.config import FILE_STATUSES
from shelfspark.operators.dml import FILE_ATTRIBUTES
from shelfspark.schema import FILE_EVENTS, KB_EVENTS

BUCKETS = 32
SIZES = ("file_size", "content_length", "chunk_size")


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished folders ``n=<number>`` under ``path``, ascending."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = []
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("n=") and files.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


# --- snapshots and deltas ---------------------------------------------------------


@dataclass(frozen=True)
class StateLog:
    """State of files or bases as a snapshot and the events after it, under ``path``.

    ``deltas/n=<seq>`` has the events of one change, ``snapshots/n=<seq>`` the state up to a
    change. In both an attribute stands with the number of the change that set it, so they
    merge by the larger number, in any order and on the map side. Rows lie in folders by a hash
    of their key, so one file's state is looked up in one of ``BUCKETS`` folders.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    attributes: tuple[str, ...]

    def _events(self) -> T.StructType:
        return FILE_EVENTS if "file_id" in self.key else KB_EVENTS

    def _set(self, events: DataFrame) -> DataFrame:
        """Events as attributes with the change that set them."""
        schema = {f.name: f.dataType for f in self._events()}
        at = [
            F.when(F.col(name).isNotNull(), F.struct("seq", F.col(name).cast(schema[name]).alias("value"))).alias(name)
            for name in self.attributes
        ]
        gone = F.when(F.col("op") == "delete", F.col("seq")).alias("deleted_at")
        return events.select(*self.key, *at, gone)

    def _merged(self, rows: DataFrame) -> DataFrame:
        last = [F.max(name).alias(name) for name in (*self.attributes, "deleted_at")]  # by seq first
        return rows.groupBy(*self.key).agg(*last)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(BUCKETS)).cast("int"))

    def append(self, events: DataFrame, seq: int) -> None:
        """Writes the events of change ``seq``; writing a change again replaces it."""
        rows = self._bucketed(self._set(events.withColumn("seq", F.lit(seq).cast("long"))))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/deltas/n={seq}")

    def _rows(self, as_of: int | None, only: DataFrame | None) -> DataFrame | None:
        base = max((n for n in _finished(self.spark, f"{self.path}/snapshots") if as_of is None or n <= as_of), default=None)
        later = [
            n for n in _finished(self.spark, f"{self.path}/deltas")
            if (base is None or n > base) and (as_of is None or n <= as_of)
        ]
        paths = [f"{self.path}/deltas/n={n}" for n in later] + ([f"{self.path}/snapshots/n={base}"] if base is not None else [])
        if not paths:
            return None
        schema = {f.name: f.dataType for f in self._events()}
        stored = T.StructType([T.StructField(k, schema[k]) for k in self.key])
        for name in self.attributes:
            stored.add(name, T.StructType().add("seq", "long").add("value", schema[name]))
        stored.add("deleted_at", "long").add("bucket", "integer")
        parts = [self.spark.read.schema(stored).parquet(p) for p in paths]
        rows = reduce(DataFrame.unionByName, parts)
        if only is not None:
            asked = self._bucketed(only.select(*self.key).distinct())
            wanted = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
            rows = rows.where(F.col("bucket").isin(wanted)).join(asked.drop("bucket"), list(self.key), "left_semi")
        return rows.drop("bucket")

    def read(self, as_of: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """The state after change ``as_of`` (the last one), of the keys in ``only`` or of all;
        None before any change."""
        rows = self._rows(as_of, only)
        if rows is None:
            return None
        state = self._merged(rows)
        values = [
            (F.coalesce(F.col(name)["value"], F.lit(-1)) if name in SIZES else F.col(name)["value"]).alias(name)
            for name in self.attributes
        ]
        return state.select(*self.key, *values, F.col("deleted_at").isNotNull().cast("int").alias("deleted"))

    def compact(self) -> int | None:
        """Writes the state after the last change as a snapshot, which later reads start from."""
        changes = _finished(self.spark, f"{self.path}/deltas")
        if not changes or changes[-1] in _finished(self.spark, f"{self.path}/snapshots"):
            return None
        rows = self._bucketed(self._merged(self._rows(changes[-1], None)))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshots/n={changes[-1]}")
        return changes[-1]


def file_log(spark: SparkSession, path: str) -> StateLog:
    return StateLog(spark, path, ("file_id",), FILE_ATTRIBUTES)


def kb_log(spark: SparkSession, path: str) -> StateLog:
    return StateLog(spark, path, ("kb_id", "user_id"), ("kb_name",))


# --- ordered conditional changes --------------------------------------------------


def compose_swaps(files: DataFrame, changes: DataFrame, statuses=FILE_STATUSES) -> DataFrame:
    """Files with the status they have after ``changes`` (file_id, seq, old, new) in order.

    A change takes files whose status is ``old`` to ``new`` and leaves others. It is a map from
    status to status, and maps compose: each range of ordered changes is folded to one map where
    it lies, and the maps of a file's ranges to one. A file with most of the changes is many
    ranges; what meets for a file is a map per range. Changes of one number go by old and new.
    """
    order = ["file_id", "seq", "old", "new"]
    placed = changes.select(*order).where(F.col("old").isin(*statuses) & F.col("new").isin(*statuses))
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    place = {s: i for i, s in enumerate(statuses)}
    schema = pa.schema([("file_id", pa.string()), ("part", pa.int32()), ("map", pa.list_(pa.int32()))])

    def fold(batches):
        open_file, part, own = None, None, []
        for batch in batches:
            out = []
            for file_id, old, new, at in zip(*(batch.column(c).to_pylist() for c in ("file_id", "old", "new", "part"))):
                if file_id != open_file:
                    if own:
                        out.append({"file_id": open_file, "part": part, "map": own})
                    open_file, part, own = file_id, at, list(range(len(place)))
                own = [place[new] if s == place[old] else s for s in own]
            yield pa.RecordBatch.from_pylist(out, schema)
        if own:
            yield pa.RecordBatch.from_pylist([{"file_id": open_file, "part": part, "map": own}], schema)

    maps = ranged.mapInArrow(fold, "file_id string, part int, map array<int>")
    of_file = maps.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("_maps"))
    names = F.array(*(F.lit(s) for s in statuses))
    start = F.array_position(names, F.col("status")).cast("int") - 1
    after = F.aggregate("_maps", start, lambda status, m: F.get(m["map"], status))
    known = F.col("_maps").isNotNull() & F.col("status").isin(*statuses)
    return (
        files.join(of_file, "file_id", "left")
        .withColumn("status", F.when(known, F.get(names, after)).otherwise(F.col("status")))
        .drop("_maps")
    )


# --- deletions as bitmaps ---------------------------------------------------------


@dataclass(frozen=True)
class VectorTable:
    """Vectors under ``path``: ``rows/n=<number>`` as they were appended, ``gone/n=<number>`` with
    bitmaps of the positions deleted in stored files. A compaction writes ``rewritten/n=<number>``
    and then ``retired/n=<number>``, the names of the files that this replaces; both count from
    the moment that the second is finished."""

    spark: SparkSession
    path: str

    def _next(self, kind: str) -> str:
        done = _finished(self.spark, f"{self.path}/{kind}")
        return f"{self.path}/{kind}/n={(done[-1] if done else 0) + 1}"

    def _all(self, kind: str, numbers: list[int] | None = None) -> DataFrame | None:
        numbers = _finished(self.spark, f"{self.path}/{kind}") if numbers is None else numbers
        if not numbers:
            return None
        paths = [f"{self.path}/{kind}/n={n}" for n in numbers]
        reader = self.spark.read.option("basePath", f"{self.path}/{kind}")
        if kind == "rewritten":  # there may be nothing left to write
            reader = reader.schema(self._all("rows").schema)
        return reader.parquet(*paths)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").partitionBy("user_id").parquet(self._next("rows"))

    def _placed(self) -> DataFrame | None:
        """All stored rows with the file and the position that they have."""
        retired = self._all("retired")
        stored = [self._all("rows"), self._all("rewritten", _finished(self.spark, f"{self.path}/retired"))]
        place = {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
        placed = [df.withColumns(place).drop("n") for df in stored if df is not None]
        if not placed:
            return None
        rows = reduce(DataFrame.unionByName, placed)
        if retired is None:
            return rows
        return rows.join(F.broadcast(retired.drop("n")), "_file", "left_anti")  # a row per rewritten file

    def marks(self) -> DataFrame | None:
        """(_file, _bucket, gone): a bitmap for each run of positions in a stored file."""
        gone = self._all("gone")
        return None if gone is None else gone.drop("n").groupBy("_file", "_bucket").agg(F.bitmap_or_agg("gone").alias("gone"))

    def _live(self) -> DataFrame | None:
        placed, marks = self._placed(), self.marks()
        if placed is None or marks is None:
            return placed
        bit = F.bitmap_bit_position("_row").cast("int")
        byte = F.conv(F.hex(F.substring("gone", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_gone = F.getbit(byte, (bit % 8).cast("int")) == 1
        joined = placed.withColumn("_bucket", F.bitmap_bucket_number("_row")).join(marks, ["_file", "_bucket"], "left")
        return joined.where(F.col("gone").isNull() | ~is_gone).drop("_bucket", "gone")

    def read(self) -> DataFrame | None:
        rows = self._live()
        return None if rows is None else rows.drop("_file", "_row")

    def delete(self, file_ids: DataFrame) -> None:
        """Marks the rows of files as gone; nothing that is stored is rewritten."""
        rows = self._live()
        if rows is None:
            return
        hit = rows.select("file_id", "_file", "_row").join(file_ids.select("file_id").distinct(), "file_id", "left_semi")
        marks = hit.groupBy("_file", F.bitmap_bucket_number("_row").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("gone")
        )
        marks.write.mode("overwrite").parquet(self._next("gone"))

    def delete_kbs(self, kb_ids: DataFrame) -> None:
        """Marks every file with a row in the given bases, whole."""
        rows = self.read()
        if rows is not None:
            self.delete(rows.join(kb_ids.select("kb_id"), "kb_id", "left_semi").select("file_id"))

    def compact(self, share: float = 0.5) -> int:
        """Rewrites the stored files of which at least ``share`` is gone; the others stay as they
        are. Returns how many were rewritten."""
        placed, marks = self._placed(), self.marks()
        if placed is None or marks is None:
            return 0
        stored = placed.groupBy("_file").agg(F.count("*").alias("_n"))
        lost = marks.groupBy("_file").agg(F.sum(F.bitmap_count("gone")).alias("_lost"))
        worn = stored.join(lost, "_file").where(F.col("_lost") >= share * F.col("_n")).select("_file")
        names = [r["_file"] for r in worn.collect()]  # a row per rewritten file
        if not names:
            return 0
        kept = self._live().where(F.col("_file").isin(names)).drop("_file", "_row")
        place = self._next("retired")
        kept.write.mode("overwrite").partitionBy("user_id").parquet(place.replace("/retired/", "/rewritten/"))
        self.spark.createDataFrame([(n,) for n in names], "_file string").write.mode("overwrite").parquet(place)
        return len(names)
