"""Streaming twins of ingest, service state, outcome windows, answers and polling.

All sinks are folders on shared storage. Batches write to a folder of their own number in
overwrite mode, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfspark.config import SERVICES, Settings
from shelfspark.functions import answers as parse
from shelfspark.functions.names import chunk_id
from shelfspark.operators.health import complete_services, outcome_windows, state_aggregates
from shelfspark.plans.ingest import chunk_texts, embed_and_store, last_titles, stamp
from shelfspark.storage import cut_lineage


def _start(df: DataFrame, checkpoint: str, mode: str, sink: Callable) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )


def _replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _has_rows(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


#: Folders that the ledger of an ingest stream is cut into by a hash of the file.
LEDGER_BUCKETS = 64


def ingest(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    cfg: Settings = Settings(),
    files: DataFrame | None = None,
    model: Callable | None = None,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Chunk texts (file_id, text and, if files have several, part) as they arrive.

    A text seen in an earlier batch is not taken again; of texts that share file and part in
    one batch the first by code point is. A part that arrives later goes on numbering where
    its file stands, under the last title of its file if titles are kept. What has been taken
    is kept in a ledger of one row per text beside ``path``, in buckets by file: a batch reads
    those of its own files. With a ``model`` the chunks of ``files`` (file_id, user_id, kb_id,
    file_name) are embedded and stored as in ``plans.ingest.ingest``; vectors and a status per
    file are written beside ``path`` as well. A batch that is run again replaces what it wrote.
    """
    ledger = f"{path}-taken"

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(LEDGER_BUCKETS)).cast("int"))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = [c for c in ("file_id", "part") if c in batch.columns]
        kept = [c for c in batch.columns if c not in (*keys, "text")]
        first = F.min(F.struct("text", *kept)).alias("_first")
        fresh = cut_lineage(batch.groupBy(*keys).agg(first).select(*keys, "_first.*"))
        earlier = titles = None
        if number and _has_rows(spark, ledger):
            wanted = [r[0] for r in bucketed(fresh).select("bucket").distinct().collect()]  # at most LEDGER_BUCKETS
            held = spark.read.parquet(ledger).where((F.col("batch") < number) & F.col("bucket").isin(wanted))
            earlier = held.join(fresh.select("file_id").distinct(), "file_id", "left_semi")
            fresh = cut_lineage(fresh.join(earlier.select(*keys), keys, "left_anti"))
            at = F.struct("batch", "n")
            titles = earlier.where("title is not null").groupBy("file_id").agg(F.max_by("title", at).alias("title"))
        chunks = chunk_texts(fresh, cfg, earlier_titles=titles)
        if earlier is not None:
            taken = earlier.groupBy("file_id").agg(F.sum("n").alias("_taken"))
            at = (F.col("chunk_idx") + F.coalesce("_taken", F.lit(0))).cast("int")
            chunks = (
                chunks.join(taken, "file_id", "left")
                .withColumn("chunk_idx", at)
                .withColumn("chunk_id", chunk_id(F.col("file_id"), F.col("chunk_idx")))
                .drop("_taken")
            )
        chunks.write.mode("overwrite").parquet(f"{path}/batch={number}")
        chunks = spark.read.parquet(f"{path}/batch={number}")
        if model is not None:
            own = files.join(fresh.select("file_id").distinct(), "file_id", "left_semi")
            _, vectors, outcome = embed_and_store(stamp(chunks, own), own, fresh.select("file_id"), model, cfg, store)
            outcome = cut_lineage(outcome)
            vectors.write.mode("overwrite").parquet(f"{path}-vectors/batch={number}")
            outcome.write.mode("overwrite").parquet(f"{path}-status/batch={number}")
        counts = chunks.groupBy("file_id").count()
        # The number of chunks, and the last title, stand with one text of the file.
        rows = fresh.select(*keys).withColumn(
            "_nth", F.row_number().over(Window.partitionBy("file_id").orderBy(*keys))
        )
        only = F.col("_nth") == 1
        n = F.when(only, F.coalesce("count", F.lit(0))).otherwise(0)
        last = last_titles(fresh, cfg) if cfg.title_enhance else fresh.select("file_id", F.lit(None).cast("string").alias("title")).limit(0)
        rows = rows.join(counts, "file_id", "left").join(last, "file_id", "left")
        rows = rows.select(*keys, n.alias("n"), F.when(only, F.col("title")).alias("title"))
        bucketed(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{ledger}/batch={number}")

    return _start(texts, checkpoint, "append", write)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, status) of an ingest stream's files: red or yellow if any batch ended so."""
    worst = F.when(F.col("status") == "red", 0).when(F.col("status") == "yellow", 1).otherwise(2)
    return spark.read.parquet(f"{path}-status").groupBy("file_id").agg(F.min_by("status", worst).alias("status"))


def service_state(
    events: DataFrame, path: str, checkpoint: str, services=SERVICES
) -> StreamingQuery:
    """Latest state per service after every batch; the state is one row per service."""
    latest = events.where(F.col("service").isin(*services)).groupBy("service").agg(
        *state_aggregates()
    )
    return _start(latest, checkpoint, "complete", _replace_batch(path))


def read_service_state(spark: SparkSession, path: str, services=SERVICES) -> DataFrame:
    """The state after the last batch."""
    return complete_services(last_batch(spark, path), services)


def last_batch(spark: SparkSession, path: str) -> DataFrame:
    written = spark.read.parquet(path)
    newest = written.agg(F.max("batch").alias("batch"))
    return written.join(F.broadcast(newest), "batch").drop("batch")  # newest is one row


def service_windows(
    events: DataFrame, path: str, checkpoint: str, seconds: int = 60, late: str = "10 minutes"
) -> StreamingQuery:
    """Outcome windows of the probe period, closed by the watermark."""
    counted = outcome_windows(events.withWatermark("ts", late), seconds)
    return (
        counted.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .format("parquet")
        .trigger(availableNow=True)
        .start(path)
    )


ANSWERS = "stream_id string, answer string, done boolean, error string"


class AnswerFold(StatefulProcessor):
    """Pieces of one answer stream, in any order, to one final record.

    The state of a stream is its pieces until the closing line and all before it are there; the
    first arrival of a piece counts. A stream that stays silent for ``silence`` of event time is
    closed with an error record and what has come without a gap. Of a closed stream only a mark
    is kept, for as long again, so that repeated lines do not open it anew.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getValueState("pieces", "seqs array<bigint>, deltas array<string>, last bigint")
        self.closed = handle.getValueState("closed", "closed boolean")

    def _wake(self, at: int) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _final(self, key, held: dict[int, str], last: int | None, error: str | None):
        whole, seq = [], 0
        while seq in held and (last is None or seq <= last):
            whole.append(held[seq])
            seq += 1
        self.pieces.clear()
        self.closed.update((True,))
        yield pd.DataFrame({"stream_id": [key[0]], "answer": ["".join(whole)], "done": [error is None], "error": [error]})

    def handleInputRows(self, key, rows, timerValues):
        seqs, deltas, last = self.pieces.get() if self.pieces.exists() else ([], [], None)
        held, newest = dict(zip(seqs, deltas)), 0
        for frame in rows:
            for seq, delta, done, ts in zip(frame["seq"], frame["delta"], frame["done"], frame["ts"]):
                held.setdefault(int(seq), delta)
                newest = max(newest, int(ts.timestamp() * 1000))
                if done:
                    last = int(seq) if last is None else min(last, int(seq))
        if self.closed.exists():
            return
        self._wake(max(newest, timerValues.getCurrentWatermarkInMs()) + self.silence_ms)
        if last is not None and all(seq in held for seq in range(last)):
            yield from self._final(key, held, last, None)
        else:
            self.pieces.update((list(held), list(held.values()), last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.closed.exists():
            self.closed.clear()
            return
        seqs, deltas, last = self.pieces.get()
        held = dict(zip(seqs, deltas))
        missing = f"piece {next(i for i in range(len(held) + 1) if i not in held)} is missing"
        self._wake(timerValues.getCurrentWatermarkInMs() + self.silence_ms)
        yield from self._final(key, held, last, "no closing line" if last is None else missing)

    def close(self) -> None:
        pass


def answers(
    events: DataFrame, path: str, checkpoint: str, silence_seconds: int = 600
) -> StreamingQuery:
    """One final record (stream_id, answer, done, error) per answer stream of lines (stream_id,
    seq, raw, ts): the whole answer at its closing line, or an error record once the stream has
    been silent for ``silence_seconds``. Rows without a stream only move the time on."""
    spark = events.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    # The condition names the time, or the optimizer would apply it before the watermark.
    in_stream = F.when(F.col("ts").isNotNull(), F.col("stream_id")).isNotNull()
    lines = events.withWatermark("ts", "0 seconds").where(in_stream)
    deltas = lines.select(
        "stream_id",
        "seq",
        parse.delta(F.col("raw")).alias("delta"),
        parse.is_done(F.col("raw")).alias("done"),
        "ts",
    )
    folded = deltas.groupBy("stream_id").transformWithStateInPandas(
        AnswerFold(1000 * silence_seconds), ANSWERS, "Append", "EventTime"
    )
    return _start(folded, checkpoint, "append", _replace_batch(path))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The final records so far."""
    return spark.read.parquet(path).drop("batch")


def pending(status_events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Per base, whether a file is still waiting, kept per file and then reduced on read."""
    latest = status_events.groupBy("kb_id", "file_id").agg(F.max_by("status", "seq").alias("status"))
    return _start(latest, checkpoint, "update", _replace_batch(path))


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """Latest status of every file over the batches, then any waiting file per base."""
    newest = (
        spark.read.parquet(path)
        .groupBy("kb_id", "file_id")
        .agg(F.max_by("status", "batch").alias("status"))
    )
    return newest.groupBy("kb_id").agg(F.bool_or(F.col("status") == "gray").alias("pending"))


def task_gauge(
    task_events: DataFrame, path: str, checkpoint: str, max_workers: int = 4
) -> StreamingQuery:
    """Pending and active tasks so far: two sums whose state is one row."""
    op = F.col("op")
    counts = task_events.groupBy().agg(
        (F.count_if(op == "submit") - F.count_if(op == "start")).alias("pending"),
        (F.count_if(op == "start") - F.count_if(op == "finish")).alias("active"),
    ).withColumn("max_workers", F.lit(max_workers))
    return _start(counts, checkpoint, "complete", _replace_batch(path))
