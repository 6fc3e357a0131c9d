"""Shared-folder checkpoints: lineage is cut on storage that outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names, or a private one for local runs."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="shelfspark-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared one that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read from there. For rows of many
    or wide columns: smaller than a checkpoint, and a reader takes only the columns it needs."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, split_bytes: int = 128 << 20) -> DataFrame:
    """Spread a small table by ``keys`` over the cores before heavy work per row.

    A small file is often one row group, hence one task. A table that its scan deals out to
    every core, by the number of its files or by their size, is left where it lies; streams are
    too.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * split_bytes or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, *keys)
