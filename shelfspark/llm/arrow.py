"""Running Python over Arrow batches inside tasks, with bounded memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one call of a batch function sees at most, unless one text alone is longer.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that a slice's texts stay under ``most`` bytes."""
    for batch in batches:
        start = size = 0
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for at, length in enumerate(lengths):
            if size and size + length > most:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, of: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """``df`` through ``of``, which turns a slice of rows, of ``most`` bytes of text, into columns
    of equal length."""

    owner = of.__module__

    def run(batches):
        hold_only(owner)
        for batch in slices(batches, text, most):
            yield pa.RecordBatch.from_pydict(of(batch))
        let_go()

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, most: int):
    """Jobs planned meanwhile send at most about ``most`` bytes at once to Python; a larger row goes
    alone. Else a batch is up to 10,000 whole texts, held by the JVM and by the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def let_go() -> None:
    """Gives freed memory back to the system, Arrow's and the allocator's: a worker that waits for
    its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


_held: dict[tuple, object] = {}


def held(owner: str, key, make: Callable):
    """What ``make`` gives, kept by the Python worker for later tasks of the same operator."""
    hold_only(owner)
    if (owner, key) not in _held:
        _held.clear()
        _held[owner, key] = make()
    return _held[owner, key]


def hold_only(owner: str) -> None:
    """Lets go of what other operators hold: workers serve one after the other."""
    if any(name != owner for name, _ in _held):
        _held.clear()
        let_go()


class Memo(dict):
    """A dict that starts anew when it holds ``most`` entries; long keys are not kept."""

    def __init__(self, most: int, key_length: int = 48):
        super().__init__()
        self.most, self.key_length = most, key_length

    def keep(self, key, value):
        if len(key) <= self.key_length:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
