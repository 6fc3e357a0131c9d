"""Ordered scans that never put a whole group, or the whole table, into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.storage import cut_lineage


def explode_rows(df: DataFrame, array: str, element: str, at: str | None = None) -> DataFrame:
    """One row per element of an array column, with its position if ``at`` is given.

    The outer form is used because the plain one makes the optimizer test the size of the
    array in a filter below, which computes a costly array a second time, before any shuffle.
    """
    kept = [c for c in df.columns if c != array]
    place = at or "_place"
    rows = df.select(*kept, F.posexplode_outer(array).alias(place, element))
    rows = rows.where(F.col(place).isNotNull())
    return rows if at else rows.drop(place)


def fill_forward(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    inclusive: bool = True,
    block_rows: int = 65536,
) -> DataFrame:
    """Last non-null ``value`` per key along the row number ``order``.

    Rows of a key are scanned in blocks of ``block_rows`` numbers. What a block inherits is
    one row per block, so a key that holds most of the table still spreads over many tasks.
    Keys that fit one block (nearly all) inherit nothing and the carry side stays empty.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    tails = (
        blocked.where(F.col(value).isNotNull())
        .groupBy(*keys, "_block")
        .agg(F.max_by(value, order).alias("_tail"))
    )
    blocks = blocked.where("_block > 0").select(*keys, "_block").distinct()
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocks.join(tails, [*keys, "_block"], "full")
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(along))
        .where("_carry is not null and _block > 0")
        .drop("_tail")
    )
    last_row = 0 if inclusive else -1
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, last_row)
    )
    return (
        blocked.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
        .join(carry, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_block", "_local", "_carry")
    )


def ordered_concat(
    df: DataFrame,
    keys: list[str],
    order: str,
    text: str,
    out: str,
    separator: str = "",
    block_rows: int = 4096,
) -> DataFrame:
    """Texts of a key joined along the row number ``order``, first in blocks, then the blocks."""

    def joined(order_column: str, text_column: str):
        ordered = F.array_sort(F.collect_list(F.struct(order_column, text_column)))
        return F.array_join(F.transform(ordered, lambda row: row[text_column]), separator)

    blocks = (
        df.withColumn("_block", F.floor(F.col(order) / block_rows))
        .groupBy(*keys, "_block")
        .agg(joined(order, text).alias("_text"))
    )
    return blocks.groupBy(*keys).agg(joined("_block", "_text").alias(out))


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with partition number and position.

    The frame is checkpointed: its two readers must see the same placement, and a lost
    executor must not lead to another one.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = placed.withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(
        numbered.withColumn("_part", F.shiftright("_at", 33)).withColumn(
            "_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        )
    ).drop("_at")


def _offsets(ranged: DataFrame, amounts: dict) -> DataFrame:
    """Sums of ``amounts`` over all earlier partitions: one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*(a.alias(f"_total_{n}") for n, a in amounts.items()))
    return totals.select(
        "_part",
        *(
            F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_before_{n}")
            for n in amounts
        ),
    )


def dense_ids(df: DataFrame, order: list, out: str, start: int = 0) -> DataFrame:
    """Consecutive ids from ``start`` along ``order``, without a single-task window."""
    ranged = _ranged(df, order)
    offsets = F.broadcast(_offsets(ranged, {"n": F.count(F.lit(1))}))  # a row per partition
    return (
        ranged.join(offsets, "_part")
        .withColumn(out, F.col("_before_n") + F.col("_pos") + F.lit(start))
        .drop("_part", "_pos", "_before_n")
    )


def running_sums(df: DataFrame, order: list, amounts: dict[str, str]) -> DataFrame:
    """Running totals over the whole table along ``order``: output name to amount column.

    ``order`` should be unique, or rows that tie are summed in any order.
    """
    ranged = _ranged(df, order)
    totals = {out: F.sum(column) for out, column in amounts.items()}
    offsets = F.broadcast(_offsets(ranged, totals))  # a row per partition
    inside = (
        Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = ranged.join(offsets, "_part")
    for out, column in amounts.items():
        summed = summed.withColumn(out, F.col(f"_before_{out}") + F.sum(column).over(inside))
    return summed.drop("_part", "_pos", *(f"_before_{out}" for out in amounts))
