"""Running totals over groups too large to be sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.joins import join_small
from marquee.scratch import small, written


def spread(rows: DataFrame, by: list[str], order: list[str], weight: str) -> tuple[DataFrame, DataFrame]:
    """The rows in ordered blocks, and a small table of the blocks.

    Rows are spread by range over group and order, so a large group covers many partitions;
    a block is what a partition holds of a group, numbered in ``_block``. The blocks have
    ``by…, _block, _start, _total``: the group's ``weight`` before the block and in it. The
    spread is written once, so that rows and blocks agree. Rows with equal ``by`` and
    ``order`` should be merged beforehand. The blocks are as many as groups and partitions
    together.
    """
    stored = written(rows.repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy(*by, "_block").agg(F.sum(weight).alias("_total"))
    start = F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    return stored, small(totals.withColumn("_start", start))


def total_in_block(by: list[str], order: list[str], weight: str) -> Column:
    """Total of ``weight`` up to a row within its block."""
    so_far = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(weight).over(so_far)


def running_total(rows: DataFrame, by: list[str], order: list[str], weight: str) -> DataFrame:
    """Add ``start`` and ``end``: the group's total of ``weight`` before and up to each row."""
    stored, blocks = spread(rows, by, order, weight)
    return (
        join_small(stored, blocks, [*by, "_block"])
        .withColumn("end", F.col("_start") + total_in_block(by, order, weight))
        .withColumn("start", F.col("end") - F.col(weight))
        .drop("_block", "_start", "_total")
    )
