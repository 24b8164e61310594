"""The largest entities of a period and their part of the period's total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.exact import exact_sums


def top_k_with_total(
    wholes: DataFrame, parts: DataFrame, by: str, entity: list[str], amount: str, k: int
) -> DataFrame:
    """``by, rank, entity…, amount, total, top``: k rows per period, or one with rank null.

    ``wholes`` gives the total per period, ``parts`` the amounts of the entities. Both go
    through one aggregation; the total then sorts ahead of the entities of its period, so
    a single window limited to k + 1 rows per period yields everything. Amounts are added
    up exactly, see ``exact``: equal sums must not differ by the order they were added in,
    and any other difference counts, however small. They must not be negative. Ties go by
    name, then by the other columns.
    """
    rows = wholes.select(by, amount, F.lit(True).alias("_whole")).unionByName(
        parts.select(by, amount, *entity, F.lit(False).alias("_whole")), allowMissingColumns=True
    )
    summed = exact_sums(rows, [by, "_whole", *entity], amount)
    best_first = Window.partitionBy(by).orderBy(
        F.col("_whole").desc(),
        F.col("_exact").desc_nulls_last(),
        *[F.col(name).asc_nulls_last() for name in reversed(entity)],
    )
    period = Window.partitionBy(by)
    part = F.when(~F.col("_whole"), F.col(amount))
    # Every part comes from a title that is in the total, so the total has rank 1.
    return (
        summed.withColumn("_place", F.row_number().over(best_first))
        .where(F.col("_place") <= k + 1)
        .withColumn("total", F.max(F.when(F.col("_whole"), F.col(amount))).over(period))
        .withColumn("top", F.coalesce(F.sum(part).over(period), F.lit(0.0)))
        .withColumn("_size", F.count("*").over(period))
        .where(~F.col("_whole") | (F.col("_size") == 1))
        .select(
            by,
            F.when(~F.col("_whole"), F.col("_place") - 1).alias("rank"),
            *entity,
            part.alias(amount),
            "total",
            "top",
        )
    )
