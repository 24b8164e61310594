"""The earliest row of an entity against the average of its other rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_and_rest(
    rows: DataFrame, entity: list[str], date: str, tie: str, measures: list[str]
) -> DataFrame:
    """``entity…, date, n_rest, first_<m>…, rest_<m>…`` with the average of the other rows.

    An entity may own a large part of all rows, so they aren't ranked: the earliest row is
    a minimum and the rest is what the sums hold besides it, which combines before the
    shuffle. Taking one huge value out of a floating-point sum would leave rounding noise
    as the average of the others, so every value is summed up in three parts, see
    ``_parts``. Ties on the date go by ``tie``, then by the measures.
    """
    earliest = F.min(F.struct(date, tie, *measures))
    aggregates: list[Column] = [earliest.alias("_first"), F.count("*").alias("_rows")]
    for m in measures:
        aggregates += [F.sum(part).alias(f"_{m}_{i}") for i, part in enumerate(_parts(F.col(m)))]
        aggregates.append(F.count(m).alias(f"_{m}_count"))
    summed = rows.where(F.col(date).isNotNull()).groupBy(*entity).agg(*aggregates)

    def rest(m: str) -> Column:
        first = F.col(f"_first.{m}")
        left = [
            F.col(f"_{m}_{i}") - F.coalesce(part, F.lit(0.0)) for i, part in enumerate(_parts(first))
        ]
        total = left[0] + left[1] + left[2]
        count = F.col(f"_{m}_count") - first.isNotNull().cast("int")
        return F.when(count > 0, total / count)

    return summed.select(
        *entity,
        F.col(f"_first.{date}").alias(date),
        (F.col("_rows") - 1).alias("n_rest"),
        *[F.col(f"_first.{m}").alias(f"first_{m}") for m in measures],
        *[rest(m).alias(f"rest_{m}") for m in measures],
    )


def _parts(value: Column) -> list[Column]:
    """The value as a multiple of 2^30, a multiple of 2^-10 below that, and the remainder.

    The parts add up to the value exactly. Sums of the first two are exact as well while
    they stay below 2^83 and 2^43, so a value can be taken out again without a trace.
    """
    coarse = F.rint(value / 2.0**30) * 2.0**30
    middle = F.rint((value - coarse) * 2.0**10) / 2.0**10
    return [coarse, middle, value - coarse - middle]
