"""Weighted mean and spread from sums that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.ranks import logarithmic_cell

# Cells to an octave; a cell's sums are taken about a value beside it.
CELLS = 256


def _shift(value: Column) -> Column:
    """A value next to ``value``, the same for its whole cell."""
    near = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value)) * F.lit(CELLS)) / F.lit(float(CELLS)))
    return F.when(value > 0, near).when(value < 0, -near).otherwise(F.lit(0.0))


def weighted_moments(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """``by…, mean, std, n``: weighted mean and population deviation, groups of weight > 0.

    Squares are never summed up about zero, where two large sums would have to be subtracted:
    each cell of values (``CELLS`` to an octave) is summed up about a value beside it, and the
    cells of a group are merged about the group's mean. Equal values have deviation 0 whatever
    they weigh; otherwise rounding changes the variance by about 10^-20 of the squared values
    at most. Rows of weight zero count in ``n`` only. ``value`` must not be null.
    """
    w, x = F.col(weight), F.col(value).cast("double")
    off = x - _shift(x)
    weighed = F.when(w > 0, x)
    cells = rows.groupBy(*by, logarithmic_cell(x, CELLS).alias("_cell")).agg(
        F.sum(w).cast("double").alias("_w"),
        F.sum(w * off).alias("_wd"),
        F.sum(w * off * off).alias("_wdd"),
        F.min(weighed).alias("_low"),
        F.max(weighed).alias("_high"),
        F.count("*").alias("n"),
    )
    one = F.col("_low") == F.col("_high")
    about = F.col("_wd") / F.col("_w")
    inner = F.when(one, F.lit(0.0)).otherwise(F.greatest(F.col("_wdd") - F.col("_wd") * about, F.lit(0.0)))
    cell = F.struct(
        F.when(one, F.col("_low")).otherwise(_shift(F.col("_low")) + about).alias("mean"),
        F.col("_w").alias("w"),
        inner.alias("square"),
    )
    merged = cells.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.when(F.col("_w") > 0, cell))).alias("_cells"), F.sum("n").alias("n")
    )

    def total(part) -> Column:
        return F.aggregate("_cells", F.lit(0.0), lambda sum_, c: sum_ + part(c))

    # The lowest cell's mean is the shift of the group.
    low = F.element_at("_cells", 1)["mean"]
    return (
        merged.where(F.size("_cells") > 0)
        .withColumn("_w", total(lambda c: c["w"]))
        .withColumn("mean", low + total(lambda c: c["w"] * (c["mean"] - low)) / F.col("_w"))
        .withColumn("_square", total(lambda c: c["square"] + c["w"] * (c["mean"] - F.col("mean")) * (c["mean"] - F.col("mean"))))
        .select(*by, "mean", F.sqrt(F.col("_square") / F.col("_w")).alias("std"), "n")
    )
