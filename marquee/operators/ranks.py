"""Exact order statistics of very large groups.

A handful of periods may hold all rows, so no period may be sorted in one task. The value
at a given rank is found by counting instead. Approximate percentiles give a narrow bracket
around every wanted rank; one pass then counts the rows by value inside the brackets and as
a whole between them. What is left is a small table of such cells. A bracket is cut into a
few slots, and only the cells of the slot with a wanted rank are ever sorted: about one row
in two thousand. The percentiles decide how small all this gets, never the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import passed
from marquee.operators.joins import join_small
from marquee.scratch import small, written

# One part in so many is the rank error that brackets are made for.
BRACKET_ACCURACY = 1_000
# The summaries of a group are merged by so many tasks before they meet in one.
MERGERS = 64
# The limits of a summary's size.
LEAST_SUMMARY, MOST_SUMMARY = 8, 65_535
# A bracket is cut into one slot more than this.
CUTS_PER_BRACKET = 7

Ranks = dict[float, Callable[[Column], Column]]


def nearest_rank(share: float) -> Callable[[Column], Column]:
    """Rank of a percentile among n values: the smallest whole number >= share * n."""
    return lambda n: F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(share) * n)))


def end_of_tile(tile: int, tiles: int) -> Callable[[Column], Column]:
    """Last rank of a tile when n rows go to tiles of even size, the first ones getting the rest."""
    return lambda n: F.least(
        n, F.floor(n / tiles) * F.lit(tile) + F.least(F.lit(tile), F.pmod(n, F.lit(tiles)))
    )


def quantiles(rows: DataFrame, by: list[str], values: dict[str, list[float]], accuracy: int) -> DataFrame:
    """``by…`` and for each column of ``values`` the array of its approximate quantiles.

    A quantile's rank is off by less than one part in ``accuracy`` of the rows, as a rule.
    Every task summarises its rows; the summaries of a group are merged in two steps, so the
    task that makes the last one gets ``MERGERS`` of them, however many tasks there were.
    """
    size = F.lit(max(LEAST_SUMMARY, min(MOST_SUMMARY, 8 * accuracy)))
    parts = rows.groupBy(*by, F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_merger")).agg(
        *[F.kll_sketch_agg_double(F.col(name).cast("double"), size).alias(name) for name in values]
    )
    whole = parts.groupBy(*by).agg(*[F.kll_merge_agg_double(name, size).alias(name) for name in values])
    return whole.select(
        *by,
        *[
            F.kll_sketch_get_quantile_double(name, F.array(*[F.lit(float(s)) for s in shares])).alias(name)
            for name, shares in values.items()
        ],
    )


def logarithmic_cell(value: Column, accuracy: int) -> Column:
    """The number of a value's cell: cells follow the order of the values, ``accuracy`` of them double it."""
    size = F.abs(value)
    number = F.when(size == float("inf"), F.lit(1e9)).otherwise(F.log2(size)) * F.lit(accuracy)
    # Sizes fall where the values are negative; the offset keeps sizes below one on their side of zero.
    above = F.floor(number).cast("bigint") + F.lit(1_100 * accuracy)
    return F.when(value > 0, above).when(value < 0, -above).otherwise(F.lit(0).cast("bigint"))


def cell_quantiles(rows: DataFrame, by: list[str], values: dict[str, float], accuracy: int) -> DataFrame:
    """``by…`` and for each column of ``values`` a value near its nearest-rank percentile, the same for any order of rows.

    One pass counts the rows by cells, each a part in ``accuracy`` of an octave wide. The answer is the smallest value
    in the cell with the wanted rank: it is off by less than one part in ``accuracy``, and right where the
    cell holds one value. Cells are added up before the shuffle, and their number doesn't grow with the rows.
    """
    each = F.array(*[F.struct(F.lit(name).alias("_name"), F.col(name).cast("double").alias("_x"), F.lit(share).alias("_share")) for name, share in values.items()])
    cells = (
        rows.select(*by, F.inline(each))
        .where(F.col("_x").isNotNull() & ~F.isnan("_x"))
        .groupBy(*by, "_name", "_share", logarithmic_cell(F.col("_x"), accuracy).alias("_cell"))
        .agg(F.count("*").alias("_n"), F.min("_x").alias("_low"))
    )
    group = Window.partitionBy(*by, "_name")
    rank = F.greatest(F.lit(1), F.ceil(F.col("_share") * F.sum("_n").over(group)))
    up_to = F.sum("_n").over(group.orderBy("_cell"))
    found = cells.select(*by, "_name", "_low", (up_to >= rank).alias("_reached")).where("_reached")
    return found.groupBy(*by).agg(*[F.min(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in values])


def _cells(
    rows: DataFrame, by: list[str], value: str, shares: list[float], measure: str | None, accuracy: int, slack: float
) -> DataFrame:
    """``by…, _slot, _inside, low, ties`` (and ``total, measured``), written as a table.

    A cell is one value inside a bracket, or all rows between two brackets; ``low`` is its
    smallest value. Slots follow the order of the values.
    """
    lows, highs = [max(0.0, p - slack) for p in shares], [min(1.0, p + slack) for p in shares]
    inner = sorted(
        {
            low + (high - low) * i / (CUTS_PER_BRACKET + 1)
            for low, high in zip(lows, highs, strict=True)
            for i in range(1, CUTS_PER_BRACKET + 1)
        }
    )
    points = sorted({*lows, *highs, *inner})
    around = small(quantiles(rows.withColumn("_points", F.col(value)), by, {"_points": points}, accuracy))

    def values_at(wanted: list[float]) -> Column:
        return F.array(*[F.get("_points", F.lit(points.index(p))) for p in wanted])

    brackets = around.select(
        *by, values_at(lows).alias("_lows"), values_at(highs).alias("_highs"), values_at(inner).alias("_inner")
    )
    measured = [measure] if measure else []
    placed = (
        join_small(rows, brackets, by)
        .select(
            *by,
            value,
            *measured,
            passed(F.col("_lows"), F.col(value), len(shares)).alias("_entered"),
            passed(F.col("_highs"), F.col(value), len(shares), including=False).alias("_left"),
            passed(F.col("_inner"), F.col(value), len(inner)).alias("_within"),
        )
        # All three counts only grow with the value, so equal sums mean equal counts.
        .withColumn("_slot", F.col("_entered") + F.col("_left") + F.col("_within"))
        .withColumn("_inside", F.col("_entered") > F.col("_left"))
    )
    sums = [F.sum(measure).alias("total"), F.count(measure).alias("measured")] if measure else []
    return written(
        placed.groupBy(*by, "_slot", "_inside", F.when(F.col("_inside"), F.col(value)).alias("_key"))
        .agg(F.min(value).alias("low"), F.count("*").alias("ties"), *sums)
        .drop("_key")
    )


def _wanted(cells: DataFrame, by: list[str], ranks: Ranks) -> DataFrame:
    """Per group and rank: the slot that holds it and the rows in the slots below."""
    in_order = Window.partitionBy(*by).orderBy("_slot")
    targets = F.array(
        *[
            F.struct(F.lit(i).alias("target"), rank(F.col("n")).cast("bigint").alias("rank"))
            for i, rank in enumerate(ranks.values())
        ]
    )
    return small(
        cells.groupBy(*by, "_slot", "_inside")
        .agg(F.sum("ties").alias("_in_slot"))
        .withColumn("n", F.sum("_in_slot").over(Window.partitionBy(*by)))
        .withColumn("_below", F.sum("_in_slot").over(in_order) - F.col("_in_slot"))
        .withColumn("_t", F.explode(targets))
        .select(*by, "_slot", "_inside", "_in_slot", "n", "_below", "_t.*")
        .where("_below < rank AND rank <= _below + _in_slot")
        .drop("_in_slot")
    )


def ranked_cells(
    rows: DataFrame,
    by: list[str],
    value: str,
    ranks: Ranks,
    measure: str | None = None,
    accuracy: int = BRACKET_ACCURACY,
    slack: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The values at the ranks, see ``values_at_ranks``, and the cells they come from.

    No two wanted values, nor rows on different sides of one, share a cell: sums over the
    rows between the ranks can be taken from the cells, ``low`` standing for the value. With
    ``measure`` they carry its sum and count as ``total`` and ``measured``.
    """
    columns = [*by, value, *([measure] if measure else [])]
    known = F.col(value).isNotNull() & ~F.isnan(value)
    rows = rows.where(known).select(*columns)
    slack = slack or 2.0 / accuracy
    while True:
        cells = _cells(rows, by, value, sorted(ranks), measure, accuracy, slack)
        wanted = _wanted(cells, by, ranks)
        if wanted.where("NOT _inside").isEmpty():
            break
        slack *= 10  # a bracket has missed its rank; at the widest they cover everything

    slot = [*by, "_slot"]
    sought = join_small(cells, wanted.select(*slot), slot, "left_semi").select(*slot, "low", "ties")
    so_far = Window.partitionBy(*slot).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    sought = sought.withColumn("start", F.sum("ties").over(so_far) - F.col("ties"))
    found = (
        join_small(sought, wanted, slot)
        .withColumn("before", F.col("_below") + F.col("start"))
        .where("before < rank AND rank <= before + ties")
        .select(*by, "target", "n", "rank", F.col("low").alias("value"), "before", "ties")
    )
    return found, cells


def values_at_ranks(
    rows: DataFrame, by: list[str], value: str, ranks: Ranks, **options: float
) -> DataFrame:
    """For each group and each wanted rank: the value there and how its ties lie.

    ``ranks`` maps the approximate share of the rows below the rank to the rank itself as
    an expression of the group's row count. Values that are null or no number are left out. ``rows`` is read
    twice, so it should be a table. The result is small:

    ``by…, target (0, 1, … in the order of ranks), n, rank, value, before, ties``

    with ``before`` rows smaller than the value and ``ties`` rows equal to it.
    """
    return ranked_cells(rows, by, value, ranks, **options)[0]
