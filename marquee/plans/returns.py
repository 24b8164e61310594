"""Return on investment by budget decile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import band, positive, return_on_investment
from marquee.operators.joins import join_small
from marquee.operators.ranks import nearest_rank, ranked_cells
from marquee.operators.tiles import tile_sums
from marquee.plans.shape import with_decade
from marquee.scratch import small


def _funded(titles: DataFrame, width: int, keep_null_period: bool) -> DataFrame:
    return (
        with_decade(titles, width, keep_null_period)
        .where(positive(F.col("budget")))
        .select("decade", "id", "budget", "revenue")
    )


def _sizes(funded: DataFrame) -> DataFrame:
    return funded.groupBy("decade").agg(
        F.count("revenue").alias("n_movies"), F.count("*").alias("n_budgets")
    )


def budget_sizes(titles: DataFrame, width: int = 10, keep_null_period: bool = False) -> DataFrame:
    """``decade, n_movies, n_budgets``: titles with a budget, those of them with a revenue first."""
    return _sizes(_funded(titles, width, keep_null_period))


def _gate(sizes: DataFrame, min_movies: int, min_budgets: int) -> DataFrame:
    enough = (F.col("n_movies") >= min_movies) & (F.col("n_budgets") >= min_budgets)
    return sizes.withColumn("enough", enough)


def roi_by_decile(
    titles: DataFrame,
    method: str = "ntile",
    min_rows: int = 1,
    min_budgets: int | None = None,
    densify: bool = False,
    tiles: int = 10,
    width: int = 10,
    keep_null_period: bool = False,
) -> DataFrame:
    """Average return per decade and budget decile: ``decade, bud_decile, avg_roi, n``.

    ``method='ntile'``: deciles of even size by budget, ties by id; ``n`` counts every title
    with a budget. ``method='cuts'``: nearest-rank cut points of all budgets, a budget equal
    to a cut goes up; ``n`` counts titles with a revenue. ``min_rows`` and ``min_budgets``
    (the same unless given) drop small decades, see ``roi_skipped``. ``densify`` adds empty
    deciles as zero. ``titles`` is read several times, so it should be a table.
    """
    least = min_rows if min_budgets is None else min_budgets
    roi = return_on_investment(F.col("budget"), F.col("revenue"))
    funded = _funded(titles, width, keep_null_period).withColumn("roi", roi)

    if method == "ntile":
        sums = tile_sums(funded, ["decade"], "budget", ["id"], "roi", tiles)
        sums = sums.withColumnRenamed("tile", "bud_decile")
    elif method == "cuts":
        ranks = {i / tiles: nearest_rank(i * (100 / tiles) / 100) for i in range(1, tiles)}
        found, cells = ranked_cells(funded, ["decade"], "budget", ranks, "roi")
        cuts = found.groupBy("decade").agg(F.sort_array(F.collect_list("value")).alias("_cuts"))
        sums = (
            join_small(cells, cuts, ["decade"])
            .withColumn("bud_decile", band(F.col("_cuts"), F.col("low"), tiles - 1))
            .groupBy("decade", "bud_decile")
            .agg(F.sum("total").alias("total"), F.sum("measured").alias("measured"))
            .withColumn("n", F.col("measured"))
            .where("n > 0")
        )
    else:
        raise ValueError("method must be ntile or cuts")

    if min_rows > 1 or least > 1 or densify:
        kept = small(_gate(_sizes(funded), min_rows, least).where("enough").select("decade"))
        if densify:
            spine = kept.withColumn("bud_decile", F.explode(F.sequence(F.lit(1), F.lit(tiles))))
            sums = join_small(spine, sums, ["decade", "bud_decile"], "left")
        else:
            sums = join_small(sums, kept, ["decade"], "left_semi")
    average = F.try_divide("total", "measured")
    if densify:
        average = F.coalesce(average, F.lit(0.0))
    return sums.select(
        "decade", "bud_decile", average.alias("avg_roi"), F.coalesce("n", F.lit(0)).alias("n")
    ).orderBy(F.col("decade").asc_nulls_last(), "bud_decile")


def roi_skipped(
    titles: DataFrame,
    min_rows: int = 20,
    min_budgets: int | None = None,
    width: int = 10,
    keep_null_period: bool = False,
) -> DataFrame:
    """The decades ``roi_by_decile`` leaves out, with their sizes and the limits."""
    least = min_rows if min_budgets is None else min_budgets
    return (
        _gate(_sizes(_funded(titles, width, keep_null_period)), min_rows, least)
        .where(~F.col("enough"))
        .select(
            "decade",
            "n_movies",
            "n_budgets",
            F.lit(min_rows).alias("min_movies"),
            F.lit(least).alias("min_budgets"),
        )
        .orderBy(F.col("decade").asc_nulls_last())
    )
