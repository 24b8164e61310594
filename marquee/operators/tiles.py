"""``ntile`` over very large groups, aggregated per tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import passed
from marquee.operators.joins import join_small
from marquee.operators.ranks import end_of_tile, ranked_cells
from marquee.operators.running import spread, total_in_block
from marquee.scratch import small


def tile_sums(
    rows: DataFrame,
    by: list[str],
    value: str,
    ties: list[str],
    measure: str,
    tiles: int = 10,
    **options: float,
) -> DataFrame:
    """Sums per tile of ``ntile(tiles) over (partition by … order by value, ties…)``.

    Only the values at the ends of the tiles matter. The rows between two of them are summed
    up without being sorted; only rows that equal an end value which falls into two tiles
    are spread by ``ties``, and of those only the blocks at an end are sorted. Result:
    ``by…, tile, n, total, measured`` with the sum and the count of ``measure``. ``value``
    must not be null.
    """
    rows = rows.select(*by, value, *ties, measure)
    ranks = {t / tiles: end_of_tile(t, tiles) for t in range(1, tiles)}
    found, cells = ranked_cells(rows, by, value, ranks, measure, **options)
    ends = small(found)
    split = ends.where("rank < before + ties").select(*by, F.col("value").alias(value))
    any_split = not split.isEmpty()

    values = ends.groupBy(*by).agg(F.sort_array(F.collect_list("value")).alias("_ends"))
    located = join_small(cells, values, by)
    located = located.withColumn("tile", passed(F.col("_ends"), F.col("low"), tiles - 1, including=False) + 1)
    if any_split:
        located = join_small(located, split.withColumnRenamed(value, "low"), [*by, "low"], "left_anti")
    whole = located.groupBy(*by, "tile").agg(
        F.sum("ties").alias("n"), F.sum("total").alias("total"), F.sum("measured").alias("measured")
    )
    if not any_split:
        return whole

    tied = (
        join_small(rows, split, [*by, value], "left_semi")
        .groupBy(*by, value, *ties, measure)
        .agg(F.count("*").alias("_copies"))
    )
    shared = _tied_sums(tied, ends, by, value, ties, measure, tiles)
    return (
        whole.unionByName(shared)
        .groupBy(*by, "tile")
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.sum(F.coalesce("measured", F.lit(0))).alias("measured"),
        )
    )


def _tied_sums(
    tied: DataFrame, ends: DataFrame, by: list[str], value: str, ties: list[str], measure: str, tiles: int
) -> DataFrame:
    """The sums of rows equal to an end value, ``_copies`` saying how often each one occurs."""
    group, order = [*by, value], [*ties, measure]
    bounds = ends.groupBy(*by).agg(F.sort_array(F.collect_list("rank")).alias("_ranks"))
    firsts = ends.groupBy(*by, F.col("value").alias(value)).agg(F.first("before").alias("_before"))

    def tiles_of(low: Column, high: Column) -> tuple[Column, Column]:
        first = passed(F.col("_ranks"), low, tiles - 1) + 1
        return first, passed(F.col("_ranks"), high, tiles - 1, including=False) + 1

    stored, blocks = spread(tied, group, order, "_copies")
    blocks = join_small(join_small(blocks, firsts, group), bounds, by)
    blocks = blocks.withColumn("_from", F.col("_before") + F.col("_start"))
    first, last = tiles_of(F.col("_from"), F.col("_from") + F.col("_total"))
    blocks = blocks.select(*group, "_block", "_ranks", "_from", first.alias("_first"), last.alias("_last"))

    def located(condition: str) -> DataFrame:
        return join_small(stored, blocks.where(condition), [*group, "_block"])

    inside = located("_first = _last").select(*by, F.col("_first").alias("tile"), measure, "_copies")

    high = F.col("_from") + total_in_block(group, order, "_copies")
    across = located("_first < _last").withColumn("_high", high)
    across = across.withColumn("_low", F.col("_high") - F.col("_copies"))
    first, last = tiles_of(F.col("_low"), F.col("_high"))
    # Copies of one row may still cover several tiles.
    across = across.withColumn("tile", F.explode(F.sequence(first, last)))
    low = F.greatest("_low", F.get("_ranks", F.col("tile") - 2))
    high = F.least("_high", F.get("_ranks", F.col("tile") - 1))
    across = across.select(*by, "tile", measure, (high - low).alias("_copies"))

    copies = F.col("_copies")
    return (
        inside.unionByName(across)
        .groupBy(*by, "tile")
        .agg(
            F.sum(copies).alias("n"),
            F.sum(F.col(measure) * copies).alias("total"),
            F.sum(F.when(F.col(measure).isNotNull(), copies)).alias("measured"),
        )
    )
