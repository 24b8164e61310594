"""What the analyses read from a titles table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import period_of_date

# The decades taken as plausible where an analysis asks for it.
PLAUSIBLE_DECADES = (1870, 2100)


def with_decade(titles: DataFrame, width: int = 10, keep_null_period: bool = False) -> DataFrame:
    """Add ``decade``, the first year of the ``width``-year period of the release date.

    The stored ``period`` is the decade; it is used as it is, so that a table partitioned by
    it is pruned.
    """
    stored = width == 10 and "period" in titles.columns
    decade = F.col("period") if stored else period_of_date(F.col("release_date"), width)
    dated = titles.withColumn("decade", decade)
    return dated if keep_null_period else dated.where(F.col("decade").isNotNull())


def genre_count(titles: DataFrame) -> Column:
    """Number of genres: a stored ``n_genres`` column or the length of the list.

    Counting the ids instead of the records keeps the names out of the scan.
    """
    return F.col("n_genres") if "n_genres" in titles.columns else F.size("genres.id")


def in_digits(frame: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named columns that are present; minus zero becomes zero."""
    names = {name: n for name, n in digits.items() if name in frame.columns}
    return frame.withColumns({name: F.round(F.col(name), n) + F.lit(0.0) for name, n in names.items()})
