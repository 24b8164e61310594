"""What there is in each period, over all analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.spine import side_by_side
from marquee.plans.concentration import top_share
from marquee.plans.returns import budget_sizes
from marquee.plans.shape import with_decade
from marquee.scratch import small


def period_overview(
    titles: DataFrame, credits: DataFrame | None = None, k: int = 5, min_votes: int = 10, width: int = 10
) -> DataFrame:
    """``decade, total, top_share, n_movies, n_budgets, n_rated`` of every period that any analysis has.

    ``total`` and ``top_share`` are those of ``top_share``, ``n_movies`` and ``n_budgets`` the sizes that
    ``roi_by_decile`` looks at, ``n_rated`` the titles with a rating and enough votes. An analysis
    without the period counts as zero. Each analysis is computed once, before the frame is
    returned, as its rows are read for their periods and for their columns.
    """
    shares = top_share(titles, credits, k, "summary", width=width)
    rated = (
        with_decade(titles, width)
        .where(F.col("vote_average").isNotNull() & (F.col("vote_count") >= min_votes))
        .groupBy("decade")
        .agg(F.count("*").alias("n_rated"))
    )
    found = side_by_side([small(frame) for frame in (shares, budget_sizes(titles, width), rated)], "decade")
    return found.fillna(0, ["total", "top_share", "n_movies", "n_budgets", "n_rated"]).select(
        "decade", "total", "top_share", "n_movies", "n_budgets", "n_rated"
    ).orderBy("decade")
