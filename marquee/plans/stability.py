"""Rating stability by number of genres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import capped_bucket
from marquee.operators.moments import weighted_moments
from marquee.plans.shape import genre_count, with_decade


def rating_stability(
    titles: DataFrame,
    zero_weight: str = "drop",
    cap: int = 3,
    width: int = 10,
    keep_null_period: bool = False,
) -> DataFrame:
    """``decade, bucket, mean, std, n``: ratings weighted by votes, per number of genres.

    ``zero_weight='drop'`` leaves titles without votes out, ``'count'`` keeps them in ``n``
    where the bucket has any votes. Titles without genre or rating never take part.
    """
    if zero_weight not in ("drop", "count"):
        raise ValueError("zero_weight must be drop or count")
    rated = (
        with_decade(titles, width, keep_null_period)
        .withColumn("bucket", capped_bucket(genre_count(titles), cap))
        .withColumn("votes", F.greatest(F.coalesce("vote_count", F.lit(0)), F.lit(0)))
        .where(F.col("bucket").isNotNull() & F.col("vote_average").isNotNull())
        .select("decade", "bucket", "vote_average", "votes")
    )
    if zero_weight == "drop":
        rated = rated.where("votes > 0")
    return weighted_moments(rated, ["decade", "bucket"], "vote_average", "votes").orderBy(
        F.col("decade").asc_nulls_last(), "bucket"
    )
