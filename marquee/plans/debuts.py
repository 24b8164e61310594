"""Debut effect: a company's first title against its later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import one_line, return_on_investment
from marquee.operators.first_rest import first_and_rest
from marquee.plans.concentration import ENTITIES, told_apart


def debut_effect(
    credits: DataFrame,
    entity: tuple[str, ...] | str = ("id", "name"),
    require_rest: bool = True,
    empty_rest: str = "null",
    limit: int | None = None,
) -> DataFrame:
    """Return and popularity of the debut, of the later titles on average, and the difference.

    Companies whose debut has no return are left out. ``require_rest`` also drops companies
    without later titles. ``empty_rest`` says what an average over nothing is: ``'null'`` or
    ``'zero'``. Titles of one day are taken by id. Largest difference in return first; the
    twelfth decimal is beyond what a sum taken in another order can change.
    """
    if empty_rest not in ("null", "zero"):
        raise ValueError("empty_rest must be null or zero")
    names = ENTITIES[(entity,) if isinstance(entity, str) else tuple(entity)]
    credits, apart = told_apart(credits, names)
    dated = (
        credits.where(F.col("release_date").isNotNull() & (F.col("company") != ""))
        .withColumn("company", one_line(F.col("company")))
        .withColumn("roi", return_on_investment(F.col("budget"), F.col("revenue")))
        .withColumn("pop", F.col("popularity"))
        .select(*apart, "release_date", "id", "roi", "pop")
    )
    compared = first_and_rest(dated, apart, "release_date", "id", ["roi", "pop"])
    compared = compared.where(F.col("first_roi").isNotNull())
    if require_rest:
        compared = compared.where("n_rest >= 1")
    post_roi, post_pop = F.col("rest_roi"), F.col("rest_pop")
    if empty_rest == "zero":
        post_roi, post_pop = F.coalesce(post_roi, F.lit(0.0)), F.coalesce(post_pop, F.lit(0.0))
    in_order = [F.col(name).asc_nulls_last() for name in reversed(apart)]
    compared = compared.withColumn("delta_roi", F.col("first_roi") - post_roi).orderBy(
        F.round("delta_roi", 12).desc_nulls_last(), *in_order
    )
    compared = compared if limit is None else compared.limit(limit)
    return compared.select(
        *names,
        F.col("release_date").alias("debut_date"),
        F.col("first_roi").alias("debut_roi"),
        post_roi.alias("post_roi"),
        F.col("first_pop").alias("debut_pop"),
        post_pop.alias("post_pop"),
        F.lit(1).cast("bigint").alias("n_debuts"),
        F.col("n_rest").alias("n_post"),
        "delta_roi",
        (F.col("first_pop") - post_pop).alias("delta_pop"),
    )
