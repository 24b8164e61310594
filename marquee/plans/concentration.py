"""Market concentration: the companies with the largest prorated revenue of a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import fraction, one_line, positive, prorate
from marquee.operators.credits import explode_credits
from marquee.operators.topk import top_k_with_total
from marquee.plans.shape import with_decade

ENTITIES = {("id", "name"): ["company_id", "company"], ("name",): ["company"]}


def told_apart(credits: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The credits and the columns that tell companies apart: by id, also one that is only a text."""
    if "company_id" not in names:
        return credits, names
    if "company_ref" not in credits.columns:
        credits = credits.withColumn("company_ref", F.lit(None).cast("string"))
    return credits, ["company_ref", *names]


def top_share(
    titles: DataFrame,
    credits: DataFrame | None = None,
    k: int = 5,
    output: str = "full",
    entity: tuple[str, ...] | str = ("id", "name"),
    width: int = 10,
) -> DataFrame:
    """Top k companies per decade by revenue, a title's revenue being split evenly.

    ``output='summary'`` has one row per decade with ``top_share`` and ``total`` (also for
    decades without any company), ``'detail'`` the ranked companies, ``'full'`` both side by
    side. Shares are fractions of the revenue of all titles of the decade. ``credits`` holds
    one row per title and company; without it the ``companies`` lists are exploded.
    """
    if output not in ("full", "summary", "detail"):
        raise ValueError("output must be full, summary or detail")
    names = ENTITIES[(entity,) if isinstance(entity, str) else tuple(entity)]
    credits = explode_credits(titles) if credits is None else credits
    credits, apart = told_apart(credits, names)

    wholes = with_decade(titles, width).where(positive(F.col("revenue"))).select("decade", "revenue")
    parts = (
        with_decade(credits, width)
        .where(positive(F.col("revenue")) & (F.col("company") != ""))
        .withColumn("revenue", prorate(F.col("revenue"), F.col("n_companies")))
        .withColumn("company", one_line(F.col("company")))
        .select("decade", *apart, "revenue")
    )
    top = top_k_with_total(wholes, parts, "decade", apart, "revenue", k)
    share = fraction(F.col("top"), F.col("total")).alias("top_share")
    if output == "summary":
        first = F.col("rank").isNull() | (F.col("rank") == 1)
        return top.where(first).select("decade", share, "total").orderBy("decade")
    detail = [
        "rank",
        *names,
        "revenue",
        fraction(F.col("revenue"), F.col("total")).alias("pct_of_total"),
    ]
    ranked = top.where(F.col("rank").isNotNull())
    if output == "detail":
        return ranked.select("decade", *detail).orderBy("decade", "rank")
    return ranked.select("decade", share, *detail).orderBy("decade", "rank")
