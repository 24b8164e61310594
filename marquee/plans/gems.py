"""Hidden gems: titles rated at the top of their decade and known by few."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import one_line
from marquee.operators.joins import join_small
from marquee.operators.ranks import cell_quantiles, nearest_rank, values_at_ranks
from marquee.plans.shape import PLAUSIBLE_DECADES, with_decade
from marquee.scratch import small

# So many periods have their limits written into filters; with more of them the limits are joined only.
MOST_PERIODS = 100


def hidden_gems(
    titles: DataFrame,
    min_votes: int = 10,
    scope: str = "eligible",
    method: str = "exact",
    high_q: float = 0.90,
    low_q: float = 0.10,
    accuracy: int = 10_000,
    limit: int | None = None,
    width: int = 10,
    stored_by_period: bool = False,
) -> DataFrame:
    """``decade, id, original_title, va, pop, vc`` of the titles beyond both thresholds.

    The thresholds are percentiles per decade: of the rating (``high_q``) and of the
    popularity (``low_q``). With ``scope='eligible'`` they are taken over titles with both
    values, enough votes and a plausible decade, with ``'all'`` over every known value of
    the decade. ``method='exact'`` is nearest rank, ``'approx'`` one pass that counts
    by cells of one part in ``accuracy``, the same for any order of the rows. Exact reads ``titles`` several times, so it should be a table.

    The thresholds become literals in the filters, so that a Parquet reader skips row groups
    below them. ``stored_by_period`` says that ``titles`` is as ``write_titles`` stores it, in
    folders by period: each is then read with its own thresholds. The rows are the same.
    """
    votes = F.coalesce(F.col("vote_count"), F.lit(0)) if scope == "all" else F.col("vote_count")
    base = with_decade(titles, width).select(
        "decade",
        "id",
        "original_title",
        F.col("vote_average").alias("va"),
        F.col("popularity").alias("pop"),
        votes.alias("vc"),
    )
    known = F.col("va").isNotNull() & F.col("pop").isNotNull()
    eligible = base.where(known & (F.col("vc") >= min_votes))
    if scope == "eligible":
        eligible = eligible.where(F.col("decade").between(*PLAUSIBLE_DECADES))
        measured = eligible
    elif scope == "all":
        eligible = eligible.where(F.col("id") != "").withColumn(
            "original_title", one_line(F.col("original_title"))
        )
        measured = base
    else:
        raise ValueError("scope must be eligible or all")

    limits = small(gem_limits(measured, method, high_q, low_q, accuracy))
    gems = (
        _beyond(eligible, limits, stored_by_period and width == 10)
        .select("decade", "id", "original_title", "va", "pop", "vc")
        .orderBy("decade", F.col("va").desc(), "pop", "id")
    )
    return gems if limit is None else gems.limit(limit)


def _beyond(eligible: DataFrame, limits: DataFrame, by_period: bool) -> DataFrame:
    """The rows beyond the thresholds of their decade, which stand in the filters as far as they can."""
    found = limits.limit(MOST_PERIODS + 1).collect()
    known = [row for row in found if row["_va"] is not None and row["_pop"] is not None]
    va, pop = F.col("va"), F.col("pop")
    if known and len(found) <= MOST_PERIODS:
        if by_period:
            parts = [
                eligible.where((F.col("decade") == row["decade"]) & (va >= row["_va"]) & (pop <= row["_pop"]))
                for row in sorted(known, key=lambda row: row["decade"])
            ]
            return reduce(DataFrame.unionByName, parts)
        eligible = eligible.where(
            (va >= min(row["_va"] for row in known)) & (pop <= max(row["_pop"] for row in known))
        )
    return join_small(eligible, limits, ["decade"]).where("va >= _va AND pop <= _pop")


def gem_limits(measured: DataFrame, method: str, high_q: float, low_q: float, accuracy: int = 10_000) -> DataFrame:
    """``decade, _va, _pop``: the thresholds of rating and popularity, exact or approximate."""
    if method == "approx":
        found = cell_quantiles(measured, ["decade"], {"va": high_q, "pop": low_q}, accuracy)
        return found.select("decade", F.col("va").alias("_va"), F.col("pop").alias("_pop"))
    if method == "exact":
        return _exact_limits(measured, high_q, low_q)
    raise ValueError("method must be exact or approx")


def _exact_limits(measured: DataFrame, high_q: float, low_q: float) -> DataFrame:
    """Both thresholds per decade, from one pass over ratings and popularities together."""
    either = F.array(
        F.struct(F.lit(1).alias("_rating"), F.col("va").alias("_x")),
        F.struct(F.lit(0).alias("_rating"), F.col("pop").alias("_x")),
    )
    ranks = {high_q: nearest_rank(high_q), low_q: nearest_rank(low_q)}
    high = (F.col("_rating") == 1) & (F.col("target") == 0)
    low = (F.col("_rating") == 0) & (F.col("target") == 1)
    return (
        values_at_ranks(measured.select("decade", F.inline(either)), ["decade", "_rating"], "_x", ranks)
        .groupBy("decade")
        .agg(
            F.max(F.when(high, F.col("value"))).alias("_va"),
            F.max(F.when(low, F.col("value"))).alias("_pop"),
        )
    )
