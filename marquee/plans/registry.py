"""The analyses by name, in the variants a user can ask for."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.credits import explode_credits
from marquee.plans.concentration import top_share
from marquee.plans.debuts import debut_effect
from marquee.plans.gems import hidden_gems
from marquee.plans.returns import roi_by_decile
from marquee.plans.shape import in_digits
from marquee.plans.stability import rating_stability
from marquee.sources.files import report_lines

# How many votes a title needs unless the caller says otherwise.
DEFAULT_MIN_VOTES = 10
# How many rows the capped lists have.
LISTED_DEBUTS = 200
LISTED_GEMS = 500
# Decimals of the report columns.
REPORT_DIGITS = {
    "top5_pct": 4,
    "total": 2,
    "revenue": 2,
    "pct": 4,
    "avg_roi": 6,
    "debut_roi": 6,
    "debut_pop": 6,
    "post_roi": 6,
    "post_pop": 6,
    "delta_roi": 6,
    "delta_pop": 6,
    "va": 3,
    "pop": 3,
    "mean": 6,
    "std": 6,
}
# The columns in front of the tab in a report line.
REPORT_KEYS = {
    "roi": ["decade", "decile"],
    "debut": ["cid", "name"],
    "hg": ["decade"],
    "stab": ["decade", "bucket"],
}
# The smallest decade the gated return report shows.
REPORT_MIN_ROWS = 20


def min_votes_of(value: object = None) -> int:
    """A vote limit from user input: whole and not negative, the default if it's no number."""
    try:
        number = float(str(value).strip() or 0) if value is not None else math.nan
    except ValueError:
        number = math.nan
    return max(0, math.floor(number)) if math.isfinite(number) else DEFAULT_MIN_VOTES


def _named(frame: DataFrame, **names: str) -> DataFrame:
    return frame.withColumnsRenamed(names)


def _mc_summary(titles: DataFrame, credits: DataFrame) -> DataFrame:
    shares = top_share(titles, credits, output="summary")
    return shares.select("decade", (F.col("top_share") * 100).alias("top5_pct"), "total")


def _mc_detail(titles: DataFrame, credits: DataFrame) -> DataFrame:
    ranked = top_share(titles, credits, output="detail")
    return ranked.select(
        "decade",
        "rank",
        F.col("company_id").alias("cid"),
        F.col("company").alias("name"),
        "revenue",
        (F.col("pct_of_total") * 100).alias("pct"),
    )


def _debut_report(credits: DataFrame) -> DataFrame:
    compared = debut_effect(credits, require_rest=False, empty_rest="zero")
    return compared.select(
        F.col("company_id").alias("cid"),
        F.col("company").alias("name"),
        F.col("debut_date").alias("date"),
        "debut_roi",
        "debut_pop",
        "post_roi",
        "post_pop",
        "n_post",
        "delta_roi",
        "delta_pop",
    ).orderBy(F.coalesce(F.col("cid").cast("string"), F.lit("")), "name")


@dataclass
class Limits:
    """What a caller may set: votes for the gems, titles and budgets per decade for the returns, how titles are stored."""

    min_votes: int = DEFAULT_MIN_VOTES
    min_rows: int = REPORT_MIN_ROWS
    min_budgets: int | None = None
    stored_by_period: bool = False


_VARIANTS: dict[str, Callable[[DataFrame, DataFrame, Limits], DataFrame]] = {
    # The query service: companies by name, fractions, capped lists.
    "q1": lambda t, c, limits: _named(top_share(t, c, entity="name"), top_share="top5_share"),
    "q1_general": lambda t, c, limits: _named(
        top_share(t, c, entity="name", output="summary").where("top_share > 0").drop("total"),
        top_share="top5_share",
    ),
    "q1_detalle": lambda t, c, limits: top_share(t, c, entity="name", output="detail"),
    "q2": lambda t, c, limits: roi_by_decile(t, keep_null_period=True),
    "q3": lambda t, c, limits: debut_effect(c, entity="name", limit=LISTED_DEBUTS),
    "q4": lambda t, c, limits: hidden_gems(
        t, limits.min_votes, limit=LISTED_GEMS, stored_by_period=limits.stored_by_period
    ),
    "q5": lambda t, c, limits: _named(
        rating_stability(t, zero_weight="count", keep_null_period=True), mean="mean_va", std="sd_va"
    ),
    # The batch reports: companies by id and name, percents, fixed decimals, no caps.
    "mc_summary": lambda t, c, limits: in_digits(_mc_summary(t, c), REPORT_DIGITS),
    "mc_detail": lambda t, c, limits: in_digits(_mc_detail(t, c), REPORT_DIGITS),
    "roi": lambda t, c, limits: in_digits(
        _named(
            roi_by_decile(
                t, "cuts", min_rows=limits.min_rows, min_budgets=limits.min_budgets, densify=True
            ),
            bud_decile="decile",
        ),
        REPORT_DIGITS,
    ),
    "debut": lambda t, c, limits: in_digits(_debut_report(c), REPORT_DIGITS),
    "hg": lambda t, c, limits: in_digits(
        _named(
            hidden_gems(t, limits.min_votes, scope="all", stored_by_period=limits.stored_by_period),
            original_title="title",
            vc="votes",
        ),
        REPORT_DIGITS,
    ),
    "stab": lambda t, c, limits: in_digits(rating_stability(t), REPORT_DIGITS),
}


def variants() -> list[str]:
    return list(_VARIANTS)


def run(
    name: str,
    titles: DataFrame,
    credits: DataFrame | None = None,
    min_votes: object = None,
    min_rows: int = REPORT_MIN_ROWS,
    min_budgets: int | None = None,
    stored_by_period: bool = False,
) -> DataFrame:
    """The named analysis over a titles table.

    Only ``q4`` and ``hg`` heed ``min_votes`` and ``stored_by_period`` (see ``hidden_gems``),
    only ``roi`` the other two limits. Without
    ``credits`` the companies listed in ``titles`` are used. ``q2``, ``q4``, ``roi`` and ``hg``
    start jobs of their own before the frame is returned, to find the ranks they need.
    """
    if name not in _VARIANTS:
        raise KeyError(f"unknown query {name!r}; available: {', '.join(_VARIANTS)}")
    if credits is None and "companies" in titles.columns:
        credits = explode_credits(titles)
    return _VARIANTS[name](titles, credits, Limits(min_votes_of(min_votes), min_rows, min_budgets, stored_by_period))


def report(name: str, titles: DataFrame, credits: DataFrame | None = None, **limits: object) -> DataFrame:
    """The lines of a batch report in one text column: ``mc``, ``roi``, ``debut``, ``hg`` or ``stab``."""
    if name == "mc":
        return _concentration_report(titles, credits)
    if name not in REPORT_KEYS:
        raise KeyError(f"unknown report {name!r}; available: mc, {', '.join(REPORT_KEYS)}")
    return report_lines(run(name, titles, credits, **limits), REPORT_KEYS[name], REPORT_DIGITS)


def _concentration_report(titles: DataFrame, credits: DataFrame | None) -> DataFrame:
    """Per decade a line with the common share and the total, then the ranked companies."""
    shares = run("mc_summary", titles, credits).select(
        "decade", F.lit("TOP5").alias("top"), "top5_pct", F.lit("TOTAL").alias("all"), "total"
    )
    ranked = run("mc_detail", titles, credits).withColumn("place", F.concat(F.lit("TOP"), "rank"))
    ranked = ranked.select("decade", "place", "rank", "cid", "name", "revenue", "pct")
    first = report_lines(shares, ["decade"], REPORT_DIGITS, keep=["decade"])
    rest = report_lines(ranked, ["decade", "place"], REPORT_DIGITS, keep=["decade", "rank"])
    lines = first.unionByName(rest, allowMissingColumns=True)
    return lines.orderBy("decade", F.col("rank").asc_nulls_first()).select("value")
