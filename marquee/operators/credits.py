"""The title-to-company relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import lead_by_pattern, names_by_pattern


def explode_credits(titles: DataFrame, companies: str = "companies") -> DataFrame:
    """One row per listed company, repeats included; titles without any have no row.

    Adds ``company_id``, ``company``, ``company_ref`` (the text of an id that isn't a whole
    number) and ``n_companies``, the length of the title's list.
    """
    others = [name for name in titles.columns if name not in (companies, "genres")]
    return (
        # The length is taken first, so that the list isn't copied into every row.
        titles.where(F.size(companies) > 0)
        .select(*others, F.size(companies).alias("n_companies"), companies)
        .select(*others, "n_companies", F.explode(companies).alias("_company"))
        .select(
            *others,
            "n_companies",
            F.col("_company.id").alias("company_id"),
            F.col("_company.name").alias("company"),
            F.col("_company.ref").alias("company_ref"),
        )
        .where("company <> ''")
    )


def pattern_credits(titles: DataFrame, text: str, lead_only: bool = False) -> DataFrame:
    """The same from a list text by the name patterns alone, for comparison with such reports.

    Names holding quotes are missed and don't count in ``n_companies``; there are no ids. With
    ``lead_only`` a title is credited to its first name alone.
    """
    others = [name for name in titles.columns if name != text]
    names = F.array_compact(F.array(lead_by_pattern(F.col(text)))) if lead_only else names_by_pattern(F.col(text))
    named = titles.select(*others, names.alias("_names"))
    return (
        named.select(*others, F.size("_names").alias("n_companies"), "_names")
        .select(*others, "n_companies", F.explode("_names").alias("company"))
        .withColumn("company_id", F.lit(None).cast("bigint"))
        .withColumn("company_ref", F.lit(None).cast("string"))
    )
