"""Joins of a large table with a table of at most one row per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(rows: DataFrame, lookup: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Add a lookup table with a row per group; null equals null in ``names``.

    Names that are never null in the lookup are compared plainly, which is cheaper. Whether
    it is broadcast follows from its size: by the mark of ``scratch.small``, or by Spark.
    """
    nullable = {name for name in names if lookup.schema[name].nullable}
    lookup = lookup.withColumnsRenamed({name: f"_on_{name}" for name in names})
    match = F.lit(True)
    for name in names:
        own, other = F.col(name), F.col(f"_on_{name}")
        match = match & (own.eqNullSafe(other) if name in nullable else own == other)
    joined = rows.join(lookup, match, how)
    return joined.drop(*[f"_on_{name}" for name in names])
