"""The keys of several tables side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_spine(frames: list[DataFrame], key: str) -> DataFrame:
    """Every key that any of the frames has, once, null included.

    Each frame's keys are made distinct before they meet, so what is shuffled is a row for each key and task.
    """
    return reduce(DataFrame.union, [frame.select(key).distinct() for frame in frames]).distinct()


def side_by_side(frames: list[DataFrame], key: str) -> DataFrame:
    """The frames, each with at most one row for each key, as columns beside each other; a missing row is null.

    The frames are read twice, for their keys and for their columns, so they should be tables.
    """
    out = key_spine(frames, key)
    for i, frame in enumerate(frames):
        own = frame.withColumnRenamed(key, f"_key_{i}")
        out = out.join(own, F.col(key).eqNullSafe(F.col(f"_key_{i}")), "left").drop(f"_key_{i}")
    return out
