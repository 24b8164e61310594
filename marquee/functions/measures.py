"""Small numeric expressions used by several analyses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def period_of_year(year: Column, width: int = 10) -> Column:
    """First year of the period the year falls in."""
    return (F.floor(year / F.lit(float(width))) * F.lit(width)).cast("int")


def positive(amount: Column) -> Column:
    """Above zero and a number; Spark takes NaN for the largest of all."""
    return (amount > 0) & ~F.isnan(amount)


def period_of_date(date: Column, width: int = 10) -> Column:
    return period_of_year(F.year(date), width)


def prorate(amount: Column, count: Column) -> Column:
    """An equal share of the amount; null when there is nobody to share it."""
    return F.try_divide(amount, count)


def fraction(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def return_on_investment(budget: Column, revenue: Column) -> Column:
    """(revenue - budget) / budget, null unless the budget is positive and both are known."""
    return F.when(positive(budget) & ~F.isnan(revenue), F.try_divide(revenue - budget, budget))


def capped_bucket(count: Column, cap: int = 3) -> Column:
    """``1``, ``2``, … and ``<cap>+``; null below one."""
    return F.when(count >= cap, F.lit(f"{cap}+")).when(count >= 1, count.cast("string"))


def passed(cuts: Column, value: Column, count: int, including: bool = True) -> Column:
    """How many of the sorted ``cuts`` are below the value, or equal to it if ``including``.

    ``cuts`` has at most ``count`` entries. Bisection spelled out as nested conditions stays
    in generated code, unlike a lambda over the array.
    """

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        cut = F.get(cuts, F.lit(middle))
        upper, lower = between(middle + 1, high), between(low, middle)
        return F.when(cut <= value if including else cut < value, upper).otherwise(lower)

    return between(0, count)


def band(cuts: Column, value: Column, count: int) -> Column:
    """Number of the band, from 1; a value equal to a cut point goes to the upper band."""
    return passed(cuts, value, count) + 1
