"""Sums of floating-point numbers of any size, exact and in any order.

A number is a mantissa of 53 bits at some height. Heights are cut into cells of 48 bits; within its
cell a number is a whole number of at most 102 bits, cut into five limbs of 24 bits. Limbs of equal
height are added up as whole numbers before and after the shuffle, one row for each cell that a group uses, which
is one or two for most. At the end the carries are passed on, so equal sums have equal digits, whatever
the order of their numbers, and digits compare as the sums do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB_BITS = 24
LIMBS = 5
CELL_BITS = 2 * LIMB_BITS
# The lowest bit of cell zero's first limb.
_LOWEST = -53
# Limbs that carries may add above the highest: sums stay below 2^63.
_ROOM = 3


def _power(exponent: Column) -> Column:
    """Two to a whole number, exactly, as long as there is such a number."""
    return F.pow(F.lit(2.0), exponent)


def _scaled(number: Column, exponent: Column) -> Column:
    """The number times a power of two that may itself be out of range."""
    half = F.floor(exponent / 2)
    return number * _power(half) * _power(exponent - half)


def _cell(amount: Column) -> Column:
    # Infinity counts as the first number that is too large.
    return F.when(amount == F.lit(float("inf")), F.lit(21)).otherwise(F.floor(F.log2(amount) / CELL_BITS).cast("int"))


def _limbs(amount: Column, cell: Column) -> list[Column]:
    whole = F.when(amount == F.lit(float("inf")), F.lit(2.0**69)).otherwise(
        _scaled(amount, F.lit(-_LOWEST) - F.lit(CELL_BITS) * cell)
    )
    out = []
    for i in reversed(range(1, LIMBS)):
        limb = F.floor(whole / 2.0 ** (LIMB_BITS * i))
        out.append(limb)
        whole = whole - limb * 2.0 ** (LIMB_BITS * i)
    return [whole.cast("bigint"), *reversed([limb.cast("bigint") for limb in out])]


def _digits(cells: Column) -> Column:
    """``top, digits``: base 2^24 digits from the highest one that isn't zero, without zeros at the end."""
    lowest = F.lit(2) * F.array_min(F.transform(cells, lambda c: c["cell"]))
    highest = F.lit(2) * F.array_max(F.transform(cells, lambda c: c["cell"])) + F.lit(LIMBS - 1 + _ROOM)

    def added(state: Column, place: Column) -> Column:
        here = F.aggregate(
            cells,
            state["carry"],
            lambda total, c: total + F.coalesce(F.get(c["limbs"], F.greatest(place - F.lit(2) * c["cell"], F.lit(-1)).cast("int")), F.lit(0).cast("bigint")),
        )
        digit = here.bitwiseAND(F.lit(2**LIMB_BITS - 1).cast("bigint"))
        return F.struct(
            F.shiftright(here, LIMB_BITS).alias("carry"),
            F.concat(F.array(digit), state["digits"]).alias("digits"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    every = F.aggregate(F.sequence(lowest, highest), start, added)["digits"]
    first = F.array_position(F.transform(every, lambda d: d != 0), True).cast("int")
    last = F.size(every) - F.array_position(F.transform(F.reverse(every), lambda d: d != 0), True).cast("int") + 1
    kept = F.when(first > 0, F.slice(every, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))))
    return F.when(F.size(cells) > 0, F.struct((highest - first + 1).alias("top"), F.coalesce(kept, F.array().cast("array<bigint>")).alias("digits")))


def as_double(exact: Column) -> Column:
    """The nearest floating-point number; infinity where there is none."""
    digits = exact["digits"]

    def digit(i: int) -> Column:
        return F.coalesce(F.get(digits, F.lit(i)), F.lit(0).cast("bigint"))

    shift = F.lit(2**LIMB_BITS).cast("bigint")
    high, low = digit(0) * shift + digit(1), digit(2) * shift + digit(3)
    # Whatever lies below decides ties only.
    low = low.bitwiseOR((F.size(digits) > 4).cast("bigint"))
    window = high * F.lit(2.0 ** (2 * LIMB_BITS)) + low
    scaled = _scaled(window, F.lit(LIMB_BITS) * (exact["top"] - 3) + F.lit(_LOWEST))
    return F.when(exact.isNotNull(), F.when(F.size(digits) > 0, scaled).otherwise(F.lit(0.0)))


def exact_sums(rows: DataFrame, by: list[str], amount: str) -> DataFrame:
    """``by…, _exact, amount``: the sum of each group's amounts, as digits that compare and as the nearest double.

    Amounts must not be negative; zeros add nothing, null and NaN are left out. A group without any
    amount has null. Infinity makes the sum infinite.
    """
    value = F.col(amount).cast("double")
    positive = F.when((value > 0) & ~F.isnan(value), value)
    cells = rows.select(*by, (value == 0).alias("_zero"), positive.alias("_x")).withColumn("_cell", _cell(F.col("_x")))
    limbs = F.array(*_limbs(F.col("_x"), F.col("_cell")))
    parts = cells.withColumn("_limbs", limbs).select(*by, "_zero", "_cell", *[F.get("_limbs", F.lit(i)).alias(f"_{i}") for i in range(LIMBS)])
    per_cell = parts.groupBy(*by, "_cell").agg(F.max("_zero").alias("_zero"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(LIMBS)])
    cell = F.struct(F.col("_cell").alias("cell"), F.array(*[F.col(f"_{i}") for i in range(LIMBS)]).alias("limbs"))
    whole = per_cell.groupBy(*by).agg(F.collect_list(F.when(F.col("_cell").isNotNull(), cell)).alias("_cells"), F.max("_zero").alias("_zero"))
    nothing = F.struct(F.lit(-1000).alias("top"), F.array().cast("array<bigint>").alias("digits"))
    exact = F.coalesce(_digits(F.col("_cells")), F.when(F.col("_zero"), nothing))
    return whole.select(*by, exact.alias("_exact")).withColumn(amount, as_double(F.col("_exact")))
