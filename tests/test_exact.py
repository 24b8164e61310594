"""Exact sums against fractions, for numbers of any size and in any order."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from marquee.operators.exact import exact_sums
from marquee.operators.topk import top_k_with_total

INF = float("inf")
GROUPS = {
    "ordinary": [0.1] * 10 + [1e6, 12345.678, 3.0],
    "wide": [2e26, 1e300, 1e-20, 5e-324, 1.0],
    "carries": [2.0**47 - 1] * 1000 + [2.0**23] * 1000,
    "tiny": [5e-324] * 7,
    "largest": [1.7976931348623157e308],
    "too large": [1.7976931348623157e308] * 3,
    "infinite": [INF, 1.0],
    "borders": [2.0 ** (48 * i) for i in range(-22, 22)] + [math.nextafter(2.0 ** (48 * i), 0) for i in range(-22, 22)],
    "half": [1.0, 2.0**-53],
    "above half": [1.0, 2.0**-53, 2.0**-1000],
    "zero": [0.0, -0.0],
    "odd": [None, float("nan"), 4.5],
    "nothing": [None],
}


def nearest(values):
    known = [v for v in values if v is not None and not math.isnan(v)]
    if INF in known:
        return INF
    total = sum(map(Fraction, known), Fraction(0))
    try:
        return float(total) if known else None
    except OverflowError:
        return INF


def rows(spark, groups, parts):
    every = [(name, v) for name, values in groups.items() for v in values]
    random.Random(parts).shuffle(every)
    return spark.createDataFrame(every, "g string, x double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_are_the_nearest_doubles(spark, parts):
    found = {r.g: r.x for r in exact_sums(rows(spark, GROUPS, parts), ["g"], "x").collect()}
    assert found == {name: nearest(values) for name, values in GROUPS.items()}


def test_digits_compare_as_the_sums(spark):
    draw = random.Random(0)
    groups = {str(i): [draw.random() * 2.0 ** draw.randint(-200, 200) for _ in range(draw.randint(1, 6))] for i in range(200)}
    groups |= {"a": [1e20, 1.0], "b": [1e20], "c": [1e20, 5e-324], "d": [1.0, 1e20]}
    ordered = [r.g for r in exact_sums(rows(spark, groups, 5), ["g"], "x").orderBy("_exact", "g").collect()]
    assert ordered == sorted(groups, key=lambda name: (sum(map(Fraction, groups[name])), name))
    digits = {r.g: r._exact for r in exact_sums(rows(spark, groups, 3), ["g"], "x").collect()}
    assert digits["a"] == digits["d"] != digits["b"]


def test_no_amount_is_left_out_of_a_ranking(spark):
    amounts = [("huge", 1e300), ("large", 2e26), ("small", 5.0), ("least", 1e-20), ("least", 1e-20)]
    parts = spark.createDataFrame([(1, *row) for row in amounts], "p int, who string, x double")
    wholes = parts.select("p", "x")
    top = top_k_with_total(wholes, parts, "p", ["who"], "x", 3).orderBy("rank").collect()
    assert [(r.rank, r.who, r.x) for r in top] == [(1, "huge", 1e300), (2, "large", 2e26), (3, "small", 5.0)]
    assert {r.total for r in top} == {1e300}
    below = top_k_with_total(wholes.where("x < 1e20"), parts.where("x < 1e20"), "p", ["who"], "x", 3)
    assert [(r.who, r.x) for r in below.orderBy("rank").collect()] == [("small", 5.0), ("least", 2e-20)]


def test_one_shuffle_of_partial_sums_before_the_cells_meet(spark):
    plan = exact_sums(rows(spark, GROUPS, 4).groupBy("g", "x").agg(F.count("*")), ["g"], "x")._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "Python" not in plan
