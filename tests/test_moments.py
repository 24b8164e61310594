"""Weighted moments against exact fractions."""

import math
import random
from fractions import Fraction

import pytest

from marquee.operators.moments import weighted_moments


def exact(rows):
    weight = sum(w for _, w in rows)
    mean = sum(Fraction(x) * w for x, w in rows) / weight
    square = sum((Fraction(x) - mean) ** 2 * w for x, w in rows) / weight
    return float(mean), math.sqrt(square)


def found(spark, data):
    frame = spark.createDataFrame(data, "g int, x double, w bigint").repartition(5)
    return {r.g: (r.mean, r.std, r.n) for r in weighted_moments(frame, ["g"], "x", "w").collect()}


def test_equal_values_have_no_deviation(spark):
    data = [(g, x, w) for g, x in enumerate((7.3, 0.1, -1e300, 0.0, 1e-310, 123456789.123)) for w in (10**9, 333, 1, 0, 7)]
    for g, row in found(spark, data).items():
        assert row == (data[5 * g][1], 0.0, 5)


def test_against_fractions(spark):
    draw = random.Random(5)
    kinds = {
        1: lambda: draw.random() * 10,
        2: lambda: 1e6 + draw.random(),
        3: lambda: draw.choice([-1, 1]) * draw.lognormvariate(0, 4),
        4: lambda: draw.choice([0.0, 5.5, 5.5, 10.0]),
        5: lambda: 1e8 + draw.randrange(3),
    }
    data = [(g, kind(), draw.randrange(0, 10**6)) for g, kind in kinds.items() for _ in range(400)]
    got = found(spark, data)
    for g in kinds:
        mean, std = exact([(x, w) for k, x, w in data if k == g])
        assert got[g][0] == pytest.approx(mean, rel=1e-12) and got[g][2] == 400
        # Sums about zero would be off by 10^-16 of the squared values.
        largest = max(abs(x) for k, x, _ in data if k == g)
        assert got[g][1] ** 2 == pytest.approx(std**2, rel=1e-9, abs=1e-20 * largest**2)


def test_groups_without_weight_are_left_out(spark):
    assert found(spark, [(1, 2.0, 0), (1, 3.0, 0), (2, 4.0, 0), (2, 5.0, 2), (None, 1.0, 1)]) == {2: (5.0, 0.0, 2), None: (1.0, 0.0, 1)}
