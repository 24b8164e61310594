import datetime
import random

import pytest
from pyspark.sql import functions as F

from marquee.operators.first_rest import first_and_rest

DAY = datetime.date(2000, 1, 1)


def compared(spark, data):
    frame = spark.createDataFrame(data, "c string, d date, id string, x double, y double")
    return {r.c: r for r in first_and_rest(frame, ["c"], "d", "id", ["x", "y"]).collect()}


def test_against_brute_force(spark):
    random.seed(3)
    data = []
    for i in range(600):
        company = "hot" if i % 3 == 0 else f"c{random.randrange(60)}"
        day = None if i % 50 == 0 else DAY + datetime.timedelta(random.randrange(40))
        x = random.choice([None, random.random() * 10])
        data.append((company, day, str(i), x, random.random()))
    got = compared(spark, data)
    for company in {row[0] for row in data}:
        own = sorted((r for r in data if r[0] == company and r[1]), key=lambda r: (r[1], r[2]))
        if not own:
            assert company not in got
            continue
        row = got[company]
        assert (row.d, row.n_rest, row.first_x, row.first_y) == (own[0][1], len(own) - 1, own[0][3], own[0][4])
        for name, at in (("rest_x", 3), ("rest_y", 4)):
            rest = [r[at] for r in own[1:] if r[at] is not None]
            expected = pytest.approx(sum(rest) / len(rest), abs=1e-9) if rest else None
            assert row[name] == expected


def test_huge_first_value_leaves_the_rest_exact(spark):
    later = DAY + datetime.timedelta(1)
    for huge in (1e12, 9e14, 1e18, 1e300):
        data = [("a", DAY, "1", huge, 1.0), ("a", later, "2", 0.1, 1.0), ("a", later, "3", 0.2, 1.0)]
        row = compared(spark, data)["a"]
        assert row.first_x == huge
        assert row.rest_x == pytest.approx(0.15, abs=1e-9)


def test_same_title_credited_twice_counts_as_later(spark):
    row = compared(spark, [("a", DAY, "1", 2.0, 1.0), ("a", DAY, "1", 2.0, 1.0)])["a"]
    assert (row.n_rest, row.first_x, row.rest_x) == (1, 2.0, 2.0)


def test_tie_on_the_date_goes_by_id(spark):
    row = compared(spark, [("a", DAY, "2", 5.0, 1.0), ("a", DAY, "10", 7.0, 1.0)])["a"]
    assert (row.first_x, row.rest_x) == (7.0, 5.0)


def test_hot_entity_combines_before_the_shuffle(spark):
    frame = spark.range(10).select(
        F.lit("c").alias("c"), F.current_date().alias("d"), F.col("id").cast("string"), F.lit(1.0).alias("x")
    )
    plan = first_and_rest(frame, ["c"], "d", "id", ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
