"""Rank-based operators against plain Python and Spark's own windows."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.operators.ranks import end_of_tile, nearest_rank, values_at_ranks
from marquee.operators.running import running_total
from marquee.operators.tiles import tile_sums
from marquee.scratch import written

SHARES = [p / 100 for p in range(10, 100, 10)]


def brute_force(values, share):
    ordered = sorted(values)
    rank = min(max(math.ceil(share * len(ordered)), 1), len(ordered))
    value = ordered[rank - 1]
    return (len(ordered), rank, value, sum(v < value for v in ordered), ordered.count(value))


def check_ranks(spark, data, **options):
    frame = spark.createDataFrame(data, "g int, v double")
    ranks = {share: nearest_rank(share) for share in SHARES}
    found = values_at_ranks(frame, ["g"], "v", ranks, **options).collect()
    got = {(r.g, r.target): (r.n, r.rank, r.value, r.before, r.ties) for r in found}
    groups = {g for g, v in data if v is not None}
    expected = {
        (g, i): brute_force([v for h, v in data if h == g and v is not None], share)
        for g in groups
        for i, share in enumerate(SHARES)
    }
    assert got == expected


def skewed(seed):
    random.seed(seed)
    data = []
    for group in (1990, 2000, None):
        for _ in range(800):
            data.append((group, random.choice([5.0, 5.0, 7.5, random.random() * 100, -random.random()])))
    return data + [(1, 3.0)] * 7 + [(2, None)]


@pytest.mark.parametrize(
    "options",
    [{}, {"accuracy": 20}, {"accuracy": 50}, {"accuracy": 5, "slack": 1e-9}],
)
def test_values_at_ranks(spark, options):
    check_ranks(spark, skewed(1), **options)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from([1, 2]), st.floats(-5, 5, allow_nan=False).map(lambda v: round(v, 1) + 0.0)),
        min_size=1,
        max_size=60,
    )
)
def test_values_at_ranks_on_any_data(spark, data):
    check_ranks(spark, data, accuracy=10)


def test_end_of_tile_matches_ntile(spark):
    sizes = spark.range(1, 60).withColumnRenamed("id", "n")
    ends = sizes.select("n", *[end_of_tile(t, 10)(F.col("n")).alias(str(t)) for t in range(1, 11)])
    tiled = (
        sizes.select("n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i"))
        .withColumn("t", F.ntile(10).over(Window.partitionBy("n").orderBy("i")))
        .groupBy("n", "t")
        .agg(F.max("i").alias("end"))
    )
    last = {(r.n, r.t): r.end for r in tiled.collect()}
    for row in ends.collect():
        for t in range(1, 11):
            assert row[str(t)] == last.get((row.n, t), row.n)


def test_tile_sums_with_ties_and_copies(spark):
    random.seed(2)
    data = []
    for group in (1990, None):
        for _ in range(900):
            value = random.choice([5.0, 5.0, 5.0, 7.5, random.random() * 100])
            data.append((group, value, str(random.randrange(300)), random.choice([None, 0.5, 0.25])))
        data += [(group, 5.0, "1", 0.25)] * 500
    for size in range(1, 25):
        data += [(size, float(random.choice([1, 2, 3])), str(i), i / 8) for i in range(size)]
    frame = spark.createDataFrame(data, "g int, v double, id string, m double")
    order = Window.partitionBy("g").orderBy("v", "id", "m")
    expected = (
        frame.withColumn("tile", F.ntile(10).over(order))
        .groupBy("g", "tile")
        .agg(F.count("*"), F.round(F.sum("m"), 6), F.count("m"))
    )
    expected = {tuple(row) for row in expected.collect()}
    for options in ({}, {"accuracy": 50}):
        sums = tile_sums(frame, ["g"], "v", ["id"], "m", **options)
        got = sums.select("g", "tile", "n", F.round("total", 6), "measured").collect()
        assert {tuple(row) for row in got} == expected


def test_tiles_differ_by_at_most_one(spark):
    frame = spark.range(1003).select(
        F.lit(1).alias("g"), F.lit(4.0).alias("v"), F.col("id").cast("string").alias("id"), F.lit(1.0).alias("m")
    )
    sizes = [r.n for r in tile_sums(frame, ["g"], "v", ["id"], "m").orderBy("tile").collect()]
    assert sizes == [101, 101, 101] + [100] * 7


def test_running_total(spark):
    frame = spark.range(2000).select(
        F.when(F.col("id") < 1900, 1).alias("g"), F.col("id").alias("k"), (F.col("id") % 7 + 1).alias("w")
    )
    window = Window.partitionBy("g").orderBy("k")
    expected = frame.select("g", "k", F.sum("w").over(window).alias("end"), "w")
    expected = {(r.g, r.k, r.end - r.w, r.end) for r in expected.collect()}
    got = running_total(frame, ["g"], ["k"], "w").select("g", "k", "start", "end").collect()
    assert {tuple(r) for r in got} == expected


def test_many_groups(spark):
    """More groups than are ever broadcast."""
    frame = spark.range(63_000).select((F.col("id") % 21_000).alias("g"), F.col("id").cast("double").alias("v"))
    found = values_at_ranks(written(frame), ["g"], "v", {0.5: nearest_rank(0.5)})
    assert found.where("value = g + 21000 AND n = 3 AND rank = 2").count() == 21_000
    totals = running_total(frame.withColumn("w", F.lit(1)), ["g"], ["v"], "w")
    assert totals.where("end = floor(v / 21000) + 1 AND start = end - 1").count() == 63_000


def test_cell_quantiles_do_not_depend_on_the_order(spark):
    import math
    import random

    from marquee.operators.ranks import cell_quantiles

    draw = random.Random(3)
    values = [draw.lognormvariate(0, 3) * draw.choice([1, 1, -1]) for _ in range(3000)] + [0.0] * 50 + [float("inf"), -float("inf"), 1e-310]
    rows = [(i % 3, v, v) for i, v in enumerate(values)] + [(9, None, 1.0), (9, float("nan"), 2.0)]
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        found = []
        for parts in (1, 7):
            draw.shuffle(rows)
            frame = spark.createDataFrame(rows, "g int, x double, y double").repartition(parts)
            found.append({r.g: (r.x, r.y) for r in cell_quantiles(frame, ["g"], {"x": share, "y": 0.5}, 1000).collect()})
        assert found[0] == found[1]
        assert found[0][9] == (None, 1.0)
        for g in range(3):
            own = sorted(v for k, v, _ in rows if k == g)
            exact = own[max(1, math.ceil(share * len(own))) - 1]
            low = found[0][g][0]
            assert low in own and (low == exact or abs(low - exact) <= abs(exact) / 1000)
