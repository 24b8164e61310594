"""What is read of a stored catalogue, and the periods of all analyses side by side."""

import datetime
import math
import os

import pytest
from pyspark.sql import functions as F

from marquee import hidden_gems, load_check, load_check_stored, period_overview, run
from marquee.functions import lead_by_pattern
from marquee.operators.credits import pattern_credits
from marquee.operators.spine import key_spine, side_by_side
from marquee.scratch import small
from marquee.plans import ingest
from marquee.plans.gems import gem_limits
from marquee.sources.files import write_titles


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    """Thirty thousand titles of three decades in files of many row groups, sorted by rating as they are stored."""
    n = 30_000
    number = F.col("id")
    mixed = F.pmod(F.xxhash64(number), F.lit(1000)) / F.lit(100.0)
    made = spark.range(n).select(
        number.cast("string").alias("id"),
        F.concat(F.lit("Title "), number).alias("original_title"),
        F.make_date(1985 + (number % 25), F.lit(3), F.lit(1)).alias("release_date"),
        # The decades differ in their ratings, so that limits of one would not do for another.
        (mixed / 2 + (number % 25) / F.lit(10.0)).alias("vote_average"),
        (F.pmod(F.xxhash64(number, F.lit(1)), F.lit(777)) / F.lit(10.0)).alias("popularity"),
        (F.lit(5) + number % 30).alias("vote_count"),
        F.floor((1985 + (number % 25)) / 10).cast("int").alias("_tens"),
    )
    path = str(tmp_path_factory.mktemp("stored") / "titles")
    context = spark.sparkContext._jsc.hadoopConfiguration()
    context.set("parquet.block.size", str(32 * 1024))
    context.set("parquet.block.size.row.check.min", "100")
    context.set("parquet.page.size.row.check.min", "100")
    try:
        write_titles(made.withColumn("period", F.col("_tens") * 10).drop("_tens").coalesce(1), path)
    finally:
        for name in ("parquet.block.size", "parquet.block.size.row.check.min", "parquet.page.size.row.check.min"):
            context.unset(name)
    return path


def scans(frame):
    """The scans of a plan without adaptive steps, after it has run."""
    out, leaves = [], frame._jdf.queryExecution().executedPlan().collectLeaves()
    for i in range(leaves.size()):
        if "FileScan" in leaves.apply(i).toString():
            out.append(leaves.apply(i))
    return out


def test_files_are_sorted_by_rating(spark, catalogue):
    rows = spark.read.parquet(catalogue).select(
        "vote_average", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")
    )
    by_file = {}
    for row in rows.orderBy("place").collect():
        by_file.setdefault(row.file, []).append(row.vote_average)
    assert len(by_file) >= 3
    assert all(ratings == sorted(ratings, reverse=True) for ratings in by_file.values())


@pytest.mark.parametrize("scope", ["eligible", "all"])
@pytest.mark.parametrize("method", ["exact", "approx"])
def test_thresholds_reach_the_scan_of_each_period(spark, catalogue, scope, method):
    stored = spark.read.parquet(catalogue)
    votes = F.col("vote_count") >= 10 if scope == "eligible" else F.lit(True)
    measured = stored.where(votes).select(
        F.col("period").alias("decade"), F.col("vote_average").alias("va"), F.col("popularity").alias("pop")
    )
    limits = {r.decade: r for r in gem_limits(measured, method, 0.9, 0.1).collect()}
    assert len({r._va for r in limits.values()}) == len(limits) == 3
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own = hidden_gems(stored, scope=scope, method=method, stored_by_period=True)
        rows = own.collect()
        found = scans(own)
        assert len(found) == len(limits)
        read = 0
        for scan in found:
            text = scan.verboseStringWithOperatorId()
            decade = next(d for d in limits if f"= {d})" in text)
            assert f"GreaterThanOrEqual(vote_average,{limits[decade]._va})" in text
            assert f"LessThanOrEqual(popularity,{limits[decade]._pop})" in text
            read += scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # A tenth has such a rating; row groups are skipped as wholes.
    assert len(rows) < read < 0.35 * stored.count()
    assert rows == hidden_gems(stored, scope=scope, method=method).collect()
    assert rows == hidden_gems(stored.drop("period"), scope=scope, method=method).collect()


def test_thresholds_are_in_the_filters_of_any_table(spark, catalogue):
    stored = spark.read.parquet(catalogue).drop("period")
    plan = hidden_gems(stored)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in reversed(plan.splitlines()) if "FileScan" in line)
    assert "GreaterThanOrEqual(vote_average" in scan and "LessThanOrEqual(popularity" in scan


def test_gems_of_many_periods_are_joined(spark, monkeypatch, catalogue):
    from marquee.plans import gems

    stored = spark.read.parquet(catalogue)
    want = hidden_gems(stored, stored_by_period=True).collect()
    monkeypatch.setattr(gems, "MOST_PERIODS", 2)
    assert hidden_gems(stored, stored_by_period=True).collect() == want


def test_gems_of_nothing_and_of_odd_values(spark, titles, tmp_path):
    assert hidden_gems(titles.limit(0), stored_by_period=True).collect() == []
    odd = titles.withColumn("vote_average", F.when(F.col("id") == "2", F.lit(math.nan)).otherwise(F.col("vote_average")))
    odd = odd.withColumn("popularity", F.when(F.col("period") == 2000, F.lit(None)).otherwise(F.col("popularity")))
    path = str(tmp_path / "odd")
    write_titles(odd, path)
    stored = spark.read.parquet(path)
    for scope in ("eligible", "all"):
        limits = small(gem_limits(stored.select(F.col("period").alias("decade"), F.col("vote_average").alias("va"), F.col("popularity").alias("pop")).where("decade IS NOT NULL"), "exact", 0.9, 0.1))
        assert limits.count() > 0
        assert hidden_gems(stored, 1, scope, stored_by_period=True).collect() == hidden_gems(odd, 1, scope).collect()


def test_named_gems_of_a_stored_table(spark, catalogue):
    stored = spark.read.parquet(catalogue)
    for name in ("q4", "hg"):
        assert run(name, stored, stored_by_period=True).collect() == run(name, stored).collect()


def test_counts_and_extremes_come_from_footers(spark, catalogue):
    footers = ingest.by_footers(spark, catalogue).withColumnRenamed("release_date", "_date")
    plan = ingest._dated(footers, ["period"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(release_date)]" in plan and "PushedGroupBy: [period]" in plan
    plan = ingest._extremes(footers, ["period"], [1980, 2000])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(release_date), MAX(release_date)]" in plan
    assert "ReadSchema: struct<min(release_date):date,max(release_date):date>" in plan


def test_load_check_of_a_stored_table(spark, catalogue):
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    checked = load_check_stored(spark, catalogue)
    assert checked.dtypes == load_check(spark.read.parquet(catalogue)).dtypes
    assert checked.collect() == load_check(spark.read.parquet(catalogue)).collect()
    assert checked.first().total == 30_000
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_load_check_where_dates_are_missing(spark, titles, tmp_path):
    """All of a period's dates, some, the oldest of all, or all of the table."""
    gone = {
        "as it is": F.lit(False),
        "some": F.col("id").isin("1", "8"),
        "a period": F.col("period") == 1990,
        "all": F.lit(True),
    }
    frames = {name: titles.withColumn("release_date", F.when(~lost, F.col("release_date"))) for name, lost in gone.items()}
    for name, frame in {**frames, "no rows": titles.limit(0)}.items():
        write_titles(frame, os.path.join(tmp_path, name, "by period"))
        frame.write.parquet(os.path.join(tmp_path, name, "in one"))
        frame.drop("period").write.parquet(os.path.join(tmp_path, name, "without"))
        want = load_check(frame).collect()
        for form in ("by period", "in one", "without"):
            if name != "no rows" or form != "by period":
                assert load_check_stored(spark, os.path.join(tmp_path, name, form)).collect() == want, (name, form)


def test_overview_has_the_periods_of_every_analysis(spark, titles):
    from pyspark.sql import Row

    dates = {"a": 1931, "b": 1942, "c": 1953, "d": 1964}
    made = spark.createDataFrame(
        [
            ("a", datetime.date(dates["a"], 1, 1), None, 5.0, None, None, [Row(id=1, name="P", ref=None)]),
            ("b", datetime.date(dates["b"], 1, 1), 3.0, None, None, None, []),
            ("c", datetime.date(dates["c"], 1, 1), None, 0.0, 7.5, 20, []),
            ("d", datetime.date(dates["d"], 1, 1), None, None, 7.5, 2, []),
        ],
        "id string, release_date date, budget double, revenue double, vote_average double, vote_count bigint,"
        " companies array<struct<id:bigint,name:string,ref:string>>",
    )
    assert [tuple(r) for r in period_overview(made).collect()] == [
        (1930, 5.0, 1.0, 0, 0, 0),
        (1940, 0.0, 0.0, 0, 1, 0),
        (1950, 0.0, 0.0, 0, 0, 1),
    ]
    assert [tuple(r)[0] for r in period_overview(made, min_votes=1, width=1).collect()] == [1931, 1942, 1953, 1964]


def test_key_spine_and_rows_side_by_side(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(2, "y"), (None, "m")], "k int, b string")
    assert sorted(map(tuple, key_spine([a, b, a], "k").collect()), key=repr) == [(1,), (2,), (None,)]
    found = side_by_side([a, b], "k")
    assert found.columns == ["k", "a", "b"]
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "x", None), (2, None, "y"), (None, "n", "m")]


def test_lead_names(spark):
    texts = {
        1: """[{"name": "A", "id": 1}, {"name": "B"}]""",
        2: "[{'name': 'A B', 'id': 1}]",
        3: """[{'name': 'late'}, {"name": "first"}]""",
        4: """[{"name" : "'Tis"}]""",
        5: "[]",
        6: None,
        7: "[{'name': ''}]",
    }
    frame = spark.createDataFrame(list(texts.items()), "id int, text string")
    found = {r.id: r.lead for r in frame.select("id", lead_by_pattern(F.col("text")).alias("lead")).collect()}
    assert found == {1: "A", 2: "A B", 3: "first", 4: "'Tis", 5: None, 6: None, 7: None}
    credits = {(r.id, r.company, r.n_companies) for r in pattern_credits(frame, "text", lead_only=True).collect()}
    assert credits == {(i, name, 1) for i, name in found.items() if name}
