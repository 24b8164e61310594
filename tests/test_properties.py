"""What must hold for any catalogue."""

import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee import rating_stability, roi_by_decile, schema, top_share
from marquee.functions import prorate
from marquee.operators.credits import explode_credits

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
MONEY = st.one_of(st.none(), st.floats(0, 1e6).map(lambda v: round(v, 2)))
NAMES = st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["A", "B", "O'C"])), max_size=4)
TITLE = st.tuples(
    st.one_of(st.none(), st.dates(datetime.date(1985, 1, 1), datetime.date(2005, 1, 1))),
    MONEY,
    MONEY,
    st.one_of(st.none(), st.floats(0, 10).map(lambda v: round(v, 1))),
    st.integers(0, 50),
    NAMES,
)


def catalogue(spark, drawn):
    rows = []
    for i, (date, budget, revenue, rating, votes, companies) in enumerate(drawn):
        decade = None if date is None else date.year // 10 * 10
        companies = [(*company, None) for company in companies]
        genres = companies[:3]
        rows.append(
            (str(i), f"T{i}", date, None, budget, revenue, 1.0, rating, votes, companies, genres, decade)
        )
    return spark.createDataFrame(rows, schema.TITLES)


@FEW
@given(st.lists(TITLE, min_size=1, max_size=25))
def test_shares(spark, drawn):
    titles = catalogue(spark, drawn)
    credits = explode_credits(titles)
    share = F.sum(prorate(F.col("revenue"), F.col("n_companies")))
    for row in credits.groupBy("id", "revenue").agg(share.alias("shared")).collect():
        assert row.revenue is None or abs(row.shared - row.revenue) < 1e-6
    for row in top_share(titles, output="summary").collect():
        assert -1e-12 <= row.top_share <= 1 + 1e-12
    everything = top_share(titles, k=1000).groupBy("decade").agg(F.sum("pct_of_total").alias("s"))
    for row in everything.collect():
        assert row.s <= 1 + 1e-9


@FEW
@given(st.lists(TITLE, min_size=1, max_size=40))
def test_deciles(spark, drawn):
    titles = catalogue(spark, drawn)
    funded = titles.where("budget > 0 AND period IS NOT NULL")
    order = Window.partitionBy("period").orderBy("budget", "id")
    plain = (
        funded.withColumn("t", F.ntile(10).over(order)).groupBy("period", "t").agg(F.count("*").alias("n"))
    )
    expected = {(r.period, r.t, r.n) for r in plain.collect()}
    assert {(r.decade, r.bud_decile, r.n) for r in roi_by_decile(titles).collect()} == expected
    cuts = roi_by_decile(titles, method="cuts").agg(F.sum("n")).first()[0] or 0
    assert cuts == funded.where("revenue IS NOT NULL").count()


@FEW
@given(st.lists(TITLE, min_size=1, max_size=25))
def test_stability(spark, drawn):
    titles = catalogue(spark, drawn)
    dropped, counted = rating_stability(titles), rating_stability(titles, zero_weight="count")
    for row in counted.collect():
        assert row["std"] >= 0 and 0 <= row["mean"] <= 10 + 1e-9
    assert dropped.count() == counted.count()


def test_nothing_in_nothing_out(spark):
    titles = catalogue(spark, [(None, None, None, None, 0, [])]).limit(0)
    for frame in (
        top_share(titles),
        roi_by_decile(titles),
        roi_by_decile(titles, method="cuts", densify=True),
        rating_stability(titles),
    ):
        assert frame.collect() == []
