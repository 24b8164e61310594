"""The ten-title fixture with answers worked out by hand."""

import datetime

import pytest

from marquee import debut_effect, hidden_gems, rating_stability, roi_by_decile, roi_skipped, top_share
from marquee.operators.credits import explode_credits, pattern_credits
from marquee.plans.ingest import as_declared

DETAIL = [
    (1990, 1, 1, "P", 350.0, 0.5),
    (1990, 2, 2, "Q", 200.0, 0.285714),
    (1990, 3, 3, "O'R", 100.0, 0.142857),
    (1990, 4, 4, "S", 50.0, 0.071429),
    (2000, 1, 3, "O'R", 300.0, 0.24),
    (2000, 2, 4, "S", 25.0, 0.02),
    (2000, 3, 5, "T", 25.0, 0.02),
]


def test_top_share_summary(titles, rows):
    assert rows(top_share(titles, output="summary")) == [
        (1990, 1.0, 700.0),
        (2000, 0.28, 1250.0),
        (2010, 0.0, 20.0),
    ]


def test_top_share_detail(titles, rows):
    assert rows(top_share(titles, output="detail")) == DETAIL


def test_top_share_full_has_both(titles, rows):
    shares = {1990: 1.0, 2000: 0.28}
    expected = [(row[0], shares[row[0]], *row[1:]) for row in DETAIL]
    assert rows(top_share(titles)) == expected


def test_top_share_of_two(titles, rows):
    top = rows(top_share(titles, k=2), "decade", "top_share", "rank", "company")
    assert top == [
        (1990, 0.785714, 1, "P"),
        (1990, 0.785714, 2, "Q"),
        (2000, 0.26, 1, "O'R"),
        (2000, 0.26, 2, "S"),
    ]


def test_equal_year_and_revenue_is_not_multiplied(titles):
    detail = top_share(titles, k=100, output="detail").where("decade = 1990")
    assert detail.agg({"revenue": "sum"}).first()[0] == pytest.approx(700)


def test_top_share_of_names_found_by_pattern(titles, rows):
    texts = titles.join(as_declared(titles).select("id", "production_companies"), "id")
    credits = pattern_credits(texts.drop("companies", "genres"), "production_companies")
    assert rows(top_share(titles, credits, output="detail")) == [
        (row[0], row[1], None, *row[3:]) for row in DETAIL
    ]


def test_roi_cuts(titles, rows):
    assert rows(roi_by_decile(titles, method="cuts")) == [
        (1990, 3, 1.0, 1),
        (1990, 6, 3.0, 1),
        (1990, 8, -0.5, 1),
        (1990, 10, -1.0, 1),
        (2000, 7, 0.75, 2),
        (2000, 10, 2.0, 1),
        (2010, 10, 1.0, 1),
    ]


def test_roi_ntile(titles, rows):
    assert rows(roi_by_decile(titles)) == [
        (1990, 1, 1.0, 1),
        (1990, 2, 3.0, 1),
        (1990, 3, -0.5, 1),
        (1990, 4, -1.0, 1),
        (2000, 1, 2.0, 1),
        (2000, 2, -0.5, 1),
        (2000, 3, 2.0, 1),
        (2010, 1, 1.0, 1),
    ]


def test_roi_ntile_with_null_period(titles, rows):
    with_null = rows(roi_by_decile(titles, keep_null_period=True))
    assert with_null[-1] == (None, 1, 0.0, 1)
    assert len(with_null) == 9


def test_roi_gate_and_report(titles, rows):
    assert rows(roi_by_decile(titles, method="cuts", min_rows=20)) == []
    assert rows(roi_skipped(titles)) == [
        (1990, 4, 4, 20, 20),
        (2000, 3, 3, 20, 20),
        (2010, 1, 1, 20, 20),
    ]
    kept = rows(roi_by_decile(titles, method="cuts", min_rows=4), "decade")
    assert kept == [(1990,)] * 4


def test_roi_densified(titles, rows):
    grid = rows(roi_by_decile(titles, method="cuts", densify=True))
    assert [row[:2] for row in grid] == [(d, t) for d in (1990, 2000, 2010) for t in range(1, 11)]
    assert (1990, 1, 0.0, 0) in grid and (1990, 3, 1.0, 1) in grid


def test_debut_effect(titles, rows):
    day = datetime.date
    columns = (
        "company_id",
        "debut_date",
        "debut_roi",
        "debut_pop",
        "post_roi",
        "post_pop",
        "n_post",
        "delta_roi",
        "delta_pop",
    )
    expected = [
        (2, day(1994, 5, 1), 3.0, 10.0, -1.0, 5.0, 1, 4.0, 5.0),
        (1, day(1994, 5, 1), 3.0, 10.0, -0.5, 25.0, 2, 3.5, -15.0),
        (3, day(1995, 7, 1), 1.0, 1.0, 2.0, 8.0, 2, -1.0, -7.0),
    ]
    credits = explode_credits(titles)
    assert rows(debut_effect(credits), *columns) == expected
    assert rows(debut_effect(credits, limit=1), *columns) == expected[:1]
    alone = (5, day(2004, 4, 4), -0.5, 0.5, None, None, 0, None, None)
    assert rows(debut_effect(credits, require_rest=False), *columns) == [*expected, alone]
    zero = (5, day(2004, 4, 4), -0.5, 0.5, 0.0, 0.0, 0, -0.5, 0.5)
    with_zero = rows(debut_effect(credits, require_rest=False, empty_rest="zero"), *columns)
    assert with_zero == [*expected[:2], zero, expected[2]]


def test_debut_by_name_merges_ids(spark, titles, rows):
    credits = explode_credits(titles).replace({"T": "S"}, subset=["company"])
    by_name = rows(debut_effect(credits, entity="name"), "company", "n_post")
    assert by_name == [("Q", 1), ("P", 2), ("O'R", 2)]


@pytest.mark.parametrize("scope", ["eligible", "all"])
@pytest.mark.parametrize("method", ["exact", "approx"])
def test_hidden_gems(titles, rows, scope, method):
    gems = hidden_gems(titles, min_votes=12, scope=scope, method=method)
    assert rows(gems) == [
        (1990, "3", "Gamma", 9.0, 1.0, 40),
        (2000, "8", "Theta", 9.5, 0.5, 12),
    ]


def test_rating_stability(titles, rows):
    dropped = [
        (1990, "1", 8.0, 0.0, 1),
        (1990, "2", 6.0, 0.0, 1),
        (1990, "3+", 8.333333, 0.942809, 2),
        (2000, "1", 7.5, 0.0, 1),
        (2000, "2", 9.5, 0.0, 1),
        (2010, "1", 4.0, 0.0, 1),
    ]
    assert rows(rating_stability(titles)) == dropped
    counted = [(*dropped[0][:4], 2), *dropped[1:]]
    assert rows(rating_stability(titles, zero_weight="count")) == counted


def test_order_and_partitions_do_not_matter(titles, rows):
    shuffled = titles.repartition(7).orderBy("popularity")
    assert rows(top_share(shuffled)) == rows(top_share(titles))
    assert rows(roi_by_decile(shuffled)) == rows(roi_by_decile(titles))
    assert rows(debut_effect(explode_credits(shuffled))) == rows(debut_effect(explode_credits(titles)))


def test_wrong_options(titles):
    for call in (
        lambda: top_share(titles, output="all"),
        lambda: roi_by_decile(titles, method="even"),
        lambda: hidden_gems(titles, scope="some"),
        lambda: hidden_gems(titles, method="rough"),
        lambda: rating_stability(titles, zero_weight="keep"),
        lambda: debut_effect(titles, empty_rest="nan"),
    ):
        with pytest.raises(ValueError):
            call()
