"""Single expressions on odd input."""

import datetime

import pytest
from pyspark.sql import functions as F

from marquee.functions import (
    band,
    blank_to_null,
    capped_bucket,
    entities_status,
    lenient_date,
    lenient_double,
    lenient_long,
    names_by_pattern,
    one_line,
    parse_entities,
    period_of_date,
    period_of_year,
    positive,
    prorate,
    return_on_investment,
    year_of_text,
)


def evaluate(spark, values, column, kind="string"):
    frame = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return [row[0] for row in frame.select(column(F.col("c"))).collect()]


def test_lenient_double(spark):
    table = {
        "1": 1.0,
        " 2.5 ": 2.5,
        "\t7\r": 7.0,
        "1e3": 1000.0,
        "-3.9": -3.9,
        "nan": None,
        "NaN": None,
        "inf": None,
        "abc": None,
        "1.5d": None,
        "2f": None,
        "": None,
        None: None,
    }
    assert evaluate(spark, table, lenient_double) == list(table.values())


def test_lenient_long(spark):
    table = {"5415.0": 5415, "-3.9": -3, "7": 7, "x": 0, "": 0, None: 0, "9e30": 0}
    assert evaluate(spark, table, lenient_long) == list(table.values())
    assert evaluate(spark, ["x"], lambda c: lenient_long(c, None)) == [None]


def test_lenient_date(spark):
    day = datetime.date
    table = {
        "1995-06-01": day(1995, 6, 1),
        " 1888-02-03 ": day(1888, 2, 3),
        "2020-1-5": None,
        "2020": None,
        "1995-13-45": None,
        "": None,
        None: None,
    }
    assert evaluate(spark, table, lenient_date) == list(table.values())
    more = lambda c: lenient_date(c, ("yyyy-MM-dd", "dd/MM/yyyy"))
    assert evaluate(spark, ["2020-01-05", "05/01/2020"], more) == [day(2020, 1, 5)] * 2


def test_keys_and_text(spark):
    assert evaluate(spark, [" a\t", "", "nan", None, "\r\n"], blank_to_null) == ["a", None, None, None, None]
    assert evaluate(spark, ["\ta|b\nc ", None], one_line) == ["a b c", ""]


def test_years_and_periods(spark):
    assert evaluate(spark, ["1995-06-01", "199", "abcd", None], year_of_text) == [1995, None, None, None]
    years = [1994, 2000, 0, -5, 12345, None]
    assert evaluate(spark, years, period_of_year, "int") == [1990, 2000, 0, -10, 12340, None]
    assert evaluate(spark, [1994, 2001], lambda c: period_of_year(c, 7), "int") == [1988, 1995]
    day = datetime.date
    assert evaluate(spark, [day(1999, 12, 31), day(2000, 1, 1)], period_of_date, "date") == [1990, 2000]


def test_measures(spark):
    frame = spark.createDataFrame(
        [(100.0, 400.0), (0.0, 5.0), (-1.0, 5.0), (None, 5.0), (5.0, None)], "b double, r double"
    )
    roi = [r[0] for r in frame.select(return_on_investment(F.col("b"), F.col("r"))).collect()]
    assert roi == [3.0, None, None, None, None]
    assert evaluate(spark, [0, 1, 2, 3, 9, None], capped_bucket, "int") == [None, "1", "2", "3+", "3+", None]
    assert evaluate(spark, [0, 4, None], lambda c: prorate(F.lit(10.0), c), "int") == [None, 2.5, None]


def test_value_equal_to_a_cut_goes_up(spark):
    cuts = F.array(*[F.lit(float(c)) for c in (10, 20, 20, 30)])
    values = [5.0, 10.0, 15.0, 20.0, 30.0, 99.0]
    assert evaluate(spark, values, lambda c: band(cuts, c, 6), "double") == [1, 2, 2, 4, 5, 5]


def test_positive_numbers(spark):
    values = [1.0, 0.0, -1.0, float("nan"), float("inf"), None]
    assert evaluate(spark, values, positive, "double") == [True, False, False, False, True, None]


def test_dates_with_more_behind_them(spark):
    day = datetime.date(1995, 10, 30)
    texts = ["1995-10-30", " 1995-10-30 00:00:00", "1995-10-30T10:00:00Z", "1995", "soon", None]
    assert evaluate(spark, texts, lenient_date) == [day, day, day, None, None, None]


# text, named records, number of records, status
LISTS = [
    ("[{'name': 'A', 'id': 1}]", [(1, "A")], 1, "ok"),
    ("""[{'name': "O'Neil", 'id': 2}]""", [(2, "O'Neil")], 1, "ok"),
    (r"""[{'name': 'it\'s', 'id': 3}]""", [(3, "it's")], 1, "ok"),
    (r"""[{'name': 'nb\xa0sp', 'id': 3}]""", [(3, "nb\xa0sp")], 1, "ok"),
    (r"""[{'name': 'a\\xb', 'id': 3}]""", [(3, r"a\xb")], 1, "ok"),
    ("[{'name': 'A', 'id': None}]", [(None, "A")], 1, "ok"),
    ("[{'name': 'w: None, ok', 'id': 6}]", [(6, "w: None, ok")], 1, "ok"),
    ("[{'name': 'A', 'id': 1, 'flag': True, 'other': [1, 2]}]", [(1, "A")], 1, "ok"),
    ('[{"name": null, "id": 4}, {"name": "x", "id": 5}]', [(5, "x")], 2, "ok"),
    ("[{'name': '', 'id': 4}]", [], 1, "ok"),
    ("[{'name': 'A', 'id': 1}, 7]", [(1, "A")], 1, "ok"),
    ("[{'name': 'A', 'id': 1},]", [(1, "A")], 1, "ok"),
    ("[{'name': 'A', 'id': 1}, {'name': 'A', 'id': 1}]", [(1, "A"), (1, "A")], 2, "ok"),
    ("[]", [], 0, "ok"),
    ("{'name': 'A', 'id': 1}", [], 0, "unreadable"),
    ("[{'name': 'A', 'id': 1", [], 0, "unreadable"),
    ("[{'name': 'A', 'id': 1}] x", [], 0, "unreadable"),
    (r"[{'name': '\U0001F600', 'id': 1}]", [(1, "😀")], 1, "ok"),
    ("[{'name': 'A', 'id': 'abc'}]", [(None, "A")], 1, "ok"),
    ("False", [], 0, "empty"),
    ("", [], 0, "empty"),
    ("nan", [], 0, "empty"),
    (None, [], 0, "empty"),
]


@pytest.mark.parametrize("text, named, count, status", LISTS)
def test_entity_lists(spark, text, named, count, status):
    frame = spark.createDataFrame([(text,)], "c string")
    c = F.col("c")
    row = frame.select(parse_entities(c), F.size(parse_entities(c, False)), entities_status(c)).first()
    assert [tuple(record)[:2] for record in row[0]] == named
    assert row[1:] == (count, status)


def test_names_by_pattern_miss_quotes_in_names(spark):
    texts = [
        """[{'name': 'A', 'id': 1}, {"name": "B"}]""",
        """[{'name': "O'Neil"}]""",
        "[]",
        None,
    ]
    assert evaluate(spark, texts, names_by_pattern) == [["B", "A"], [], [], []]
