from __future__ import annotations

import datetime

import pytest

from marquee import schema, scratch, session

GOLDEN = [
    ("1", "Alpha", "1994-05-01", 100, 400, 10, 8.0, 100, [(1, "P"), (2, "Q")], "a"),
    ("2", "Beta", "1995-06-01", 200, 100, 20, 6.0, 50, [(1, "P")], "ab"),
    ("3", "Gamma", "1995-07-01", 50, 100, 1, 9.0, 40, [(3, "O'R")], "abc"),
    ("4", "Delta", "1995-08-01", None, 100, 30, 5.0, 0, [(1, "P"), (4, "S")], "a"),
    ("5", "Eps", "1999-01-01", 400, 0, 5, 7.0, 20, [(2, "Q")], "abcd"),
    ("6", "Zeta", "2003-03-03", 100, 300, 8, 7.5, 30, [(3, "O'R"), (3, "O'R")], "b"),
    ("7", "Eta", "2004-04-04", 300, 900, 2, 9.5, 15, [], "ab"),
    ("8", "Theta", "2004-04-04", 100, 50, 0.5, 9.5, 12, [(4, "S"), (5, "T")], ""),
    ("9", "Iota", None, 10, 10, 1, 10, 99, [(1, "P")], "a"),
    ("10", "Kappa", "2011-01-01", 10, 20, 3, 4.0, 10, [], "a"),
]


def _number(value):
    return None if value is None else float(value)


def golden_rows():
    for id_, title, date, budget, revenue, pop, va, votes, companies, genres in GOLDEN:
        day = None if date is None else datetime.date.fromisoformat(date)
        yield (
            id_,
            title,
            day,
            date,
            _number(budget),
            _number(revenue),
            _number(pop),
            _number(va),
            votes,
            [(i, name, None) for i, name in companies],
            [(i, g, None) for i, g in enumerate(genres)],
            None if day is None else day.year // 10 * 10,
        )


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    built = session.build(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(warehouse),
        spark__driver__memory="4g",
        spark__sql__maxMetadataStringLength="2000",
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    scratch.clear(built)
    built.stop()


@pytest.fixture(scope="session")
def titles(spark):
    return spark.createDataFrame(list(golden_rows()), schema.TITLES)


@pytest.fixture
def rows():
    """Collects a frame as a set-comparable list of tuples with rounded floats."""

    def collect(frame, *columns, digits=6):
        def plain(value):
            return round(value, digits) + 0.0 if isinstance(value, float) else value

        picked = frame.select(*columns) if columns else frame
        return [tuple(plain(value) for value in row) for row in picked.collect()]

    return collect
