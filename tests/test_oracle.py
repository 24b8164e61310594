"""Every registered query against the same question in SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from marquee import hidden_gems
from marquee.scratch import written
from marquee.sources.orders import order_titles

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry._own_sql()
QUERIES = {query.__name__: query for query in entry._QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        if name.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def sorted_rows(rows, order):
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    if name not in SQL:
        assert rows
        return
    found = database.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    order = [columns.index(c) for c in sorted(columns)]
    own = [frame.columns.index(c) for c in sorted(columns)]
    assert sorted_rows(rows, own) == sorted_rows(found.fetchall(), order)


def test_every_sql_has_a_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(SQL)


def test_approximate_gems_are_within_the_rank_error(spark):
    titles = written(order_titles(spark, FOLDER, parts=False))

    def ids(method, accuracy, high, low):
        options = {"min_votes": 2, "limit": None, "accuracy": accuracy, "high_q": high, "low_q": low}
        return {r.id for r in hidden_gems(titles, method=method, **options).collect()}

    assert ids("approx", 1_000_000, 0.9, 0.1) == ids("exact", 10_000, 0.9, 0.1)
    rough = ids("approx", 20, 0.9, 0.1)
    assert ids("exact", 10_000, 0.96, 0.04) <= rough <= ids("exact", 10_000, 0.84, 0.16)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
