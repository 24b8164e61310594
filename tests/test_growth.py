"""What the queries over large order tables read, parse and deal out, on rows of their own."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marquee.sources.orders import keyed_titles, order_companies, order_credits, order_titles

DAY = datetime.date(1994, 5, 1)
TABLES = {
    "orders": ("o_orderkey bigint, o_orderdate date, o_totalprice double", [(1, DAY, 10.0), (1, DAY, 20.0), (2, DAY, 5.0), (3, None, 1.0), (None, DAY, 2.0)]),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double",
        [(1, 1, 1, 2.0, 0.1), (1, 2, 2, 3.0, 0.0), (1, 2, 2, 3.0, 0.0), (2, 9, 1, 1.0, 0.2), (2, 1, None, 1.0, 0.2), (None, 1, 1, 1.0, 0.0), (4, 3, 3, 1.0, 0.0)],
    ),
    "part": ("p_partkey bigint, p_type string, p_retailprice double", [(1, "SMALL", 1.5), (2, "LARGE", 2.0), (2, "LARGE", 3.0), (3, None, 1.0)]),
    "supplier": ("s_suppkey bigint, s_name string", [(1, "A"), (2, "B"), (2, None), (3, "C"), (None, "D")]),
    "customer": ("c_custkey bigint, c_name string", [(i, f"Customer {i}") for i in range(20)] + [(None, "X"), (3, None)]),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("orders")
    for name, (columns, rows) in TABLES.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def sorted_rows(frame):
    return sorted(map(repr, frame.collect()))


class Grabbed(Exception):
    pass


def grabbed(monkeypatch, writer, name, spark, folder):
    """The frame that a query writes first."""
    found = []

    def grab(frame, *_):
        found.append(frame)
        raise Grabbed

    monkeypatch.setattr(entry, writer, grab)
    with pytest.raises(Grabbed):
        getattr(entry, name)(spark, folder)
    return found[0]


@pytest.mark.parametrize("writer, name", [("write_titles", "_catalogue"), ("write_csv", "csv_to_shares")])
def test_line_items_are_read_for_the_figures_and_the_companies(spark, folder, monkeypatch, writer, name):
    plan = plan_of(grabbed(monkeypatch, writer, name, spark, folder))
    assert len([line for line in plan.splitlines() if "Relation [l_orderkey#" in line]) == 2


def test_companies_as_in_the_credits(spark, folder):
    columns = [F.col(name).cast("string") for name in ("id", "company_id", "company")]
    found = order_companies(spark, folder).withColumnRenamed("o_orderkey", "id").select(*columns)
    assert sorted_rows(found) == sorted_rows(order_credits(spark, folder, parts=False).select(*columns))
    assert found.count() == 7


def test_titles_with_types(spark, folder):
    titles = keyed_titles(spark, folder, types=True)
    counted = titles.withColumn("n_genres", F.when(F.col("types").isNotNull(), F.size("types").cast("bigint"))).drop("o_orderkey", "types")
    assert sorted_rows(counted) == sorted_rows(order_titles(spark, folder))


def test_filled_as_format_string(spark):
    frame = spark.createDataFrame([("O'R", 1), ("%s", None), (None, 3)], "name string, id bigint")
    form = "[{'name': '%s', 'id': %s}]"
    assert frame.where(entry._filled(form, F.col("name"), F.col("id")) == F.format_string(form, "name", "id")).count() == 3


def test_literals_are_dealt_to_many_tasks_and_parsed_once(spark, folder):
    found = entry.list_literals(spark, folder)
    assert found.rdd.getNumPartitions() >= 4
    # One parse has three from_json of the usual spelling and three of the rewritten one.
    assert plan_of(found).count("from_json(") <= 6
    assert found.count() == 22
