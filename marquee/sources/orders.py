"""An order book read as a title catalogue.

An order is a title: its total is the revenue, its line items give the other figures, and
the suppliers of its lines are the credited companies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _hundredths(value: Column) -> Column:
    """Whole hundredths, so that sums don't depend on the order of the rows."""
    return F.floor(value * 100 + F.lit(0.5))


def keyed_titles(spark: SparkSession, folder: str, parts: bool = True, types: bool = False) -> DataFrame:
    """``order_titles`` with ``o_orderkey``; ``types``, the set of the parts' types, can take the place of ``n_genres``."""
    lines = table(spark, folder, "lineitem")
    figures = [
        F.sum("l_quantity").alias("popularity"),
        F.sum(_hundredths(F.col("l_discount"))).alias("_percents"),
        F.count("*").alias("vote_count"),
    ]
    added = []
    if parts:
        part = table(spark, folder, "part")
        lines = lines.join(part, lines["l_partkey"] == part["p_partkey"])
        cost = _hundredths(F.col("l_quantity")) * _hundredths(F.col("p_retailprice"))
        kinds = F.collect_set("p_type").alias("types") if types else F.count_distinct("p_type").alias("n_genres")
        figures += [(F.sum(cost) / F.lit(10_000.0)).alias("budget"), kinds]
        added = ["budget", "types" if types else "n_genres"]
    per_order = lines.groupBy("l_orderkey").agg(*figures)
    orders = table(spark, folder, "orders")
    rating = F.floor(F.lit(10.0) * F.col("_percents") / F.col("vote_count")) / F.lit(10.0)
    return orders.join(per_order, orders["o_orderkey"] == per_order["l_orderkey"], "left").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("original_title"),
        F.col("o_orderdate").cast("date").alias("release_date"),
        F.col("o_totalprice").alias("revenue"),
        "popularity",
        rating.alias("vote_average"),
        "vote_count",
        *added,
    )


def order_titles(spark: SparkSession, folder: str, parts: bool = True) -> DataFrame:
    """One title per order. ``budget`` and ``n_genres`` need the parts; leave them out if unused.

    Orders without line items keep null figures.
    """
    return keyed_titles(spark, folder, parts).drop("o_orderkey")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's suppliers as ``o_orderkey, company_id``, every pair once."""
    return (
        table(spark, folder, "lineitem")
        .where("l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL")
        .select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("company_id"))
        .repartition("o_orderkey")
        .distinct()
    )


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company")
    )


def order_companies(spark: SparkSession, folder: str) -> DataFrame:
    """``o_orderkey, company_id, company`` of the credits, without the title's figures, which cost an aggregation."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    return _pairs(spark, folder).join(orders, "o_orderkey").join(_names(spark, folder), "company_id")


def order_credits(spark: SparkSession, folder: str, parts: bool = True) -> DataFrame:
    """One credit per order and supplier, with the title's figures and ``n_companies``."""
    # One shuffle by order serves the distinct pairs and the count, which is dropped where unused.
    pairs = _pairs(spark, folder).withColumn("n_companies", F.count("*").over(Window.partitionBy("o_orderkey")))
    titles = keyed_titles(spark, folder, parts)
    return (
        pairs.join(titles, "o_orderkey")
        .join(_names(spark, folder), "company_id")
        .drop("o_orderkey")
    )
