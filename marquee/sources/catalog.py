"""Database and external table over the cleaned Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.schema import DECLARED_TYPES


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def register_table(
    spark: SparkSession, table: str, location: str, types: dict[str, str] | None = None
) -> DataFrame:
    """An external Parquet table with declared columns; nothing happens if it exists."""
    escaped = location.replace("\\", "\\\\").replace("'", "\\'")
    columns = ", ".join(f"`{name}` {kind}" for name, kind in (types or DECLARED_TYPES).items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING PARQUET LOCATION '{escaped}'")
    return spark.table(table)
