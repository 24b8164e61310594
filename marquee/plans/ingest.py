"""From the raw text columns to typed titles, and what there is to know about a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions import (
    as_records,
    blank_to_null,
    entities,
    lenient_date,
    lenient_double,
    lenient_long,
    period_of_date,
    period_of_year,
    read_records,
    status,
    strip_space,
    year_of_text,
)
from marquee.functions.lenient import DATE_FORMATS
from marquee.schema import DECLARED_TYPES, RAW_COLUMNS
from marquee.sources.files import read_csv, write_titles

LISTS = {"companies": "production_companies", "genres": "genres"}


def clean(raw: DataFrame, date_formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Typed titles from the ten text columns, plus ``unreadable``: the list texts that failed.

    Bad values become null, a missing vote count zero, an unreadable list an empty one.
    Every input row is kept. A date text that isn't a date still has a period if it opens
    with a year.
    """
    date = lenient_date(F.col("release_date"), date_formats)
    year = year_of_text(strip_space(F.col("release_date")))
    # The lists are read in a step of their own, as several columns come from them.
    read = raw.withColumns({f"_{name}": read_records(F.col(text)) for name, text in LISTS.items()})
    failed = [
        F.when(
            status(F.col(text), F.col(f"_{name}")) == "unreadable",
            F.struct(F.lit(name).alias("list"), F.col(text).alias("text")),
        )
        for name, text in LISTS.items()
    ]
    return read.select(
        blank_to_null(F.col("id")).alias("id"),
        "original_title",
        date.alias("release_date"),
        F.col("release_date").alias("release_date_raw"),
        *[lenient_double(F.col(c)).alias(c) for c in ("budget", "revenue", "popularity", "vote_average")],
        lenient_long(F.col("vote_count")).alias("vote_count"),
        entities(F.col("_companies")).alias("companies"),
        entities(F.col("_genres"), named_only=False).alias("genres"),
        F.coalesce(period_of_date(date), period_of_year(year)).alias("period"),
        F.array_compact(F.array(*failed)).alias("unreadable"),
    )


def split(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The titles, and a quarantine with one row per list text that couldn't be read."""
    failed = cleaned.where(F.size("unreadable") > 0)
    return (
        cleaned.drop("unreadable"),
        failed.select("id", "original_title", F.inline("unreadable")),
    )


def ingest(
    spark: SparkSession,
    path: str,
    date_formats: tuple[str, ...] = DATE_FORMATS,
    multi_line: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Titles and quarantine of a raw CSV file, both lazy."""
    return split(clean(read_csv(spark, path, RAW_COLUMNS, multi_line), date_formats))


def ingest_to(
    spark: SparkSession,
    path: str,
    target: str,
    date_formats: tuple[str, ...] = DATE_FORMATS,
    multi_line: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The same, read and parsed once into a Parquet table partitioned by period."""
    write_titles(clean(read_csv(spark, path, RAW_COLUMNS, multi_line), date_formats), target)
    return split(spark.read.parquet(target))


def as_declared(titles: DataFrame) -> DataFrame:
    """The ten columns and types of the registered table: lists as JSON text, dates as text.

    This is what goes to the cleaned CSV and Parquet files; ``clean`` reads it back.
    """
    day = F.coalesce(F.date_format("release_date", "yyyy-MM-dd"), F.lit(""))
    columns = {
        **{name: F.col(name) for name in RAW_COLUMNS if name in titles.columns},
        "release_date": day,
        **{text: F.to_json(as_records(F.col(name))) for name, text in LISTS.items()},
    }
    return titles.select(*[columns[name].cast(kind).alias(name) for name, kind in DECLARED_TYPES.items()])


def dropped_columns(raw: DataFrame) -> list[str]:
    """The columns of the raw file that aren't kept."""
    return [name for name in raw.columns if name not in RAW_COLUMNS]


def profile(frame: DataFrame) -> DataFrame:
    """``column, type, n_rows, n_nulls`` of every column, from one pass over the table."""
    counts = frame.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(f"`{name}`").isNull()).alias(f"_{i}") for i, name in enumerate(frame.columns)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind).alias("type"),
                F.col("_rows").alias("n_rows"),
                F.col(f"_{i}").alias("n_nulls"),
            )
            for i, (name, kind) in enumerate(frame.dtypes)
        ]
    )
    return counts.select(F.inline(lines))


def preview(frame: DataFrame, n: int = 5) -> DataFrame:
    return frame.limit(n)


def load_check(frame: DataFrame, date: str = "release_date") -> DataFrame:
    """``total, first_date, last_date`` of a loaded table."""
    return frame.agg(
        F.count("*").alias("total"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )


def by_footers(spark: SparkSession, path: str) -> DataFrame:
    """A stored Parquet table whose counts and extremes are taken from the statistics in the footers.

    Spark's second Parquet reader does that. It is switched on in a session of its own on the same
    context, so that the caller's settings stay as they are.
    """
    footers = spark.newSession()
    v1_only = [name for name in footers.conf.get("spark.sql.sources.useV1SourceList").split(",") if name.strip() != "parquet"]
    footers.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1_only))
    footers.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return footers.read.parquet(path)


def _dated(frame: DataFrame, by: list[str]) -> DataFrame:
    return frame.groupBy(*by).agg(F.count("*").alias("n"), F.count("_date").alias("n_dated"))


def _extremes(frame: DataFrame, by: list[str], keys: list) -> DataFrame:
    if by:
        named = F.col(by[0]).isin([key for key in keys if key is not None])
        frame = frame.where(named | F.col(by[0]).isNull() if None in keys else named)
    return frame.agg(F.min("_date").alias("first_date"), F.max("_date").alias("last_date"))


def load_check_stored(spark: SparkSession, path: str, date: str = "release_date", period: str = "period") -> DataFrame:
    """The same of a stored Parquet table, from the footers of its files.

    Footers count the rows and the dates of every ``period`` (the folders of ``write_titles``; a table
    without that column is one period). Where all rows have a date they give the first and last one too; footers of
    files without any date have none, so the column is read in periods where dates are missing in part.
    The periods' counts, a row each, are looked at here, so jobs start before the frame is returned.
    """
    footers = by_footers(spark, path).withColumnRenamed(date, "_date")
    by = [period] if period in footers.columns else []
    # Files without any row have no statistics, not even a count of zero.
    counts = [row for row in _dated(footers, by).collect() if row.n]
    found = []
    for frame, rows in (
        (footers, [row for row in counts if 0 < row.n_dated == row.n]),
        (spark.read.parquet(path).withColumnRenamed(date, "_date"), [row for row in counts if 0 < row.n_dated < row.n]),
    ):
        if rows:
            found.append(_extremes(frame, by, [row[period] for row in rows] if by else []).first())
    kind = footers.schema["_date"].dataType
    schema = T.StructType(
        [T.StructField("total", T.LongType()), T.StructField("first_date", kind), T.StructField("last_date", kind)]
    )
    first = min((row.first_date for row in found), default=None)
    last = max((row.last_date for row in found), default=None)
    return spark.createDataFrame([(sum(row.n for row in counts), first, last)], schema)
