"""Column names and types shared by the whole library."""

from __future__ import annotations

from pyspark.sql import types as T

# The ten useful columns of the raw file.
RAW_COLUMNS = [
    "id",
    "original_title",
    "release_date",
    "budget",
    "revenue",
    "popularity",
    "vote_average",
    "vote_count",
    "production_companies",
    "genres",
]

# Types of the registered external table over the cleaned Parquet file.
DECLARED_TYPES = {
    "id": "string",
    "original_title": "string",
    "release_date": "string",
    "budget": "double",
    "revenue": "double",
    "popularity": "double",
    "vote_average": "string",
    "vote_count": "string",
    "production_companies": "string",
    "genres": "string",
}

ENTITY = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("ref", T.StringType())])

TITLES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("original_title", T.StringType()),
        T.StructField("release_date", T.DateType()),
        T.StructField("release_date_raw", T.StringType()),
        T.StructField("budget", T.DoubleType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("popularity", T.DoubleType()),
        T.StructField("vote_average", T.DoubleType()),
        T.StructField("vote_count", T.LongType()),
        T.StructField("companies", T.ArrayType(ENTITY)),
        T.StructField("genres", T.ArrayType(ENTITY)),
        T.StructField("period", T.IntegerType()),
    ]
)
