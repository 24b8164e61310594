import pytest
from odd_tables import CLASHING, FOLDER, ODD, SCHEMAS


def store(spark, folder, rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty, long and repeated texts."""
    return store(spark, tmp_path_factory.mktemp("odd") / "t", ODD)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return store(spark, tmp_path_factory.mktemp("empty") / "t", {})


@pytest.fixture(scope="session")
def crowded(spark):
    """The odd documents with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD["documents"], SCHEMAS["documents"])
    return frame.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def documents():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
