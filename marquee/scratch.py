"""Intermediate tables in the folder all executors share.

A written table is read back as often as needed without being computed again, and it
outlives the executors that wrote it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is broadcast has so many rows at most.
MOST_ROWS = 20_000

_local_folder: str | None = None


def folder(spark: SparkSession) -> str:
    """The shared folder; only a session on one machine may fall back to a local one."""
    global _local_folder
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="marquee-")
    return _local_folder


def scratch_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The same rows, read from a table written now."""
    path = scratch_path(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """The same rows dealt evenly to many tasks, for costly work on rows that come from few splits.

    A file's row group is read by one task, whatever follows the scan.
    """
    spark = frame.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return frame.repartition(tasks)


def small(frame: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """A table computed now, for a join: fixed on the driver and marked for broadcast if it is small.

    With more than ``most`` rows it becomes a written table without a mark, so Spark joins it
    as it does any other. Columns without nulls are declared as such in the small case.
    """
    rows = frame.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return written(frame)
    fields = [
        T.StructField(field.name, field.dataType, rows[field.name].null_count > 0)
        for field in frame.schema
    ]
    return F.broadcast(frame.sparkSession.createDataFrame(rows, T.StructType(fields)))


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames over them can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
