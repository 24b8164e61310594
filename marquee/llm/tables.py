"""Written tables that are replaced round by round, and vectors in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marquee.scratch import scratch_path


class Stored:
    """A frame written to the shared folder now and read back; it can be deleted once replaced."""

    def __init__(self, frame: DataFrame) -> None:
        self.spark, self.path = frame.sparkSession, scratch_path(frame.sparkSession)
        frame.write.parquet(self.path)
        self.frame = self.spark.read.schema(frame.schema).parquet(self.path)

    def delete(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lists_of(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A column of lists that all have ``width`` numbers and no null, as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def blocks_of_lists(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[tuple[list, np.ndarray]]:
    """The rows ``id, x`` of a task in blocks of ``size``: the ids and a matrix."""
    ids: list = []
    parts: list[np.ndarray] = []
    for batch in batches:
        points, own = lists_of(batch, "x", width), batch.column(0).to_pylist()
        at = 0
        while at < len(own):
            take = min(size - len(ids), len(own) - at)
            ids += own[at : at + take]
            parts.append(points[at : at + take])
            at += take
            if len(ids) == size:
                yield ids, np.concatenate(parts)
                ids, parts = [], []
    if ids:
        yield ids, np.concatenate(parts)
