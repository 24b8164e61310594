"""CSV files whose quoted fields hold line ends, read in splits.

A split can't tell by itself whether it starts inside a quoted field. What a line does depends on that:
it leaves the state as it is, turns it round, or sets it. So does a split, as all its lines one after the
other, and a first pass finds what each split does from either state: two bits for each split. Put
together in the order of the splits they give the state in which each one starts. The second pass makes
records of the lines. A record that goes over the end of a split is left in pieces, one or two for
each split, which are put together by file in a join of their own.

Lines end in a line feed, with or without a carriage return before it. A quoted field opens right
after a separator or at the start of a record; quotes elsewhere are text, as they are to Spark's parser.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# From the start of a record: whole fields, then one that opens and isn't closed.
_ENDS_INSIDE = r'(?s)^(?:(?:[^",][^,]*)?,|"(?:[^"]|"")*"(?:[^",][^,]*)?,)*"(?:[^"]|"")*$'
# Kinds of pieces, in the order in which they follow each other within a split.
WHOLE, HEADER, HEAD, MIDDLE, TAIL = range(5)


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    where = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", "\n").text(files).select(*where, "value")


def _inside_after(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line ends inside a quoted field, if it starts outside one, and if inside one."""
    from_out, from_in = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(quoted):
        some = lines.take(pa.array(quoted))
        from_out[quoted] = pc.match_substring_regex(some, _ENDS_INSIDE).to_numpy(zero_copy_only=False)
        opened = pc.binary_join_element_wise(b'"', some, b"")
        from_in[quoted] = pc.match_substring_regex(opened, _ENDS_INSIDE).to_numpy(zero_copy_only=False)
    return from_out, from_in


def _inside(from_out: np.ndarray, from_in: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line ends inside, when the first one starts as told."""
    sets, turns = from_out == from_in, np.cumsum(from_out & ~from_in)
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
    since = turns - np.where(last >= 0, turns[last], 0)
    return np.where(last >= 0, from_out[last], start) ^ (since % 2 == 1)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """The lines of a batch by the split they are of."""
    file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    lines = batch.column(2).cast(pa.binary())
    for start, stop in zip([0, *cuts], [*cuts, len(file)], strict=True):
        if stop > start:
            yield int(file[start]), int(block[start]), lines.slice(start, stop - start)


def _joined(lines: pa.Array, ends: np.ndarray) -> pa.Array:
    """Records of the lines up to each of the ends, without the carriage return after them."""
    offsets = pa.array(np.concatenate([[0], ends + 1]), pa.int32())
    return pc.replace_substring_regex(pc.binary_join(pa.ListArray.from_arrays(offsets, lines), b"\n"), r"\r\z", "")


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split what it does from either state, and for a file's first one the first record."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for file, block, lines in _stretches(batch):
            state = found.setdefault((file, block), [False, True, None if block else [], False])
            from_out, from_in = _inside_after(lines)
            outside = _inside(from_out, from_in, state[0])
            if state[2] is not None and not state[3]:
                ends = np.flatnonzero(~outside)[:1]
                state[2].append(lines.slice(0, int(ends[0]) + 1 if len(ends) else len(lines)))
                state[3] = bool(len(ends))
            state[0], state[1] = bool(outside[-1]), bool(_inside(from_out, from_in, state[1])[-1])
    keys, states = list(found), list(found.values())
    heads = [None if s[2] is None else pc.binary_join(pa.ListArray.from_arrays(pa.array([0, sum(map(len, s[2]))], pa.int32()), pa.concat_arrays(s[2])), b"\n")[0].as_py() for s in states]
    columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
    columns += [pa.array([s[i] for s in states], pa.bool_()) for i in (0, 1, 3)] + [pa.array(heads, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["file", "block", "from_out", "from_in", "closed", "head"])


def _assembled(batches: Iterator[pa.RecordBatch], inside: dict[tuple[int, int], bool]) -> Iterator[pa.RecordBatch]:
    """The records of each split, its header, and the pieces of those that go over its ends."""
    names = ["file", "block", "kind", "value"]
    split: tuple[int, int] | None = None
    open_, rest, first = False, None, False

    def rows(values: pa.Array, kinds: np.ndarray) -> pa.RecordBatch:
        text = pc.cast(values, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
        n = len(text)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, split[0])), pa.array(np.full(n, split[1])), pa.array(kinds, pa.int32()), text], names)

    def left() -> Iterator[pa.RecordBatch]:
        if rest is not None and len(rest):
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), b"\n")
            yield rows(whole, np.array([MIDDLE if first and inside[split] else TAIL]))

    for batch in batches:
        for file, block, lines in _stretches(batch):
            if (file, block) != split:
                yield from left()
                split, rest, first = (file, block), None, True
                open_ = inside[split]
            after = _inside(*_inside_after(lines), open_)
            open_ = bool(after[-1])
            ends = np.flatnonzero(~after)
            if rest is not None and len(rest):
                lines, ends = pa.concat_arrays([rest, lines]), ends + len(rest)
            if len(ends):
                kinds = np.full(len(ends), WHOLE)
                if first:
                    kinds[0] = HEAD if inside[split] else WHOLE if block else HEADER
                    first = False
                yield rows(_joined(lines.slice(0, int(ends[-1]) + 1), ends), kinds)
                lines = lines.slice(int(ends[-1]) + 1)
            rest = lines
    if split is not None:
        yield from left()


def records(spark: SparkSession, files: list[str]) -> tuple[DataFrame, dict[str, list[int]]]:
    """``file, value``, a row for each record but the headers, and the files (as ``file``) by header."""
    lines = _lines(spark, files)
    kinds = "file bigint, block bigint, from_out boolean, from_in boolean, closed boolean, head binary"
    # A row of a few bytes for each split, as Spark's own list of splits has.
    effects = sorted(lines.mapInArrow(_effects, kinds).collect(), key=lambda row: (row.file, row.block))
    inside: dict[tuple[int, int], bool] = {}
    headers: dict[str, list[int]] = {}
    state, file = False, None
    for row in effects:
        state = state and row.file == file
        file = row.file
        inside[row.file, row.block] = state
        state = row.from_in if state else row.from_out
        if row.head is not None:
            if not row.closed:
                raise ValueError("the header doesn't end within the first split of a file")
            headers.setdefault(row.head.decode().removeprefix("﻿").removesuffix("\r"), []).append(row.file)
    pieces = lines.mapInArrow(lambda batches: _assembled(batches, inside), "file bigint, block bigint, kind int, value string")
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "value")
    in_order = Window.partitionBy("file").orderBy("block", "kind")
    crossing = (
        pieces.where(F.col("kind") >= HEAD)
        .withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(in_order))
        .groupBy("file", "record")
        .agg(F.array_sort(F.collect_list(F.struct("block", "kind", "value"))).alias("parts"))
        .select("file", F.array_join("parts.value", "\n").alias("value"))
    )
    return whole.unionAll(crossing).where(F.trim("value") != ""), headers


def _names(header: str) -> list[str]:
    """Column names as Spark's reader makes them: empty and repeated ones get their number."""
    names = next(csv.reader(io.StringIO(header, newline="")), [])
    seen = Counter(name.lower() for name in names)
    return [f"_c{i}" if not name else f"{name}{i}" if seen[name.lower()] > 1 else name for i, name in enumerate(names)]


def read_across(spark: SparkSession, files: list[str], options: dict[str, str], columns: list[str] | None) -> DataFrame:
    """The files' columns as text, found by name in each file's own header; without ``columns`` all there are."""
    rows, headers = records(spark, files)
    layouts = {header: _names(header) for header in headers}
    names = columns if columns is not None else list(dict.fromkeys(name for own in layouts.values() for name in own))
    parsed, found = {}, {name: [] for name in names}
    for i, (header, own) in enumerate(layouts.items()):
        fields = F.from_csv("value", _ddl(own), {**options, "header": "false", "multiLine": "true"})
        mine = F.col("file").isin(headers[header]) if len(layouts) > 1 else F.lit(True)
        parsed[f"_{i}"] = F.when(mine, fields)
        for name in names:
            if name in own:
                found[name].append(F.col(f"_{i}")[name])
    if not parsed:
        return spark.createDataFrame([], T.StructType([T.StructField(name, T.StringType()) for name in names]))

    def text(name: str) -> Column:
        return (F.coalesce(*found[name]) if found[name] else F.lit(None).cast("string")).alias(name)

    return rows.withColumns(parsed).select(*[text(name) for name in names])


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
