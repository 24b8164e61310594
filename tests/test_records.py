"""CSV records that go over lines and splits, against Spark's reader with one task for each file."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.sources import records
from marquee.sources.files import read_csv

PIECES = ["a", "b c", '""', ",", "\n", "\r\n", "\n\n", "é", "'", "\\", "x" * 50, ""]


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that records, fields and quotes fall on their borders."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def field(draw):
    if draw.random() < 0.5:
        return draw.choice(["", "plain", "12.5", 'an 8" disk', " blanks "])
    return '"' + "".join(draw.choices(PIECES, k=draw.randint(0, 6))) + '"'


def write(path, seed, end="\n", header='id,"te\nxt",other', n=150):
    draw = random.Random(seed)
    rows = [",".join([str(i), field(draw), field(draw)]) for i in range(n)]
    path.write_bytes((end.join([header, *rows]) + (end if seed % 2 else "")).encode())
    return str(path)


def collected(frame):
    return sorted(tuple("" if x is None else x for x in row) for row in frame.collect())


@pytest.mark.parametrize("seed", range(6))
def test_same_rows_as_one_task(spark, tmp_path, small_splits, seed):
    path = write(tmp_path / "a.csv", seed, end="\r\n" if seed > 3 else "\n")
    options = {"lineSep": "\r\n"} if seed > 3 else {}
    whole = spark.read.options(header="true", escape='"', multiLine="true", **options).csv(path)
    found = read_csv(spark, path)
    assert found.columns == whole.columns
    assert whole.rdd.getNumPartitions() == 1
    assert records._lines(spark, [path]).rdd.getNumPartitions() > 5
    assert collected(found) == collected(whole)


def test_a_field_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {i} with a ""quote"", a comma' for i in range(200))
    path = tmp_path / "a.csv"
    path.write_text(f'id,text\n1,short\n2,"{long}"\n3,"more\nlines"\n4,"{long}"')
    rows = {r.id: r.text for r in read_csv(spark, str(path)).collect()}
    text = long.replace('""', '"')
    assert rows == {"1": "short", "2": text, "3": "more\nlines", "4": text}


def test_files_of_other_layouts_and_without_line_ends(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", 1, header="id,text,other")
    write(tmp_path / "b.csv", 3, header="other,id,third")
    (tmp_path / "c.csv").write_text("text,id\nplain,900\n")
    (tmp_path / "d.csv").write_text("id,text\n")
    found = read_csv(spark, str(tmp_path), ["id", "other", "missing"])
    a = spark.read.options(header="true", escape='"', multiLine="true").csv(str(tmp_path / "a.csv")).select("id", "other")
    b = spark.read.options(header="true", escape='"', multiLine="true").csv(str(tmp_path / "b.csv")).select("id", "other")
    c = spark.createDataFrame([("900", None)], a.schema)
    assert collected(found) == collected(a.union(b).union(c).withColumn("missing", F.lit(None)))


def test_blank_lines_marks_and_odd_names(spark, tmp_path, small_splits):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿id,,id,"a `b`"\n\n1,2,3,"x\ny"\n\n'.encode())
    frame = read_csv(spark, str(path), multi_line=True)
    assert frame.columns == ["id0", "_c1", "id2", "a `b`"]
    assert [tuple(r) for r in frame.collect()] == [("1", "2", "3", "x\ny")]


def test_an_open_quote_at_the_end(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,a\n2,"never\nclosed\n')
    whole = spark.read.options(header="true", escape='"', multiLine="true").csv(str(path))
    assert {r.id for r in read_csv(spark, str(path)).collect()} == {r.id for r in whole.collect()} == {"1", "2"}
