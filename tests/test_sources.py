"""Files, catalog, ingest and registry."""

import csv
import datetime
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from marquee import ingest, load_check, profile, report, run, variants
from marquee.operators.credits import explode_credits
from marquee.plans.ingest import as_declared, clean, dropped_columns, ingest_to, preview, split
from marquee.plans.registry import min_votes_of
from marquee.schema import DECLARED_TYPES, RAW_COLUMNS, TITLES
from marquee.scratch import folder, small, written
from marquee.sources.catalog import create_database, register_table
from marquee.sources.files import (
    read_csv,
    report_lines,
    write_csv,
    write_report,
    write_result,
    write_titles,
)

RAW = [
    {
        "adult": "False",
        "id": " 1 ",
        "original_title": 'A "quoted", title\nwith a line end',
        "release_date": "1995-10-30",
        "budget": "100",
        "revenue": "300.5",
        "popularity": "21.9",
        "vote_average": "7.7",
        "vote_count": "5415.0",
        "production_companies": """[{'name': "O'Neil, Inc", 'id': 3}, {'name': 'B', 'id': 4}]""",
        "genres": "[{'id': 16, 'name': 'Animation'}, {'id': 35}]",
    },
    {
        "adult": "x",
        "id": "",
        "original_title": "B",
        "release_date": "not a date",
        "budget": "/path.jpg",
        "revenue": "",
        "popularity": "Beware",
        "vote_average": "nan",
        "vote_count": "",
        "production_companies": "[{'name': 'broken",
        "genres": "False",
    },
]


@pytest.fixture(scope="module")
def raw_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "raw.csv"
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, fieldnames=list(RAW[0]))
        writer.writeheader()
        writer.writerows(RAW)
    return str(path)


def test_csv_is_read_as_text_by_name(spark, raw_path):
    raw = read_csv(spark, raw_path)
    assert {kind for _, kind in raw.dtypes} == {"string"}
    assert [r.original_title for r in raw.collect()] == [RAW[0]["original_title"], "B"]
    assert dropped_columns(raw) == ["adult"]
    picked = read_csv(spark, raw_path, ["genres", "missing", "id"])
    assert picked.columns == ["genres", "missing", "id"]
    assert [r.missing for r in picked.collect()] == [None, None]


def test_ingest(spark, raw_path):
    titles, quarantine = ingest(spark, raw_path)
    assert titles.schema.simpleString() == TITLES.simpleString()
    first, second = titles.collect()
    assert first.id == "1" and second.id is None
    assert first.release_date == datetime.date(1995, 10, 30) and second.release_date is None
    assert (first.period, second.period) == (1990, None)
    assert second.release_date_raw == "not a date"
    assert (first.budget, first.revenue, first.popularity, first.vote_average) == (100, 300.5, 21.9, 7.7)
    assert (second.budget, second.revenue, second.popularity, second.vote_average) == (None,) * 4
    assert (first.vote_count, second.vote_count) == (5415, 0)
    assert [tuple(c)[:2] for c in first.companies] == [(3, "O'Neil, Inc"), (4, "B")]
    assert [tuple(g)[:2] for g in first.genres] == [(16, "Animation"), (35, None)]
    assert second.companies == [] and second.genres == []
    assert [tuple(r) for r in quarantine.collect()] == [(None, "B", "companies", "[{'name': 'broken")]


def test_stored_ingest(spark, raw_path, tmp_path):
    titles, quarantine = ingest(spark, raw_path)
    stored, kept = ingest_to(spark, raw_path, str(tmp_path / "titles"))
    assert sorted(stored.columns) == sorted(titles.columns)
    assert sorted(map(str, stored.select(*titles.columns).collect())) == sorted(map(str, titles.collect()))
    assert kept.collect() == quarantine.collect()


def test_lists_are_parsed_once(spark, raw_path):
    cleaned = clean(read_csv(spark, raw_path, RAW_COLUMNS))
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    # The file has line ends in fields: records of one split and those over several are parsed apart.
    assert plan.count("from_json(ArrayType(StructType") == 2 * 2


def test_profile_preview_and_load_check(spark, titles):
    counts = {r["column"]: (r["type"], r["n_rows"], r["n_nulls"]) for r in profile(titles).collect()}
    assert counts["id"] == ("string", 10, 0)
    assert counts["release_date"] == ("date", 10, 1)
    assert counts["budget"] == ("double", 10, 1)
    assert preview(titles, 3).count() == 3
    day = datetime.date
    assert tuple(load_check(titles).first()) == (10, day(1994, 5, 1), day(2011, 1, 1))


def test_csv_round_trip(spark, titles, tmp_path):
    path = str(tmp_path / "csv")
    write_csv(titles, path)
    back = read_csv(spark, path)
    assert back.count() == 10
    row = back.where("id = '3'").first()
    assert json.loads(row.companies) == [{"id": 3, "name": "O'R"}]
    assert row.release_date == "1995-07-01"
    # Written as empty text, which the CSV reader takes for a missing value.
    assert back.where("id = '9'").first().release_date in (None, "")


def test_csv_keeps_every_character(spark, tmp_path):
    texts = [" padded ", 'quo"ted', "a,b", "line\nend", "back\\slash", "tab\t", "été", "'", '"', '\\"']
    path = str(tmp_path / "texts")
    write_csv(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), path)
    assert [r.t for r in read_csv(spark, path).orderBy(F.col("i").cast("int")).collect()] == texts


def test_titles_are_stored_by_period(spark, titles, tmp_path):
    path = str(tmp_path / "titles")
    write_titles(titles, path)
    folders = {name for name in os.listdir(path) if name.startswith("period=")}
    assert folders == {"period=1990", "period=2000", "period=2010", "period=__HIVE_DEFAULT_PARTITION__"}
    stored = spark.read.parquet(path)
    assert stored.count() == 10
    plan = run("stab", stored.where("period = 1990"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*period#\d+ = 1990", plan)


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_results_are_written(spark, titles, tmp_path, form):
    path = str(tmp_path / form)
    write_result(run("stab", titles), path, form)
    back = spark.read.option("header", "true").format(form).load(path)
    assert back.count() == 6
    with pytest.raises(ValueError):
        write_result(titles, path, "xml")


def test_report_lines(spark, titles, tmp_path):
    frame = run("stab", titles)
    lines = [r.value for r in report_lines(frame, ["decade", "bucket"], {"mean": 6, "std": 6}).collect()]
    assert lines[2] == "1990|3+\t8.333333|0.942809|2"
    path = str(tmp_path / "report")
    write_report(frame, path, ["decade", "bucket"], {"mean": 3, "std": 3})
    assert "1990|3+\t8.333|0.943|2" in [r.value for r in spark.read.text(path).collect()]


def test_external_table_over_cleaned_file(spark, tmp_path):
    location = str(tmp_path / "input")
    row = {name: "1.5" if kind == "double" else "x" for name, kind in DECLARED_TYPES.items()}
    frame = spark.createDataFrame([row]).select(
        *[F.col(name).cast(kind) for name, kind in DECLARED_TYPES.items()]
    )
    frame.write.parquet(location)
    create_database(spark, "films")
    create_database(spark, "films")
    registered = register_table(spark, "films.movies", location)
    assert dict(registered.dtypes) == DECLARED_TYPES
    assert register_table(spark, "films.movies", location).count() == 1
    assert list(DECLARED_TYPES) == RAW_COLUMNS
    spark.sql("DROP DATABASE films CASCADE")


def test_analyses_over_the_registered_text_table(spark, titles, tmp_path, rows):
    location = str(tmp_path / "declared")
    as_declared(titles).write.parquet(location)
    create_database(spark, "shows")
    table = register_table(spark, "shows.movies", location)
    again, quarantine = split(clean(table))
    assert quarantine.count() == 0
    for name in ("q1", "q3", "stab", "hg"):
        assert rows(run(name, again)) == rows(run(name, titles))
    spark.sql("DROP DATABASE shows CASCADE")


def test_registry(spark, titles, rows):
    assert len(variants()) == 13
    for name in variants():
        assert run(name, titles).columns
    with pytest.raises(KeyError, match="q1_general"):
        run("q9", titles)
    assert run("q1", titles).columns == ["decade", "top5_share", "rank", "company", "revenue", "pct_of_total"]
    assert run("q2", titles).columns == ["decade", "bud_decile", "avg_roi", "n"]
    assert run("q4", titles).columns == ["decade", "id", "original_title", "va", "pop", "vc"]
    assert run("q5", titles).columns == ["decade", "bucket", "mean_va", "sd_va", "n"]
    assert rows(run("q1_general", titles)) == [(1990, 1.0), (2000, 0.28)]
    assert rows(run("mc_summary", titles)) == [(1990, 100.0, 700.0), (2000, 28.0, 1250.0), (2010, 0.0, 20.0)]
    assert [r.id for r in run("q4", titles, min_votes="12").collect()] == ["3", "8"]
    assert [r.cid for r in run("debut", titles).collect()] == [1, 2, 3, 5]
    assert run("q1", titles, explode_credits(titles)).count() == 7


def test_batch_reports(titles):
    def lines(name, **limits):
        return [r.value for r in report(name, titles, **limits).collect()]

    assert lines("mc") == [
        "1990\tTOP5|100.0000|TOTAL|700.00",
        "1990|TOP1\t1|P|350.00|50.0000",
        "1990|TOP2\t2|Q|200.00|28.5714",
        "1990|TOP3\t3|O'R|100.00|14.2857",
        "1990|TOP4\t4|S|50.00|7.1429",
        "2000\tTOP5|28.0000|TOTAL|1250.00",
        "2000|TOP1\t3|O'R|300.00|24.0000",
        "2000|TOP2\t4|S|25.00|2.0000",
        "2000|TOP3\t5|T|25.00|2.0000",
        "2010\tTOP5|0.0000|TOTAL|20.00",
    ]
    assert lines("debut")[0] == "1|P\t1994-05-01|3.000000|10.000000|-0.500000|25.000000|2|3.500000|-15.000000"
    assert lines("hg", min_votes=12) == ["1990\t3|Gamma|9.000|1.000|40", "2000\t8|Theta|9.500|0.500|12"]
    assert lines("stab")[2] == "1990|3+\t8.333333|0.942809|2"
    assert lines("roi") == []
    small = lines("roi", min_rows=4)
    assert len(small) == 10
    assert small[0] == "1990|1\t0.000000|0" and small[2] == "1990|3\t1.000000|1"
    with pytest.raises(KeyError, match="stab"):
        report("q1", titles)


def test_queries_without_companies_need_no_list(titles):
    assert run("stab", titles.drop("companies")).count() == 6


def test_min_votes_input():
    table = {None: 10, "abc": 10, "inf": 10, "nan": 10, "": 0, "12.9": 12, "-3": 0, 7: 7}
    assert [min_votes_of(value) for value in table] == list(table.values())


def test_scratch(spark, titles):
    assert folder(spark)
    copy = written(titles)
    assert copy.schema == titles.schema and copy.count() == 10
    assert small(titles, 10).count() == 10
    large = small(titles, 9)
    assert large.count() == 10 and large.schema == titles.schema


class Unset:
    """A session whose checkpoint folder isn't set."""

    def __init__(self, master):
        self.master = master
        self.conf = self.sparkContext = self

    def get(self, name, default=None):
        return default

    def getCheckpointDir(self):
        return None


def test_scratch_folder_is_local_on_one_machine_only():
    assert folder(Unset("local[2]")) == folder(Unset("local[4]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folder(Unset("yarn"))
