"""

Orders stand for titles and their suppliers for companies, see ``marquee/sources/orders.py``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import debut_effect, hidden_gems, load_check, load_check_stored, period_overview, profile, rating_stability
from marquee import report, roi_by_decile, roi_skipped, run, top_share, variants
from marquee.functions import (
    blank_to_null,
    capped_bucket,
    entities,
    entities_status,
    lead_by_pattern,
    lenient_date,
    lenient_double,
    lenient_long,
    names_by_pattern,
    one_line,
    parse_entities,
    period_of_date,
    period_of_year,
    prorate,
    read_records,
    status,
    year_of_text,
)
from marquee.operators.ranks import nearest_rank, values_at_ranks
from marquee.operators.running import running_total
from marquee.operators.tiles import tile_sums
from marquee.operators.topk import top_k_with_total
from marquee.plans.gems import gem_limits
from marquee.plans.ingest import as_declared, clean, ingest_to, split
from marquee.plans.shape import in_digits, with_decade
from marquee.schema import RAW_COLUMNS
from marquee.scratch import scratch_path, spread, written
from marquee.sources.catalog import create_database, register_table
from marquee.sources.files import read_csv, write_csv, write_result, write_titles
from marquee.sources.orders import keyed_titles, order_companies, order_credits, order_titles, table

MONEY = {"revenue": 2, "total": 2}
SHARES = {"top_share": 6, "pct_of_total": 6}


# --- the five analyses -----------------------------------------------------------------


def _shares(spark: SparkSession, folder: str, **options) -> DataFrame:
    titles = order_titles(spark, folder, parts=False)
    credits = order_credits(spark, folder, parts=False)
    return in_digits(top_share(titles, credits, **options), {**MONEY, **SHARES})


def top_share_full(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder)


def top_share_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder, output="summary")


def top_share_detail(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder, output="detail")


def top_share_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder, entity="name")


def top_share_yearly(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder, k=3, width=1)


def prorate_check(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of a title add up to its revenue."""
    credits = order_credits(spark, folder, parts=False)
    share = prorate(F.col("revenue"), F.col("n_companies"))
    sums = credits.groupBy("id").agg(
        F.max("n_companies").alias("n_companies"),
        F.sum(share).alias("shared"),
        F.max("revenue").alias("revenue"),
    )
    return in_digits(sums, {"shared": 2, "revenue": 2})


def _stored_titles(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The columns as a written table, for the analyses that read them several times."""
    parts = "budget" in columns
    return written(order_titles(spark, folder, parts).select("id", "release_date", *columns))


def _returns(spark: SparkSession, folder: str, **options) -> DataFrame:
    titles = _stored_titles(spark, folder, "budget", "revenue")
    return in_digits(roi_by_decile(titles, **options), {"avg_roi": 6})


def roi_ntile(spark: SparkSession, folder: str) -> DataFrame:
    return _returns(spark, folder)


def roi_ntile_yearly(spark: SparkSession, folder: str) -> DataFrame:
    return _returns(spark, folder, width=1)


def roi_cuts(spark: SparkSession, folder: str) -> DataFrame:
    return _returns(spark, folder, method="cuts", min_rows=20, densify=True)


def densify_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Budgets in a few round numbers, so that some deciles of every year are empty."""
    titles = _stored_titles(spark, folder, "budget", "revenue")
    coarse = titles.withColumn("budget", F.round("budget", -5) + 1)
    grid = roi_by_decile(coarse, method="cuts", densify=True, width=1)
    return in_digits(grid, {"avg_roi": 6})


def _average_year(spark: SparkSession, folder: str) -> int:
    """Orders with a budget per year, so that some years are below it and some above at any scale."""
    years = order_titles(spark, folder).where("budget > 0").groupBy(F.year("release_date")).count()
    return years.agg(F.ceil(F.avg("count"))).first()[0]


def roi_gated(spark: SparkSession, folder: str) -> DataFrame:
    return _returns(spark, folder, method="cuts", min_rows=_average_year(spark, folder), width=1)


def roi_skipped_years(spark: SparkSession, folder: str) -> DataFrame:
    return roi_skipped(order_titles(spark, folder), min_rows=_average_year(spark, folder), width=1)


DEBUT_DIGITS = {
    name: 6 for name in ("debut_roi", "post_roi", "debut_pop", "post_pop", "delta_roi", "delta_pop")
}


def _debuts(spark: SparkSession, folder: str, **options) -> DataFrame:
    compared = debut_effect(order_credits(spark, folder), **options)
    compared = compared.withColumn("debut_date", F.date_format("debut_date", "yyyy-MM-dd"))
    return in_digits(compared, DEBUT_DIGITS)


def debuts_top(spark: SparkSession, folder: str) -> DataFrame:
    return _debuts(spark, folder, entity="name", limit=200)


def debuts_first_twenty(spark: SparkSession, folder: str) -> DataFrame:
    """A list cut well before its end, where the order decides."""
    return _debuts(spark, folder, entity="name", limit=20)


def debuts_all(spark: SparkSession, folder: str) -> DataFrame:
    return _debuts(spark, folder, require_rest=False, empty_rest="zero")


def _gems(spark: SparkSession, folder: str, **options) -> DataFrame:
    columns = ("original_title", "vote_average", "popularity", "vote_count")
    return hidden_gems(_stored_titles(spark, folder, *columns), min_votes=2, **options)


def hidden_gems_eligible(spark: SparkSession, folder: str) -> DataFrame:
    return _gems(spark, folder, limit=500)


def hidden_gems_first_fifty(spark: SparkSession, folder: str) -> DataFrame:
    return _gems(spark, folder, limit=50)


def hidden_gems_all(spark: SparkSession, folder: str) -> DataFrame:
    return _gems(spark, folder, scope="all")


def hidden_gems_yearly(spark: SparkSession, folder: str) -> DataFrame:
    return _gems(spark, folder, width=1)


def hidden_gems_approx(spark: SparkSession, folder: str) -> DataFrame:
    return _gems(spark, folder, method="approx")


def _by_period(spark: SparkSession, folder: str, parts: bool = False) -> str:
    """The titles stored in folders by period."""
    path = scratch_path(spark)
    write_titles(order_titles(spark, folder, parts).withColumn("period", period_of_date(F.col("release_date"))), path)
    return path


def hidden_gems_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Each period read with its own thresholds."""
    stored = spark.read.parquet(_by_period(spark, folder))
    return hidden_gems(stored, min_votes=2, limit=500, stored_by_period=True)


def hidden_gems_rank_error(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the approximate thresholds lie within their rank error, per decade."""
    accuracy = 1000
    measured = with_decade(_stored_titles(spark, folder, "vote_average", "popularity", "vote_count")).select(
        "decade", F.col("vote_average").alias("va"), F.col("popularity").alias("pop")
    )
    limits = gem_limits(measured, "approx", 0.9, 0.1, accuracy)
    placed = measured.join(limits, "decade").groupBy("decade").agg(
        *[
            aggregate
            for value, limit in (("va", "_va"), ("pop", "_pop"))
            for aggregate in (
                F.count(value).alias(f"{value}_n"),
                F.count_if(F.col(value) < F.col(limit)).alias(f"{value}_below"),
                F.count_if(F.col(value) <= F.col(limit)).alias(f"{value}_up_to"),
            )
        ]
    )

    def within(value: str, share: float) -> Column:
        n, slack = F.col(f"{value}_n"), F.col(f"{value}_n") / accuracy + 1
        return (F.col(f"{value}_below") <= share * n + slack) & (F.col(f"{value}_up_to") >= share * n - slack)

    return placed.select(
        "decade", "va_n", "pop_n", within("va", 0.9).alias("va_within"), within("pop", 0.1).alias("pop_within")
    )


def stability(spark: SparkSession, folder: str) -> DataFrame:
    return in_digits(rating_stability(order_titles(spark, folder)), {"mean": 6, "std": 6})


def stability_count_zero(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a single line count as titles without votes."""
    titles = order_titles(spark, folder).withColumn("vote_count", F.col("vote_count") - 1)
    return in_digits(rating_stability(titles, zero_weight="count"), {"mean": 6, "std": 6})


# --- expressions -----------------------------------------------------------------------


def lenient_cast(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    text = (
        F.when(F.col("l_linenumber") % 6 == 0, "nan")
        .when(F.col("l_linenumber") % 6 == 1, F.concat(F.lit("  "), F.col("l_partkey"), F.lit(".0\t")))
        .when(F.col("l_linenumber") % 6 == 2, "n/a")
        .when(F.col("l_linenumber") % 6 == 3, F.concat(F.col("l_suppkey"), F.lit(".25")))
        .when(F.col("l_linenumber") % 6 == 4, "")
        .otherwise(F.concat(F.lit("-"), F.col("l_suppkey"), F.lit(".75")))
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("raw")).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (lenient_double(F.col("raw")) + F.lit(0.0)).alias("number"),
        lenient_long(F.col("raw")).alias("whole"),
        blank_to_null(F.col("raw")).alias("key"),
    )


def decade_period(spark: SparkSession, folder: str) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = lenient_date(F.col("text"))
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", text.alias("text"))
        .select(
            "o_orderkey",
            year_of_text(F.col("text")).alias("year"),
            period_of_year(year_of_text(F.col("text"))).alias("decade"),
            period_of_date(date, 7).alias("seven_years"),
            F.date_format(date, "yyyy-MM-dd").alias("iso_date"),
            F.substring("text", 1, 7).alias("month"),
        )
    )


def cap_bucket(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return (
        lines.select(capped_bucket(F.col("n")).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"))
    )


def text_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    plain = one_line(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.length(plain).alias("length"), F.md5(plain.cast("binary")).alias("digest")
    )


def trim_both(spark: SparkSession, folder: str) -> DataFrame:
    quoted = F.concat(F.lit("''"), F.col("p_name"), F.lit("'"))
    return table(spark, folder, "part").select("p_partkey", F.btrim(quoted, F.lit("'")).alias("name"))


def _list_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Customer and nation as a list text in one of four spellings."""
    customers, nations = table(spark, folder, "customer"), table(spark, folder, "nation")
    kind = F.col("c_custkey") % 4
    python = "[{'name': '%s', 'id': %s}, {'name': '%s', 'id': %s}]"
    form = (
        F.when(kind == 0, F.format_string(python, "c_name", "c_custkey", "n_name", "n_nationkey"))
        .when(kind == 1, F.format_string(python.replace("'", '"'), "c_name", "c_custkey", "n_name", "n_nationkey"))
        .when(kind == 2, F.format_string("[{'id': None, 'name': \"%s's\"}, {'name': '', 'id': 1},]", "c_name"))
        .otherwise(F.format_string("{'name': '%s', 'id': %s}", "c_name", "c_custkey"))
    )
    joined = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"])
    return joined.select("c_custkey", form.alias("text"))


def list_parse(spark: SparkSession, folder: str) -> DataFrame:
    texts = _list_texts(spark, folder).select(
        "c_custkey",
        parse_entities(F.col("text")).alias("named"),
        F.size(parse_entities(F.col("text"), named_only=False)).alias("n_records"),
    )
    return texts.select("c_custkey", "n_records", F.size("named").alias("n_named"), F.explode("named")).select(
        "c_custkey", "n_records", "n_named", F.col("col.id").alias("id"), F.col("col.name").alias("name")
    )


def list_status(spark: SparkSession, folder: str) -> DataFrame:
    return _list_texts(spark, folder).select("c_custkey", entities_status(F.col("text")).alias("status"))


def list_names_by_pattern(spark: SparkSession, folder: str) -> DataFrame:
    names = F.explode(names_by_pattern(F.col("text")))
    return _list_texts(spark, folder).select("c_custkey", names.alias("name"))


def lead_companies(spark: SparkSession, folder: str) -> DataFrame:
    return _list_texts(spark, folder).select("c_custkey", lead_by_pattern(F.col("text")).alias("lead"))


LINK = r'href="([^"]*)"'


def regex_extract_all(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(LINK), F.lit(0))
    inner = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    return table(spark, folder, "pages").select(
        "page_id",
        F.size(found).alias("n_links"),
        F.array_join(inner, " ").alias("links"),
        F.nullif(F.regexp_extract("html", LINK, 0), F.lit("")).alias("first_match"),
    )


def regex_replace(spark: SparkSession, folder: str) -> DataFrame:
    text = F.regexp_replace("html", "<[^>]*>", "")
    return table(spark, folder, "pages").select(
        "page_id", F.length(text).alias("length"), F.md5(text.cast("binary")).alias("digest")
    )


def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return (
        table(spark, folder, "events")
        .select("event_type", k.alias("k"))
        .groupBy("event_type", "k")
        .agg(F.count("*").alias("n"))
    )


def union_all(spark: SparkSession, folder: str) -> DataFrame:
    """Both name lists under each other, and how often a key is in either."""
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"))
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"))
    both = suppliers.withColumn("supplied", F.lit(1)).unionByName(
        customers.withColumn("supplied", F.lit(0))
    )
    return both.groupBy("nation").agg(F.count("*").alias("n"), F.sum("supplied").alias("n_suppliers"))


def key_union(spark: SparkSession, folder: str) -> DataFrame:
    years = F.year("o_orderdate").alias("year")
    shipped = F.year("l_shipdate").alias("year")
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return orders.select(years).distinct().union(lines.select(shipped).distinct()).distinct()


def top_n_global(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
        .limit(200)
    )


def profile_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return profile(order_titles(spark, folder)).drop("type")


def load_check_titles(spark: SparkSession, folder: str) -> DataFrame:
    checked = load_check(order_titles(spark, folder, parts=False))
    return checked.select(
        "total", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_date", "last_date")]
    )


def load_check_footers(spark: SparkSession, folder: str) -> DataFrame:
    """The same of a stored table, from the footers of its files."""
    checked = load_check_stored(spark, _by_period(spark, folder))
    return checked.select(
        "total", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_date", "last_date")]
    )


def _overview(spark: SparkSession, folder: str, **options) -> DataFrame:
    titles, credits = order_titles(spark, folder), order_credits(spark, folder, parts=False)
    return in_digits(period_overview(titles, credits, **options), {**MONEY, **SHARES})


def overview_by_decade(spark: SparkSession, folder: str) -> DataFrame:
    return _overview(spark, folder, min_votes=2)


def overview_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return _overview(spark, folder, k=3, min_votes=7, width=1)


def running_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of a flag were shipped up to each day."""
    days = (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
        .agg(F.count("*").alias("n"))
    )
    return running_total(days, ["l_returnflag"], ["day"], "n")


def tiles_of_tied_values(spark: SparkSession, folder: str) -> DataFrame:
    """Deciles by quantity, of which there are few, so most ends fall into ties."""
    lines = table(spark, folder, "lineitem")
    order = ["l_orderkey", "l_linenumber"]
    sums = tile_sums(lines, ["l_returnflag"], "l_quantity", order, "l_extendedprice")
    return in_digits(sums, {"total": 2})


def decile_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """The nine cut points of the order totals per year."""
    totals = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("total")
    )
    ranks = {i / 10: nearest_rank(i / 10) for i in range(1, 10)}
    return values_at_ranks(totals, ["year"], "total", ranks)


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, commas and line ends through a CSV file and back."""
    path = scratch_path(spark)
    write_csv(table(spark, folder, "documents"), path)
    back = read_csv(spark, path, ["doc_id", "text", "lang", "source", "n_chars", "missing"])
    return back.select(
        lenient_long(F.col("doc_id"), None).alias("doc_id"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
        "lang",
        "source",
        lenient_long(F.col("n_chars"), None).alias("n_chars"),
        F.col("missing").isNull().alias("missing"),
    )


def ingest_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Order titles spelled as raw text, stored through the ingest and read back."""
    odd = F.col("vote_count") % 2 == 1
    raw = order_titles(spark, folder).select(
        F.concat(F.lit(" "), F.col("id"), F.lit("\t")).alias("id"),
        "original_title",
        F.when(odd, F.date_format("release_date", "yyyy-MM-dd")).otherwise("soon").alias("release_date"),
        F.when(odd, F.col("budget").cast("string")).otherwise("/poster.jpg").alias("budget"),
        F.col("revenue").cast("string").alias("revenue"),
        F.coalesce(F.col("popularity").cast("string"), F.lit("nan")).alias("popularity"),
        F.col("vote_average").cast("string").alias("vote_average"),
        F.concat(F.col("vote_count").cast("string"), F.lit(".0")).alias("vote_count"),
        F.when(odd, "[{'name': 'A\\'s', 'id': 7}, {'name': '', 'id': None}]")
        .otherwise("[{'name': 'cut off")
        .alias("production_companies"),
        F.when(odd, '[{"id": 1}, {"id": 2}]').otherwise("False").alias("genres"),
    )
    path = scratch_path(spark)
    write_titles(clean(raw), path)
    titles, quarantine = split(spark.read.parquet(path))
    failed = quarantine.groupBy("id").agg(F.count("*").alias("n_unreadable"))
    return titles.join(failed, "id", "left").select(
        "id",
        F.date_format("release_date", "yyyy-MM-dd").alias("day"),
        "period",
        "budget",
        "revenue",
        "popularity",
        "vote_average",
        "vote_count",
        F.array_join("companies.name", ",").alias("companies"),
        F.size("genres").alias("n_genres"),
        F.coalesce("n_unreadable", F.lit(0)).alias("n_unreadable"),
    )


def csv_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one folder with their columns in different orders, one of them lacking a column."""
    path = scratch_path(spark)
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    write_csv(rows.where("c_custkey % 3 = 0"), path)
    write_csv(rows.where("c_custkey % 3 = 1").select("c_name", "c_acctbal", "c_custkey"), path, "append")
    write_csv(rows.where("c_custkey % 3 = 2").select("c_acctbal", "c_custkey"), path, "append")
    back = read_csv(spark, path, ["c_custkey", "c_name", "c_acctbal"])
    return back.select(
        lenient_long(F.col("c_custkey"), None).alias("c_custkey"),
        "c_name",
        lenient_double(F.col("c_acctbal")).alias("c_acctbal"),
    )


def csv_to_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Raw CSV whose overviews hold quotes and line ends, through the ingest to an analysis."""
    named = _filled("{'name': '%s', 'id': %s}", F.col("company"), F.col("company_id"))
    lists = order_companies(spark, folder).groupBy("o_orderkey").agg(F.array_join(F.collect_list(named), ", ").alias("_list"))
    raw = keyed_titles(spark, folder, parts=False).join(lists, "o_orderkey", "left").select(
        F.concat(F.lit('He said: "'), F.col("id"), F.lit('",\nand left.\n')).alias("overview"),
        "id",
        "original_title",
        F.date_format("release_date", "yyyy-MM-dd").alias("release_date"),
        F.lit("").alias("budget"),
        F.col("revenue").cast("string").alias("revenue"),
        *[F.col(c).cast("string").alias(c) for c in ("popularity", "vote_average", "vote_count")],
        F.concat(F.lit("["), F.coalesce("_list", F.lit("")), F.lit("]")).alias("production_companies"),
        F.lit("[]").alias("genres"),
    )
    path = scratch_path(spark)
    write_csv(raw, f"{path}/raw")
    stored, _ = ingest_to(spark, f"{path}/raw", f"{path}/titles")
    return in_digits(top_share(stored), {**MONEY, **SHARES})


def amounts_of_any_size(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts between 10^-16 and 10^306 in one ranking, each of them in the total."""
    size = F.col("company_id") % 4
    scale = F.when(size == 0, 1e-20).when(size == 1, 1.0).when(size == 2, 2e20).otherwise(1e290)
    parts = with_decade(order_credits(spark, folder, parts=False)).select(
        "decade", "company_id", (F.col("revenue") / F.col("n_companies") * scale).alias("amount")
    )
    found = top_k_with_total(parts.select("decade", "amount"), parts, "decade", ["company_id"], "amount", 1_000_000)
    return found.select(
        "decade", "rank", "company_id", *[F.format_string("%.9e", name).alias(name) for name in ("amount", "total")]
    )


def list_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Names in all spellings that a literal of the source language may have."""
    forms = [
        "[{'name': u'%s', 'id': 1}]",
        "[{'name': '''%s''', 'id': 1}]",
        "[{'name': '%s' \"\" u'', 'id': 1}]",
        "[{'name': '%s', 'id': 1}, (1, 2)]",
        "[{'name': '%s', 'id': 1}, None]",
        "[{'name': '%s', 'id': 1,}]",
        "[{'name': '\\U00000041\\N{LATIN SMALL LETTER B}%s', 'id': 1}]",
        "[{'name': '%s', 'id': 1_000}]",
        "[{'name': b'%s', 'id': 1}]",
        "({'name': '%s', 'id': 1},)",
    ]
    kind, text = F.col("c_custkey") % len(forms), F.lit(None)
    for i, form in enumerate(forms):
        text = F.when(kind == i, F.format_string(form, "c_name")).otherwise(text)
    # Spelt and parsed by all tasks, however few splits the file has; each text is parsed once.
    names = spread(table(spark, folder, "customer").select("c_custkey", "c_name"))
    texts = names.select("c_custkey", text.alias("text"))
    read = texts.withColumn("records", read_records(F.col("text")))
    found = read.select(
        "c_custkey", F.get(entities(F.col("records")), F.lit(0)).alias("named"), status(F.col("text"), F.col("records")).alias("status")
    )
    return found.select("c_custkey", F.col("named.id").alias("id"), F.col("named.name").alias("name"), "status")


def mixed_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Date texts with a time of day, or with a year alone, keep their period."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, day)
        .when(kind == 1, F.concat(day, F.lit(" 00:00:00")))
        .when(kind == 2, F.concat(day, F.lit("T10:00:00Z")))
        .when(kind == 3, F.left(day, F.lit(4)))
        .otherwise("soon")
    )
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        text.alias("release_date"),
        *[F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS if c not in ("id", "release_date")],
    )
    return clean(raw).select("id", F.date_format("release_date", "yyyy-MM-dd").alias("day"), "period")


def top_share_tiny(spark: SparkSession, folder: str) -> DataFrame:
    """Revenues far below a cent are ranked like any others."""
    titles, credits = order_titles(spark, folder, parts=False), order_credits(spark, folder, parts=False)
    titles, credits = (f.withColumn("revenue", F.round(F.col("revenue") / 1e8, 10)) for f in (titles, credits))
    return in_digits(top_share(titles, credits, output="detail").drop("pct_of_total"), {"revenue": 9})


def top_share_without_nan(spark: SparkSession, folder: str) -> DataFrame:
    """A revenue that isn't a number counts as none."""
    odd = F.when(F.col("id").cast("bigint") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("revenue"))
    titles, credits = order_titles(spark, folder, parts=False), order_credits(spark, folder, parts=False)
    shares = top_share(titles.withColumn("revenue", odd), credits.withColumn("revenue", odd))
    return in_digits(shares, {**MONEY, **SHARES})


def text_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Companies of one name with different ids, some of which aren't whole numbers."""
    text = F.format_string("[{'name': 'Nation %s', 'id': 'N%s'}, {'name': 'Same', 'id': %s}]", "s_nationkey", "s_nationkey", "s_suppkey")
    same = F.format_string("[{'name': 'Same', 'id': 'N%s'}]", "s_nationkey")
    titles = table(spark, folder, "supplier").select(
        F.lit(1990).alias("period"),
        (F.abs("s_acctbal") * 2).alias("revenue"),
        parse_entities(F.when(F.col("s_suppkey") % 2 == 0, text).otherwise(same)).alias("companies"),
    )
    return in_digits(top_share(titles, k=10, output="detail").drop("pct_of_total"), {"revenue": 2})


# --- from raw list texts to the named analyses ------------------------------------------


def _shifted_date(day: Column) -> Column:
    """Some orders lie far ahead and some long ago, so that there are odd decades."""
    kind = F.col("id").cast("bigint") % 50
    return F.when(kind == 0, F.add_months(day, 2400)).when(kind == 1, F.add_months(day, -480)).otherwise(day)


def _filled(form: str, *values: Column) -> Column:
    """``format_string`` with ``%s`` alone, at a fraction of its cost."""
    first, *rest = form.split("%s")
    texts = [F.coalesce(value.cast("string"), F.lit("null")) for value in values]
    return F.concat(F.lit(first), *[part for text, after in zip(texts, rest) for part in (text, F.lit(after))])


_catalogues: dict[tuple[str, str], str] = {}


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Titles stored through the ingest from texts; the oldest ones list no company.

    Companies and genres are texts in the Python or the JSON spelling, dates have a time of day
    now and then. The ingest is done once in a session, in ``_catalogues`` is where.
    """
    key = (spark.sparkContext.applicationId, str(folder))
    if key in _catalogues:
        return spark.read.parquet(_catalogues[key])
    odd = F.col("id").cast("bigint") % 2 == 1
    # Everything is grouped and joined by the order's key, so each row is shuffled once.
    titles = keyed_titles(spark, folder, types=True)
    companies = (
        order_companies(spark, folder)
        .groupBy(F.col("o_orderkey").alias("_key"))
        .agg(F.sort_array(F.collect_set(F.struct("company_id", "company"))).alias("own"))
    )

    def spelt(python: Column, json: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.when(odd, python).otherwise(json), ", "), F.lit("]"))

    own = spelt(
        F.transform("own", lambda c: _filled("{'name': '%s', 'id': %s}", c["company"], c["company_id"])),
        F.transform("own", lambda c: _filled('{"name": "%s", "id": %s}', c["company"], c["company_id"])),
    )
    types = F.sort_array("types")
    genres = spelt(
        F.transform(types, lambda t, i: _filled("{'id': %s, 'name': '%s'}", i, t)),
        F.transform(types, lambda t, i: _filled('{"id": %s, "name": "%s"}', i, t)),
    )
    day = F.date_format(_shifted_date(F.col("release_date")), "yyyy-MM-dd")
    raw = titles.join(companies, titles["o_orderkey"] == companies["_key"], "left").select(
        "id",
        "original_title",
        F.when(odd, day).otherwise(F.concat(day, F.lit(" 12:00:00"))).alias("release_date"),
        *[F.col(c).cast("string").alias(c) for c in ("budget", "revenue", "popularity", "vote_average", "vote_count")],
        F.when(F.col("id").cast("bigint") % 50 == 1, "[]").otherwise(own).alias("production_companies"),
        genres.alias("genres"),
    )
    path = scratch_path(spark)
    write_titles(clean(raw).drop("unreadable"), path)
    _catalogues[key] = path
    return spark.read.parquet(path)


def _run_digits(frame: DataFrame) -> DataFrame:
    days = {c: F.date_format(c, "yyyy-MM-dd") for c, kind in frame.dtypes if kind == "date"}
    return in_digits(frame.withColumns(days), {c: 6 for c, kind in frame.dtypes if kind == "double"})


def _run_named(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _run_digits(run(name, _catalogue(spark, folder), min_votes="2"))

    query.__name__ = f"run_{name}"
    query.__doc__ = f"``{name}`` over titles ingested from list texts."
    return query


# --- files and catalogue ----------------------------------------------------------------


def result_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """A result written as Parquet, CSV and JSON and read back."""
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("date").alias("none"))
    back = []
    for form in ("parquet", "csv", "json"):
        path = scratch_path(spark)
        write_result(rows, path, form)
        read = read_csv(spark, path) if form == "csv" else spark.read.format(form).load(path)
        none = F.coalesce(F.col("none").cast("string"), F.lit("")) if "none" in read.columns else F.lit("")
        back.append(read.select(F.lit(form).alias("form"), F.col("s_suppkey").cast("bigint"), "s_name", none.alias("none")))
    return back[0].unionByName(back[1]).unionByName(back[2])


def registered_table(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned titles as an external table of declared types."""
    path = scratch_path(spark) + "/titles of 'orders'"
    as_declared(_catalogue(spark, folder)).write.parquet(path)
    name = "titles_" + path.split("/")[-2]
    create_database(spark, "marquee_check")
    loaded = register_table(spark, f"marquee_check.{name}", path)
    return loaded.select(
        "id", "release_date", "revenue", F.get_json_object("production_companies", "$[0].name").alias("first_company")
    )


def type_listing(spark: SparkSession, folder: str) -> DataFrame:
    return profile(order_titles(spark, folder)).select("column", "type")


def report_text_returns(spark: SparkSession, folder: str) -> DataFrame:
    return report("roi", written(order_titles(spark, folder)))


def report_text_debuts(spark: SparkSession, folder: str) -> DataFrame:
    return report("debut", order_titles(spark, folder), order_credits(spark, folder))


def report_text_gems(spark: SparkSession, folder: str) -> DataFrame:
    return report("hg", written(order_titles(spark, folder, False)), min_votes=2)


def _report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    parts = name in ("debut", "roi")
    titles = order_titles(spark, folder, parts)
    if name == "hg":
        titles = written(titles)
    return run(name, titles, order_credits(spark, folder, parts), min_votes="2")


def report_concentration(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, "mc_summary")


def report_companies(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, "mc_detail")


def report_debuts(spark: SparkSession, folder: str) -> DataFrame:
    report = _report(spark, folder, "debut")
    return report.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def report_gems(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, "hg")


def report_text(spark: SparkSession, folder: str) -> DataFrame:
    return report("stab", order_titles(spark, folder))


def report_text_concentration(spark: SparkSession, folder: str) -> DataFrame:
    return report("mc", order_titles(spark, folder, False), order_credits(spark, folder, False))


_QUERIES = [
    top_share_full,
    top_share_summary,
    top_share_detail,
    top_share_by_name,
    top_share_yearly,
    prorate_check,
    roi_ntile,
    roi_ntile_yearly,
    roi_cuts,
    densify_grid,
    roi_gated,
    roi_skipped_years,
    debuts_top,
    debuts_all,
    hidden_gems_eligible,
    hidden_gems_all,
    hidden_gems_yearly,
    hidden_gems_approx,
    stability,
    stability_count_zero,
    lenient_cast,
    decade_period,
    cap_bucket,
    text_sanitise,
    trim_both,
    list_parse,
    list_status,
    list_names_by_pattern,
    regex_extract_all,
    regex_replace,
    json_extract,
    union_all,
    key_union,
    top_n_global,
    profile_nulls,
    load_check_titles,
    running_counts,
    tiles_of_tied_values,
    decile_cuts,
    csv_round_trip,
    ingest_titles,
    report_concentration,
    report_companies,
    report_debuts,
    report_gems,
    report_text,
    report_text_concentration,
    report_text_returns,
    report_text_debuts,
    report_text_gems,
    debuts_first_twenty,
    hidden_gems_first_fifty,
    hidden_gems_rank_error,
    csv_layouts,
    csv_to_shares,
    amounts_of_any_size,
    list_literals,
    mixed_dates,
    top_share_tiny,
    top_share_without_nan,
    text_ids,
    result_sinks,
    registered_table,
    type_listing,
    hidden_gems_by_period,
    load_check_footers,
    lead_companies,
    overview_by_decade,
    overview_by_year,
    *map(_run_named, variants()),
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: market concentration per decade."""
    return top_share_full(spark, "/root/testdata/sf0.001")


def _training_text() -> list:
    """The module with the training text queries and the corpus pipeline, as far as they are there."""
    found = []
    for name in ("marquee.llm.queries", "corpus_pipeline"):
        try:
            found.append(importlib.import_module(name))
        except ModuleNotFoundError as missing:
            if missing.name not in ("marquee.llm", name):
                raise
            return found
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {query.__name__: query for query in _QUERIES}
    for module in _training_text():
        every |= module.queries()
    return every


# --- the same in SQL -------------------------------------------------------------------

_TITLES = """
titles AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         'Order ' || CAST(o_orderkey AS VARCHAR) AS original_title,
         CAST(o_orderdate AS DATE) AS release_date,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(year(o_orderdate) - year(o_orderdate) % 10 AS INTEGER) AS decade,
         o_totalprice AS revenue, popularity, vote_average, vote_count, budget, n_genres,
         CASE WHEN budget > 0 THEN (o_totalprice - budget) / budget END AS roi
  FROM orders LEFT JOIN (
    SELECT l_orderkey,
           CAST(sum(CAST(l_quantity AS DECIMAL(12,2)) * CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS budget,
           sum(l_quantity) AS popularity,
           floor(10e0 * CAST(sum(CAST(round(100 * l_discount) AS INTEGER)) AS BIGINT) / count(*)) / 10e0 AS vote_average,
           count(*) AS vote_count,
           count(DISTINCT p_type) AS n_genres
    FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""

_CREDITS = """
credits AS (
  SELECT t.*, s_suppkey AS company_id, s_name AS company,
         count(*) OVER (PARTITION BY t.id) AS n_companies
  FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, l_suppkey FROM lineitem)
  JOIN titles t USING (id) JOIN supplier ON s_suppkey = l_suppkey
)"""


def _sql_shares(period: str, entity: str, k: int, columns: str, where: str) -> str:
    return f"""
    WITH {_TITLES}, {_CREDITS},
    totals AS (
      SELECT {period} AS decade, sum(revenue) AS total FROM titles WHERE revenue > 0 GROUP BY 1),
    summed AS (
      SELECT {period} AS decade, {entity}, sum(revenue / n_companies) AS revenue
      FROM credits WHERE revenue > 0 GROUP BY ALL),
    ranked AS (
      SELECT *, row_number() OVER (
        PARTITION BY decade ORDER BY round(revenue, 2) DESC, company, {entity}) AS rank
      FROM summed),
    top AS (
      SELECT *, sum(revenue) OVER (PARTITION BY decade) AS top
      FROM ranked WHERE rank <= {k})
    SELECT {columns} FROM totals LEFT JOIN top USING (decade) WHERE {where}"""


_SHARE = "round(coalesce(top, 0e0) / total, 6) AS top_share"
_DETAIL = "CAST(rank AS INTEGER) AS rank, {e}, round(revenue, 2) AS revenue, round(revenue / total, 6) AS pct_of_total"
_BY_ID = _DETAIL.format(e="company_id, company")
_BY_NAME = _DETAIL.format(e="company")


_LINES = """
  rank, printf('%d%sTOP5|%.4f|TOTAL|%.2f', decade, chr(9), round(top / total * 100, 4), round(total, 2)) AS summary,
  printf('%d|TOP%d%s%d|%s|%.2f|%.4f', decade, rank, chr(9), company_id, company,
         round(revenue, 2), round(revenue / total * 100, 4)) AS detail"""


def _sql_ntile(period: str) -> str:
    return f"""
    WITH {_TITLES}, tiled AS (
      SELECT {period} AS decade, roi, ntile(10) OVER (PARTITION BY {period} ORDER BY budget, id) AS bud_decile
      FROM titles WHERE budget > 0)
    SELECT decade, CAST(bud_decile AS INTEGER) AS bud_decile, round(avg(roi), 6) AS avg_roi, count(*) AS n
    FROM tiled GROUP BY 1, 2"""


def _sql_cuts(period: str, budget: str = "budget", least: int = 1, densify: bool = False) -> str:
    result = "SELECT decade, bud_decile, round(avg(roi), 6) AS avg_roi, count(*) AS n FROM banded GROUP BY 1, 2"
    if densify:
        result = f"""
        SELECT decade, CAST(tile AS INTEGER) AS bud_decile, coalesce(avg_roi, 0e0) AS avg_roi, coalesce(n, 0) AS n
        FROM (SELECT decade, unnest(range(1, 11)) AS tile FROM sizes WHERE n_budgets >= {least}) s
        LEFT JOIN ({result}) r ON r.decade = s.decade AND r.bud_decile = s.tile"""
        result = result.replace("SELECT decade, CAST", "SELECT s.decade, CAST")
    return f"""
    WITH {_TITLES},
    base AS (
      SELECT {period} AS decade, revenue, budget, (revenue - budget) / budget AS roi
      FROM (SELECT * REPLACE ({budget} AS budget) FROM titles) WHERE budget > 0),
    sizes AS (SELECT decade, count(*) AS n_budgets FROM base GROUP BY 1),
    placed AS (
      SELECT decade, budget, row_number() OVER (PARTITION BY decade ORDER BY budget) AS place,
             count(*) OVER (PARTITION BY decade) AS n FROM base),
    cuts AS (
      SELECT decade, budget AS cut
      FROM placed, (SELECT unnest(range(10, 100, 10)) AS p)
      WHERE place = greatest(1, CAST(ceil(p / 100e0 * n) AS BIGINT))),
    arrays AS (SELECT decade, list(cut) AS cuts FROM cuts GROUP BY 1),
    banded AS (
      SELECT decade, roi,
             CAST(1 + len(list_filter(cuts, lambda c: c <= budget)) AS INTEGER) AS bud_decile
      FROM base JOIN arrays USING (decade) JOIN sizes USING (decade) WHERE n_budgets >= {least})
    {result}"""


def _sql_debuts(entity: str, rest: str, where: str, limit: str) -> str:
    return f"""
    WITH {_TITLES}, {_CREDITS},
    placed AS (
      SELECT {entity}, release_date, roi, popularity AS pop,
             row_number() OVER (PARTITION BY {entity} ORDER BY release_date, id) AS place
      FROM credits),
    compared AS (
      SELECT {entity},
             strftime(min(release_date), '%Y-%m-%d') AS debut_date,
             max(roi) FILTER (place = 1) AS debut_roi,
             {rest.format("avg(roi) FILTER (place > 1)")} AS post_roi,
             max(pop) FILTER (place = 1) AS debut_pop,
             {rest.format("avg(pop) FILTER (place > 1)")} AS post_pop,
             count(*) FILTER (place = 1) AS n_debuts,
             count(*) FILTER (place > 1) AS n_post
      FROM placed GROUP BY ALL)
    SELECT {entity}, debut_date, round(debut_roi, 6) AS debut_roi, round(post_roi, 6) AS post_roi,
           round(debut_pop, 6) AS debut_pop, round(post_pop, 6) AS post_pop, n_debuts, n_post,
           round(debut_roi - post_roi, 6) AS delta_roi, round(debut_pop - post_pop, 6) AS delta_pop
    FROM compared WHERE debut_roi IS NOT NULL AND {where}
    ORDER BY round(debut_roi - post_roi, 6) DESC NULLS LAST, company {limit}"""


def _sql_gems(period: str, measured: str, limit: str) -> str:
    return f"""
    WITH {_TITLES},
    base AS (
      SELECT {period} AS decade, id, original_title, vote_average AS va, popularity AS pop, vote_count AS vc
      FROM titles),
    measured AS (SELECT * FROM base WHERE {measured}),
    va AS (
      SELECT decade, va, row_number() OVER (PARTITION BY decade ORDER BY va) AS place,
             count(*) OVER (PARTITION BY decade) AS n FROM measured WHERE va IS NOT NULL),
    pop AS (
      SELECT decade, pop, row_number() OVER (PARTITION BY decade ORDER BY pop) AS place,
             count(*) OVER (PARTITION BY decade) AS n FROM measured WHERE pop IS NOT NULL),
    high AS (SELECT decade, va AS high FROM va WHERE place = greatest(1, CAST(ceil(0.9e0 * n) AS BIGINT))),
    low AS (SELECT decade, pop AS low FROM pop WHERE place = greatest(1, CAST(ceil(0.1e0 * n) AS BIGINT)))
    SELECT decade, id, original_title, va, pop, vc
    FROM base JOIN high USING (decade) JOIN low USING (decade)
    WHERE vc >= 2 AND va >= high AND pop <= low
    ORDER BY decade, va DESC, pop, id {limit}"""


def _sql_overview(period: str, k: int, min_votes: int) -> str:
    shares = _sql_shares(
        period, "company_id, company", k, f"decade, {_SHARE}, round(total, 2) AS total", "rank = 1 OR rank IS NULL"
    )
    return f"""
    WITH {_TITLES},
    shares AS ({shares}),
    sizes AS (
      SELECT {period} AS decade, count(revenue) AS n_movies, count(*) AS n_budgets FROM titles WHERE budget > 0 GROUP BY 1),
    rated AS (
      SELECT {period} AS decade, count(*) AS n_rated FROM titles
      WHERE vote_average IS NOT NULL AND vote_count >= {min_votes} GROUP BY 1),
    spine AS (SELECT decade FROM shares UNION SELECT decade FROM sizes UNION SELECT decade FROM rated)
    SELECT decade, coalesce(total, 0e0) AS total, coalesce(top_share, 0e0) AS top_share,
           coalesce(n_movies, 0) AS n_movies, coalesce(n_budgets, 0) AS n_budgets, coalesce(n_rated, 0) AS n_rated
    FROM spine LEFT JOIN shares USING (decade) LEFT JOIN sizes USING (decade) LEFT JOIN rated USING (decade)"""


def _sql_cell_gems(accuracy: int) -> str:
    """Thresholds by counts of logarithmic cells."""

    def limit(value: str, share: str) -> str:
        cell = f"CASE WHEN {value} > 0 THEN floor(log2({value}) * {accuracy}) ELSE -1e9 END"
        return f"""
    {value}_cells AS (
      SELECT decade, {cell} AS cell, count(*) AS n, min({value}) AS low FROM measured GROUP BY ALL),
    {value}_limit AS (
      SELECT decade, min(low) AS {value}_limit
      FROM (SELECT decade, low, sum(n) OVER (PARTITION BY decade ORDER BY cell) AS up_to,
                   greatest(1, ceil({share} * sum(n) OVER (PARTITION BY decade))) AS wanted FROM {value}_cells)
      WHERE up_to >= wanted GROUP BY decade)"""

    return f"""
    WITH {_TITLES},
    measured AS (
      SELECT decade, id, original_title, vote_average AS va, popularity AS pop, vote_count AS vc
      FROM titles WHERE vote_average IS NOT NULL AND popularity IS NOT NULL AND vote_count >= 2),
    {limit("va", "0.9e0")}, {limit("pop", "0.1e0")}
    SELECT decade, id, original_title, va, pop, vc
    FROM measured JOIN va_limit USING (decade) JOIN pop_limit USING (decade)
    WHERE va >= va_limit AND pop <= pop_limit"""


def _sql_stability(weight: str, where: str) -> str:
    return f"""
    WITH {_TITLES},
    rated AS (
      SELECT decade, CASE WHEN n_genres >= 3 THEN '3+' ELSE CAST(n_genres AS VARCHAR) END AS bucket,
             vote_average AS x, {weight} AS w
      FROM titles WHERE n_genres >= 1 AND vote_average IS NOT NULL),
    sums AS (
      SELECT decade, bucket, CAST(sum(w) AS DOUBLE) AS w, sum(w * x) AS wx, sum(w * x * x) AS wxx, count(*) AS n
      FROM rated WHERE {where} GROUP BY 1, 2)
    SELECT decade, bucket, round(wx / w, 6) AS mean,
           round(sqrt(greatest(wxx / w - (wx / w) * (wx / w), 0e0)), 6) AS std, n
    FROM sums WHERE w > 0"""


_TEXTS = """
texts AS (
  SELECT c_custkey, c_name, n_name, n_nationkey, c_custkey % 4 AS kind
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


_AVERAGE_YEAR = """
    SELECT CAST(ceil(avg(n)) AS INTEGER)
    FROM (SELECT count(*) AS n FROM titles WHERE budget > 0 GROUP BY year)"""

# The catalogue of ``_catalogue``: titles at other dates, of which the oldest have no credits.
_SHIFTED = """
  date_add(CAST(o_orderdate AS DATE), CASE o_orderkey % 50 WHEN 0 THEN INTERVAL 200 YEAR
           WHEN 1 THEN INTERVAL (-40) YEAR ELSE INTERVAL 0 YEAR END)"""


def _moved(sql: str) -> str:
    """The same question over the catalogue made from texts."""
    sql = sql.replace("CAST(o_orderdate AS DATE) AS release_date", f"CAST({_SHIFTED} AS DATE) AS release_date")
    sql = sql.replace("year(o_orderdate)", f"year({_SHIFTED})")
    return sql.replace("FROM lineitem)\n  JOIN titles", "FROM lineitem WHERE l_orderkey % 50 <> 1)\n  JOIN titles")


def _run_sql() -> dict[str, str]:
    by_id, by_name = "company_id, company", "company"
    ranked, first = "rank IS NOT NULL", "rank = 1 OR rank IS NULL"
    gems = "va IS NOT NULL AND pop IS NOT NULL AND vc >= 2 AND decade BETWEEN 1870 AND 2100"
    share = "round(coalesce(top, 0e0) / total, 6)"
    money, part = "round(revenue, 6) AS revenue", "round(revenue / total, 6) AS pct_of_total"
    place = "CAST(rank AS INTEGER) AS rank"
    debuts = _sql_debuts(by_id, "coalesce({}, 0e0)", "true", "")
    stable = _sql_stability
    found = {
        "q1": _sql_shares(
            "decade", by_name, 5, f"decade, {share} AS top5_share, {place}, company, {money}, {part}", ranked
        ),
        "q1_general": _sql_shares("decade", by_name, 5, f"decade, {share} AS top5_share", f"rank = 1 AND {share} > 0"),
        "q1_detalle": _sql_shares("decade", by_name, 5, f"decade, {place}, company, {money}, {part}", ranked),
        "q2": _sql_ntile("decade"),
        "q3": _sql_debuts(by_name, "{}", "n_post >= 1", "LIMIT 200"),
        "q4": _sql_gems("decade", gems, "LIMIT 500").replace("WHERE vc >= 2", f"WHERE {gems}"),
        "q5": f"SELECT decade, bucket, mean AS mean_va, std AS sd_va, n FROM ({stable('vote_count', 'true')})",
        "mc_summary": _sql_shares(
            "decade",
            by_id,
            5,
            "decade, round(coalesce(top, 0e0) / total * 100, 4) AS top5_pct, round(total, 2) AS total",
            first,
        ),
        "mc_detail": _sql_shares(
            "decade",
            by_id,
            5,
            f"decade, {place}, company_id AS cid, company AS name, round(revenue, 2) AS revenue, "
            "round(revenue / total * 100, 4) AS pct",
            ranked,
        ),
        "roi": f"SELECT decade, bud_decile AS decile, avg_roi, n FROM ({_sql_cuts('decade', least=20, densify=True)})",
        "debut": f"""
            SELECT company_id AS cid, company AS name, debut_date AS date, debut_roi, debut_pop,
                   post_roi, post_pop, n_post, delta_roi, delta_pop FROM ({debuts})""",
        "hg": f"""
            SELECT decade, id, original_title AS title, round(va, 3) AS va, round(pop, 3) AS pop, vc AS votes
            FROM ({_sql_gems("decade", "true", "")})""",
        "stab": stable("vote_count", "w > 0"),
    }
    return {f"run_{name}": _moved(sql) for name, sql in found.items()}


def _own_sql() -> dict[str, str]:
    stable = _sql_stability("vote_count", "w > 0")
    return {
        "top_share_full": _sql_shares(
            "decade", "company_id, company", 5, f"decade, {_SHARE}, {_BY_ID}", "rank IS NOT NULL"
        ),
        "top_share_summary": _sql_shares(
            "decade",
            "company_id, company",
            5,
            f"decade, {_SHARE}, round(total, 2) AS total",
            "rank = 1 OR rank IS NULL",
        ),
        "top_share_detail": _sql_shares(
            "decade", "company_id, company", 5, f"decade, {_BY_ID}", "rank IS NOT NULL"
        ),
        "top_share_by_name": _sql_shares(
            "decade", "company", 5, f"decade, {_SHARE}, {_BY_NAME}", "rank IS NOT NULL"
        ),
        "top_share_yearly": _sql_shares(
            "year", "company_id, company", 3, f"decade, {_SHARE}, {_BY_ID}", "rank IS NOT NULL"
        ),
        "prorate_check": f"""
            WITH {_TITLES}, {_CREDITS}
            SELECT id, max(n_companies) AS n_companies, round(sum(revenue / n_companies), 2) AS shared,
                   round(max(revenue), 2) AS revenue
            FROM credits GROUP BY id""",
        "roi_ntile": _sql_ntile("decade"),
        "roi_ntile_yearly": _sql_ntile("year"),
        "roi_cuts": _sql_cuts("decade", least=20, densify=True),
        "densify_grid": _sql_cuts("year", budget="round(budget, -5) + 1", densify=True),
        "roi_gated": _sql_cuts("year", least=f"({_AVERAGE_YEAR})"),
        "roi_skipped_years": f"""
            WITH {_TITLES}
            SELECT year AS decade, count(revenue) AS n_movies, count(*) AS n_budgets,
                   gate AS min_movies, gate AS min_budgets
            FROM titles, (SELECT ({_AVERAGE_YEAR}) AS gate) WHERE budget > 0 GROUP BY year, gate
            HAVING count(revenue) < gate OR count(*) < gate""",
        "debuts_top": _sql_debuts("company", "{}", "n_post >= 1", "LIMIT 200"),
        "debuts_all": _sql_debuts("company_id, company", "coalesce({}, 0e0)", "true", ""),
        "hidden_gems_eligible": _sql_gems(
            "decade", "va IS NOT NULL AND pop IS NOT NULL AND vc >= 2", "LIMIT 500"
        ),
        "hidden_gems_by_period": _sql_gems(
            "decade", "va IS NOT NULL AND pop IS NOT NULL AND vc >= 2", "LIMIT 500"
        ),
        "hidden_gems_approx": _sql_cell_gems(10_000),
        "hidden_gems_all": _sql_gems("decade", "true", ""),
        "hidden_gems_yearly": _sql_gems("year", "va IS NOT NULL AND pop IS NOT NULL AND vc >= 2", ""),
        "stability": stable,
        "stability_count_zero": _sql_stability("vote_count - 1", "true"),
        "lenient_cast": r"""
            WITH raw AS (
              SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                     CASE l_linenumber % 6 WHEN 2 THEN 'n/a'
                          WHEN 1 THEN CAST(l_partkey AS VARCHAR) || '.0'
                          WHEN 3 THEN CAST(l_suppkey AS VARCHAR) || '.25'
                          WHEN 5 THEN '-' || CAST(l_suppkey AS VARCHAR) || '.75' END AS key
              FROM lineitem)
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   TRY_CAST(key AS DOUBLE) + 0e0 AS number,
                   coalesce(CAST(trunc(TRY_CAST(key AS DOUBLE)) AS BIGINT), 0) AS whole, key
            FROM raw""",
        "decade_period": """
            SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
                   CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade,
                   CAST(year(o_orderdate) // 7 * 7 AS INTEGER) AS seven_years,
                   strftime(o_orderdate, '%Y-%m-%d') AS iso_date,
                   strftime(o_orderdate, '%Y-%m') AS month
            FROM orders""",
        "cap_bucket": """
            SELECT CASE WHEN n >= 3 THEN '3+' ELSE CAST(n AS VARCHAR) END AS bucket, count(*) AS n
            FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1""",
        "text_sanitise": """
            SELECT doc_id, CAST(length(plain) AS INTEGER) AS length, md5(plain) AS digest
            FROM (SELECT doc_id, trim(translate(text, chr(9) || chr(10) || '|', '   ')) AS plain
                  FROM documents)""",
        "trim_both": "SELECT p_partkey, p_name AS name FROM part",
        "list_parse": f"""
            WITH {_TEXTS}
            SELECT c_custkey, 2 AS n_records, 2 AS n_named, c_custkey AS id, c_name AS name
            FROM texts WHERE kind < 2
            UNION ALL
            SELECT c_custkey, 2, 2, n_nationkey, n_name FROM texts WHERE kind < 2
            UNION ALL
            SELECT c_custkey, 2, 1, NULL, c_name || '''s' FROM texts WHERE kind = 2""",
        "list_status": f"""
            WITH {_TEXTS}
            SELECT c_custkey, CASE kind WHEN 3 THEN 'unreadable' ELSE 'ok' END AS status FROM texts""",
        "list_names_by_pattern": f"""
            WITH {_TEXTS}
            SELECT c_custkey, c_name AS name FROM texts WHERE kind <> 2
            UNION ALL
            SELECT c_custkey, n_name FROM texts WHERE kind < 2""",
        "regex_extract_all": f"""
            SELECT page_id, CAST(len(regexp_extract_all(html, '{LINK}', 0)) AS INTEGER) AS n_links,
                   array_to_string(regexp_extract_all(html, '{LINK}', 1), ' ') AS links,
                   nullif(regexp_extract(html, '{LINK}', 0), '') AS first_match
            FROM pages""",
        "regex_replace": """
            SELECT page_id, CAST(length(plain) AS INTEGER) AS length, md5(plain) AS digest
            FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages)""",
        "json_extract": """
            SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n
            FROM events GROUP BY 1, 2""",
        "union_all": """
            SELECT nation, count(*) AS n, CAST(sum(supplied) AS BIGINT) AS n_suppliers
            FROM (SELECT s_nationkey AS nation, 1 AS supplied FROM supplier
                  UNION ALL SELECT c_nationkey, 0 FROM customer) GROUP BY 1""",
        "key_union": """
            SELECT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
            UNION SELECT CAST(year(l_shipdate) AS INTEGER) FROM lineitem""",
        "top_n_global": """
            SELECT o_orderkey, o_totalprice FROM orders
            ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""",
        "profile_nulls": "WITH "
        + _TITLES
        + " UNION ALL ".join(
            f" SELECT '{name}' AS \"column\", count(*) AS n_rows, count(*) - count({name}) AS n_nulls FROM titles"
            for name in (
                "id",
                "original_title",
                "release_date",
                "revenue",
                "popularity",
                "vote_average",
                "vote_count",
                "budget",
                "n_genres",
            )
        ),
        "load_check_titles": """
            SELECT count(*) AS total, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date,
                   strftime(max(o_orderdate), '%Y-%m-%d') AS last_date
            FROM orders""",
        "load_check_footers": """
            SELECT count(*) AS total, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date,
                   strftime(max(o_orderdate), '%Y-%m-%d') AS last_date
            FROM orders""",
        "overview_by_decade": _sql_overview("decade", 5, 2),
        "overview_by_year": _sql_overview("year", 3, 7),
        "lead_companies": f"""
            WITH {_TEXTS}
            SELECT c_custkey, CASE WHEN kind <> 2 THEN c_name END AS lead FROM texts""",
        "running_counts": """
            SELECT l_returnflag, day, n, CAST(sum(n) OVER w - n AS BIGINT) AS start,
                   CAST(sum(n) OVER w AS BIGINT) AS "end"
            FROM (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n
                  FROM lineitem GROUP BY 1, 2)
            WINDOW w AS (PARTITION BY l_returnflag ORDER BY day)""",
        "tiles_of_tied_values": """
            SELECT l_returnflag, CAST(tile AS INTEGER) AS tile, count(*) AS n,
                   round(sum(l_extendedprice), 2) AS total, count(l_extendedprice) AS measured
            FROM (SELECT *, ntile(10) OVER (
                    PARTITION BY l_returnflag
                    ORDER BY l_quantity, l_orderkey, l_linenumber, l_extendedprice) AS tile
                  FROM lineitem)
            GROUP BY 1, 2""",
        "decile_cuts": """
            WITH placed AS (
              SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS value,
                     row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice) AS place,
                     count(*) OVER (PARTITION BY year(o_orderdate)) AS n,
                     rank() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice) - 1 AS before,
                     count(*) OVER (PARTITION BY year(o_orderdate), o_totalprice) AS ties
              FROM orders)
            SELECT year, CAST(t AS INTEGER) AS target, n, place AS rank, value, before, ties
            FROM placed, (SELECT unnest(range(0, 9)) AS t)
            WHERE place = greatest(1, CAST(ceil((t + 1) / 10e0 * n) AS BIGINT))""",
        "csv_round_trip": """
            SELECT doc_id, md5(text) AS digest, lang, source, n_chars, true AS missing FROM documents""",
        "ingest_titles": f"""
            WITH {_TITLES}, parity AS (SELECT *, coalesce(vote_count % 2 = 1, false) AS odd FROM titles)
            SELECT id, CASE WHEN odd THEN strftime(release_date, '%Y-%m-%d') END AS day,
                   CASE WHEN odd THEN decade END AS period, CASE WHEN odd THEN budget END AS budget,
                   revenue, popularity, vote_average, coalesce(vote_count, 0) AS vote_count,
                   CASE WHEN odd THEN 'A''s' ELSE '' END AS companies,
                   CASE WHEN odd THEN 2 ELSE 0 END AS n_genres,
                   CAST(CASE WHEN odd THEN 0 ELSE 1 END AS BIGINT) AS n_unreadable
            FROM parity""",
        "report_concentration": _sql_shares(
            "decade",
            "company_id, company",
            5,
            "decade, round(coalesce(top, 0e0) / total * 100, 4) AS top5_pct, round(total, 2) AS total",
            "rank = 1 OR rank IS NULL",
        ),
        "report_companies": _sql_shares(
            "decade",
            "company_id, company",
            5,
            "decade, CAST(rank AS INTEGER) AS rank, company_id AS cid, company AS name, "
            "round(revenue, 2) AS revenue, round(revenue / total * 100, 4) AS pct",
            "rank IS NOT NULL",
        ),
        "report_debuts": f"""
            SELECT company_id AS cid, company AS name, debut_date AS date, debut_roi, debut_pop,
                   post_roi, post_pop, n_post, delta_roi, delta_pop
            FROM ({_sql_debuts("company_id, company", "coalesce({}, 0e0)", "true", "")})""",
        "report_gems": f"""
            SELECT decade, id, original_title AS title, round(va, 3) AS va, round(pop, 3) AS pop, vc AS votes
            FROM ({_sql_gems("decade", "true", "")})""",
        "report_text": f"""
            SELECT CAST(decade AS VARCHAR) || '|' || bucket || chr(9)
                   || printf('%.6f|%.6f|%d', mean, std, n) AS value
            FROM ({stable})""",
        "report_text_concentration": f"""
            SELECT unnest(CASE WHEN rank = 1 THEN [summary, detail] ELSE [detail] END) AS value
            FROM ({_sql_shares("decade", "company_id, company", 5, _LINES, "rank IS NOT NULL")})""",
        "report_text_returns": f"""
            SELECT CAST(decade AS VARCHAR) || '|' || bud_decile || chr(9) || printf('%.6f|%d', avg_roi, n) AS value
            FROM ({_sql_cuts("decade", least=20, densify=True)})""",
        "report_text_debuts": f"""
            SELECT company_id || '|' || company || chr(9) || debut_date || '|'
                   || printf('%.6f|%.6f|%.6f|%.6f|%d|%.6f|%.6f', debut_roi, debut_pop, post_roi, post_pop, n_post,
                             delta_roi + 0e0, delta_pop + 0e0) AS value
            FROM ({_sql_debuts("company_id, company", "coalesce({}, 0e0)", "true", "")})""",
        "report_text_gems": f"""
            SELECT CAST(decade AS VARCHAR) || chr(9) || id || '|' || original_title || '|'
                   || printf('%.3f|%.3f|%d', va, pop, vc) AS value
            FROM ({_sql_gems("decade", "true", "")})""",
        "debuts_first_twenty": _sql_debuts("company", "{}", "n_post >= 1", "LIMIT 20"),
        "hidden_gems_first_fifty": _sql_gems(
            "decade", "va IS NOT NULL AND pop IS NOT NULL AND vc >= 2", "LIMIT 50"
        ),
        "hidden_gems_rank_error": f"""
            WITH {_TITLES}
            SELECT decade, count(vote_average) AS va_n, count(popularity) AS pop_n, true AS va_within, true AS pop_within
            FROM titles GROUP BY decade""",
        "csv_layouts": """
            SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS c_name, c_acctbal FROM customer""",
        "csv_to_shares": _sql_shares("decade", "company_id, company", 5, f"decade, {_SHARE}, {_BY_ID}", "rank IS NOT NULL"),
        "amounts_of_any_size": f"""
            WITH {_TITLES}, {_CREDITS},
            parts AS (
              SELECT decade, company_id, revenue / n_companies * CASE company_id % 4
                     WHEN 0 THEN 1e-20 WHEN 1 THEN 1e0 WHEN 2 THEN 2e20 ELSE 1e290 END AS amount
              FROM credits),
            summed AS (SELECT decade, company_id, fsum(amount) AS amount FROM parts GROUP BY ALL),
            totals AS (SELECT decade, fsum(amount) AS total FROM parts GROUP BY ALL)
            SELECT decade, CAST(row_number() OVER (PARTITION BY decade ORDER BY amount DESC) AS INTEGER) AS rank, company_id,
                   printf('%.9e', amount) AS amount, printf('%.9e', total) AS total
            FROM summed JOIN totals USING (decade)""",
        "list_literals": """
            SELECT c_custkey, CASE WHEN k < 7 THEN 1 WHEN k = 7 THEN 1000 END AS id,
                   CASE WHEN k = 6 THEN 'Ab' || c_name WHEN k < 8 THEN c_name END AS name,
                   CASE WHEN k < 8 THEN 'ok' ELSE 'unreadable' END AS status
            FROM (SELECT *, c_custkey % 10 AS k FROM customer)""",
        "mixed_dates": """
            SELECT CAST(o_orderkey AS VARCHAR) AS id,
                   CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
                   CASE WHEN o_orderkey % 5 < 4 THEN CAST(year(o_orderdate) // 10 * 10 AS INTEGER) END AS period
            FROM orders""",
        "top_share_tiny": f"""
            WITH {_TITLES}, {_CREDITS},
            summed AS (
              SELECT decade, company_id, company,
                     sum(CAST(round(revenue / 1e8, 10) / n_companies AS DECIMAL(38, 12))) AS revenue
              FROM credits WHERE round(revenue / 1e8, 10) > 0 GROUP BY ALL),
            ranked AS (
              SELECT *, row_number() OVER (PARTITION BY decade ORDER BY revenue DESC, company, company_id) AS rank
              FROM summed)
            SELECT decade, CAST(rank AS INTEGER) AS rank, company_id, company, round(CAST(revenue AS DOUBLE), 9) AS revenue
            FROM ranked WHERE rank <= 5""",
        "top_share_without_nan": _sql_shares(
            "decade", "company_id, company", 5, f"decade, {_SHARE}, {_BY_ID}", "rank IS NOT NULL"
        ).replace("WHERE revenue > 0", "WHERE revenue > 0 AND CAST(id AS BIGINT) % 7 <> 0"),
        "text_ids": """
            WITH parts AS (
              SELECT 'N' || s_nationkey AS ref, NULL AS company_id, 'Nation ' || s_nationkey AS company,
                     abs(s_acctbal) AS revenue FROM supplier WHERE s_suppkey % 2 = 0
              UNION ALL
              SELECT NULL, s_suppkey, 'Same', abs(s_acctbal) FROM supplier WHERE s_suppkey % 2 = 0
              UNION ALL
              SELECT 'N' || s_nationkey, NULL, 'Same', abs(s_acctbal) * 2 FROM supplier WHERE s_suppkey % 2 = 1),
            summed AS (SELECT ref, company_id, company, sum(revenue) AS revenue FROM parts WHERE revenue > 0 GROUP BY ALL)
            SELECT 1990 AS decade, CAST(rank AS INTEGER) AS rank, company_id, company, round(revenue, 2) AS revenue
            FROM (SELECT *, row_number() OVER (ORDER BY round(revenue, 6) DESC, company, company_id, ref) AS rank FROM summed)
            WHERE rank <= 10""",
        "result_sinks": """
            SELECT form, s_suppkey, s_name, '' AS none FROM supplier, (VALUES ('parquet'), ('csv'), ('json')) AS f(form)""",
        "registered_table": _moved(f"""
            WITH {_TITLES}, {_CREDITS}
            SELECT id, strftime(release_date, '%Y-%m-%d') AS release_date, revenue, first_company
            FROM titles LEFT JOIN (
              SELECT id, min_by(company, company_id) AS first_company FROM credits GROUP BY id) USING (id)"""),
        "type_listing": """
            SELECT unnest(['id', 'original_title', 'release_date', 'revenue', 'popularity', 'vote_average',
                           'vote_count', 'budget', 'n_genres']) AS "column",
                   unnest(['string', 'string', 'date', 'double', 'double', 'double', 'bigint', 'double', 'bigint']) AS type""",
        **_run_sql(),
    }


def oracle_sql() -> dict[str, str]:
    every = _own_sql()
    for module in _training_text():
        every |= module.oracle_sql()
    return every
