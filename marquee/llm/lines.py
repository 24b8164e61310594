"""Repeated runs of lines, found by winnowing, with DataFrame functions only.

A window is a line and as many of the next ones as it takes to reach ``min_words`` words; a
longer line is a window of its own. Lines without a word are passed over. From each window the
line with the smallest hash is selected, so two runs of the same lines with that many words
share a selected line for certain, wherever they stand. What is written is a row for each
selected line, with the extent of the windows that select it: its place.

Places whose hash is selected nowhere else are dropped with all their windows. The others are joined
by hash and by the lines around them: each window of a place meets the first place that has
the same window. A match is extended both ways. As far as windows reach, by the windows before and after that
match as well, which overlap; beyond the last one line by line, which is a longer window that ends a
line later, joined the same way. Each extension meets the first place that has it, which need not be the place
of the match that it extends: the lines around a run may differ there, while two later places have more in
common. So a run is found to its ends, without a pair for every two places of it.

Every occurrence of a run but the first, in the order of ids and lines, is deleted: a line goes if
it lies in a run of ``min_words`` words or more that also stands at an earlier place. Shorter runs stay.

Windows are compared by two 64-bit hashes of their lines. Documents are told apart by id and
text: rows that repeat both are one document, whose lines are judged once, and get the same
result. Documents with one id and different texts are ordered by a hash, null ids come first.
Null texts stay null, an empty text stays empty, a text whose lines all go becomes empty. A
run that overlaps its own repetition counts as repeated, so of one line many times over, the
first window's opening line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.scratch import written

MIN_WORDS = 50
# Words are what lies between these signs.
WORD = r"[^ \t\r\f\x0B]+"

_DOC = ["k1", "k2"]


def _keys(id_: Column, text: Column) -> list[Column]:
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(F.lit(1), id_, text).alias("k2")]


def _lines(documents: DataFrame, min_words: int) -> DataFrame:
    """The lines with a word: ``id, k1, k2, pos, h1, h2, w, before``, spread by document.

    ``w`` is the number of words up to ``min_words``, ``before`` that of the lines before.
    """
    each = documents.select("id", *_keys(F.col("id"), F.col("text")), F.posexplode(F.split("text", "\n")))
    hashed = each.select(
        "id",
        *_DOC,
        "pos",
        F.xxhash64("col").alias("h1"),
        F.xxhash64(F.lit(1), "col").alias("h2"),
        F.least(F.regexp_count("col", F.lit(WORD)), F.lit(min_words)).alias("w"),
    )
    # Rows that repeat meet once for each task, before the lines of a document come together.
    once = hashed.where("w > 0").dropDuplicates([*_DOC, "pos"])
    earlier = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("before", F.coalesce(F.sum("w").over(earlier), F.lit(0)))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """For each line that opens a window: its last line, its selected line and its identity.

    A window also counts with the lines after it, up to the end of the next window but its last
    line, or to the last line where no window follows. Longer runs are made of the next window
    too, so there are at most two or so for each line.
    """
    in_order = Window.partitionBy(*_DOC).orderBy("before")
    ahead = in_order.rangeBetween(0, min_words - 1)
    every = lines.select(
        "id",
        *_DOC,
        "pos",
        "before",
        F.min(F.struct("h1", "pos")).over(ahead).alias("selected"),
        F.collect_list(F.struct("pos", "h1", "h2")).over(ahead).alias("own"),
        F.sum("w").over(ahead).alias("words"),
    )
    following = F.lead("own").over(in_order)
    # A window of one line doesn't overlap the next one: both together are a run as well.
    short = (F.lead("words").over(in_order) >= min_words) & (F.size("own") > 1)
    every = every.withColumn("following", following).withColumn("short", short.cast("int"))
    run = F.when(F.col("following").isNull(), F.col("own")).otherwise(F.concat(F.slice("own", 1, 1), F.col("following")))
    most = F.greatest(F.size("own"), F.coalesce(F.size("following") + 1 - F.col("short"), F.lit(0)))
    sizes = F.sequence(F.size("own"), most)
    return (
        every.where(F.col("words") >= min_words)
        .select("id", *_DOC, "pos", "selected", run.alias("run"), F.explode(sizes).alias("size"))
        .select("id", *_DOC, "pos", "selected", F.slice("run", 1, F.col("size")).alias("run"))
        .select(
            "id",
            *_DOC,
            "pos",
            F.element_at("run", -1)["pos"].alias("last"),
            F.col("selected.h1").alias("mark"),
            F.col("selected.pos").alias("marked"),
            F.xxhash64("run.h1").alias("w1"),
            F.xxhash64("run.h2").alias("w2"),
        )
    )


def _places(windows: DataFrame) -> DataFrame:
    """One row for each selected line: where it stands, and the ``windows`` that select it."""
    each = F.struct("pos", "last", "w1", "w2")
    return windows.groupBy("id", *_DOC, "marked", "mark").agg(F.collect_list(each).alias("windows"))


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``k1, k2, runs, n`` for each document (``id, text``) with lines that came before.

    ``runs`` are sorted pairs of a first and a last line, from 0; ``n`` is how many lines they have.
    """
    places = written(_places(_windows(_lines(documents, min_words), min_words)))
    # Selected lines that are selected at one place only are alone.
    marks = places.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    shared = places.join(marks, "mark", "left_semi")
    candidates = written(shared.select("id", *_DOC, F.inline("windows")))
    # Written, so that the join below has a shuffle of its own and Spark can split a hot window.
    firsts = written(
        candidates.groupBy("w1", "w2")
        .agg(F.min(F.struct("id", *_DOC, "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("w1", "w2", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"), F.col("first.pos").alias("fpos"))
    )
    later = candidates.join(firsts, ["w1", "w2"]).where("NOT (k1 = f1 AND k2 = f2 AND pos = fpos)")
    # Windows of a document end in the order in which they start, so overlaps are with the one before.
    in_order = Window.partitionBy(*_DOC).orderBy("pos", "last")
    opens = F.coalesce(F.col("pos") > F.lag("last").over(in_order), F.lit(True)).cast("int")
    runs = (
        later.select(*_DOC, "pos", "last", opens.alias("opens"))
        .withColumn("run", F.sum("opens").over(in_order))
        .groupBy(*_DOC, "run")
        .agg(F.min("pos").alias("first"), F.max("last").alias("last"))
    )
    return runs.groupBy(*_DOC).agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"),
        F.sum(F.col("last") - F.col("first") + 1).alias("n"),
    )


def without(text: Column, runs: Column) -> Column:
    """The text without its lines in the runs."""
    lines = F.split(text, "\n")

    def between(i: Column) -> Column:
        start = F.coalesce(F.get(runs, i - 1)["last"] + 1, F.lit(0))
        stop = F.coalesce(F.get(runs, i)["first"], F.size(lines))
        return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), between)), "\n")


def deduplicated(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """The documents as ``row``, with ``kept`` (the text that stays), ``n_lines`` and ``n_removed``."""
    id_, value = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    runs = repeated_runs(documents.select(id_.alias("id"), value.alias("text")), min_words)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row, *_keys(id_, value)).join(runs, _DOC, "left")
    value = F.col(f"row.`{text}`")
    return rows.select(
        "row",
        F.when(F.col("runs").isNull(), value).otherwise(without(value, F.col("runs"))).alias("kept"),
        F.coalesce(F.size(F.split(value, "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_removed"),
    )
