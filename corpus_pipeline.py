"""From raw documents to token ids: the stages, and a run over all of them.

Each stage takes ``(spark, docs, sf_dir)`` and gives the documents that go on, with the columns
of ``docs``; the last one gives token ids. Between stages the documents are a written table,
so a lost executor costs no more than the stage it worked on.

What a stage does with odd rows follows from its operator: null and empty texts pass the
quality stage (weight 0), have no lines to delete, are one group of near-duplicates of which
the smallest id stays, share nothing with the benchmark and have no tokens. Rows that repeat
share their fate until near-duplicates are removed, where one of them stays. Empty tables
stay empty. Columns other than ``doc_id`` and ``text`` are carried along whatever their names;
``n_chars``, if there, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, decontaminate, lines, resample, simhash
from marquee.llm.queries import VOCABULARY, table
from marquee.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by their importance against the well labelled ones."""
    return resample.resampled(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without runs of lines that came before, to their ends; those of which nothing is left go."""
    found = lines.deduplicated(docs)
    changed = F.col("n_removed") > 0
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        n_chars = F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return found.where(~changed | (F.trim("kept") != "")).select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no passage with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids`` (little-endian, 32 bits each) and whether decoding gives the text back."""
    coded = bpe.round_trip(F.col("text"), bpe.load(VOCABULARY), public_tokenizers.PATTERN)
    return docs.select("doc_id", coded.alias("coded")).select(
        "doc_id",
        (F.octet_length("coded.token_ids") / 4).cast("bigint").alias("n_tokens"),
        "coded.token_ids",
        "coded.intact",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("tokens", tokens),
]

# The first stage's hashed models and drawn noise can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
