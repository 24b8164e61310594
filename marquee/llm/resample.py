"""Quality by importance: which documents look like a target sample, drawn by Gumbel top-k.

Two bags of hashed n-grams (one and two tokens; two equal tokens in a row are one n-gram of
their own kind) are counted: one over the target texts, one over all raw texts. The log ratio
of the two models, added up over a text, is its log weight; per n-gram it is what texts of
different lengths are compared by. Gumbel noise is added to it, over the temperature, and the
largest k are drawn, which is sampling without replacement in proportion to the weights. The
closer the temperature to 0, the surer that the largest weights are drawn.

k is the number of documents whose weight per n-gram is above minus ``margin`` nats, so it
follows from the data and leaves out what the target model explains clearly worse.

Defined results: null and empty texts have no n-grams and weight 0. The noise follows from id
and text, so repeated rows share their fate. Ties at the boundary are all drawn. Without a
target text all weights are 0 and everything is drawn; of an empty table nothing is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.batches import SpanHash, marked, mixed, raw, runs, slices, text_udf
from marquee.scratch import written

BUCKETS = 10_000
TEMPERATURE = 0.05
MARGIN = 0.2
# The target model is fitted on so many labelled documents at most; the raw model on all.
MOST_TARGETS = 20_000

# Tokens are runs of letters and digits, or runs of other signs, between blanks and control characters.
_LETTERS = marked("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SIGNS = ~_LETTERS
_SIGNS[:33] = _SIGNS[127] = False


class Models(NamedTuple):
    """The log ratio of target and raw model by bucket."""

    ratio: np.ndarray


def grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, and the text each belongs to."""
    data, offsets = raw(texts)
    letters, signs = runs(_LETTERS[data], offsets), runs(_SIGNS[data], offsets)
    order = np.argsort(np.concatenate([letters[0], signs[0]]), kind="stable")
    starts, ends = (np.concatenate(x)[order] for x in zip(letters, signs, strict=True))
    words = SpanHash(data).of(starts, ends)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    both = owner[1:] == owner[:-1]
    pairs = np.where(words[1:] == words[:-1], np.uint64(1), words[:-1] * np.uint64(3) + words[1:])
    pairs = mixed(pairs)[both]
    keys = np.concatenate([words, pairs]) % np.uint64(buckets)
    return keys.astype(np.int64), np.concatenate([owner, owner[:-1][both]])


def counts(texts: DataFrame, text: str, weight: Column, buckets: int) -> np.ndarray:
    """How often each bucket occurs, for the raw model and, by ``weight``, for the target.

    Each task adds up its part before the shuffle; what is collected has one row a bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            at = 0
            target = np.array(batch.column(1).to_pylist(), bool)
            for part in slices(batch.column(0)):
                keys, owner = grams(part, buckets)
                sums[0] += np.bincount(keys, minlength=buckets)
                sums[1] += np.bincount(keys[target[at + owner]], minlength=buckets)
                at += len(part)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])], ["bucket", "n_raw", "n_target"]
        )

    rows = texts.select(F.col(f"`{text}`").alias("text"), F.coalesce(weight, F.lit(False)).alias("target"))
    found = rows.mapInArrow(count, "bucket bigint, n_raw bigint, n_target bigint")
    table = np.zeros((2, buckets), np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n_raw"), F.sum("n_target")).collect():
        table[:, row[0]] = row[1], row[2]
    return table


def fitted(texts: DataFrame, text: str, target: Column, buckets: int = BUCKETS) -> Models:
    """Both models over all rows; ``target`` says which rows are target texts."""
    n_raw, n_target = counts(texts, text, target, buckets)
    if not n_target.sum():
        return Models(np.zeros(buckets))
    shares = [(n + 1.0) / (n.sum() + buckets) for n in (n_target, n_raw)]
    return Models(np.log(shares[0]) - np.log(shares[1]))


def _weigher(models: Models) -> Callable[[pa.Array], list]:
    def weigh(texts: pa.Array) -> list:
        keys, owner = grams(texts, len(models.ratio))
        sums = np.bincount(owner, models.ratio[keys], len(texts))
        return [sums, np.bincount(owner, minlength=len(texts))]

    return weigh


def gumbel(*identity: Column) -> Column:
    """Gumbel noise drawn by a hash of the columns, the same wherever it is computed."""
    spread = F.pmod(F.xxhash64(F.lit("gumbel"), *identity), F.lit(1 << 52)).cast("double")
    return -F.log(-F.log((spread + 0.5) / float(1 << 52)))


def kth_largest(scores: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest value of a column, by narrowing a bracket with counts.

    Each pass counts the rows above 63 points of the bracket, so a dozen passes over a written
    column are enough and no row leaves its place.
    """
    bounds = scores.agg(F.min(column), F.max(column)).first()
    if bounds[0] is None or k <= 0:
        return None
    low, high = bounds
    if scores.where(F.col(column) >= F.lit(high)).count() >= k:
        return high
    while True:  # at least k rows lie at or above low, fewer at or above high
        points = sorted({float(p) for p in np.linspace(low, high, 65)[1:-1]} - {low, high})
        if not points:
            return low
        above = scores.agg(*[F.count_if(F.col(column) >= F.lit(p)).alias(f"p{i}") for i, p in enumerate(points)]).first()
        enough = [p for p, n in zip(points, above, strict=True) if n >= k]
        fewer = [p for p, n in zip(points, above, strict=True) if n < k]
        low, high = max([low, *enough]), min([high, *fewer])
        inside = scores.where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))
        values = inside.select(column).limit(1001).collect()
        if len(values) <= 1000:
            missing = k - scores.where(F.col(column) >= F.lit(high)).count()
            return sorted((row[0] for row in values), reverse=True)[missing - 1]


def targets(labels: DataFrame, id_column: str = "doc_id", good: str = "quality", most: int = MOST_TARGETS) -> DataFrame:
    """The ids of up to ``most`` documents labelled good by all their labels, chosen by a hash of the id."""
    ids = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id"))
    good_ids = ids.agg(F.min(good).alias("good")).where("good = 1").select("id")
    return good_ids.orderBy(F.xxhash64("id"), "id").limit(most)


def scored(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """The documents as ``row``, with ``log_weight``, ``n_grams`` and ``key``, the noisy weight.

    The ids of the target texts are broadcast: there are ``MOST_TARGETS`` at most.
    """
    key, value = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    chosen = targets(labels, id_column).select(F.col("id").alias("target_id"), F.lit(True).alias("target"))
    texts = documents.select(key.alias("id"), value.alias("text"))
    texts = texts.join(F.broadcast(chosen), F.col("id") == F.col("target_id"), "left")
    models = fitted(texts, "text", F.col("target"), buckets)
    weigh = text_udf(lambda: _weigher(models), "log_weight double, n_grams bigint")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    noise = gumbel(F.col(f"row.`{id_column}`"), F.col(f"row.`{text}`"))
    return (
        documents.select(row)
        .select("row", weigh(F.col(f"row.`{text}`")).alias("w"))
        .select("row", "w.*", (F.col("w.log_weight") / F.greatest("w.n_grams", F.lit(1))).alias("mean"))
        .select("row", "log_weight", "n_grams", (F.col("mean") / temperature + noise).alias("key"), "mean")
    )


def drawn(scores: DataFrame, margin: float = MARGIN) -> float | None:
    """The least key that is drawn. ``scores`` is a written table with ``key`` and ``mean``."""
    return kth_largest(scores, "key", scores.where(F.col("mean") >= -margin).count())


def resampled(documents: DataFrame, labels: DataFrame, margin: float = MARGIN, **options) -> DataFrame:
    """The documents that are drawn, with their columns as they are."""
    rows = scored(documents, labels, **options)
    least = drawn(written(rows.select("key", "mean")), margin)
    if least is None:
        return documents.limit(0)
    return rows.where(F.col("key") >= F.lit(least)).select("row.*")
