"""Language of a text by rank-order profiles of its most frequent n-grams.

A profile is the ``PROFILE`` most frequent n-grams of one to three letters, a blank standing
for the edge of a word. A text's own most frequent n-grams are compared with every language's
profile: the sum over them of how far apart the two ranks are, an n-gram that the profile
doesn't have being out of place by the whole length. The least distance wins.

Texts that are null or without a letter are ``und``. Case is folded; anything but letters
separates words. Equally frequent n-grams are ranked by their code points, equally distant
languages by name, so repeated rows get equal answers. Without a labelled text every
prediction is ``und``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.batches import slices, text_udf

PROFILE = 400
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of each text with their counts: text number, n-gram, count, in that order.

    An n-gram is its code points in one number, 21 bits each, 0 standing for a word's edge.
    """
    lower = [text.lower() if text else "" for text in texts]
    sizes = np.array([len(t) + 1 for t in lower], np.int64)
    points = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    points = np.where(_letters()[points], points, 0)
    blank = points == 0
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    points, owner = points[keep], owner[keep]
    # An edge in front of each text, unless it opens with one.
    opens = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]) & (points != 0)) if len(points) else []
    points, owner = np.insert(points, opens, 0), np.insert(owner, opens, owner[opens] if len(opens) else [])
    distinct, small = np.unique(points, return_inverse=True)
    bits = max(1, int(len(distinct)).bit_length())
    if bits * 3 + 2 + int(len(texts)).bit_length() > 64 and len(texts) > 1:
        # Too many letters for so many texts in one number; one text has room for all letters there are.
        half = len(texts) // 2
        (a, gram_a, n_a), (b, gram_b, n_b) = counted(texts[:half]), counted(texts[half:])
        return np.concatenate([a, b + half]), np.concatenate([gram_a, gram_b]), np.concatenate([n_a, n_b])
    width = np.uint64(bits)
    small = small.astype(np.uint64)
    kinds = []
    for n in (1, 2, 3):
        m = len(points) - n + 1
        if m <= 0:
            continue
        own = owner[:m] == owner[n - 1 :]
        own &= points[n // 2 : n // 2 + m] != 0 if n != 2 else (points[:m] != 0) | (points[1:] != 0)
        at = np.flatnonzero(own)
        key = owner[at].astype(np.uint64) * np.uint64(4) + np.uint64(n)
        for j in range(3):
            key = (key << width) | (small[at + j] if j < n else np.uint64(0))
        kinds.append(key)
    keys = np.concatenate(kinds) if kinds else np.zeros(0, np.uint64)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    mask = (np.uint64(1) << width) - np.uint64(1)
    gram = np.zeros(len(keys), np.int64)
    size = ((keys >> np.uint64(3 * bits)) & np.uint64(3)).astype(np.int64)
    for j in range(3):
        part = distinct[((keys >> np.uint64((2 - j) * bits)) & mask).astype(np.int64)]
        gram = (gram << 21) | np.where(j < size, part + 1, 0)
    return (keys >> np.uint64(3 * bits + 2)).astype(np.int64), gram, count


def _few_at_a_time(texts: pa.Array) -> Iterator[list[str | None]]:
    for part in slices(texts, 1 << 20):
        for i in range(0, max(1, len(part)), 512):
            yield part.slice(i, 512).to_pylist()


def profiles(labelled: DataFrame, text: str, lang: str, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams over all the rows, in order.

    The n-grams of a batch are added up before the shuffle. What is collected has ``size``
    numbers for each language.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            at = 0
            sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for part in _few_at_a_time(batch.column(0)):
                owner, gram, n = counted(part)
                sums.append(_summed(number[at : at + len(part)][owner], gram, n))
                at += len(part)
            which, gram, n = _summed(*(np.concatenate(x) for x in zip(*sums, strict=True))) if sums else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in which], pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())],
                ["lang", "gram", "n"],
            )

    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    grams = rows.where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(count, "lang string, gram bigint, n bigint")
    sums = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= size)
    found: dict[str, list] = {}
    for row in top.orderBy("lang", "rank").collect():
        found.setdefault(row.lang, []).append(row.gram)
    return {name: np.array(grams, np.int64) for name, grams in found.items()}


def _summed(which: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((gram, which))
    which, gram, n = which[order], gram[order], n[order]
    if not len(gram):
        return which, gram, n
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (which[1:] != which[:-1])]))
    return which[first], gram[first], np.add.reduceat(n, first)


def _classifier(known: dict[str, np.ndarray], size: int) -> Callable[[pa.Array], list]:
    names = sorted(known)
    every = np.unique(np.concatenate([known[name] for name in names])) if names else np.zeros(0, np.int64)
    # Rank of every profile n-gram in each language, `size` where it has none; one more row for the rest.
    ranks = np.full((len(every) + 1, len(names)), size, np.int64)
    for k, name in enumerate(names):
        ranks[np.searchsorted(every, known[name]), k] = np.arange(len(known[name]))

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        owner, gram, n = counted(texts)
        if not names or not len(owner):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        order = np.lexsort((gram, -n, owner))
        owner, gram = owner[order], gram[order]
        starts = np.searchsorted(owner, np.arange(len(texts)))
        rank = np.arange(len(owner)) - starts[owner]
        used = rank < size
        owner, gram, rank = owner[used], gram[used], rank[used]
        place = np.minimum(np.searchsorted(every, gram), len(every) - 1)
        place = np.where(every[place] == gram, place, len(every))
        theirs = ranks[place]
        apart = np.where(theirs < size, np.abs(theirs - rank[:, None]), size)
        starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        sums = np.concatenate([np.zeros((1, len(names)), np.int64), np.cumsum(apart, axis=0)])
        distance = sums[starts[1:]] - sums[starts[:-1]]
        n_grams = np.diff(starts)
        best = np.argmin(distance, axis=1)
        least = distance[np.arange(len(texts)), best]
        score = np.where(n_grams > 0, 1 - least / (size * np.maximum(n_grams, 1)), 0.0)
        return [names[b] if m else UNKNOWN for b, m in zip(best, n_grams, strict=True)], score.tolist()

    def work(texts: pa.Array) -> list:
        langs, scores = [], []
        for part in _few_at_a_time(texts):
            found = predict(part)
            langs += found[0]
            scores += found[1]
        return [langs, scores]

    return work


def predicted(text: Column, known: dict[str, np.ndarray], size: int = PROFILE) -> Column:
    """``lang`` and ``score``, one less the distance as a share of the largest possible one."""
    return text_udf(lambda: _classifier(known, size), "lang string, score double")(text)
