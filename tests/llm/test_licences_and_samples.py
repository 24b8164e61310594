"""Licence texts against a trial of every place, the drawn sample on documents not learnt from, benchmarks in parts."""

import random
import zlib

import brute
import pytest
from odd_tables import FOLDER
from pyspark.sql import functions as F

from marquee.llm import decontaminate, licences, resample
from marquee.scratch import written


def noisy(draw, share):
    """Licence texts between other words, a share of their words replaced outside the mandatory phrases."""
    filler = "the a of to software license permission granted free public terms version mit apache by 2 0".split()
    out = [draw.choice(filler) for _ in range(draw.randrange(12))]
    for _ in range(draw.randrange(1, 4)):
        _, text, keys = draw.choice(licences.TEXTS)
        own = brute.words(text)
        fixed = set()
        for key in map(brute.words, keys):
            at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
            fixed.update(range(at, at + len(key)))
        for i, word in enumerate(own):
            if i in fixed or draw.random() >= share:
                out.append(word)
            elif draw.random() < 0.6:
                out.append(draw.choice(filler))
        out += [draw.choice(filler) for _ in range(draw.randrange(12))]
    return " ".join(out)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.35, 0.5])
def test_no_licence_text_is_missed(spark, share):
    draw = random.Random(int(share * 100))
    texts = [noisy(draw, share) for _ in range(150)] + [None, "", "mit", "gnu general public license"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    every = licences.templates()
    found = licences.index(every, licences.document_frequencies(frame, "text", every))
    rows = frame.select("doc_id", licences.scanned(F.col("text"), found).alias("s")).collect()
    n = 0
    for row in rows:
        got = sorted((m.label, m.first_word, m.score) for m in row.s.matches if not m.exact)
        want = brute.licence_texts(texts[row.doc_id], licences.TEXTS)
        assert got == [(label, first, pytest.approx(score)) for label, first, score in want]
        n += len(want)
    assert n > 150


def test_the_draw_is_a_sample_and_holds_on_documents_not_learnt_from(spark):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    folder = FOLDER.replace("sf0.001", "sf0.01")
    documents, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    scores = written(resample.scored(documents, labels.where(~held)).select("row.doc_id", "key", "mean"))
    least = resample.drawn(scores)
    rows = {r.doc_id: r for r in scores.collect()}
    drawn = {id_ for id_, r in rows.items() if r.key >= least}
    assert len(drawn) == sum(r.mean >= -resample.MARGIN for r in rows.values())
    good = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    kept = {q: [id_ in drawn for id_, own in good.items() if own == q] for q in (0, 1)}
    assert sum(kept[1]) >= 0.99 * len(kept[1]) and sum(kept[0]) <= 0.1 * len(kept[0])


def test_noise_decides_between_equal_weights(spark):
    """Gumbel top-k draws in proportion to the weights: the share of each weight follows from the temperature."""
    frame = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.05).alias("mean"))
    key = F.col("mean") / resample.TEMPERATURE + resample.gumbel(F.col("id"))
    scores = written(frame.select("id", "mean", key.alias("key")))
    least = resample.kth_largest(scores, "key", 1_000)
    n = {r.mean: r["count"] for r in scores.where(F.col("key") >= least).groupBy("mean").count().collect()}
    assert sum(n.values()) == 1_000
    # One temperature apart: e times as likely at each draw.
    assert 2.0 < n[0.0] / n[-0.05] < 3.4


def test_items_longer_than_an_automaton(spark):
    """An item in several pieces hits what it hits as a whole, and is named once."""
    draw = random.Random(4)
    long = [f"w{i}" for i in range(300)]
    items = [("long", " ".join(long)), ("short", "only three words"), (None, " ".join(long[50:70])), ("none", None), ("blank", " ")]
    texts = ["a " + " ".join(long[i : i + n]) + " b" for i in range(0, 290, 7) for n in (9, 10, 25)]
    texts += [" ".join(long), "Only THREE, words", None, "", " ".join(draw.sample(long, 50))]
    documents = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, spans int")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    results = [
        decontaminate.scanned(documents, benchmark, words_per_automaton=n).select("row.doc_id", "found.*").orderBy("doc_id").collect()
        for n in (25_000, 40, 7)
    ]
    assert results[0] == results[1] == results[2]
    assert results[0][-5].n_hit == 300 and results[0][-5]["items"] == ["long"]
    assert results[0][-4]["items"] == ["short"]
