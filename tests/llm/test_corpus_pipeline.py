"""The pipeline against a brute-force version of its stages, and its stages on odd tables."""

import os

import brute
import duckdb
import numpy as np
import pytest
from odd_tables import CLASHING, PASSAGE
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from marquee.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STAGES = dict(corpus_pipeline.STAGES)


def test_run_against_brute_force(spark):
    every = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    drawn = {r.doc_id for r in queries.op3_quality_resample(spark, FOLDER).collect() if r.kept}
    docs = [(i, t) for i, t in every if i in drawn]
    kept = brute.deduplicated(docs)
    docs = [(i, new) for (i, old), new in zip(docs, kept, strict=True) if new == old or new.strip()]
    group = brute.groups([brute.simhash(t) for _, t in docs])
    docs = [doc for k, doc in enumerate(docs) if group[k] == k]
    docs = [(i, t) for i, t in docs if brute.shared(t, items)[1] == 0]
    encoding = brute.encoding()
    want = {i: np.array(encoding.encode_ordinary(t), "<u4").tobytes() for i, t in docs}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(rows) == len(want) < len(every)
    assert {r.doc_id: bytes(r.token_ids) for r in rows} == want
    assert all(r.intact and r.n_tokens * 4 == len(r.token_ids) for r in rows)


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_empty_documents(spark, odd, crowded, name):
    found = STAGES[name](spark, crowded.limit(0), odd)
    assert found.collect() == []
    if name != "tokens":
        assert found.columns == crowded.columns


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_with_clashing_columns(spark, odd, crowded, name):
    plain = STAGES[name](spark, crowded.drop(*[f"`{c}`" if "." in c else c for c in CLASHING if "." not in c], "a b.c"), odd)
    found = STAGES[name](spark, crowded, odd)
    if name != "tokens":
        assert found.dtypes == crowded.dtypes
        assert all(row[len(row) - len(CLASHING) + i] == i for row in found.collect() for i in range(len(CLASHING)))
    columns = ["doc_id", "text"] if name != "tokens" else ["doc_id", "token_ids"]
    assert sorted(found.select(*columns).collect(), key=repr) == sorted(plain.select(*columns).collect(), key=repr)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_with_empty_other_tables(spark, odd, empty, name):
    documents = spark.read.parquet(f"{odd}/documents.parquet")
    found = STAGES[name](spark, documents, empty)
    if name in ("quality", "decontaminate", "tokens"):
        assert found.count() == documents.count()


def kept(spark, odd, name):
    return STAGES[name](spark, spark.read.parquet(f"{odd}/documents.parquet"), odd).collect()


def test_line_stage(spark, odd):
    rows = kept(spark, odd, "line_dedup")
    own = next(r for r in rows if r.doc_id == 6)
    assert own.text == "Another opening.\nAnother closing." and own.n_chars == len(own.text)
    assert next(r for r in rows if r.doc_id == 5).n_chars == 1  # untouched
    assert len(rows) == 16
    copies = spark.createDataFrame([(i, PASSAGE) for i in range(5)], "doc_id bigint, text string")
    assert [r.doc_id for r in STAGES["line_dedup"](spark, copies, odd).collect()] == [0]


def test_line_stage_deletes_runs_to_their_ends(spark, odd):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    copy = "\n".join([*long, "a short line", "", "the end"])
    texts = [
        (0, copy),
        (1, copy),  # nothing is left of an exact copy
        (2, "\n".join(["Opening.", *long, "a short line", "another end"])),
        (3, "\n".join([long[0], "first tail"])),
        (4, "\n".join([long[0], "second tail", "of two lines"])),
        (5, "\n".join([long[0], "second tail", "of two lines", "and one more"])),  # as in 4, not in 0
        (6, "a short line\n\nthe end"),
    ]
    rows = STAGES["line_dedup"](spark, spark.createDataFrame(texts, "doc_id bigint, text string"), odd).collect()
    assert {r.doc_id: r.text for r in rows} == {
        0: copy,
        2: "Opening.\nanother end",
        3: "first tail",
        4: "second tail\nof two lines",
        5: "and one more",
        6: "a short line\n\nthe end",
    }


def runs_to_their_ends(texts, least):
    """Every line in a run of ``least`` words or more that started at an earlier place, by all runs."""
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n")
        used = [(i, n) for i, line in enumerate(lines) if (n := len(line.split()))]
        gone = set()
        for a in range(len(used)):
            for b in range(a, len(used)):
                if sum(n for _, n in used[a : b + 1]) >= least:
                    name = tuple(lines[i] for i, _ in used[a : b + 1])
                    if name in seen:
                        gone.update(range(used[a][0], used[b][0] + 1))
                    seen.add(name)
        out.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
    return out


def test_whole_runs_against_brute_force(spark):
    import random

    from marquee.llm import lines

    rng = random.Random(7)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 3, 8, 20, 60]))) for _ in range(12)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25))) for _ in range(80)]
    texts += [text + rng.choice(["", "\nb", "\nb\na c"]) for text in texts[:40]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for least in (5, 50):
        rows = lines.deduplicated(frame, min_words=least).collect()
        found = {r.row.doc_id: r.kept for r in rows}
        assert [found[i] for i in range(len(texts))] == runs_to_their_ends(texts, least)


def test_near_duplicate_stage(spark, odd):
    rows = kept(spark, odd, "near_dedup")
    ids = [r.doc_id for r in rows]
    assert ids.count(1) == 1 and 7 not in ids
    assert ids.count(2) == 1 and 3 not in ids and 9 not in ids
    assert ids.count(8) == 2  # one id, different texts
    assert ids.count(None) == 1
    copies = spark.createDataFrame([(4, "one text", i) for i in (3, 3, 2)], "doc_id bigint, text string, other int")
    assert STAGES["near_dedup"](spark, copies, odd).count() == 1


def test_near_duplicates_with_a_map_column(spark, odd):
    frame = spark.createDataFrame([(4, "one text", {"a": i}) for i in (3, 3, 2)], "doc_id bigint, text string, other map<string,int>")
    assert STAGES["near_dedup"](spark, frame, odd).count() == 1


def test_contamination_stage(spark, odd):
    ids = [r.doc_id for r in kept(spark, odd, "decontaminate")]
    assert None not in ids and 1 not in ids and 7 not in ids and ids.count(8) == 1
    assert {2, 3, 4, 5, 6, 9, 10, 11, 12} <= set(ids)


def test_several_automata_agree_with_one(spark, odd):
    from marquee.llm import decontaminate

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    both = [
        decontaminate.scanned(documents, items, words_per_automaton=n).select("row.doc_id", "found.*").orderBy("doc_id").collect()
        for n in (25_000, 300)
    ]
    assert both[0] == both[1]
    spans = [(r.doc_id, s) for r in both[0] for s in r.spans]
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert spans
    for doc, span in spans:
        passage = brute.words(texts[doc][span.start : span.end])
        assert passage == brute.words(texts[doc])[span.first_word : span.first_word + span.n_words]


def test_conversation_in_many_blocks(spark):
    """A conversation that runs through all blocks has the path of one pass over it."""
    import random

    from marquee.llm import chat

    rng = random.Random(2)
    rows = []
    for c, n in ((1, 3), (2, 700), (3, 5)):
        for t in range(n):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.9 else "user"
            mark = rng.choice(["", "", "", "User: ", "Assistant: "])
            body = "\n".join(rng.choice(["Why?", "It is so. " * rng.randrange(1, 30), "User: no", "Bot: yes"]) for _ in range(rng.randrange(1, 4)))
            rows.append((c, t, role, mark + body))
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        blocks = chat.in_blocks(frame, "conv_id", "turn", "text", "role", None)
        assert blocks.select("block").distinct().count() > 5
        model = chat.learnt(blocks)
        found = chat.formatted(blocks, model).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    starts, turns, before = {}, {}, None
    for c, _, role, _ in rows:
        r = chat.ROLES.index(role)
        if before and before[0] == c:
            turns[before[1], r] = turns.get((before[1], r), 0) + 1
        else:
            starts[r] = starts.get(r, 0) + 1
        before = (c, r)
    seen = {}
    for _, _, role, text in rows:
        for i, code in enumerate(chat.codes(text)):
            key = (chat.ROLES.index(role), int(i == 0), code)
            seen[key] = seen.get(key, 0) + 1
    assert model == chat.model(chat.ROLES, starts, turns, seen)
    want = []
    for c in (1, 2, 3):
        own = [(t, text) for k, t, _, text in rows if k == c]
        states, _ = chat.path([chat.codes(text) for _, text in own], model, None, None)
        for (t, text), lines in zip(own, states, strict=True):
            want += [(c, t, i, role, said) for i, (role, said) in enumerate(chat.turns_of(text, lines, model.roles))]
    assert sorted((r.conversation, r.order, r.part, r.role, r.said) for r in found) == want


def test_markers():
    from marquee.llm import chat

    assert [chat.marker(x)[0] for x in ("User: hi", "**Assistant:** x", "### Human", "<|system|> x", "[user] x", "Q: x")] == [
        "user", "assistant", "user", "system", "user", "user",
    ]
    assert [chat.marker(x)[0] for x in ("Anna: hi", "hi there", "", "A fine day", "user", "The model is: x")] == [
        "name", "none", "none", "none", "none", "none",
    ]
