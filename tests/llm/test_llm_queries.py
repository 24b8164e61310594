"""The registered queries against SQL or a brute-force version, and on odd and empty tables."""

import os

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from odd_tables import PASSAGE
from pyspark.sql import functions as F

from marquee.llm import bpe, language, lines, phrases, queries, simhash

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = queries.queries()
SQL = queries.oracle_sql()
TABLE = {
    "op1_chat_turns": "conversations",
    "op7_html_extract": "pages",
    "op11_heap_clusters": "embeddings",
    "op13_spectrum_whitening": "embeddings",
}


def run(spark, name, folder=FOLDER):
    return QUERIES[name](spark, folder).collect()


def source(spark, name, folder):
    return spark.read.parquet(f"{folder}/{TABLE.get(name, 'documents')}.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    database = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = database.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    frame = QUERIES[name](spark, empty)
    assert frame.collect() == []
    assert frame.dtypes == QUERIES[name](spark, FOLDER).dtypes


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables_lose_no_row(spark, odd, name):
    rows = run(spark, name, odd)
    n = source(spark, name, odd).count()
    if name == "op1_chat_turns":
        assert sum(row.part == 0 for row in rows) == n
    elif name == "op13_spectrum_whitening":
        assert len(rows) == 32 * n
    else:
        assert len(rows) == n


def test_chat_on_odd_rows(spark, odd):
    rows = run(spark, "op1_chat_turns", odd)
    own = sorted((r.part, r.role, r.rendered) for r in rows if r.conv_id == 1 and r.turn == 0)
    assert own == [
        (0, "user", "<|im_start|>user\nhello there<|im_end|>\n"),
        (1, "assistant", "<|im_start|>assistant\nhi, how can I help?<|im_end|>\n"),
        (2, "user", "<|im_start|>user\nnot at all<|im_end|>\n"),
    ]
    own = [(r.part, r.role, r.rendered) for r in rows if r.conv_id == 2]
    assert sorted(own)[::2] == [
        (0, "system", "<|im_start|>system\nBe short.<|im_end|>\n"),
        (1, "assistant", "<|im_start|>assistant\nYes. < |im_end|><|im_end|>\n"),
    ]
    assert sum(r.role_given is None for r in rows) == 1


def test_chat_on_held_out_conversations(spark):
    rows = [r for r in run(spark, "op1_chat_turns") if r.held_out]
    assert sum(r.role == r.role_given for r in rows) >= 0.9 * len(rows)


def test_fingerprints(spark, documents):
    texts = [text or "" for _, text, _ in documents]
    changed = brute.edited(texts)
    own, other = ([brute.fingerprint(t, phrases.LEVEL) for t in x] for x in (texts, changed))
    rows = {r.doc_id: r for r in run(spark, "op2_fingerprints")}
    assert len(rows) == len(documents)
    for i, (id_, _, _) in enumerate(documents):
        row = rows[id_]
        assert (row.n_chars, row.edited_sha256) == (len(texts[i]), brute.sha(changed[i]))
        assert (row.fingerprint, row.edited_fingerprint) == (own[i], other[i])
        # Likeness follows from the two texts that are returned.
        assert row.near_edited == brute.likeness(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == brute.likeness(row.fingerprint, rows[documents[(i + 1) % len(texts)][0]].fingerprint)
    long = [rows[id_] for id_, text, _ in documents if len(text) > 300]
    assert np.mean([r.near_edited for r in long]) > 0.45 > 0.1 > np.mean([r.near_next for r in long])


def test_fingerprints_of_long_texts_that_share_one_passage(spark, tmp_path):
    import random

    rng = random.Random(3)
    own = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(4_000)) for _ in range(3)]
    passage = own[2][:700]
    texts = [own[0][:14_000] + passage + own[0][14_000:], own[1][:9_000] + passage + own[1][9_000:]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = run(spark, "op2_fingerprints", str(tmp_path))
    names = [set(zip(*np.unique(phrases.names([t], phrases.LEVEL)[1], return_counts=True), strict=True)) for t in texts]
    counts = [{n: int(c) for n, c in x} for x in names]
    common = sum(min(c, counts[1].get(n, 0)) for n, c in counts[0].items())
    want = common / (sum(counts[0].values()) + sum(counts[1].values()) - common)
    assert want > 0.005
    # Hashes of 32 bits may meet by chance.
    assert [r.near_next for r in rows] == pytest.approx([want] * 2, rel=0.02)
    same = frame.select(phrases.fingerprint(F.col("text")).alias("f")).collect()
    assert {r.f for r in same} == {r.fingerprint for r in rows}
    both = spark.createDataFrame([(rows[0].fingerprint, rows[1].fingerprint)], "a string, b string")
    assert both.select(phrases.likeness(F.col("a"), F.col("b"))).first()[0] == rows[0].near_next


def test_fingerprints_of_odd_rows(spark, odd):
    rows = run(spark, "op2_fingerprints", odd)
    blank = [r for r in rows if r.doc_id in (2, 3)]
    assert [(r.n_chars, r.fingerprint, r.edited_sha256) for r in blank] == [(0, "", brute.sha(""))] * 2
    assert next(r for r in blank if r.doc_id == 2).near_next == 1
    assert next(r for r in blank if r.doc_id == 2).near_edited == 1
    assert len({r.fingerprint for r in rows if r.doc_id == 7}) == 1
    # After the last id comes the first row, one without an id.
    last = next(r for r in rows if r.doc_id == 12)
    text = "spam*** spam*** spam*** spam*** spam*** spam***"
    n = len(text) // 4
    assert last.edited_sha256 == brute.sha(text[: len(text) - n] + "A text without an id"[:n])


def test_quality_against_exact_models(spark, documents):
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall()
    rows = {r.doc_id: r for r in run(spark, "op3_quality_resample")}
    means = brute.mean_weights([(id_, text) for id_, text, _ in documents], {id_ for id_, q in labels if q})
    own = [rows[id_].log_weight / max(1, rows[id_].n_grams) for id_, _, _ in documents]
    assert [rows[id_].n_grams for id_, _, _ in documents] == [len(brute.ngrams(text)) for _, text, _ in documents]
    # The hashed models share buckets among n-grams, so they agree in rank rather than in value.
    assert np.corrcoef(np.argsort(np.argsort(means)), np.argsort(np.argsort(own)))[0, 1] > 0.9
    judged = [(rows[id_].kept, bool(q)) for id_, q in labels if id_ in rows]
    assert all(kept for kept, good in judged if good)
    assert sum(kept for kept, good in judged if not good) <= 0.1 * sum(not good for _, good in judged)


def test_quality_without_labels(spark, odd, tmp_path):
    spark.read.parquet(f"{odd}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{odd}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    rows = run(spark, "op3_quality_resample", tmp_path)
    assert all(r.kept and r.log_weight == 0 for r in rows)
    repeated = [r.draw_key for r in rows if r.doc_id == 7]
    assert len(repeated) == 2 and len(set(repeated)) == 1


def test_lines_of_odd_rows(spark, odd):
    rows = {}
    for row in run(spark, "op4_line_dedup", odd):
        rows.setdefault(row.doc_id, []).append(row)
    assert rows[5][0].text == "Opening.\n" + PASSAGE + "\nClosing."
    assert (rows[6][0].text, rows[6][0].n_removed) == ("Another opening.\nAnother closing.", 1)
    assert (rows[2][0].text, rows[3][0].text, rows[9][0].text) == (None, "", "\n\n \n\t\n")
    assert rows[7][0] == rows[7][1] and rows[7][0].n_removed == 0
    assert rows[4][0].n_removed == 0 and rows[4][0].n_lines == 20_000


def test_lines_against_brute_force(spark):
    import random

    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 3, 8, 20, 60]))) for _ in range(12)] + ["", "  "]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for i in range(120)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    for least in (5, 25):
        found = {r.row.doc_id: r.kept for r in lines.deduplicated(frame, min_words=least).collect()}
        assert [found[i] for i, _ in texts] == brute.deduplicated(texts, least)


def test_lines_are_matched_by_selected_places(spark):
    shared = [f"{i} is the number of this line" for i in range(40)]
    # The line selected from the run of documents 1 and 2 stands among other lines in document 0.
    frame = spark.createDataFrame([(1, "\n".join(shared))], "id bigint, text string")
    windows = lines._windows(lines._lines(frame, 50), 50)
    places = lines._places(windows).collect()
    assert len({p.marked for p in places}) == len(places) < windows.count() == sum(len(p.windows) for p in places)
    others = [line for p in places for line in (shared[p.marked], *[f"{p.marked} {k} is alone" for k in range(20)])]
    texts = [(0, "\n".join(others)), (1, "\n".join(shared)), (2, "\n".join(["Opening.", *shared, "Closing."]))]
    rows = lines.deduplicated(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.row.doc_id: r.kept for r in rows} == {0: texts[0][1], 1: texts[1][1], 2: "Opening.\nClosing."}


def test_simhash(spark, documents):
    prints = [brute.simhash(text) for _, text, _ in documents]
    group = brute.groups(prints)
    rows = {r.doc_id: r for r in run(spark, "op5_simhash_dedup")}
    assert [rows[id_].fingerprint for id_, _, _ in documents] == [f"{p:016x}" for p in prints]
    assert [rows[id_].component_id for id_, _, _ in documents] == [documents[g][0] for g in group]


def test_simhash_of_odd_rows(spark, odd):
    rows = run(spark, "op5_simhash_dedup", odd)
    # No words, no bits: the null, the empty and the blank text.
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (2, 3, 9)} == {("0" * 16, 2)}
    assert {r.component_id for r in rows if r.doc_id in (1, 7)} == {1}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}


def test_licences(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op6_license_scan")}
    for id_, text, _ in documents:
        row = rows[id_]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == brute.phrases(text)
        assert set(row.base_labels.split(",")) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(row.labels)


def test_pages(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall())
    rows = run(spark, "op7_html_extract")
    assert all(r.n_chars == len(r.text) for r in rows)
    right = sum(r.text == brute.article(pages[r.page_id]) for r in rows)
    assert right >= 0.98 * len(pages)


def test_odd_pages(spark, odd):
    rows = {}
    for row in run(spark, "op7_html_extract", odd):
        rows.setdefault(row.page_id, []).append(row.text)
    assert rows[1] == ["Title\nOne & two, three."] * 2
    assert rows[2] == rows[3] == [""]
    assert rows[None] == ["Never closed at all, but a paragraph it is. And another sentence."]
    assert rows[4][0].count("\n") == 2999


def test_tokens(spark, documents):
    encoding = brute.encoding()
    rows = {r.doc_id: r for r in run(spark, "op8_byte_bpe")}
    for id_, text, _ in documents:
        ids = np.array(encoding.encode_ordinary(text), "<u4")
        row = rows[id_]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), brute.sha(ids.tobytes()))
        assert row.decoded_sha256 == brute.sha(text)


def test_pre_tokens_of_every_code_point():
    """Every character between two letters, cut as the tokenizer library does."""
    encoding = brute.encoding()
    vocabulary = bpe.load(queries.VOCABULARY)
    encode = bpe._encoder(vocabulary, queries.public_tokenizers.PATTERN)
    texts = ["".join(f"a{chr(c)} b'{chr(c)}s\n" for c in range(i, i + 0x800) if not 0xD800 <= c < 0xE000) for i in range(0, 0x110000, 0x800)]
    for i in range(0, len(texts), 16):
        own = encode(pa.array(texts[i : i + 16])).to_pylist()
        assert own == [np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in texts[i : i + 16]]


def test_tokens_of_odd_rows(spark, odd):
    rows = run(spark, "op8_byte_bpe", odd)
    assert {(r.n_tokens, r.ids_sha256) for r in rows if r.doc_id in (2, 3)} == {(0, brute.sha(""))}


def test_languages(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op9_language_id")}
    some = brute.languages(documents, language.PROFILE)
    for (id_, _, _), (lang, score) in zip(documents, some, strict=True):
        assert rows[id_].lang_pred == lang
        assert rows[id_].score == pytest.approx(score)
        assert rows[id_].held_out == (brute.third(id_) == 1)
    held = [(lang, rows[id_].lang_pred) for id_, _, lang in documents if rows[id_].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_languages_of_odd_rows(spark, odd):
    rows = run(spark, "op9_language_id", odd)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 9, 10)} == {"und"}
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert {r.lang_pred for r in rows} <= {"und", "en", "de", "fr"}


def test_contamination_of_odd_rows(spark, odd):
    rows = {}
    for row in run(spark, "op10_decontaminate", odd):
        rows.setdefault(row.doc_id, []).append(row)
    first, second = rows[None]
    assert first == second
    assert (first.n_words, first.n_hit, first.n_items, first.items_sha256) == (20, 10, 1, brute.sha("1"))
    # A short item counts as a whole, an item without id adds words but no id.
    assert (rows[1][0].n_hit, rows[1][0].items_sha256) == (2, brute.sha("4"))
    assert sorted((r.n_hit, r.n_items) for r in rows[8]) == [(0, 0), (5, 0)]
    assert (rows[2][0].n_words, rows[2][0].contaminated, rows[2][0].items_sha256) == (0, False, brute.sha(""))


def test_vocabulary_is_a_perfect_hash():
    vocabulary = bpe.load(queries.VOCABULARY)
    tokens = vocabulary.flat.tobytes()
    bounds = vocabulary.offsets.tolist()
    every = [tokens[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    assert sorted(vocabulary.ids.tolist()) == list(range(len(every)))
    assert bpe.whole_tokens(vocabulary, every).tolist() == list(range(len(every)))
    assert bpe.whole_tokens(vocabulary, [b"\x00\x01\x02\x03", b"qzqzqzqz"]).tolist() == [-1, -1]


def test_trie_join_splits_large_groups(spark):
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 62, 40, np.int64)[rng.integers(0, 40, 400)] ^ (1 << rng.integers(0, 62, 400)))
    frame = spark.createDataFrame([(int(p),) for p in prints], "fp bigint")

    def trees(group):
        found = [(r.a, r.b) for r in simhash.links(frame, 2, group).collect()]
        parent = {int(p): int(p) for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in found:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return {p: find(p) for p in parent}

    want = brute.groups([int(p) for p in prints])
    assert trees(100_000) == trees(3) == {int(p): int(prints[w]) for p, w in zip(prints, want, strict=True)}


def test_languages_of_all_letters_at_once():
    """More letters than fit beside the numbers of many texts: the same counts, a few texts at a time."""
    every = "".join(c for c in map(chr, range(0x30000)) if c.isalpha() and c == c.lower())
    texts = [every] + ["abc"] * 255 + [None, ""]
    owner, gram, n = language.counted(texts)
    alone = [language.counted([text]) for text in (every, "abc")]
    for text, (_, own, count) in zip((0, 200), alone, strict=True):
        assert sorted(zip(gram[owner == text].tolist(), n[owner == text].tolist(), strict=True)) == sorted(zip(own.tolist(), count.tolist(), strict=True))
    assert set(owner.tolist()) == set(range(256))


def test_round_trip_of_one_step(spark, documents):
    """Ids and their check in one step are those of the two steps, also of null, empty and odd texts."""
    vocabulary = bpe.load(queries.VOCABULARY)
    pattern = queries.public_tokenizers.PATTERN
    texts = [(None,), ("",), ("à \U0001f600'll  \n",)] + [(t,) for _, t, _ in documents[:50]]
    frame = spark.createDataFrame(texts, "text string").repartition(3)
    one = frame.select("text", bpe.round_trip(F.col("text"), vocabulary, pattern).alias("c")).select("text", "c.*")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    two = {r.text: bytes(r.ids) for r in frame.select("text", bpe.encode(F.col("text"), vocabulary, pattern).alias("ids")).collect()}
    rows = one.collect()
    assert len(rows) == len(texts)
    assert all(r.intact and bytes(r.token_ids) == two[r.text] for r in rows)
