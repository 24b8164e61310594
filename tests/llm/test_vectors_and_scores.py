"""Clustering, whitening and language-model scores against brute force, exact laws, and on odd tables."""

import hashlib
import itertools
import math
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from odd_tables import CLASHING, FOLDER
from pyspark.sql import functions as F

from marquee.llm import batches, centroids, pitman_yor, queries, whitening

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors():
    return duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()


# --- clustering ---


def lloyd(points, start, rounds):
    """Every vector against every centroid, in whole numbers."""
    centers = [list(c) for c in start]
    for round_ in range(rounds + 1):
        apart = [[sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centers] for x in points]
        labels = [row.index(min(row)) for row in apart]
        if round_ == rounds:
            return labels, [min(row) for row in apart], centers
        for j in range(len(centers)):
            own = [x for x, label in zip(points, labels, strict=True) if label == j]
            if own:
                centers[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]


@pytest.mark.parametrize("block", [3, centroids.BLOCK])
@pytest.mark.parametrize("spread", [3, 1000, 2**24])
def test_clusters_of_many_ties(spark, monkeypatch, spread, block):
    """Few and repeated values, so that distances tie and clusters run empty; large ones need 64 bits."""
    monkeypatch.setattr(centroids, "BLOCK", block)
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (300, 4)).tolist()
    points += points[:50] + [points[0]] * 50
    frame = spark.createDataFrame(list(enumerate(points)), "id bigint, x array<bigint>").repartition(5)
    start = np.array(points[:7] + [points[0]], np.int64)
    found, final = centroids.clustered(frame, start, 6)
    labels, distances, centers = lloyd(points, start.tolist(), 6)
    assert [(r.cluster, r.distance) for r in found.orderBy("id").collect()] == list(zip(labels, distances, strict=True))
    assert final.tolist() == centers


def test_only_expired_vectors_are_scanned_again(monkeypatch):
    """Far clusters that hardly move: after the first scan the heaps give nothing away."""
    rng = np.random.default_rng(5)
    centers = np.array([[0, 0], [10_000, 0], [0, 10_000]])
    points = (centers[rng.integers(0, 3, 900)] + rng.integers(-50, 50, (900, 2))).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(points.tolist())], ["id", "x"])
    (block,) = centroids._opened(iter([batch]), centers)
    seen = []
    scan = centroids.scan
    monkeypatch.setattr(centroids, "scan", lambda p, c: seen.append(len(p)) or scan(p, c))
    list(centroids._round(iter([block]), centers + 3, np.full(3, 12.0)))
    assert seen == []
    list(centroids._round(iter([block]), centers + 3, np.full(3, 9_900.0)))
    assert 0 < sum(seen) < 900


def test_query_equals_lloyd(spark, vectors):
    points = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    order = sorted(points, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    labels, distances, centers = lloyd(list(points.values()), [points[i] for i in order[:40]], 5)
    rows = {r.vec_id: r for r in queries.op11_heap_clusters(spark, FOLDER).collect()}
    assert len(rows) == len(points)
    for i, j, d in zip(points, labels, distances, strict=True):
        assert (rows[i].cluster, rows[i].distance) == (j, d)
        assert rows[i].centroid_sha256 == hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()
    assert {r.inertia for r in rows.values()} == {sum(distances)}


ODD_VECTORS = [
    (1, [0.5] * 64),
    (1, [0.5] * 64),
    (2, None),
    (3, []),
    (4, [0.25] * 63),
    (5, [0.25] * 63 + [None]),
    (6, [0.25] * 63 + [NAN]),
    (7, [0.25] * 63 + [-INF]),
    (None, [-0.5] * 63 + [2.0]),
    (9, [0.0] * 63 + [1e-9]),
]


@pytest.fixture(scope="module")
def odd_vectors(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd-vectors")
    frame = spark.createDataFrame(ODD_VECTORS, "vec_id bigint, embedding array<float>").repartition(4)
    crowd = [F.lit(i).alias(name) for i, name in enumerate([*CLASHING, "x", "cluster", "points", "white", "context", "symbol"])]
    frame.select("*", *crowd).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], frame.schema).write.parquet(f"{folder}/none/embeddings.parquet")
    return str(folder)


def test_odd_vectors(spark, odd_vectors):
    rows = queries.op11_heap_clusters(spark, odd_vectors).collect()
    # Three different vectors, each its own centroid; copies share the first one.
    assert sorted((r.vec_id is None, r.vec_id, r.distance) for r in rows if r.vec_id) == [(False, 1, 0), (False, 1, 0), (False, 9, 0)]
    assert len(rows) == 4 and len({r.cluster for r in rows}) == 3
    rows = queries.op13_spectrum_whitening(spark, odd_vectors).collect()
    assert len(rows) == 4 * 32 and {r.n for r in rows} == {4}
    # Four vectors, three of them different, span two dimensions; the others have no deviation.
    assert all((r.whitened is None) == (r.component > 2) for r in rows)
    assert rows[0].identity_error < 1e-9
    for query in (queries.op11_heap_clusters, queries.op13_spectrum_whitening):
        assert query(spark, f"{odd_vectors}/none").collect() == []


def test_components_that_do_not_fit_are_an_error(spark):
    frame = spark.createDataFrame([(1, [3e9, 1.0]), (2, [0.0, 1.0])], "id bigint, v array<double>")
    kept = centroids.kept(frame, "id", "v", 2, 1)
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(kept, np.zeros((1, 2), np.int64), 1)[0].collect()


# --- whitening ---


def test_whitening_against_a_dense_solver(spark, vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors], np.int64)
    n, total = len(x), x.sum(0)
    centred = (x - 1_000_000) - (total - n * 1_000_000) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    expected = centred @ axes[:, :32] / np.sqrt(values[:32])
    rows = queries.op13_spectrum_whitening(spark, FOLDER).collect()
    assert len(rows) == 32 * n
    own = np.zeros((n, 32))
    place = {i: k for k, (i, _) in enumerate(vectors)}
    for r in rows:
        own[place[r.vec_id], r.component - 1] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
        assert r.n == n and r.identity_error < 1e-9
    signs = np.sign((own * expected).sum(0))
    assert np.abs(own * signs - expected).max() < 1e-8
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for (i, _), row in zip(vectors, x, strict=True)}
    assert {r.vec_id: r.deviation for r in rows} == exact


def test_covariance_is_exact_far_from_zero(spark):
    rng = np.random.default_rng(2)
    points = rng.integers(-3, 4, (500, 3)).astype(object) + 10**12
    frame = spark.createDataFrame([(i, [int(a) for a in p]) for i, p in enumerate(points)], "id bigint, x array<bigint>").repartition(7)
    n, total = whitening.sums(frame)
    matrix, _ = whitening.covariance(frame, n, total)
    for i, j in itertools.product(range(3), repeat=2):
        exact = Fraction(int((points[:, i] * points[:, j]).sum()), n) - Fraction(total[i] * total[j], n * n)
        assert matrix[i, j] == float(exact)


def test_inertia_counts():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 20):
        a = rng.normal(size=(d, d))
        a = (a + a.T) / 2
        values = np.linalg.eigvalsh(a)
        for shift in [-10, *(values[:-1] + values[1:]) / 2, 10]:
            assert whitening.count_above(a, shift) == (values > shift).sum()
    assert whitening.count_above(np.array([[0.0, 1], [1, 0]]), 0) == 1


@pytest.mark.parametrize("values", [[9, 4, 1], [5, 5, 5, 3, 3, 1, 0, 0], [1, 1 + 1e-14, 1 + 2e-14, 0.5], [7], [1e-8, 1, 1e8], [0, 0]])
def test_leading_eigenvectors(values):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    matrix = (q * np.array(values, float)) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, axes = whitening.leading(matrix, 32)
    top = max(values) or 1
    assert np.abs(found - sorted(values, reverse=True)).max() < 1e-12 * top
    assert np.abs(axes @ axes.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ axes.T - axes.T * found).max() < 1e-12 * top


# --- language model ---


def split(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        words = words.replace(space, " ")
    return [w for w in words.split(" ") if w] + [None]


def test_base_scores(spark, documents):
    learn = Counter(t for i, text, _ in documents if zlib.crc32(str(i).encode()) % 7 != 2 for t in split(text))
    n, v = sum(learn.values()), len(learn)
    rows = {r.doc_id: r for r in queries.op12_pitman_yor(spark, FOLDER).collect()}
    assert len(rows) == len(documents)
    for i, text, _ in documents:
        own = split(text)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(own), n)
        assert r.n_known == sum(learn[t] > 0 for t in own)
        assert r.base_score == pytest.approx(sum(math.log10((learn[t] + 1) / (n + v + 1)) for t in own), rel=1e-10)
    held = [r for r in rows.values() if r.held_out]
    # Texts that weren't learnt from are more probable than token by token.
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def every_path(c, base, parent, d):
    """The law of the number of tables of one dish, from all ways in which its customers can sit."""
    law = Counter()
    for opens in itertools.product([0, 1], repeat=c - 1):
        k, weight = 1, base * parent
        for i, opened in enumerate(opens, 1):
            weight *= (base + d * k) * parent if opened else i - d * k
            k += opened
        law[k] += weight
    return {k: w / sum(law.values()) for k, w in law.items()}


def test_seats_follow_the_exact_law():
    n, (base, parent, d) = 100_000, (3.0, 0.4, 0.5)
    c = np.full(n, 6)
    seats = None
    for round_ in range(8):
        seats = pitman_yor.seated(np.arange(n), seats, c, np.full(n, base), np.full(n, parent), d, round_)
    for k, share in every_path(6, base, parent, d).items():
        assert (seats.t == k).mean() == pytest.approx(share, abs=0.006)


def test_seats_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    keys, c = rng.integers(0, 1 << 60, 200), rng.integers(1, 400, 200)
    base, parent = rng.uniform(1, 50, 200), rng.uniform(0.001, 0.9, 200)
    whole = pitman_yor.seated(keys, None, c, base, parent, 0.4, 3)
    later = pitman_yor.seated(keys, whole, c, base, parent, 0.4, 4)
    for part in (slice(0, 7), slice(7, 200)):
        first = pitman_yor.seated(keys[part], None, c[part], base[part], parent[part], 0.4, 3)
        assert first.sizes.tolist() == whole.sizes[part].tolist()
        assert pitman_yor.seated(keys[part], first, c[part], base[part], parent[part], 0.4, 4).sizes.tolist() == later.sizes[part].tolist()
    assert (whole.t <= c).all() and (later.opened >= 1).all()


def test_log_gamma():
    x = np.array([1e-9, 0.1, 0.99, 1, 2, 9.99, 10, 77.7, 1e12])
    assert pitman_yor.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)


TEXTS = ["a b c a b", "b c d", "a a a a b", "c", "", None, "d e f a b c", "the end of a b", "x y z", "a b"] * 3


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string").repartition(3)


def scores(small, probe=None, **options):
    model = pitman_yor.learnt(small.select("text"), **options)
    rows = pitman_yor.scored(small if probe is None else probe, "text", model, ["id"]).collect()
    return {r.kept.id: r for r in rows}


@pytest.mark.parametrize("words", [0, 3, 100])
def test_probabilities_add_up(spark, small, words):
    """Over all symbols after any context, and over all words of a class with the unknown one among them."""
    classes = 2
    model = pitman_yor.learnt(small.select("text"), words=words, classes=classes)
    size, gains = model.lexicon.size, dict(zip(model.pairs.tolist(), model.pair_gains.tolist(), strict=True))

    def after(context, symbol):
        default = float(model.pair_default(np.array([context]), np.array([symbol]))[0])
        return default * 10 ** gains.get(context * size + symbol, 0.0)

    for context in range(size + 1):
        assert sum(after(context, s) for s in range(size)) == pytest.approx(1, rel=1e-9)
    vocabulary = {w for text in TEXTS for w in split(text) if w}
    # An unknown word in each class.
    vocabulary.update({pitman_yor.tokens(pa.array([w]), classes).classes[0]: w for w in map(str, range(10, 99))}.values())
    probe = spark.createDataFrame([(w, w) for w in vocabulary], "id string, text string")
    within = Counter()
    for r in pitman_yor.scored(probe, "text", model, ["id"]).collect():
        _, symbol, _ = model.lexicon.read(pitman_yor.tokens(pa.array([r.kept.id]), classes))
        # P(word) is P(symbol | start) P(word | class) P(end | symbol)
        within[int(symbol[0])] += 10**r.score / after(size, symbol[0]) / after(symbol[0], 0)
    assert set(within) >= {size - 2, size - 1}
    assert list(within.values()) == pytest.approx([1.0] * len(within), rel=1e-9)


def test_what_tasks_know_does_not_change_scores(small):
    plain = scores(small, words=2, classes=3)
    for options in ({"most_pairs": 0}, {"most_pairs": 5}, {"most_words": 6}):
        other = scores(small, words=2, classes=3, **options)
        assert {i: r.score for i, r in other.items()} == pytest.approx({i: r.score for i, r in plain.items()}, rel=1e-12)
        assert {i: r.base_score for i, r in other.items()} == pytest.approx({i: r.base_score for i, r in plain.items()}, rel=1e-12)
        assert {i: r.n_known for i, r in other.items()} == {i: r.n_known for i, r in plain.items()}


@pytest.mark.parametrize("kind", [np.uint64, np.int64])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 1025])
def test_places_of_numbers(n, kind):
    """Numbers in a row, spread ones, and ones with equal places in the table, which clash."""
    rng = np.random.default_rng(n)
    inverse = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    clashing = [(i * inverse) % (1 << 64) for i in range(2 * n)]
    for numbers in (range(2 * n), clashing, rng.choice(1 << 62, 2 * n, replace=False).tolist(), [(1 << 64) - 1 - i for i in range(2 * n)]):
        every = rng.permutation(np.array(list(numbers), np.uint64)).view(kind)
        keys, place = every[:n], {int(k): i for i, k in enumerate(every[:n])}
        found = batches.Places(keys).of(np.concatenate([every, every]))
        assert found.tolist() == [place.get(int(k), -1) for k in every] * 2


def test_words_and_pairs_are_not_searched_for(small, monkeypatch):
    """Tokens are looked up in steps that don't grow with what a task knows."""
    model = pitman_yor.learnt(small.select("text"), words=4, classes=3)
    texts = pa.array(["a b c zz a", "d e"])
    plain = pitman_yor.tokens(texts, 3)
    expected = [model.lexicon.keys.tolist().index(k) if k in model.lexicon.keys else -1 for k in plain.keys]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), texts, pa.StructArray.from_arrays([pa.array([0, 1])], ["id"])], ["row", "text", "kept"])
    search, needles = np.searchsorted, []
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *args, **kw: needles.append(np.ravel(a)) or search(a, v, *args, **kw))
    assert model.lexicon.read(plain)[0].tolist() == expected
    list(pitman_yor._scorer(model)(iter([batch])))
    assert not any(np.array_equal(a, known) for a in needles for known in (model.lexicon.keys, model.pairs))
    # Tables are made by a task, not sent to it.
    assert not {"_places", "_symbols"} & set(model.lexicon.__getstate__())


def test_rounds_hand_seats_on_as_bytes():
    """Three rounds over rows in batches of all sizes are those over seats that are kept as they are."""
    rng = np.random.default_rng(5)
    n, n_contexts, classes = 300, 20, 4
    keys, c = rng.choice(1 << 60, n, replace=False), rng.integers(2, 60, n)
    context, symbol = rng.integers(0, n_contexts, n), rng.integers(0, 9, n)
    in_class = np.arange(n) % 3 == 0
    context[in_class], symbol[in_class] = n_contexts + rng.integers(0, classes, in_class.sum()), -1
    tables, level = rng.integers(60, 90, n_contexts + classes), rng.uniform(0.01, 0.2, 9)
    d, sizes = np.array([0.4, 0.6]), rng.integers(5, 9, classes)
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(context, pa.int32()), pa.array(symbol, pa.int32()), pa.array(c)], ["key", "context", "symbol", "c"])
    parent = np.where(in_class, 1 / (sizes[np.maximum(context - n_contexts, 0) % classes] + 1), level[symbol])
    state, plain, total = [rows], None, np.zeros(n, np.int64)
    for round_ in range(3):
        step = pitman_yor._Sweep(1.0, d, n_contexts, tables, level, sizes, round_, round_ >= 1)
        state = [out.slice(i, 77) for out in step.run(iter(state)) for i in range(0, out.num_rows, 77)]
        t, both = np.ones(n, np.int64) if plain is None else plain.t, {}
        for kind in (False, True):
            own = np.flatnonzero(in_class == kind)
            base = 1.0 + d[int(kind)] * (tables[context[own]] - t[own])
            new = pitman_yor.seated(keys[own], plain and pitman_yor._picked(plain, own), c[own], base, parent[own], d[int(kind)], round_)
            both.update(zip(own.tolist(), np.split(new.opened, np.cumsum(new.sizes)[:-1]), strict=True))
        plain = pitman_yor.Seats(c, np.concatenate([both[i] for i in range(n)]), np.array([len(both[i]) for i in range(n)]))
        total += plain.t * (round_ >= 1)
    out = pa.Table.from_batches(state)
    assert [np.frombuffer(x, np.int64).tolist() for x in out["opened"].to_pylist()] == [both[i].tolist() for i in range(n)]
    assert out["t"].to_pylist() == plain.t.tolist() and out["tables"].to_pylist() == total.tolist()


def one_by_one(texts, rounds, seed, d=0.5):
    """Plain Gibbs sampling, a customer at a time, of the same two levels; strength one."""
    import random

    draw = random.Random(seed)
    symbols = sorted({str(t) for text in texts for t in split(text)})
    seats, parent = {}, {}  # (context, dish) -> table sizes; dish -> table sizes in the parent

    def chance(tables, dish, below):
        own, all_ = tables.get(dish, []), [n for sizes in tables.values() for n in sizes]
        return (sum(own) - d * len(own) + (1 + d * len(all_)) * below) / (1 + sum(all_))

    def enter(tables, dish, below):
        own, n_tables = tables.setdefault(dish, []), sum(len(s) for s in tables.values())
        weights = [n - d for n in own] + [(1 + d * n_tables) * below]
        place = draw.choices(range(len(weights)), weights)[0]
        if place == len(own):
            own.append(0)
        own[place] += 1
        return own[place] == 1

    def leave(tables, dish):
        own = tables[dish]
        place = draw.choices(range(len(own)), own)[0]
        own[place] -= 1
        if not own[place]:
            del own[place]
            return True
        return False

    level = 1 / len(symbols)
    pairs = [(str(a), str(b)) for text in texts for a, b in zip(["start", *split(text)], split(text), strict=False)]
    total = Counter()
    for round_ in range(rounds):
        for a, b in pairs:
            own = seats.setdefault(a, {})
            if round_ and leave(own, b):
                leave(parent, b)
            if enter(own, b, chance(parent, b, level)):
                enter(parent, b, level)
        if round_ >= rounds // 2:
            for a, b in set(pairs):
                total[a, b] += chance(seats[a], b, chance(parent, b, level)) / (rounds - rounds // 2)
    return [sum(math.log10(total[str(a), str(b)]) for a, b in zip(["start", *split(t)], split(t), strict=False)) for t in texts]


def test_scores_are_those_of_plain_gibbs_sampling(small, monkeypatch):
    monkeypatch.setattr(pitman_yor, "discount", lambda ones, twos: 0.5)
    n_symbols = len({str(t) for text in TEXTS for t in split(text)})
    # As many symbols as words, so that both have the same lowest level; one class stays empty.
    own = scores(small, words=n_symbols - 1, classes=1, burn_in=5, samples=40)
    plain = one_by_one(TEXTS, 400, 1)
    # The empty class is one more symbol at the lowest level.
    assert sum(own[i].score for i in range(len(TEXTS))) == pytest.approx(sum(plain), rel=0.02)
    for i in range(len(TEXTS)):
        assert own[i].score == pytest.approx(plain[i], rel=0.1, abs=0.05)


def test_odd_texts(spark, odd):
    rows = queries.op12_pitman_yor(spark, odd).collect()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].n_tokens == by_id[3].n_tokens == by_id[9].n_tokens == 1
    assert by_id[2].score == by_id[3].score < 0
    repeated = [r for r in rows if r.doc_id == 7]
    assert len(repeated) == 2 and repeated[0].score == repeated[1].score
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)


def test_nothing_to_learn_from(spark, small):
    model = pitman_yor.learnt(small.select("text").where("false"), words=10, classes=4)
    rows = pitman_yor.scored(small, "text", model, ["id"]).collect()
    # Five symbols, and one word in each class.
    assert {round(10 ** (r.score / r.n_tokens), 9) for r in rows} == {0.2}
    assert all(r.base_score == 0 and r.n_known == 0 for r in rows)
