"""The registered queries over the operators of this package, and their SQL.

Each query applies its operator with production parameters to the whole of its table. What
the operators return in full (texts, ids, spans) is reduced to digests here.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm import (
    bpe,
    centroids,
    chat,
    decontaminate,
    language,
    licences,
    lines,
    pages,
    phrases,
    pitman_yor,
    resample,
    simhash,
    whitening,
)
from marquee.scratch import written

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation's turns, their roles recovered by a model learnt from two thirds of them."""
    rows = table(spark, folder, "conversations")
    third = "crc32(cast(cast(conv_id as string) as binary)) % 3"
    blocks = chat.in_blocks(rows, "conv_id", "turn", "text", "role", f"{third} != 1")
    found = chat.formatted(blocks, chat.learnt(blocks))
    return found.select(
        F.col("conversation").alias("conv_id"),
        F.col("order").alias("turn"),
        "part",
        F.coalesce(F.crc32(F.col("conversation").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        "role_given",
        "role",
        "rendered",
    )


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's fingerprint against its edited text's and the next document's."""
    found = phrases.against_next(table(spark, folder, "documents"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


def op3_quality_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's importance weight against the well labelled ones, and whether it is drawn."""
    rows = resample.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
    scores = written(rows.select("row.doc_id", "log_weight", "n_grams", "mean", "key"))
    least = resample.drawn(scores)
    kept = F.lit(False) if least is None else F.col("key") >= F.lit(least)
    return scores.select("doc_id", "log_weight", "n_grams", F.col("key").alias("draw_key"), kept.alias("kept"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the runs of lines that came before."""
    found = lines.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.col("kept").alias("text"))


def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and the component of near-duplicates it is in."""
    found = simhash.grouped(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The licences that every document names or quotes."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    every = licences.templates()
    found = licences.index(every, licences.document_frequencies(documents, "text", every))
    scan = documents.select("doc_id", licences.scanned(F.col("text"), found).alias("s"))
    base = F.filter("s.matches", lambda m: m["exact"])

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return scan.select(
        "doc_id",
        "s.n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("s.matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("s.matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op7_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    every = table(spark, folder, "pages")
    text = pages.extracted(F.col("html"), pages.fitted(every))
    return every.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again."""
    vocabulary = bpe.load(VOCABULARY)
    ids = bpe.encode(F.col("text"), vocabulary, public_tokenizers.PATTERN)
    return (
        table(spark, folder, "documents")
        .select("doc_id", ids.alias("ids"))
        .select("doc_id", "ids", bpe.decode(F.col("ids"), vocabulary).alias("decoded"))
        .select(
            "doc_id",
            (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
            F.sha2("ids", 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256"),
        )
    )


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text, learnt from two thirds of the documents.

    A document without id is neither held out nor learnt from.
    """
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    known = language.profiles(documents.where(third != 1), "text", "lang")
    found = language.predicted(F.col("text"), known)
    return documents.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score"
    )


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """What every document shares with the benchmark items."""
    found = decontaminate.scanned(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "row.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


CENTROIDS, COMPONENTS, ROUNDS, SCALE = 40, 64, 5, 256


def op11_heap_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's cluster after five rounds from forty vectors chosen by their hash."""
    vectors = centroids.kept(table(spark, folder, "embeddings"), "vec_id", "embedding", COMPONENTS, SCALE)
    chosen = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    assigned, final = centroids.clustered(vectors, centroids.first_centroids(vectors, CENTROIDS, chosen), ROUNDS)
    assigned = written(assigned)
    texts = F.array(*[F.lit(",".join(map(str, centroid))) for centroid in final.tolist()]).cast("array<string>")
    inertias = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertias = inertias.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(1))))
    # A row for each centroid.
    return assigned.join(F.broadcast(inertias), "cluster").select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2(F.get(texts, F.col("cluster")), 256).alias("centroid_sha256"),
    )


def op12_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's probability under a hierarchical Pitman-Yor model learnt from six sevenths of them.

    A document without id is neither held out nor learnt from.
    """
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    documents = table(spark, folder, "documents").select(
        "doc_id", "text", F.coalesce(seventh == 2, F.lit(False)).alias("held_out"), F.coalesce(seventh != 2, F.lit(False)).alias("learn")
    )
    model = pitman_yor.learnt(documents.where("learn").select("text"))
    found = pitman_yor.scored(documents, "text", model, ["doc_id", "held_out"])
    return found.select(
        "kept.doc_id", "kept.held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def op13_spectrum_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector along the 32 leading principal components, in units of their deviation."""
    vectors = whitening.kept(table(spark, folder, "embeddings"), "vec_id", "embedding", 64, 1_000_000)
    return whitening.whitened(vectors, 32).withColumnRenamed("id", "vec_id")


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP10 = f"""
WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         array_to_string(list_slice(w, i, i + 9), ' ') AS words
  FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT d.doc_id, d.i, n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
        FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS p(i)) AS d
  JOIN windows USING (n, words)),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items
  FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


_OP4 = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, i - 1 AS pos, lines[i] AS line,
         least(50, len(regexp_extract_all(lines[i], '[^ \t\r\f\x0B]+'))) AS w
  FROM split, unnest(range(1, len(lines) + 1)) AS p(i)),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k,
         coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM lines WHERE w > 0),
used AS (
  SELECT doc_id, list(line ORDER BY pos) AS words, list(pos ORDER BY pos) AS places FROM counted GROUP BY doc_id),
windows AS (
  SELECT doc_id, k, max(k) OVER ahead AS last
  FROM counted
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  QUALIFY sum(w) OVER ahead >= 50),
-- A run that goes on is made of the next window too.
longer AS (
  SELECT doc_id, k, last, lead(last) OVER (PARTITION BY doc_id ORDER BY k) AS following FROM windows),
runs AS (
  SELECT doc_id, k, y, words, places
  FROM longer JOIN used USING (doc_id), unnest(range(last, coalesce(following, len(words)) + 1)) AS p(y)),
later AS (
  SELECT doc_id, places[k] AS first, places[y] AS last FROM runs
  QUALIFY row_number() OVER (PARTITION BY array_to_string(words[k:y], chr(10)) ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(n, 0) AS n_removed,
       CASE WHEN lines IS NOT NULL THEN coalesce(text, '') END AS text
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""


def _sql_clusters() -> str:
    """Lloyd's rounds, one after the other: the nearest centroid of each vector, then the means."""
    steps = [
        f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {COMPONENTS}),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS j, x AS m FROM kept
  QUALIFY j < {CENTROIDS})"""
    ]
    nearest = """
a{0} AS MATERIALIZED (
  SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d
  FROM (SELECT r, j, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{0})
  GROUP BY r)"""
    means = """
c{1} AS MATERIALIZED (
  SELECT j, coalesce(mean, m) AS m
  FROM c{0} LEFT JOIN (
    SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS mean
    FROM (SELECT a{0}.j, i, sum(x[i]) AS s, count(*) AS n
          FROM a{0} JOIN kept USING (r), unnest(range(1, len(x) + 1)) AS p(i) GROUP BY a{0}.j, i)
    GROUP BY j) USING (j))"""
    for i in range(ROUNDS):
        steps += [nearest.format(i), means.format(i, i + 1)]
    steps.append(nearest.format(ROUNDS))
    return (
        ",".join(steps)
        + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} USING (j)"""
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in [op1_chat_turns, op2_fingerprints, op3_quality_resample, op4_line_dedup, op5_simhash_dedup, op6_license_scan, op7_html_extract, op8_byte_bpe, op9_language_id, op10_decontaminate, op11_heap_clusters, op12_pitman_yor, op13_spectrum_whitening]}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": _OP4, "op10_decontaminate": _OP10, "op11_heap_clusters": _sql_clusters()}
