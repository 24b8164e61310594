"""Fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases into longer phrases, and so on. Where a phrase
ends is decided by deterministic coin tossing: every symbol gets a label from the lowest bit
in which it differs from its left neighbour, a few rounds of which leave labels below eight,
and the symbols whose label is larger than both neighbours' open a phrase. Runs of one symbol
are a symbol of their own first, so neighbours always differ. A decision looks at a few
symbols around, so equal passages are cut alike wherever they stand, and only the phrases at
their ends depend on what is around them. A phrase's name is a hash of its symbols' names.

A text's fingerprint has the hashes of all names at one level and above in hexadecimal, in order, a
phrase that recurs having a hash for each time. So it grows with the text, by about a name for each
ten characters. The likeness of two fingerprints is the share of all their phrases that they have in
common, and depends on the two strings alone.

Null and empty texts have an empty fingerprint. A text too short for the level has the name of
the whole text. Equal texts have equal fingerprints; two empty ones are alike (1), an empty and
another one are not (0).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from marquee.llm.batches import SpanHash, mixed, text_udf

LEVEL = 3
CHUNK = 1 << 19
BLOCKS_PER_TASK = 4


def _toss_table(size: int) -> np.ndarray:
    """The next label for a label (row) and its left neighbour's (column)."""
    own, left = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    apart = own ^ left
    place = np.bitwise_count((apart & -apart) - 1)
    return np.where(apart == 0, 0, 2 * place + (own >> place & 1)).astype(np.uint8)


_TOSS = _toss_table(128)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below eight, neighbours of one text having different ones."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    # The first symbol of a text has no left neighbour: its lowest bit decides.
    left[first] = ~symbols[first]
    apart = symbols ^ left
    low = (apart & (~apart + symbols.dtype.type(1))) - symbols.dtype.type(1)
    place = np.bitwise_count(low)
    labels = (place * np.uint8(2)) + ((symbols >> place.astype(symbols.dtype)) & symbols.dtype.type(1)).astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[first] = labels[first] ^ np.uint8(1)
        labels = _TOSS[labels, before]
    return labels


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases, and which of them open a text.

    ``first`` are the places at which the texts start; no text is empty.
    """
    starts = np.ones(len(symbols), bool)
    starts[1:] = symbols[1:] != symbols[:-1]
    starts[first] = True
    if not starts.all():
        places = np.flatnonzero(starts)
        length = np.diff(np.append(places, len(symbols))).astype(np.uint64)
        names = symbols[places].astype(np.uint64)
        names = np.where(length > 1, mixed(names ^ (length * np.uint64(0xA24BAED4963EE407))), names)
        first = np.searchsorted(places, first)
        symbols = names
    labels = _labels(symbols, first)
    opens = np.zeros(len(labels), bool)
    opens[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    # The last symbol of a text never opens a phrase, the first always does.
    last = np.append(first[1:], len(symbols)) - 1
    opens[last] = False
    opens[first] = True
    # The comparison above looked across the border of two texts only at their ends.
    places = np.flatnonzero(opens)
    names = SpanHash(symbols).of(places, np.append(places[1:], len(symbols)))
    return names, np.searchsorted(places, first)


def names(texts: list[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases at a level and above: the text's number and the name; none for empty texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    used = np.flatnonzero(sizes)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = (np.cumsum(sizes) - sizes)[used]
    owners, found = [], []
    depth = 0
    while len(used):
        symbols, first = parse(symbols, first)
        depth += 1
        count = np.diff(np.append(first, len(symbols)))
        whole = count == 1
        if depth >= level:
            owners.append(np.repeat(used, count))
            found.append(symbols)
        else:
            owners.append(used[whole])
            found.append(symbols[first[whole]])
        # What is one phrase by now is done.
        keep = np.repeat(~whole, count)
        symbols, used, count = symbols[keep], used[~whole], count[~whole]
        first = np.cumsum(count) - count
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def sketches(texts: list[str], level: int = LEVEL) -> list[np.ndarray]:
    """The hashes of each text's phrases, ascending, of 44 bits each."""
    owner, name = names(texts, level)
    # Phrases that recur in a text are told apart by how often they came before.
    bits = np.uint64(20)
    keys = np.sort(owner.astype(np.uint64) << (np.uint64(64) - bits) | name >> bits)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    owner = keys >> (np.uint64(64) - bits)
    name = (keys << bits) + times.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    keys = np.unique(owner << (np.uint64(64) - bits) | mixed(name) >> bits)
    owner = keys >> (np.uint64(64) - bits)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1, dtype=np.uint64))
    keys &= np.uint64((1 << 44) - 1)
    return [keys[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def shortened(sketch: np.ndarray) -> np.ndarray:
    """The upper 32 bits of each hash, ascending, each once."""
    short = sketch >> np.uint64(12)
    return short[np.append(np.ones(min(1, len(short)), bool), short[1:] != short[:-1])].astype(np.uint32)


def written_out(short: np.ndarray) -> str:
    """The fingerprint as text."""
    return short.astype(">u4").tobytes().hex()


def read_in(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common hashes among those of both; each array is ascending and without repeats."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs are merged
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return n / (len(both) - n)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) >= CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    yield start, len(texts)


def fingerprints(texts: list[str], level: int = LEVEL) -> list[np.ndarray]:
    return [shortened(s) for a, b in _chunks(texts) for s in sketches(texts[a:b], level)]


def fingerprint(text: Column, level: int = LEVEL) -> Column:
    def work(texts: pa.Array) -> pa.Array:
        return pa.array([written_out(p) for p in fingerprints([t or "" for t in texts.to_pylist()], level)], pa.string())

    return text_udf(lambda: work, "string")(text)


def likeness(a: Column, b: Column) -> Column:
    """What share of their phrases two texts have in common, 0 to 1, from their fingerprints."""

    def work(first: pa.Array, second: pa.Array) -> pa.Array:
        pairs = zip(first.to_pylist(), second.to_pylist(), strict=True)
        return pa.array([alike(read_in(x or ""), read_in(y or "")) for x, y in pairs], pa.float64())

    work.__annotations__ = {"first": pa.Array, "second": pa.Array, "return": pa.Array}
    return arrow_udf(work, "double")(a, b)


def in_blocks(rows: DataFrame, order: str, text: str) -> DataFrame:
    """The rows in blocks along ``order``, each followed by a copy of what comes next.

    ``id, text, tail`` in sorted partitions that hold whole blocks: first a block's rows, then,
    marked as ``tail``, those that open the next block (after the last: the first). Null ids
    come first, rows with one id go by text. The borders are the least ids of the partitions
    of a sort by range, so only one id for each partition is collected. There are a few
    blocks for each task, so that tasks get about as many rows each.
    """
    rows = rows.select(F.col(f"`{order}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("id").repartitionByRange(n * BLOCKS_PER_TASK, "id").groupBy(F.spark_partition_id().alias("p"))
    firsts = ids.agg(F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()
    borders = sorted(row.least for row in firsts if row.least is not None)
    last = max(0, len(borders) - 1)
    first = None if any(row.nulls for row in firsts) or not borders else borders[0]

    def places(keys: pa.Array) -> pa.Array:
        """For each id its own block, and those that it follows as the next row."""
        out = []
        for key in keys.to_pylist():
            block = 0 if key is None else max(0, bisect_right(borders, key) - 1)
            own = [(block, False)]
            if block and key == borders[block]:
                own.append((block - 1, True))
            if key == first:
                own.append((last, True))
            out.append([{"block": b, "tail": t} for b, t in own])
        return pa.array(out, pa.list_(pa.struct([("block", pa.int32()), ("tail", pa.bool_())])))

    places.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    placed = rows.select("id", "text", arrow_udf(places, "array<struct<block:int,tail:boolean>>")("id").alias("p"))
    return (
        placed.select("id", "text", F.explode("p").alias("c"))
        .select("id", "text", "c.block", "c.tail")
        .repartition(n, "block")
        .sortWithinPartitions("block", "tail", "id", "text")
    )


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the start of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


EDITED = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def against_next(rows: DataFrame, order: str, text: str, level: int = LEVEL) -> DataFrame:
    """Every text's fingerprint, and how alike it is to its edited text's and the next one's in order.

    Rows are read in order, one batch at a time, so a task keeps a batch and the row before.
    """
    placed = in_blocks(rows, order, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the row whose next one is still to come, with its fingerprint
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for a, b in _chunks(texts):
                part = batch.slice(a, b - a)
                columns = {c: part.column(part.schema.get_field_index(c)) for c in ("id", "block", "tail")}
                chunk = texts[a:b]
                prints = fingerprints(chunk, level)
                blocks, tails = columns["block"].to_pylist(), columns["tail"].to_pylist()
                every = ([held] if held else []) + [
                    [columns["id"].slice(i, 1), blocks[i], tails[i], chunk[i], prints[i]] for i in range(len(chunk))
                ]
                pairs = [(x, y) for x, y in zip(every, every[1:], strict=False) if x[1] == y[1] and not x[2]]
                held = every[-1]
                if pairs:
                    yield answers(pairs)

    def answers(pairs: list) -> pa.RecordBatch:
        new = [edited(x[3], y[3]) for x, y in pairs]
        prints = fingerprints(new, level)
        columns = [
            pa.concat_arrays([x[0] for x, _ in pairs]),
            pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            pa.array([written_out(x[4]) for x, _ in pairs], pa.string()),
            pa.array([written_out(p) for p in prints], pa.string()),
            pa.array([alike(x[4], p) for (x, _), p in zip(pairs, prints, strict=True)], pa.float64()),
            pa.array([alike(x[4], y[4]) for x, y in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", *(f.split()[0] for f in EDITED.split(", "))])

    return placed.mapInArrow(run, f"id {rows.schema[order].dataType.simpleString()}, {EDITED}")
