"""Near-duplicates by SimHash: fingerprints, links within a few bits, and their components.

Documents with equal fingerprints are one class, so only distinct fingerprints are compared.
The comparison is a join of a binary trie with itself: pairs of nodes are followed downwards
together, the bits in which their paths differ are added up, and a pair is given up as soon
as they exceed the limit.

To spread the trie, its bits are taken in several orders. Cut the bits into one part more
than the limit: two fingerprints within the limit agree on a whole part. So for each part
the trie that has this part on top needs no pair of different nodes there, and its subtrees
below the part can be joined apart from each other, each as a group of the shuffle. A group
that is too large is cut again in the same way by its other bits, until it isn't.

Links are made into components by repeatedly pointing every fingerprint to the smallest one
known around it; nothing of this passes through the driver but counts.

Defined results: null and empty texts, and those without a word, have fingerprint zero and
are linked like any other. Rows that repeat are in one component. ``component`` of rows that
all lack an id is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.batches import signed, text_udf
from marquee.llm.components import components
from marquee.scratch import written

SHINGLE = 3
MAX_BITS = 2
BITS = 64
# A group of so many distinct fingerprints is joined in one task, in a few dozen megabytes.
GROUP = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, size: int, seed: int = 42) -> list[int]:
    """XXH64 of the runs of ``size`` words, joined by a blank; fewer words are one run."""
    words = text.encode().translate(_LOWER).split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    starts, ends, at = [], [], 0
    for word in words:
        starts.append(at)
        at += len(word)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the number whose bits are set in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    starts = np.cumsum(sizes) - sizes
    used = np.flatnonzero(sizes)
    if not len(used):
        return out
    for bit in range(BITS):
        on = (hashes >> np.uint64(bit)) & np.uint64(1)
        n = np.add.reduceat(on.astype(np.int64), starts[used])
        out[used] |= (2 * n > sizes[used]).astype(np.uint64) << np.uint64(bit)
    return out


def _printer(size: int) -> Callable[[pa.Array], pa.Array]:
    def work(texts: pa.Array) -> pa.Array:
        each = [shingle_hashes(text, size) if text else [] for text in texts.to_pylist()]
        sizes = np.array([len(x) for x in each], np.int64)
        hashes = np.fromiter((h for x in each for h in x), np.uint64, int(sizes.sum()))
        return pa.array(signed(majority(hashes, sizes)))

    return work


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """The 64-bit SimHash of a text's shingles, as a signed number."""
    return text_udf(lambda: _printer(size), "bigint")(text)


def _parts(mask: int, n_parts: int) -> list[int]:
    """The bits outside the mask in ``n_parts`` parts, each added to the mask."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    cuts = [len(free) * k // n_parts for k in range(n_parts + 1)]
    return [mask | sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _number(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split(groups: DataFrame, masks: list[int], n_parts: int) -> tuple[DataFrame, list[int]]:
    """Each row of a group goes to the groups of its parts: same bits within a longer mask."""
    longer = {mask: _parts(mask, n_parts) for mask in masks}
    choice = F.array()
    for mask, own in longer.items():
        choice = F.when(F.col("mask") == F.lit(_number(mask)), F.array(*[F.lit(_number(m)) for m in own])).otherwise(choice)
    rows = groups.select("fp", F.explode(choice).alias("mask"))
    if len(masks) > 1:  # different ways down may fix the same bits
        rows = rows.distinct()
    return rows.withColumn("top", F.col("fp").bitwiseAND(F.col("mask"))), sorted({m for own in longer.values() for m in own})


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints in column ``fp`` within ``max_bits``.

    Of the pairs within one group only those are given that a spanning forest needs, so the
    components are those of all pairs.
    """
    rows, masks = _split(fingerprints.select("fp", F.lit(0).cast("bigint").alias("mask")), [0], max_bits + 1)
    ready = []
    while True:
        rows = written(rows)
        sizes = rows.groupBy("mask", "top").agg(F.count("*").alias("n")).where("n > 1")
        # Groups of one have no pair. A fully fixed group is one fingerprint.
        sizes = written(sizes)
        # With a few bits left, a group has few members whatever the limit.
        too_large = (F.col("n") > group) & (F.bit_count("mask") < BITS - 8)
        ready.append(rows.join(sizes.where(~too_large).drop("n"), ["mask", "top"], "left_semi"))
        large = sizes.where(too_large).drop("n")
        if large.isEmpty():
            break
        rows, masks = _split(rows.join(large, ["mask", "top"], "left_semi"), masks, max_bits + 1)
    pairs = None
    for part in ready:
        found = part.repartition("mask", "top").sortWithinPartitions("mask", "top", "fp").mapInArrow(
            _joiner(max_bits), "a bigint, b bigint"
        )
        pairs = found if pairs is None else pairs.unionAll(found)
    return pairs


def _joiner(max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins each group of sorted rows (fp, mask, top) with itself; groups may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("fp", "mask", "top")]
            rows = np.stack(columns) if not rest else np.concatenate([rest.pop(), np.stack(columns)], axis=1)
            last = np.flatnonzero((rows[1] != rows[1, -1]) | (rows[2] != rows[2, -1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest.append(rows[:, cut:])
            if cut:
                yield _joined(rows[:, :cut], max_bits)
        if rest:
            yield _joined(rest[0], max_bits)

    return run


def _joined(rows: np.ndarray, max_bits: int) -> pa.RecordBatch:
    fp = rows[0].view(np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], (rows[1, 1:] != rows[1, :-1]) | (rows[2, 1:] != rows[2, :-1])]))
    bounds = np.append(edge, len(fp))
    # Signed order puts the numbers with the top bit first; the trie wants them last.
    group = np.repeat(np.arange(len(edge)), np.diff(bounds))
    order = np.lexsort((fp, group))
    fp = fp[order]
    first, second = forest(len(fp), *self_join(fp, bounds[:-1], bounds[1:], max_bits))
    a, b = signed(fp[first]), signed(fp[second])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def self_join(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, max_bits: int, most: int = 1 << 19):
    """Places of all pairs within ``max_bits`` in each of the sorted ranges, which are tries.

    A node is a range of numbers that agree above some bit. A pair of nodes has the four
    ranges' ends, the bit to look at next and the differing bits so far. Only ``most`` pairs of
    nodes go down together; the others wait on a stack.
    """
    one = np.uint64(1)
    wide = ends - starts > 1
    starts, ends = starts[wide], ends[wide]
    stack = [(BITS - 1, starts, ends, starts, ends, np.zeros(len(starts), np.int64))]
    found = []
    while stack:
        bit, a0, a1, b0, b1, bits = stack.pop()
        if not len(a0):
            continue
        if len(a0) > most and bit >= 0:
            half = len(a0) // 2
            stack += [(bit, *(x[s] for x in (a0, a1, b0, b1, bits))) for s in (slice(half), slice(half, None))]
            continue
        # Two leaves: the rest of both paths at once.
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            a, b = a0[leaves], b0[leaves]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
            near &= a != b
            found.append((a[near], b[near]))
            a0, a1, b0, b1, bits = (x[~leaves] for x in (a0, a1, b0, b1, bits))
        if not len(a0) or bit < 0:
            continue
        # Where the next bit turns from 0 to 1 in each node.
        am, bm = _turn(fp, a0, a1, bit), _turn(fp, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        children = [
            (a0, am, b0, bm, bits, np.ones(len(a0), bool)),
            (am, a1, bm, b1, bits, np.ones(len(a0), bool)),
            (a0, am, bm, b1, bits + 1, bits < max_bits),
            (am, a1, b0, bm, bits + 1, (bits < max_bits) & ~same),
        ]
        parts = []
        for c0, c1, d0, d1, n, ok in children:
            ok = ok & (c1 > c0) & (d1 > d0)
            ok &= ~((c0 == d0) & (c1 == d1) & (c1 - c0 == 1))
            parts.append(tuple(x[ok] for x in (c0, c1, d0, d1, n)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _turn(fp: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """In sorted ranges that agree above the bit: the first place where it is set."""
    low, high = low.copy(), high.copy()
    shift, one = np.uint64(bit), np.uint64(1)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        on = ((fp[np.minimum(middle, len(fp) - 1)] >> shift) & one).astype(bool)
        high = np.where(open_ & on, middle, high)
        low = np.where(open_ & ~on, middle + 1, low)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links only those that join two trees, found by union and find."""
    parent = list(range(n))
    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def grouped(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """For each document ``id, k1, k2, fp, root, component``.

    ``k1`` and ``k2`` are hashes of id and text, ``root`` is the smallest fingerprint that can be reached over links, ``component`` the
    smallest id of the documents reached.
    """
    key, value = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    prints = written(documents.select(key.alias("id"), *_row_keys(key, value), fingerprint(value, size).alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    reached = components(links(classes.select("fp"), max_bits), "a", "b")
    # Only fingerprints with a link are in there; the others are a component of their own.
    linked = classes.join(reached, F.col("fp") == F.col("node"), "left")
    linked = linked.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    labelled = linked.join(least, "root").select("fp", "root", "component")
    return prints.join(labelled, "fp").select("id", "k1", "k2", "fp", "root", "component")


def _row_keys(id_: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(F.lit(1), id_, text).alias("k2")]


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each component, with its columns as they are.

    Rows without id stay only where a component has no other. Of several rows with the
    smallest id one stays, chosen by hashes of its text and its other columns.
    """
    found = grouped(documents, id_column, text, **options)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")).alias("best"))
    keys = _row_keys(F.col(f"`{id_column}`"), F.col(f"`{text}`"))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    chosen = documents.select(row, *keys).join(best.select("best.k1", "best.k2"), ["k1", "k2"], "left_semi")
    # Maps have no order and no hash; their JSON text has.
    maps = [f.name for f in documents.schema if "map<" in f.dataType.simpleString()]
    hashed = F.struct(*[F.col(f"row.`{c}`") for c in documents.columns if c not in maps])
    texts = [F.to_json(F.struct(F.col(f"row.`{name}`"))) for name in maps]
    copies = Window.partitionBy("k1", "k2").orderBy(F.xxhash64(hashed), *texts)
    return chosen.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select("row.*")
