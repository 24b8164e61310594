"""Exact Lloyd clustering in which only vectors whose bounds have expired are looked at again.

A vector keeps its cluster for certain as long as its distance to the own centroid (upper) is
below that to any other one (lower). When centroids move, the gap between the two shrinks by no
more than the own centroid's drift plus the largest drift of another one. So every cluster adds
these up in one number, and each of its vectors is kept under ``gap + that number at the time of
its last scan``: the order of the vectors in a cluster never changes, and a heap per cluster gives
away exactly those whose gap has been used up. They are popped, compared with all centroids in
whole numbers, and pushed onto the heap of their cluster.

Vectors are held in blocks, a row each, with the heaps of the block's vectors: a round is one
pass over the blocks without a shuffle, in which tasks get the centroids and the drifts, and what comes back
are the sums of the vectors that changed clusters. Each round writes the blocks anew, in the
smallest integers that hold them, and deletes those of the round before last. The driver sees the
centroids and their sums only.

Defined results: vectors that are null, have another number of components than ``width`` or hold
null, NaN or infinity are left out; a null id is kept, and comes last among the first centroids.
Rows that repeat are vectors of their own. With fewer than ``k`` vectors there are as many
centroids. Distances must fit 64 bits, so components beyond ``LARGEST`` after scaling are an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.tables import Stored, blocks_of_lists

# Vectors of a block: with 64 components, a megabyte or two at most.
BLOCK = 4_096
LARGEST = 2**26
# Distances as floating-point numbers are off by less than this part.
SLACK = 1e-12
# Numbers up to here are exact as floating-point numbers.
_EXACT = 2**53

_BLOCKS = (
    "ids array<bigint>, points binary, item int, clusters binary, heaps array<struct<gaps:binary,places:binary>>, "
    "moved array<struct<cluster:int,n:bigint,sums:array<bigint>>>"
)
_ARROW = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("points", pa.binary()),
        ("item", pa.int32()),
        ("clusters", pa.binary()),
        ("heaps", pa.list_(pa.struct([("gaps", pa.binary()), ("places", pa.binary())]))),
        ("moved", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))),
    ]
)


def kept(rows: DataFrame, id_column: str, vector: str, width: int, scale: int) -> DataFrame:
    """``id, x``: the vectors with ``width`` finite components, each as the integer floor(scale * component)."""
    value = F.col(f"`{vector}`")
    sound = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(value, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint"))
    usable = rows.where((F.size(value) == width) & F.coalesce(sound, F.lit(False)))
    return usable.select(F.col(f"`{id_column}`").alias("id"), whole.alias("x"))


def first_centroids(vectors: DataFrame, k: int, order: Column) -> np.ndarray:
    """The ``k`` first vectors by ``order``, an expression over ``id``; ties go by the components."""
    rows = vectors.select(order.alias("o"), "x").orderBy(F.col("o").asc_nulls_last(), "x").limit(k).collect()
    return np.array([row.x for row in rows], np.int64).reshape(len(rows), len(rows[0].x) if rows else 0)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers, a row for each point."""
    top = int(max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * top * top * points.shape[1] < _EXACT:
        a, b = points.astype(np.float64), centroids.astype(np.float64)
        return (np.square(a).sum(1)[:, None] - 2 * (a @ b.T) + np.square(b).sum(1)).astype(np.int64)
    a = points.astype(np.int64)
    return np.stack([np.square(a - c).sum(1) for c in centroids], 1)


def scan(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point its cluster, the squared distance to it, and the gap to the next best one.

    Of equally near centroids the first is taken; the gap is never too large.
    """
    apart = squared(points, centroids)
    own = apart.argmin(1)
    least = apart[np.arange(len(points)), own]
    if len(centroids) == 1:
        return own, least, np.full(len(points), np.inf)
    apart[np.arange(len(points)), own] = np.iinfo(np.int64).max
    upper, lower = np.sqrt(least.astype(np.float64)), np.sqrt(apart.min(1).astype(np.float64))
    return own, least, lower * (1 - SLACK) - upper * (1 + SLACK)


def _smallest(points: np.ndarray) -> np.ndarray:
    top = int(np.abs(points).max(initial=0))
    return points.astype(np.int8 if top < 2**7 else np.int16 if top < 2**15 else np.int32)


def _packed(ids: list, points: np.ndarray, clusters: np.ndarray, heaps: list[list], moved: dict) -> dict:
    return {
        "ids": ids,
        "points": points.tobytes(),
        "item": points.itemsize,
        "clusters": clusters.astype(np.int32).tobytes(),
        "heaps": [
            {
                "gaps": np.array([gap for gap, _ in heap], np.float64).tobytes(),
                "places": np.array([place for _, place in heap], np.int32).tobytes(),
            }
            for heap in heaps
        ],
        "moved": [{"cluster": j, "n": n, "sums": sums.tolist()} for j, (n, sums) in sorted(moved.items())],
    }


def _moved(points: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> dict[int, tuple[int, np.ndarray]]:
    """For each cluster whose members changed: how many more there are, and by how much the sums grew."""
    wide = points.astype(np.int64)
    n, sums = np.zeros(k, np.int64), np.zeros((k, points.shape[1]), np.int64)
    for labels, sign in ((after, 1), (before, -1)):
        if labels is not None:
            n += sign * np.bincount(labels, minlength=k)
            np.add.at(sums, labels, sign * wide)
    return {j: (int(n[j]), sums[j]) for j in range(k) if n[j] or sums[j].any()}


def _opened(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the vectors, each of them scanned and put on the heap of its cluster."""
    for ids, points in blocks_of_lists(batches, BLOCK, centroids.shape[1]):
        if len(points) and (points.max() > LARGEST or points.min() < -LARGEST):
            raise ValueError(f"a component is beyond {LARGEST} after scaling")
        points = _smallest(points)
        own, _, gaps = scan(points, centroids)
        heaps: list[list] = [[] for _ in centroids]
        for place, (j, gap) in enumerate(zip(own.tolist(), gaps.tolist(), strict=True)):
            heaps[j].append((gap, place))
        for heap in heaps:
            heapq.heapify(heap)
        yield pa.RecordBatch.from_pylist([_packed(ids, points, own, heaps, _moved(points, None, own, len(centroids)))], _ARROW)


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(row["points"], f"i{row['item']}").reshape(-1, width)
    return points, np.frombuffer(row["clusters"], np.int32).copy()


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drifted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pop what has expired, scan it, push it again; ``drifted`` is what each cluster has added up."""
    for batch in batches:
        for row in batch.to_pylist():
            points, clusters = _unpacked(row, centroids.shape[1])
            heaps = [
                list(zip(np.frombuffer(h["gaps"]).tolist(), np.frombuffer(h["places"], np.int32).tolist(), strict=True))
                for h in row["heaps"]
            ]
            expired = []
            for heap, gone in zip(heaps, drifted.tolist(), strict=True):
                while heap and heap[0][0] <= gone:
                    expired.append(heapq.heappop(heap)[1])
            moved = {}
            if expired:
                places = np.array(sorted(expired))
                own, _, gaps = scan(points[places], centroids)
                for place, j, gap in zip(places.tolist(), own.tolist(), gaps.tolist(), strict=True):
                    heapq.heappush(heaps[j], (gap + drifted[j] * (1 + SLACK), place))
                changed = clusters[places] != own
                moved = _moved(points[places[changed]], clusters[places[changed]], own[changed], len(centroids))
                clusters[places] = own
            yield pa.RecordBatch.from_pylist([_packed(row["ids"], points, clusters, heaps, moved)], _ARROW)


def _found(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            points, clusters = _unpacked(row, centroids.shape[1])
            apart = np.square(points.astype(np.int64) - centroids[clusters]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(clusters), pa.array(apart)], ["id", "cluster", "distance"])


def _totals(blocks: DataFrame, k: int, width: int) -> tuple[list[int], list[list[int]]]:
    """The changes of all blocks added up: members, and sums of each component."""
    each = blocks.select(F.inline("moved"))
    n, sums = [0] * k, [[0] * width for _ in range(k)]
    for row in each.groupBy("cluster").agg(F.sum("n").alias("n")).collect():
        n[row.cluster] = row.n
    parts = each.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos")
    for row in parts.agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("total")).collect():
        sums[row.cluster][row.pos] = int(row.total)
    return n, sums


def clustered(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` (squared) of each vector (``id, x``), and the final centroids.

    Each round assigns every vector to the nearest centroid, the first of equally near ones, and
    replaces the centroids by the mean of their vectors, rounded down; empty ones stay. After the
    rounds the vectors are assigned once more.
    """
    k, width = centroids.shape
    if k == 0:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    first = centroids
    blocks = Stored(vectors.mapInArrow(lambda batches: _opened(batches, first), _BLOCKS))
    members, sums = [0] * k, [[0] * width for _ in range(k)]
    drifted = np.zeros(k)
    for _ in range(rounds):
        more, grown = _totals(blocks.frame, k, width)
        members = [a + b for a, b in zip(members, more, strict=True)]
        sums = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, grown, strict=True)]
        moved = np.array([[s // n for s in row] if n else old.tolist() for n, row, old in zip(members, sums, centroids, strict=True)], np.int64)
        drift = np.sqrt(np.square(moved - centroids).sum(1).astype(np.float64)) * (1 + SLACK)
        if not drift.any():
            break  # nothing moves any more
        # The largest drift of another centroid: the largest, or for that one the second largest.
        two = np.sort(drift)[-2:]
        others = np.where(np.arange(k) == drift.argmax(), two[0] if k > 1 else 0.0, two[-1])
        drifted = (drifted + drift + others) * (1 + SLACK)
        centroids, gone = moved, blocks
        blocks = Stored(_next(gone.frame, centroids, drifted))
        gone.delete()
    last = centroids
    return blocks.frame.select("ids", "points", "item", "clusters").mapInArrow(
        lambda batches: _found(batches, last), "id bigint, cluster int, distance bigint"
    ), centroids


def _next(blocks: DataFrame, centroids: np.ndarray, drifted: np.ndarray) -> DataFrame:
    return blocks.mapInArrow(lambda batches: _round(batches, centroids, drifted), _BLOCKS)
