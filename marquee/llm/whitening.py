"""Whitening of vectors by their leading principal components, found by spectrum slicing.

The covariance is exact: components are whole numbers, taken relative to a whole number near
their mean before they are multiplied, and sums are whole numbers too. So it depends neither on
the order of the rows nor on how far the mean lies from zero.

The eigenvalues of the covariance ``V`` are told apart by counting: by Sylvester's law of inertia,
``V - s`` has as many positive eigenvalues as an LDLt decomposition of it has positive pivots,
so each factorisation tells how many eigenvalues lie above ``s``. Bisection on these counts gives
an interval that holds one eigenvalue only, Rayleigh quotient iteration converges cubically
inside it, and two more counts, just above and just below, certify that the value found is the
one with that number. Eigenvalues too close to be told apart are taken as a cluster: as many
orthogonal vectors as the counts say, from inverse iteration in the space that is left.

Defined results: vectors that are null or hold null, NaN or infinity are left out, and so are those
whose length is not the most frequent one (of equally frequent lengths the largest). Ids may be null or
repeat. Where an eigenvalue is zero to within rounding there is no whitening: ``whitened`` is null in that
component, which the identity error leaves out. ``deviation`` is null where it doesn't fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.tables import lists_of
from marquee.scratch import written

# Rows whose products are added up at once; the sums stay below the limits of whole numbers.
ROWS = 4_096
# Eigenvalues are told apart down to this part of the largest one.
CLOSE = 1e-12
# Below this part of the largest one an eigenvalue counts as zero.
ZERO = 1e-13


def kept(rows: DataFrame, id_column: str, vector: str, scale: int, offset: int) -> DataFrame:
    """``id, x`` of the usable vectors, each component as the integer floor(scale * component) + offset."""
    value = F.col(f"`{vector}`")
    sound = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(value, lambda c: (F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(offset)).cast("bigint"))
    usable = rows.where(F.coalesce(sound, F.lit(False)) & (F.size(value) > 0))
    widths = usable.groupBy(F.size(value).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    return usable.where(F.size(value) == (widths[0].width if widths else 0)).select(F.col(f"`{id_column}`").alias("id"), whole.alias("x"))


# --- moments ---


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each component."""
    each = vectors.select(F.posexplode("x")).groupBy("pos")
    rows = each.agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).orderBy("pos").collect()
    return (rows[0].n if rows else 0), [int(row.s) for row in rows]


def _products(batches: Iterator[pa.RecordBatch], pivot: list[int]) -> Iterator[pa.RecordBatch]:
    """What a task's vectors add to the sums of products of their components, relative to the pivot."""
    width = len(pivot)
    upper = np.triu_indices(width)
    total = np.zeros(len(upper[0]), object)
    for batch in batches:
        points = lists_of(batch, "x", width) - np.array(pivot, np.int64)
        for at in range(0, len(points), ROWS):
            part = points[at : at + ROWS]
            top = max(int(part.max()), -int(part.min()))
            if top * top * len(part) < 2**53:
                wide = part.astype(np.float64)
                product = (wide.T @ wide).astype(np.int64)
            else:
                wide = part.astype(object)
                product = wide.T @ wide
            total += product[upper].astype(object)
    yield pa.RecordBatch.from_arrays([pa.array([[str(int(x)) for x in total]])], ["sums"])


def covariance(vectors: DataFrame, n: int, total: list[int]) -> tuple[np.ndarray, list[int]]:
    """The covariance of the components, rounded once at the end, and the whole numbers near their means."""
    width = len(total)
    pivot = [(2 * s + n) // (2 * n) for s in total]
    parts = vectors.mapInArrow(lambda batches: _products(batches, pivot), "sums array<string>")
    each = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    products = {row.pos: int(row.s) for row in each.collect()}
    rest = [s - n * p for s, p in zip(total, pivot, strict=True)]
    out = np.zeros((width, width))
    for pos, (i, j) in enumerate(zip(*np.triu_indices(width), strict=True)):
        out[i, j] = out[j, i] = Fraction(n * products[pos] - rest[i] * rest[j], n * n)
    return out, pivot


# --- eigenvalues ---


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed the shift: the positive ones of D in an LDLt of ``matrix - shift``.

    Pivots are chosen over the whole remaining matrix, of one row or two, so the factors stay small.
    """
    a = matrix - shift * np.eye(len(matrix))
    ratio = (1 + 17**0.5) / 8
    above = 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        i, j = divmod(int(off.argmax()), len(a))
        if diagonal[k] >= ratio * off[i, j]:
            pivot, rest = [k], np.delete(np.arange(len(a)), k)
            if a[k, k] == 0:
                break  # nothing but zeros is left
            above += a[k, k] > 0
        else:  # a pair with a negative determinant: one positive, one negative eigenvalue
            pivot, rest = [i, j], np.delete(np.arange(len(a)), [i, j])
            above += 1
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return int(above)


def _isolated(matrix: np.ndarray, number: int, low: float, high: float, least: float) -> tuple[float, float, int, int]:
    """An interval around the eigenvalue with that number, and how many lie above its ends.

    Halved until it holds this one only, or is no wider than ``least``.
    """
    above_low, above_high = count_above(matrix, low), count_above(matrix, high)
    while above_low - above_high > 1 and high - low > least:
        middle = (low + high) / 2
        above = count_above(matrix, middle)
        if above >= number:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    return low, high, above_low, above_high


def _solved(matrix: np.ndarray, shift: float, vector: np.ndarray, scale: float) -> np.ndarray:
    try:
        out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), vector)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        out = np.linalg.solve(matrix - (shift + scale * 4e-16) * np.eye(len(matrix)), vector)
    return out / np.linalg.norm(out)


def _iterated(matrix: np.ndarray, low: float, high: float, scale: float, found: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of the interval; None if it leaves it."""
    vector = np.cos(np.arange(1.0, len(matrix) + 1) ** 2)
    shift, best, least = (low + high) / 2, None, np.inf
    for step in range(40):
        vector = vector - found.T @ (found @ vector)
        vector = _solved(matrix, shift, vector / np.linalg.norm(vector), scale)
        value = float(vector @ matrix @ vector)
        rest = np.linalg.norm(matrix @ vector - value * vector)
        if best is not None and rest >= least / 2:
            break  # as exact as it gets
        if rest <= 8 * len(matrix) * 2.3e-16 * scale:
            best, least = (value, vector), rest
        # Two steps of inverse iteration first, so that the start belongs to this interval.
        shift = value if step >= 2 and low <= value <= high else shift
    return best if best is not None and low <= best[0] <= high else None


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as rows."""
    d = len(matrix)
    most = min(most, d)
    radius = np.abs(matrix).sum(1).max() if d else 0.0
    if radius == 0:
        return np.zeros(most), np.eye(d)[:most]
    values: list[float] = []
    vectors = np.zeros((0, d))
    floor, roof = -radius * 1e-3, radius * (1 + 1e-9)
    while len(values) < most:
        number = len(values) + 1
        low, high, above_low, above_high = _isolated(matrix, number, floor, roof, CLOSE * radius)
        size = above_low - above_high
        if size == 1:
            found = [_single(matrix, number, low, high, radius, vectors)]
        else:
            found = _clustered(matrix, (low + high) / 2, size, radius, vectors)
        values += [value for value, _ in found]
        for _, vector in found:
            # A small eigenvalue beside large ones leaves the last digits of its vector to rounding; they are made orthogonal.
            for _ in range(2):
                vector = vector - vectors.T @ (vectors @ vector)
            vectors = np.vstack([vectors, vector / np.linalg.norm(vector)])
    order = np.argsort(-np.array(values[:most]), kind="stable")
    return np.array(values)[order], vectors[order]


def _single(matrix: np.ndarray, number: int, low: float, high: float, scale: float, found: np.ndarray) -> tuple[float, np.ndarray]:
    """The eigenvalue that the interval holds, certified by the counts on both sides of it."""
    got = _iterated(matrix, low, high, scale, found)
    while got is None and high - low > CLOSE * scale:  # a narrower interval is a better start
        middle = (low + high) / 2
        low, high = (middle, high) if count_above(matrix, middle) >= number else (low, middle)
        got = _iterated(matrix, low, high, scale, found)
    value, vector = got or _clustered(matrix, (low + high) / 2, 1, scale, found)[0]
    margin = 1e-13 * scale * len(matrix)
    if not count_above(matrix, value + margin) < number <= count_above(matrix, value - margin):
        raise ArithmeticError(f"the counts don't certify eigenvalue {number}")
    return value, vector


def _clustered(matrix: np.ndarray, shift: float, size: int, scale: float, found: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """Orthogonal vectors of eigenvalues that can't be told apart, by inverse iteration."""
    out: list[tuple[float, np.ndarray]] = []
    for k in range(size):
        known = np.vstack([found, *[vector for _, vector in out]])
        vector = np.cos((k + 2.0) * np.arange(1.0, len(matrix) + 1) ** 2)
        for _ in range(6):
            for _ in range(2):
                vector = vector - known.T @ (known @ vector)
            vector = _solved(matrix, shift + scale * 1e-15, vector / np.linalg.norm(vector), scale)
        for _ in range(2):
            vector = vector - known.T @ (known @ vector)
        vector /= np.linalg.norm(vector)
        out.append((float(vector @ matrix @ vector), vector))
    return out


# --- the vectors ---


def _applied(batches: Iterator[pa.RecordBatch], n: int, total: list[int], pivot: list[int], means: np.ndarray, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = len(total)
    for batch in batches:
        points = lists_of(batch, "x", width) - np.array(pivot, np.int64)
        white = (points.astype(np.float64) - means) @ axes.T
        rest = [s - n * p for s, p in zip(total, pivot, strict=True)]
        top = max(int(points.max()), -int(points.min())) * n + max(map(abs, rest)) if len(points) else 0
        exact = points if top * top * width < 2**63 else points.astype(object)
        apart = np.square(n * exact - np.array(rest, exact.dtype)).sum(1)
        kinds = [pa.field("id", pa.int64()), pa.field("deviation", pa.int64()), pa.field("white", pa.list_(pa.float64()))]
        deviation = pa.array([int(x) if x < 2**63 else None for x in apart.tolist()], pa.int64())
        flat = pa.ListArray.from_arrays(np.arange(0, white.size + 1, len(axes), dtype=np.int32), pa.array(white.ravel())) if len(axes) else pa.array([[]] * len(white), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), deviation, flat], schema=pa.schema(kinds))


def _white_products(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width + 1, width + 1))
    for batch in batches:
        white = np.hstack([lists_of(batch, "white", width), np.ones((batch.num_rows, 1))])
        total += white.T @ white
    yield pa.RecordBatch.from_arrays([pa.array([total[np.triu_indices(width + 1)].tolist()])], ["sums"])


def identity_error(white: DataFrame, width: int, n: int) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    parts = white.select("white").mapInArrow(lambda batches: _white_products(batches, width), "sums array<double>")
    rows = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    full = np.zeros((width + 1, width + 1))
    upper = np.triu_indices(width + 1)
    flat = {row.pos: row.s for row in rows}
    full[upper] = [flat[i] / n for i in range(len(upper[0]))]
    mean = full[:width, width]
    own = np.triu(full[:width, :width] - np.outer(mean, mean)) - np.eye(width)
    return float(np.abs(own).max())


def whitened(vectors: DataFrame, most: int) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``, a row for each vector (``id, x``) and component."""
    names = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    n, total = sums(vectors)
    if n == 0:
        return vectors.sparkSession.createDataFrame([], names)
    matrix, pivot = covariance(vectors, n, total)
    values, axes = leading(matrix, most)
    whole = float(np.trace(matrix))
    usable = int((values > ZERO * values[0]).sum()) if values[0] > 0 else 0
    means = np.array([float(Fraction(s - n * p, n)) for s, p in zip(total, pivot, strict=True)])
    scaled = axes[:usable] / np.sqrt(values[:usable])[:, None]
    white = written(vectors.mapInArrow(lambda b: _applied(b, n, total, pivot, means, scaled), "id bigint, deviation bigint, white array<double>"))
    error = identity_error(white, usable, n) if usable else 0.0
    explained = F.array(*[F.lit(float(max(v, 0.0) / whole) if whole else 0.0) for v in values])
    each = white.select("id", "deviation", "white", F.explode(F.sequence(F.lit(1), F.lit(len(values)))).alias("component"))
    return each.select(
        "id",
        "component",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.get("white", F.col("component") - 1).alias("whitened"),
        F.get(explained, F.col("component") - 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
