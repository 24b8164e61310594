"""Texts of Arrow batches as byte arrays, and functions over them as column expressions.

Spark deals out the rows; the functions here see one batch at a time, cut into slices of a
few megabytes of text, so a task's memory depends on the slice and the longest text alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cut into runs of rows with about ``most`` bytes each; a longer text is a slice of its own."""
    if len(texts) == 0:
        yield texts
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(row, stop - row)
        row = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if places is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_udf(make: Callable[[], Callable], returns: str) -> Callable[..., Column]:
    """A column function over one text column.

    ``make`` is called once in each task and gives the function that turns a slice of texts
    into the result: an Arrow array, or a list of them for the fields of a struct. Spark is
    kept from evaluating the function twice for one row.
    """
    kind = T.StructType.fromDDL(returns) if " " in returns.strip() else T._parse_datatype_string(returns)
    arrow_kind = to_arrow_type(kind)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for column in columns:
            done = []
            for part in slices(column):
                found = work(part)
                if isinstance(found, list):
                    fields = [arrow_kind.field(i) for i in range(arrow_kind.num_fields)]
                    cells = [
                        x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type)
                        for x, f in zip(found, fields, strict=True)
                    ]
                    found = pa.StructArray.from_arrays(cells, fields=fields)
                done.append(found)
            yield pa.concat_arrays(done)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, kind).asNondeterministic()


def marked(members: str) -> np.ndarray:
    """For each byte whether it is one of the characters, or 0x80 and above."""
    table = np.zeros(256, bool)
    table[list(members.encode())] = True
    table[128:] = True
    return table


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags; no run crosses from one text into the next."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(flags) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(flags), bool)
    before[0], before[1:] = False, flags[:-1]
    starts = np.flatnonzero(flags & (~before | cut[:-1]))
    after = np.empty(len(flags), bool)
    after[-1], after[:-1] = False, flags[1:]
    ends = np.flatnonzero(flags & (~after | cut[1:])) + 1
    return starts, ends


def mixed(numbers: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a bijection)."""
    x = numbers.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class SpanHash:
    """64-bit hashes of any byte spans of an array, from one pass of prefix sums."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(SpanHash._up) < n:
            SpanHash._up, SpanHash._down = _powers(_MULTIPLIER, n), _powers(_INVERSE, n)
        sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * SpanHash._up[: n - 1], out=sums[1:])
        self.sums, self.down = sums, SpanHash._down

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


class Places:
    """Where each of some 64-bit numbers stands among them; they are told apart, none occurs twice.

    A table with open addressing, at most half full: a number is looked up in one or two steps, while a binary
    search takes one, and a miss of the cache, for each time their number doubles.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys.view(np.uint64)
        bits = max(1, (2 * len(keys) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        at, left = self._home(self.keys), np.arange(len(keys))
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            beaten = self.table[at] != left
            at, left = (at[beaten] + 1) & self.last, left[beaten]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(_MULTIPLIER) >> self.shift).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, or -1."""
        keys = keys.view(np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.table[at]
        left = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.last
            out[left] = found = self.table[at]
            more = (self.keys[found] != keys[left]) & (found >= 0)
            at, left = at[more], left[more]
        return out


def signed(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.uint64, copy=False).view(np.int64)
