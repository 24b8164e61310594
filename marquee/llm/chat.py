"""Turns of a conversation recovered from its lines, and written out in one form.

Every line has a marker (does it open like ``User:``, ``### Assistant``, ``<|system|>`` …, with
another name, or with none?) and a shape (length, question, blank). A hidden Markov model
has a state for each role and for whether the line opens a turn or goes on with it. Roles
follow each other from row to row as in labelled conversations; within a row a new turn is
rare, and almost never without a marker. Viterbi gives the best states of a whole
conversation, and each turn is written out as ``<|im_start|>role``, its lines, ``<|im_end|>``.

A conversation may be of any length. Rows are sorted by range into blocks, a long
conversation running through many of them. Scores add up and the best path is a maximum, so
a block's effect on the rows behind it is one small matrix; the blocks' matrices (one each,
whatever they hold) give the scores at every border, and the roles at the borders are settled
from the end. Then every block finds its own best path between them: the result is that of
one pass over the conversation.

Defined results: a row opens a turn, so every row has at least one. A null or empty text is
one empty line. Null conversation ids are one conversation, null orders come first. Rows
with the same place are taken in the order of a hash of their text. Equally good paths are
settled for the role first in ``roles``. What stands for the written form in a text is broken
up by a blank.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marquee.llm.batches import text_udf
from marquee.scratch import written

ROLES = ("assistant", "system", "user")
# Chance of a new turn at a line within a row, before its marker is seen.
SWITCH = 0.02

# Words that open a speaker's line.
SPEAKERS = {
    "user": "user human person customer client student question q prompt me",
    "assistant": "assistant ai bot chatbot model agent answer a response gpt",
    "system": "system instruction instructions context",
}
_KIND_OF = {word: kind for kind, words in SPEAKERS.items() for word in words.split()}
MARKERS = ("none", "name", *ROLES)
SHAPES = 16

_OPENS = re.compile(r"[\s>*_#\[(<|-]*")
_WORD = re.compile(r"([^\W\d_]+)((?:[ _-][^\W\d_]+)?(?:[ _-]?\d+)?)")
_CLOSES = re.compile(r"[*_\])|>]*\s*(?::|(?<=[\]|>*])|$)[*_]*\s*")


def marker(line: str) -> tuple[str, int]:
    """The kind of marker that a line opens with, and where what is said begins."""
    opens = _OPENS.match(line)
    word = _WORD.match(line, opens.end())
    if not word or word.end() - opens.end() > 30:
        return "none", 0
    closes = _CLOSES.match(line, word.end())
    if not closes or closes.end() == word.end() and closes.end() < len(line):
        return "none", 0
    kind = _KIND_OF.get(word[1].lower())
    decorated = opens.end() > 0 and any(c in "#[<|" for c in opens[0])
    colon = ":" in closes[0]
    if kind and not word[2].strip("0123456789 _-") and (colon or decorated):
        return kind, closes.end()
    if colon and word[1][0].isupper():
        return "name", 0
    return "none", 0


def shape(line: str) -> int:
    """Length in four steps, whether it asks, whether it has no letter."""
    n = len(line)
    steps = (n > 20) + (n > 80) + (n > 240)
    return steps + 4 * line.rstrip().endswith("?") + 8 * (not any(map(str.isalpha, line)))


def codes(text: str | None) -> list[int]:
    return [MARKERS.index(marker(line)[0]) * SHAPES + shape(line) for line in (text or "").split("\n")]


class Model(NamedTuple):
    """Log scores: of the first row's role, of a row's role after the last one's, of a code in each state."""

    roles: tuple[str, ...]
    start: list[float]
    turn: list[list[float]]
    first: list[list[float]]
    opening: list[list[float]]
    inside: list[list[float]]


def _log_shares(counts: list[float]) -> list[float]:
    total = sum(counts)
    return [math.log(c / total) for c in counts]


def model(
    roles: tuple[str, ...],
    starts: dict[int, int],
    turns: dict[tuple[int, int], int],
    seen: dict[tuple[int, int, int], int],
) -> Model:
    """A model from counts: roles of first rows, pairs of roles, and (role, first line?, code).

    Every count starts above zero. A marker is likely for its own role and unlikely for another
    one, which counts can outweigh for the lines that open a row, but not for later ones.
    """
    n = range(len(roles))

    def shapes(role: int, first: int) -> list[float]:
        own = [0.5 + sum(seen.get((role, first, i * SHAPES + s), 0) for i in range(len(MARKERS))) for s in range(SHAPES)]
        return _log_shares(own)

    def marks(role: int) -> list[float]:
        own = [sum(seen.get((role, 1, i * SHAPES + s), 0) for s in range(SHAPES)) for i in range(len(MARKERS))]
        return _log_shares([k + (20.0 if m in ("none", roles[role]) else 0.5) for k, m in zip(own, MARKERS, strict=True)])

    # Labelled rows don't say where turns begin within a row: there the marker alone does.
    def opens(role: int) -> list[float]:
        return _log_shares([1.0 if m == roles[role] else 0.02 if m == "name" else 0.0002 for m in MARKERS])

    goes_on = _log_shares([1.0 if m == "none" else 0.05 if m == "name" else 0.0005 for m in MARKERS])

    def both(mark: list[float], form: list[float]) -> list[float]:
        return [x + y for x in mark for y in form]

    return Model(
        roles,
        _log_shares([1.0 + starts.get(r, 0) for r in n]),
        [_log_shares([1.0 + turns.get((q, r), 0) for r in n]) for q in n],
        [both(marks(r), shapes(r, 1)) for r in n],
        [both(opens(r), shapes(r, 1)) for r in n],
        [both(goes_on, shapes(r, 0)) for r in n],
    )


def _row(scores: list[float], known: list[int], m: Model, back: list | None) -> list[float]:
    """Scores of the roles after a row's lines, from those before its first line is seen.

    ``scores`` are already those of each role opening the row. ``back`` gets for each line the
    role before and whether the line opens a turn, for every role.
    """
    n = range(len(m.roles))
    scores = [scores[r] + m.first[r][known[0]] for r in n]
    stay, new = math.log(1 - SWITCH), math.log(SWITCH / len(m.roles))
    for code in known[1:]:
        best = max(n, key=lambda q: (scores[q], -q))
        inside = [scores[r] + stay + m.inside[r][code] for r in n]
        opened = [scores[best] + new + m.opening[r][code] for r in n]
        if back is not None:
            back.append([(best, True) if opened[r] > inside[r] else (r, False) for r in n])
        scores = [max(inside[r], opened[r]) for r in n]
    return scores


def _after(scores: list[float], m: Model) -> list[tuple[float, int]]:
    """For each role of the next row: the best score to open it, and the role before."""
    n = range(len(m.roles))
    out = []
    for r in n:
        q = max(n, key=lambda q: (scores[q] + m.turn[q][r], -q))
        out.append((scores[q] + m.turn[q][r], q))
    return out


def through(rows: list[list[int]], m: Model, before: list[float] | None) -> list[float]:
    """Scores of the roles after rows of one conversation; ``before`` is None at its start."""
    scores = before
    for known in rows:
        opened = m.start if scores is None else [s for s, _ in _after(scores, m)]
        scores = _row(list(opened), known, m, None)
    return scores


def path(rows: list[list[int]], m: Model, before: list[float] | None, last: int | None) -> tuple[list, int | None]:
    """For each line of each row its role and whether it opens a turn; and the role before the rows.

    ``last`` is the role that the rows have to end with, the best one if None.
    """
    scores, trace = before, []
    for known in rows:
        entry = [(s, None) for s in m.start] if scores is None else _after(scores, m)
        back: list = []
        scores = _row([s for s, _ in entry], known, m, back)
        trace.append((entry, back))
    role = last if last is not None else max(range(len(m.roles)), key=lambda r: (scores[r], -r))
    out = []
    for entry, back in reversed(trace):
        lines = []
        for choice in reversed(back):
            before_, opens = choice[role]
            lines.append((role, opens))
            role = before_
        lines.append((role, True))
        out.append(lines[::-1])
        role = entry[role][1]
    return out[::-1], role


def turns_of(text: str | None, states: list[tuple[int, bool]], roles: tuple[str, ...]) -> list[tuple[str, str]]:
    """The turns of a row: role and what was said, markers taken off."""
    out: list[tuple[str, list[str]]] = []
    for line, (role, opens) in zip((text or "").split("\n"), states, strict=True):
        if opens:
            kind, begin = marker(line)
            out.append((roles[role], [line[begin:] if kind == roles[role] else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(said).strip("\n")) for role, said in out]


def rendered(role: str, said: str) -> str:
    for sign in ("<|im_start|>", "<|im_end|>"):
        said = said.replace(sign, sign[0] + " " + sign[1:])
    return f"<|im_start|>{role}\n{said}<|im_end|>\n"


class _Rows:
    """Runs of one conversation from sorted batches of a block: its key and its rows."""

    def __init__(self, batches: Iterator[pa.RecordBatch], columns: list[str]) -> None:
        self.batches, self.columns = batches, columns

    def __iter__(self) -> Iterator[tuple[int, object, list[tuple]]]:
        key, rows = None, []
        for batch in self.batches:
            data = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "c", *self.columns)]
            for block, c, *values in zip(*data, strict=True):
                if key != (block, c):
                    if key:
                        yield *key, rows
                    key, rows = (block, c), []
                rows.append(tuple(values))
        if key:
            yield *key, rows


def _blocks(rows: DataFrame, *columns: str) -> DataFrame:
    return (
        rows.select("block", "c", "o", "tie", *columns).repartition("block").sortWithinPartitions("block", "c", "o", "tie")
    )


def in_blocks(rows: DataFrame, conversation: str, order: str, text: str, role: str | None, learn: str | None) -> DataFrame:
    """The rows sorted by range into blocks, with their lines' codes, as a written table.

    ``c`` is the conversation, ``o`` the order, ``tie`` the hash that orders rows of one place.
    """
    value = F.col(f"`{text}`")
    known = text_udf(lambda: lambda texts: pa.array([codes(t) for t in texts.to_pylist()], pa.list_(pa.int32())), "array<int>")
    frame = rows.select(
        F.col(f"`{conversation}`").alias("conversation"),
        F.col(f"`{conversation}`").cast("string").alias("c"),
        F.col(f"`{order}`").alias("o"),
        F.xxhash64(value).alias("tie"),
        value.alias("text"),
        (F.col(f"`{role}`").cast("string") if role else F.lit(None).cast("string")).alias("role"),
        (F.coalesce(F.expr(learn), F.lit(False)) if learn else F.lit(True)).alias("learn"),
    )
    spread = frame.repartitionByRange("c", "o", "tie").withColumn("block", F.spark_partition_id())
    return written(spread.withColumn("codes", known(F.col("text"))))


def learnt(blocks: DataFrame, roles: tuple[str, ...] = ROLES) -> Model:
    """A model from the labelled rows; those with another role or none are passed over.

    Counts are added up per block and summed by Spark. One row for each block comes back
    besides, so that pairs of rows across a border count as well.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        sums: dict[tuple[int, int, int, int], int] = {}

        def add(*key: int) -> None:
            sums[key] = sums.get(key, 0) + 1

        ends: dict[int, list] = {}
        for block, c, rows in _Rows(batches, ["role", "learn", "codes"]):
            named = [roles.index(r) if learn and r in roles else -1 for r, learn, _ in rows]
            for (_, _, known), r in zip(rows, named, strict=True):
                if r >= 0:
                    for i, code in enumerate(known):
                        add(2, r, int(i == 0), code)
            for q, r in zip(named, named[1:], strict=False):
                if q >= 0 and r >= 0:
                    add(1, q, r, 0)
            if block in ends:
                if named[0] >= 0:
                    add(0, named[0], 0, 0)
                ends[block][2:] = [c, named[-1]]
            else:
                ends[block] = [c, named[0], c, named[-1]]
        out += [(kind, x, y, z, n, None, None) for (kind, x, y, z), n in sums.items()]
        out += [(3, block, r, q, 1, c, d) for block, (c, r, d, q) in ends.items()]
        names = ["kind", "x", "y", "z", "n", "c", "d"]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], t) for i, t in enumerate(types)], names)

    found = _blocks(blocks, "role", "learn", "codes").mapInArrow(
        count, "kind bigint, x bigint, y bigint, z bigint, n bigint, c string, d string"
    )
    rows = found.groupBy("kind", "x", "y", "z", "c", "d").agg(F.sum("n").alias("n")).collect()
    starts: dict[int, int] = {}
    pairs: dict[tuple[int, int], int] = {}
    seen: dict[tuple[int, int, int], int] = {}
    for row in rows:
        if row.kind == 0:
            starts[row.x] = row.n
        elif row.kind == 1:
            pairs[row.x, row.y] = row.n
        elif row.kind == 2:
            seen[row.x, row.y, row.z] = row.n
    before: tuple[object, int] | None = None
    for row in sorted((r for r in rows if r.kind == 3), key=lambda r: r.x):
        if before and before[0] == row.c:
            if before[1] >= 0 and row.y >= 0:
                pairs[before[1], row.y] = pairs.get((before[1], row.y), 0) + 1
        elif row.y >= 0:
            starts[row.y] = starts.get(row.y, 0) + 1
        before = (row.d, row.z)
    return model(roles, starts, pairs, seen)


class Border(NamedTuple):
    """What a block is told: scores before its first row, and the role its last row has to end with."""

    before: list[float] | None
    last: int | None


def borders(blocks: DataFrame, m: Model) -> dict[int, Border]:
    """The scores and roles at the borders of all blocks.

    A block sends the effect of its first conversation's rows, as one matrix, and the scores
    after its last one's: a row for each block, which are chained here in order.
    """
    n = len(m.roles)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, list] = {}
        for block, c, rows in _Rows(batches, ["codes"]):
            known = [r[0] for r in rows]
            fresh = through(known, m, None)
            if block not in ends:
                units = [[0.0 if q == r else -math.inf for r in range(n)] for q in range(n)]
                ends[block] = [c, [x for unit in units for x in through(known, m, unit)], fresh, c, None]
            else:
                ends[block][3:] = [c, fresh]
        rows = [(block, *values) for block, values in ends.items()]
        types = [pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.list_(pa.float64())]
        names = ["block", "c", "matrix", "fresh", "d", "after"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    found = _blocks(blocks, "codes").mapInArrow(
        summarise, "block bigint, c string, matrix array<double>, fresh array<double>, d string, after array<double>"
    )
    rows = sorted(found.collect(), key=lambda r: r.block)
    # Forwards: the scores with which each block's first conversation goes on, None if it starts there.
    entry: list[list[float] | None] = []
    leaving: list[float] = []
    for k, row in enumerate(rows):
        goes_on = k > 0 and rows[k - 1].d == row.c
        entry.append(leaving if goes_on else None)
        if row.after is not None:
            leaving = row.after
        elif not goes_on:
            leaving = row.fresh
        else:
            leaving = [max(leaving[q] + row.matrix[q * n + r] for q in range(n)) for r in range(n)]
    # Backwards: the role before a block follows from the role after it.
    last: list[int | None] = [None] * len(rows)
    for k in range(len(rows) - 1, 0, -1):
        if entry[k] is None:
            continue
        row = rows[k]
        scores = entry[k]
        end = last[k] if row.after is None else None
        every = [[scores[q] + row.matrix[q * n + r] for r in range(n)] for q in range(n)]
        if end is None:
            end = max(range(n), key=lambda r: (max(every[q][r] for q in range(n)), -r))
        last[k - 1] = max(range(n), key=lambda q: (every[q][end], -q))
    return {row.block: Border(entry[k], last[k]) for k, row in enumerate(rows)}


def formatted(blocks: DataFrame, m: Model) -> DataFrame:
    """The turns: ``conversation, order, part, role_given, role, said, rendered``."""
    known = borders(blocks, m)
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: int | None = None
        held: tuple | None = None  # the last run of a block isn't known as such until the next one comes
        for run in _Rows(batches, ["conversation", "o", "role", "text", "codes"]):
            if held:
                yield turns(held, seen != held[0], run[0] != held[0])
                seen = held[0]
            held = run
        if held:
            yield turns(held, seen != held[0], True)

    def turns(run: tuple, opens_block: bool, ends_block: bool) -> pa.RecordBatch:
        block, _, rows = run
        before = known[block].before if opens_block else None
        last = known[block].last if ends_block else None
        states, _ = path([r[4] for r in rows], m, before, last)
        out: list[tuple] = []
        for (conversation, o, role, text, _), lines in zip(rows, states, strict=True):
            for part, (own, said) in enumerate(turns_of(text, lines, m.roles)):
                out.append((conversation, o, part, role, own, said, rendered(own, said)))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], names=[f.name for f in fields]
        )

    schema = (
        f"conversation {kinds['conversation']}, `order` {kinds['o']}, part bigint, role_given string, role string,"
        " said string, rendered string"
    )
    fields = list(to_arrow_schema(T.StructType.fromDDL(schema)))
    return _blocks(blocks, "conversation", "role", "text", "codes").mapInArrow(decode, schema)
