"""Passages of benchmark items in documents, found by one Aho-Corasick automaton.

Items and documents are normalised alike: A-Z to lower case, words of digits, letters and
everything beyond ASCII, one blank between words. Every run of ``window`` words of an item is
a pattern (a shorter item as a whole), and one automaton over all of them reads each text
once. Hits are given as spans of the original text.

The automaton is made in every task from the words of the items. Beyond ``words_per_automaton``
the items, and an item that is longer itself, are split: the documents are read once for each
part, and what a pass has found is written before the next one starts, the table of the pass
before being deleted. So the driver, the plan and a worker hold one part at a time, however
large the benchmark is.

Null texts have no words and no hits; so do empty ones. Items that are null or have no word
match nothing. Repeated rows give equal results, and items that share a passage are all named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.batches import marked, raw, runs, text_udf
from marquee.llm.tables import Stored

WINDOW = 10
# A window has about 60 bytes, so this is a trie of one or two million nodes.
WORDS_PER_AUTOMATON = 25_000

IN_WORDS = marked("0123456789abcdefghijklmnopqrstuvwxyz")
_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if IN_WORDS[b] else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_CLEAN).split() if text else []


def patterns_of(items: list[tuple[object, str | None]], window: int) -> dict[bytes, list[int]]:
    """The windows of all items, with the places of the items that have them."""
    found: dict[bytes, list[int]] = {}
    for place, (_, text) in enumerate(items):
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            holders = found.setdefault(b" %b " % b" ".join(words[i : i + window]), [])
            if not holders or holders[-1] != place:
                holders.append(place)
    return found


def _scanner(items: list[tuple[object, str | None]], window: int) -> Callable[[pa.Array], list]:
    automaton = ahocorasick.Automaton()
    for pattern, holders in patterns_of(items, window).items():
        automaton.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, len(pattern), holders))
    if len(automaton):
        automaton.make_automaton()

    def hits(joined: str) -> tuple[list[tuple[int, int]], set[int]]:
        """Where patterns lie in the normalised text as (start, words), and the items' places."""
        at, places = [], set()
        for end, (n, length, holders) in automaton.iter(joined):
            at.append((end - length + 1, n))
            places.update(holders)
        return at, places

    def scan(texts: pa.Array) -> list:
        data, offsets = raw(texts)
        plain = data.tobytes().translate(_CLEAN)
        n_words, spans, names = [], [], []
        for i in range(len(texts)):
            words = plain[offsets[i] : offsets[i + 1]].split()
            n_words.append(len(words))
            joined = b" %b " % b" ".join(words)
            at, places = hits(joined.decode("latin-1")) if words and len(automaton) else ([], ())
            names.append([str(items[place][0]) for place in sorted(places) if items[place][0] is not None])
            spans.append(_spans(texts[i].as_py(), joined, at) if at else [])
        return [n_words, spans, names]

    return scan


def _spans(text: str, joined: bytes, at: list[tuple[int, int]]) -> list[dict]:
    """Hits in the normalised text as spans of words and of the original's characters.

    Hits that share or touch a word are one span.
    """
    data = np.frombuffer(text.encode().translate(_CLEAN), np.uint8)
    starts, ends = runs(IN_WORDS[data], np.array([0, len(data)]))
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    covered = np.zeros(len(starts) + 1, np.int64)
    for start, n in at:
        first = int(np.searchsorted(blanks, start))
        covered[first] += 1
        covered[first + n] -= 1
    firsts, lasts = runs(np.cumsum(covered)[:-1] > 0, np.array([0, len(starts)]))
    # Bytes to characters: count the bytes that open one.
    opens = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
    return [
        {"start": int(opens[starts[a]]), "end": int(opens[ends[b - 1]]), "first_word": int(a), "n_words": int(b - a)}
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)
    ]


_SPANS = "array<struct<start:int,end:int,first_word:int,n_words:int>>"


def _pieces(text: str | None, window: int, most: int) -> Iterator[tuple[int, str]]:
    """An item's words in pieces that have ``most`` windows at most, and how many words a piece has."""
    words = words_of(text)
    for start in range(0, max(1, len(words) - window + 1), most):
        piece = words[start : start + most + window - 1]
        yield len(piece), b" ".join(piece).decode()


def _parts(items: DataFrame, id_column: str, text_column: str, window: int, most: int) -> Iterator[list]:
    """The items in parts of so many words; the driver holds one part at a time."""
    part, n = [], 0
    for row in items.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).toLocalIterator():
        for words, piece in _pieces(row.text, window, most):
            if part and n + words > most:
                yield part
                part, n = [], 0
            part.append((row.id, piece))
            n += words
    yield part


def scanned(
    documents: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    words_per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """The documents as ``row``, with ``found``: what the items have in common with each text.

    ``found`` has ``n_words``, ``n_hit`` (words inside a hit), ``spans`` (``start`` and ``end`` as
    characters of the text) and ``items`` (distinct ids as text, sorted).
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    before: Stored | None = None
    done: Stored | None = None
    for k, part in enumerate(_parts(items, item_id, item_text, window, words_per_automaton)):
        if k:
            before, done = done, Stored(rows)
            rows = done.frame
            if before:
                before.delete()
        scan = text_udf(
            lambda part=part: _scanner(part, window),
            f"n_words bigint, spans {_SPANS}, items array<string>",
        )
        rows = rows.withColumn("pass", scan(F.col(f"row.`{text}`")))
        if k:
            spans, named = _united(F.col("spans"), F.col("pass.spans")), F.concat("items", "pass.items")
        else:
            spans, named = F.col("pass.spans"), F.col("pass.items")
        rows = rows.select("row", "pass.n_words", spans.alias("spans"), F.array_sort(F.array_distinct(named)).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["n_words"])
    return rows.select("row", F.struct("n_words", hit.alias("n_hit"), "spans", "items").alias("found"))


def _united(earlier: Column, later: Column) -> Column:
    """The spans of two passes, those that overlap or touch made one."""
    every = F.array_sort(F.concat(earlier, later))

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        stop = F.greatest(last["first_word"] + last["n_words"], span["first_word"] + span["n_words"])
        joined = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], span["end"]).alias("end"),
            last["first_word"].alias("first_word"),
            (stop - last["first_word"]).alias("n_words"),
        )
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["first_word"] + F.try_element_at(done, F.lit(-1))["n_words"] >= span["first_word"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(every, F.array().cast(_SPANS), add)


def clean(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that share no window with an item, with their columns as they are."""
    return scanned(documents, items, **options).where("found.n_hit = 0").select("row.*")
