"""Byte-level byte-pair encoding by a rank file, and its inverse.

A text is cut into pre-tokens by a pattern. Whole pre-tokens that are in the vocabulary are
found in a minimal perfect hash; the others are merged pair by pair, lowest rank first, with
a heap over a linked list of their bytes.

Null and empty texts have no ids. Rows are independent, so repeated rows give equal ids.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column

from marquee.llm.batches import SpanHash, mixed, raw, text_udf

MEMO_WORDS = 250_000

# Fixed value: the pattern that the public byte-level vocabularies were made with.
RUNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Letters and digits that the tokenizer libraries' tables don't know yet, being
# of a later version of Unicode than theirs; they are neither to them.
UNKNOWN_YET = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F "
    "12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)

# Kept from task to task in a worker: the kinds of code points, and for a vocabulary the ranks that merging looks up.
_KINDS: list[np.ndarray] = []
_RANKS: dict[int, "Ranks"] = {}

_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Vocabulary(NamedTuple):
    """Tokens by id in one byte string, and the minimal perfect hash over them.

    ``shift`` has for each bucket of hashes the number that sends its tokens to free places,
    or minus the place less one for a bucket with a single token; ``ids`` is the token at a place.
    """

    flat: np.ndarray
    offsets: np.ndarray
    shift: np.ndarray
    ids: np.ndarray


class Ranks(NamedTuple):
    """The rank of a token, that of every two bytes (-1: no token), and what was merged before."""

    of: Callable[[bytes], int | None]
    pairs: list[list[int]]
    memo: dict[bytes, bytes]


def load(path: str) -> Vocabulary:
    """Read a rank file: a line per token, base64 and id, the ids being 0, 1, …"""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ids of the rank file have gaps")
    return build([ranks[i] for i in range(len(ranks))])


def _place(hashes: np.ndarray, shift: np.ndarray | int, n: int) -> np.ndarray:
    return (mixed(hashes ^ (np.asarray(shift, np.uint64) * _SPREAD)) % np.uint64(n)).astype(np.int64)


def build(tokens: list[bytes]) -> Vocabulary:
    """Lay out the tokens and find the shifts, buckets with the most tokens first."""
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    hashes = SpanHash(flat).of(offsets[:-1], offsets[1:])
    n = len(tokens)
    if len(np.unique(hashes)) < n:
        raise ValueError("two tokens are alike")
    n_buckets = n // 4 + 1
    bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
    members = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    firsts = np.cumsum(sizes) - sizes
    shift, ids, taken = np.zeros(n_buckets, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    largest_first = np.argsort(-sizes, kind="stable")
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in largest_first[sizes[largest_first] > 1]:
        own = members[firsts[b] : firsts[b] + sizes[b]]
        base = np.uint64(0)
        while True:
            places = _place(hashes[own][None, :], (tries + base)[:, None], n)
            in_order = np.sort(places, axis=1)
            fits = ~taken[places].any(axis=1) & (in_order[:, 1:] != in_order[:, :-1]).all(axis=1)
            if fits.any():
                k = int(np.argmax(fits))
                shift[b], ids[places[k]], taken[places[k]] = int(base) + k + 1, own, True
                break
            base += np.uint64(len(tries))
    alone = largest_first[sizes[largest_first] == 1]
    free = np.flatnonzero(~taken)
    shift[alone], ids[free] = -free - 1, members[firsts[alone]]
    return Vocabulary(flat, offsets, shift, ids)


def whole_tokens(vocabulary: Vocabulary, words: list[bytes]) -> np.ndarray:
    """The id of each word that is a token, -1 for the others."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    hashes = SpanHash(flat).of(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
    n = len(vocabulary.ids)
    shift = vocabulary.shift[(hashes % np.uint64(len(vocabulary.shift))).astype(np.int64)]
    place = np.where(shift < 0, -shift - 1, _place(hashes, np.maximum(shift, 0), n))
    found = vocabulary.ids[place]
    starts, stops = vocabulary.offsets[found], vocabulary.offsets[found + 1]
    tokens = vocabulary.flat.tobytes()
    same = [tokens[a:b] == w for a, b, w in zip(starts.tolist(), stops.tolist(), words, strict=True)]
    return np.where(same, found, -1)


def merge(word: bytes, rank: Callable[[bytes], int | None], pairs: list[list[int]]) -> list[int]:
    """Join neighbours, the pair of lowest rank first and the leftmost of equal ones.

    ``pairs`` has the rank of every two bytes, -1 if they are no token. The heap's entries are
    a rank and a place in one number; ``now`` has the present rank of the pair at a place, so
    an entry that no longer holds is known when it comes up.
    """
    n = len(word)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    now = [pairs[a][b] for a, b in zip(word, word[1:])]
    now.append(-1)
    heap = [r << bits | i for i, r in enumerate(now) if r >= 0]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        i = entry & mask
        if now[i] != entry >> bits:
            continue
        middle = after[i]
        end = after[middle]
        now[middle] = -1
        after[i], before[end] = end, i
        if end < n:
            r = now[i] = rank(word[i : after[end]], -1)
            if r >= 0:
                push(heap, r << bits | i)
        else:
            now[i] = -1
        left = before[i]
        if left >= 0:
            r = now[left] = rank(word[left:end], -1)
            if r >= 0:
                push(heap, r << bits | left)
    ids, i = [], 0
    while i < n:
        ids.append(rank(word[i : after[i]]))
        i = after[i]
    return ids


def _kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 a digit, 3 white space, 0 anything else."""
    if not _KINDS:
        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, members in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
            for found in regex.finditer(members, every):
                points = np.frombuffer(found[0].encode("utf-32-le"), np.uint32)
                table[points] = kind
        for span in UNKNOWN_YET.split():
            low, _, high = span.partition("-")
            table[int(low, 16) : int(high or low, 16) + 1] = 0
        _KINDS.append(table)
    return _KINDS[0]


def _by_runs(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of ``RUNS``, without a search per match.

    The pattern takes runs of one kind. The last of several white space characters before
    something else is cut off; if it is a blank, it opens the next pre-token instead. An
    apostrophe that opens a pre-token takes one of the short endings with it.
    """
    n = len(points)
    kind = _kinds()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    text_start = first.copy()
    first[1:n] |= kind[1:] != kind[:-1]
    space = np.zeros(n + 1, bool)
    space[:n] = kind == 3
    # A white space character before something else of the same text starts a pre-token.
    last_space = np.flatnonzero(space[:n] & ~space[1:] & ~text_start[1:])
    first[last_space] = True
    joins = last_space[points[last_space] == 32]
    first[joins + 1] = False
    quote = np.flatnonzero((points == 39) & first[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == 1) & ~text_start[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(text_start[np.minimum(quote + 2, n)], 0, two)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, size)
        quote, size = quote[size > 0], size[size > 0]
        first[quote + 1] = False
        first[quote + 1 + size] = True
    first[n] = True
    places = np.flatnonzero(first)
    return places[:-1], places[1:]


def _pre_tokens(texts: pa.Array, pattern: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The pre-tokens of all texts as numbers into a list of distinct ones, and each text's count."""
    if pattern == RUNS:
        joined = "".join(text or "" for text in texts.to_pylist())
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), [], np.zeros(len(texts), np.int64)
        starts, ends = _by_runs(points, offsets)
        codes, _ = pd.factorize(SpanHash(points).of(starts, ends))
        _, one = np.unique(codes, return_index=True)
        sizes = ends - starts
        place = np.arange(len(points)) - np.repeat(starts - starts[one][codes], sizes)
        if (sizes == sizes[one][codes]).all() and (points == points[np.minimum(place, len(points) - 1)]).all():
            distinct = [joined[a:b].encode() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            before = np.searchsorted(starts, offsets)
            return codes, distinct, np.diff(before)
    cut = regex.compile(pattern).findall
    found = [cut(text) if text else [] for text in texts.to_pylist()]
    each = np.empty(sum(map(len, found)), object)
    each[:] = [word for words in found for word in words]
    codes, distinct = pd.factorize(each)
    return codes, [w.encode() for w in distinct], np.array([len(words) for words in found], np.int64)


def _ranks(vocabulary: Vocabulary) -> Ranks:
    """Built once in a worker, however many tasks it gets."""
    tokens = vocabulary.flat.tobytes()
    key = hash((tokens, vocabulary.offsets.tobytes()))
    if key not in _RANKS:
        bounds = vocabulary.offsets.tolist()
        rank = {tokens[a:b]: i for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))}.get
        pairs = [[rank(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        _RANKS[key] = Ranks(rank, pairs, {})
    return _RANKS[key]


def _encoder(vocabulary: Vocabulary, pattern: str) -> Callable[[pa.Array], pa.Array]:
    rank, pairs, memo = _ranks(vocabulary)

    def ids_of(words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed."""
        whole = whole_tokens(vocabulary, words)
        out = []
        for word, token, packed in zip(words, whole.tolist(), np.array(whole, "<u4").view("V4").tolist(), strict=True):
            if token < 0:
                packed = memo.get(word)
                if packed is None:
                    packed = array("I", merge(word, rank, pairs)).tobytes()
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    if len(word) <= 64:
                        memo[word] = packed
            out.append(packed)
        return out

    def encode(texts: pa.Array) -> pa.Array:
        codes, distinct, counts = _pre_tokens(texts, pattern)
        if not distinct:
            return pa.array([b""] * len(texts), pa.binary())
        packed = ids_of(distinct)
        sizes = np.array([len(x) for x in packed], np.int64) >> 2
        flat = np.frombuffer(b"".join(packed), np.dtype("<u4"))
        firsts = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(firsts[codes] - (ends - n), n)]
        last = np.concatenate([[0], ends])[np.cumsum(counts)] * 4
        places = pa.py_buffer(np.concatenate([[0], last]).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, places, pa.py_buffer(ids)])

    return encode


def _decoder(vocabulary: Vocabulary) -> Callable[[pa.Array], pa.Array]:
    lengths = np.diff(vocabulary.offsets)

    def decode(packed: pa.Array) -> pa.Array:
        data, offsets = raw(packed)
        ids = np.frombuffer(data.tobytes(), np.dtype("<u4")).astype(np.int64)
        n = lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        text = vocabulary.flat[np.arange(total) + np.repeat(vocabulary.offsets[ids] - (ends - n), n)]
        last = np.concatenate([[0], ends]).astype(np.int64)[offsets // 4]
        return pa.Array.from_buffers(
            pa.binary(), len(packed), [None, pa.py_buffer(last.astype(np.int32)), pa.py_buffer(text)]
        )

    return decode


def encode(text: Column, vocabulary: Vocabulary, pattern: str) -> Column:
    """The ids of a text as little-endian unsigned 32-bit integers, one after the other."""
    return text_udf(lambda: _encoder(vocabulary, pattern), "binary")(text)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes that such ids stand for."""
    return text_udf(lambda: _decoder(vocabulary), "binary")(ids)


def round_trip(text: Column, vocabulary: Vocabulary, pattern: str) -> Column:
    """``token_ids, intact``: the ids as ``encode`` gives them, and whether ``decode`` gives the text's bytes back.

    One Python step instead of two, so a task has one worker with one vocabulary, and the decoded bytes stay in it.
    """

    def both() -> Callable[[pa.Array], list[pa.Array]]:
        to_ids, to_bytes = _encoder(vocabulary, pattern), _decoder(vocabulary)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids = to_ids(texts)
            return [ids, pc.equal(to_bytes(ids), pc.fill_null(texts, "").cast(pa.binary()))]

        return work

    return text_udf(both, "token_ids binary, intact boolean")(text)
