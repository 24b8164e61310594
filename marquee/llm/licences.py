"""Licence texts in documents, by a positional index of their rarest words.

Each template is a text of a licence, or a short phrase that names one. The index has, for
every mandatory phrase of a template, its rarest word and where in the template it stands; rare
means a high inverse document frequency over all the documents, with the templates' own counts
deciding ties. A document's words are looked up there: an occurrence says where the template
would have to begin. Places on which the words of all its mandatory phrases agree, give or take
a few words, are candidates. As a template is only accepted where all its mandatory phrases
are, no place that the verification accepts is missed. Each candidate is verified: a phrase
must be there word by word, and a licence text must have its mandatory phrases where they belong,
give or take a few words, and most of its words in place. Of accepted beginnings that are next
to each other the one with the highest score counts, the first one of equals.

Words are compared by their bytes after A-Z went to lower case; anything but digits, letters
and what lies beyond ASCII separates them. Null and empty texts have no words and no labels.
Documents are independent, so repeated rows give equal results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.batches import SpanHash, marked, raw, runs, slices, text_udf
from marquee.llm.decontaminate import words_of

# A licence text is there if this share of its words is in place.
LEAST = 0.6
# How far apart from its place a part of a licence text may be, in words.
SLACK = 3

# Phrases that name a licence, and the label each stands for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Characteristic passages of public licence texts and notices, with the phrases
# that must be in them.
TEXTS = [
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0",
        ["apache license", "version 2 0"],
    ),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
        ["except in compliance with the license", "apache org licenses"],
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    ("mit", "Released under the MIT License", ["mit license"]),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted",
        ["with or without fee"],
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
        ["free software", "gnu general public license"],
    ),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    (
        "lgpl",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ["gnu lesser general public license"],
    ),
    (
        "agpl",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        ["gnu affero general public license"],
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ["mozilla public license"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ["free and unencumbered software", "public domain"],
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ["cc by nc sa 4 0"]),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to"
        " this work",
        ["waived all copyright"],
    ),
]

_IN_WORDS = marked("0123456789abcdefghijklmnopqrstuvwxyz")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]
    exact: bool


def templates(
    phrases: dict[str, str] | None = None, texts: list[tuple[str, str, list[str]]] | None = None
) -> list[Template]:
    """The phrases, which must be met exactly, and the licence texts with their key phrases' places."""
    found = []
    for phrase, label in (PHRASES if phrases is None else phrases).items():
        words = tuple(words_of(phrase))
        found.append(Template(label, words, ((0, words),), True))
    for label, text, keys in TEXTS if texts is None else texts:
        words = tuple(words_of(text))
        places = []
        for key in keys:
            own = tuple(words_of(key))
            at = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
            if not at:
                raise ValueError(f"{key!r} is not in the text of {label}")
            places.append((at[0], own))
        found.append(Template(label, words, tuple(places), False))
    return found


def _hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    return SpanHash(data).of(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


class Words:
    """The words of a slice of texts: their hashes, bytes and the text of each."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = raw(texts)
        self.data = _LOWER[data]
        self.starts, self.ends = runs(_IN_WORDS[self.data], offsets)
        self.hashes = SpanHash(self.data).of(self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)

    def at(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def document_frequencies(documents: DataFrame, text: str, every: list[Template]) -> dict[bytes, int]:
    """In how many of the documents each of the templates' words occurs."""
    vocabulary = sorted({w for t in every for w in t.words})
    sought = _hashes(vocabulary)
    order = np.argsort(sought)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                words = Words(part)
                place = np.minimum(np.searchsorted(sought[order], words.hashes), len(order) - 1)
                hit = np.flatnonzero(sought[order][place] == words.hashes)
                owner = np.searchsorted(words.bounds, hit, side="right") - 1
                pairs = np.unique(owner * len(vocabulary) + order[place[hit]])
                sums += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["word", "n"])

    found = documents.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word bigint, n bigint")
    return {vocabulary[row[0]]: row[1] for row in found.groupBy("word").agg(F.sum("n")).collect()}


class Index(NamedTuple):
    """Postings of rare words, sorted by hash: the word's hash, its template, mandatory phrase and place there."""

    every: list[Template]
    hashes: np.ndarray
    template: np.ndarray
    key: np.ndarray
    place: np.ndarray


def index(every: list[Template], frequencies: dict[bytes, int]) -> Index:
    """Index the word with the highest inverse document frequency of each mandatory phrase."""
    shared = {w: sum(w in t.words for t in every) for t in every for w in t.words}
    rows = []
    for number, template in enumerate(every):
        for key, (place, phrase) in enumerate(template.keys):
            rarest = min(range(len(phrase)), key=lambda i: (frequencies.get(phrase[i], 0), shared[phrase[i]], phrase[i], i))
            rows.append((phrase[rarest], number, key, place + rarest))
    hashes = _hashes([row[0] for row in rows])
    order = np.argsort(hashes, kind="stable")
    template, key, place = (np.array([row[k] for row in rows], np.int64)[order] for k in (1, 2, 3))
    return Index(every, hashes[order], template, key, place)


class Match(NamedTuple):
    label: str
    exact: bool
    first_word: int
    n_words: int
    score: float


def _match(words: Words, low: int, high: int, template: Template, begin: int) -> Match | None:
    """Verify a template that would begin at a word of the text in ``low … high``."""
    n = len(template.words)

    def there(place: int, phrase: tuple[bytes, ...], slack: int) -> bool:
        for shift in sorted(range(-slack, slack + 1), key=abs):
            start = begin + place + shift
            if start >= low and start + len(phrase) <= high and all(words.at(start + i) == w for i, w in enumerate(phrase)):
                return True
        return False

    if template.exact:
        return Match(template.label, True, begin - low, n, 1.0) if there(0, template.words, 0) else None
    if not all(there(place, phrase, SLACK) for place, phrase in template.keys):
        return None
    first, last = max(low, begin - SLACK), min(high, begin + n + SLACK)
    around = [words.at(i) for i in range(first, last)]
    places: dict[bytes, list[int]] = {}
    for i, word in enumerate(around):
        places.setdefault(word, []).append(first + i - begin)
    score = sum(any(abs(p - i) <= SLACK for p in places.get(w, ())) for i, w in enumerate(template.words)) / n
    return Match(template.label, False, max(0, begin - low), n, score) if score >= LEAST else None


def _scanner(found: Index) -> Callable[[pa.Array], list]:
    distinct = np.unique(found.hashes)
    lows = np.searchsorted(found.hashes, distinct)
    sizes = np.diff(np.append(lows, len(found.hashes)))

    def scan(texts: pa.Array) -> list:
        words = Words(texts)
        n_words = np.diff(words.bounds)
        place = np.minimum(np.searchsorted(distinct, words.hashes), len(distinct) - 1)
        hit = np.flatnonzero(distinct[place] == words.hashes)
        owner = np.searchsorted(words.bounds, hit, side="right") - 1
        # One row for each occurrence and posting: where the template would begin.
        n = sizes[place[hit]]
        each = np.repeat(np.arange(len(hit)), n)
        posting = lows[place[hit]][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        template = found.template[posting]
        begin = hit[each] - found.place[posting]
        text = owner[each]
        matches: list[list[Match]] = [[] for _ in range(len(texts))]
        order = np.lexsort((begin, template, text))
        rows = zip(text[order].tolist(), template[order].tolist(), found.key[posting[order]].tolist(), begin[order].tolist(), strict=True)
        for (t, k), own in groupby(rows, lambda row: row[:2]):
            votes: list[list[int]] = [[] for _ in found.every[k].keys]
            for _, _, key, b in own:
                votes[key].append(b)
            if all(votes):
                matches[t] += _verified(words, int(words.bounds[t]), int(words.bounds[t + 1]), found.every[k], votes)
        return [n_words, [[m._asdict() for m in sorted(own, key=lambda m: (m.first_word, m.label))] for own in matches]]

    return scan


def _verified(words: Words, low: int, high: int, template: Template, votes: list[list[int]]) -> list[Match]:
    """The template's matches; ``votes`` has for each mandatory phrase where the template would begin, sorted."""
    slack = 0 if template.exact else SLACK

    def agreed(begin: int) -> bool:
        return all((i := bisect_left(own, begin - slack)) < len(own) and own[i] <= begin + slack for own in votes)

    accepted = []
    for begin in sorted({v + d for v in min(votes, key=len) for d in range(-slack, slack + 1)}):
        if agreed(begin) and (match := _match(words, low, high, template, begin)):
            accepted.append((begin, match))
    best, i = [], 0
    while i < len(accepted):
        side = [a for a in accepted[i : i + 2 * slack + 1] if a[0] <= accepted[i][0] + 2 * slack]
        best.append(max(side, key=lambda a: (a[1].score, -a[0]))[1])
        i += len(side)
    return best


_MATCHES = "array<struct<label:string,exact:boolean,first_word:bigint,n_words:bigint,score:double>>"


def scanned(text: Column, found: Index) -> Column:
    """``n_words`` and the ``matches``: label, whether by a phrase, first word, words and score."""
    return text_udf(lambda: _scanner(found), f"n_words bigint, matches {_MATCHES}")(text)
