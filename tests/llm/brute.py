"""The operators' answers by the plainest means, for small tables."""

import base64
import hashlib
import html
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- fingerprints and near-duplicates ---


def edited(texts):
    """Texts in order, each with its last quarter replaced by the start of the next one."""
    out = []
    for i, text in enumerate(texts):
        n = len(text) // 4
        out.append(text[: len(text) - n] + texts[(i + 1) % len(texts)][:n])
    return out


MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def toss(own, left):
    """Twice the place of the lowest bit in which two different numbers differ, plus the own bit there."""
    place = ((own ^ left) & -(own ^ left)).bit_length() - 1
    return 2 * place + (own >> place & 1)


def phrases_of(symbols):
    """One level of locally consistent parsing, a symbol at a time."""
    runs = []
    for symbol in symbols:
        if runs and runs[-1][0] == symbol:
            runs[-1][1] += 1
        else:
            runs.append([symbol, 1])
    merged = [mix((s ^ n * 0xA24BAED4963EE407) & MASK) if n > 1 else s for s, n in runs]
    labels = [toss(x, merged[i - 1] if i else ~x) for i, x in enumerate(merged)]
    for _ in range(3):
        labels = [toss(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
    opens = [i for i in range(len(labels)) if i == 0 or (i < len(labels) - 1 and labels[i - 1] < labels[i] > labels[i + 1])]
    spans = [merged[a:b] for a, b in zip(opens, [*opens[1:], len(merged)], strict=True)]
    return [mix(sum((x + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, x in enumerate(span)) & MASK) for span in spans]


def fingerprint(text, level):
    symbols, depth, names = [ord(c) for c in text], 0, []
    while symbols:
        symbols = phrases_of(symbols)
        depth += 1
        if depth >= level or len(symbols) == 1:
            names += symbols
        if len(symbols) == 1:
            break
    times, out = Counter(), set()
    for name in names:
        high = name >> 20 << 20
        out.add(mix((high + times[high] * 0xA24BAED4963EE407) & MASK) >> 32)
        times[high] += 1
    return "".join(f"{x:08x}" for x in sorted(out))


def likeness(a, b):
    a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (a, b))
    return len(a & b) / len(a | b) if a or b else 1.0


def simhash(text, size=3):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(own[i : i + size]) for i in range(len(own) - size + 1)] if len(own) >= size else [" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(prints, max_bits=2):
    """For each place the smallest place that can be reached over links."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


# --- lines ---


def deduplicated(documents, least=50):
    """(id, text) in order -> the kept texts: each line against every earlier place, as far as both go on alike."""
    places, used, out = {}, [], []
    for d, (_, text) in enumerate(documents):
        lines = (text or "").split("\n")
        counts = [len(re.findall(r"[^ \t\r\f\x0B]+", line)) for line in lines]
        used.append([(i, lines[i], n) for i, n in enumerate(counts) if n])
        gone = set()
        for k, (first, line, _) in enumerate(used[d]):
            earlier = places.setdefault(line, [])
            for e, m in earlier:
                n = 0
                while k + n < len(used[d]) and m + n < len(used[e]) and used[d][k + n][1] == used[e][m + n][1]:
                    n += 1
                if sum(x[2] for x in used[d][k : k + n]) >= least:
                    gone.update(range(first, used[d][k + n - 1][0] + 1))
            earlier.append((d, k))
        out.append(None if text is None else "\n".join(line for i, line in enumerate(lines) if i not in gone))
    return out


# --- benchmark and licences ---


def shared(text, items, window=10):
    """Number of words, of words in a window of an item, and the items' ids."""
    own = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        theirs = words(item_text)
        n = min(window, len(theirs))
        windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(own), len(hit), sorted(str(i) for i in found if i is not None)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def phrases(text):
    own = words(text)
    places = [
        (i, label)
        for phrase, label in PHRASES.items()
        for i in range(len(own))
        if own[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(own), len(places), min(starts, default=None), max(starts, default=None), labels


def licence_texts(text, texts, least=0.6, slack=3):
    """``label, first word, score`` of every licence text, tried at every place."""
    own, found = words(text), []
    for label, template, keys in texts:
        template = words(template)
        places = []
        for key in map(words, keys):
            at = next(i for i in range(len(template)) if template[i : i + len(key)] == key)
            places.append((at, key))
        accepted = []
        for begin in range(-len(template) - slack, len(own) + slack):
            ok = all(
                any(0 <= begin + at + d and own[begin + at + d : begin + at + d + len(key)] == key for d in range(-slack, slack + 1))
                for at, key in places
            )
            if ok:
                near = [
                    any(0 <= begin + i + d < len(own) and own[begin + i + d] == w for d in range(-slack, slack + 1))
                    for i, w in enumerate(template)
                ]
                if sum(near) / len(near) >= least:
                    accepted.append((begin, sum(near) / len(near)))
        while accepted:
            side = [a for a in accepted if a[0] <= accepted[0][0] + 2 * slack]
            begin, score = max(side, key=lambda a: (a[1], -a[0]))
            found.append((label, max(0, begin), score))
            accepted = accepted[len(side) :]
    return sorted(found)


# --- tokens ---


def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- language ---


def third(id_):
    return zlib.crc32(str(id_).encode()) % 3


def grams(text):
    counts = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" "):
        if word:
            edged = f"\0{word}\0"
            for n in (1, 2, 3):
                counts.update(edged[i : i + n] for i in range(len(edged) - n + 1) if edged[i : i + n].strip("\0"))
    return counts


def ranking(counts, size):
    def code(gram):
        points = [ord(c) + 1 for c in gram] + [0] * (3 - len(gram))
        return points[0] << 42 | points[1] << 21 | points[2]

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def languages(documents, size):
    """(id, text, lang) -> (language, score) each."""
    totals = {}
    for id_, text, lang in documents:
        if lang is not None and text is not None and (id_ is not None and third(id_) != 1):
            totals.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: i for i, g in enumerate(ranking(c, size))} for lang, c in totals.items() if c}
    out = []
    for _, text, _ in documents:
        own = ranking(grams(text), size)
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        apart = {
            lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()
        }
        best = min(sorted(apart), key=apart.get)
        out.append((best, 1 - apart[best] / (size * len(own))))
    return out


# --- pages ---


def article(page):
    """The text of the one article of a page of the test tables."""
    inner = re.search(r"<article>(.*)</article>", page or "", re.DOTALL)
    pieces = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in pieces]
    return "\n".join(t for t in texts if t)


# --- quality ---


def tokens(text):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", text or "")


def ngrams(text):
    own = tokens(text)
    return [(w,) for w in own] + [("same",) * 3 if a == b else (a, b) for a, b in zip(own, own[1:], strict=False)]


def mean_weights(documents, good):
    """(id, text) and the ids of good ones -> mean log ratio of exact n-gram models, without hashing."""
    target, raw = Counter(), Counter()
    for id_, text in documents:
        found = ngrams(text)
        raw.update(found)
        if id_ in good:
            target.update(found)
    n = len(raw)
    t, r = sum(target.values()) + n, sum(raw.values()) + n
    out = []
    for _, text in documents:
        found = ngrams(text)
        weights = [math.log((target[g] + 1) / t) - math.log((raw[g] + 1) / r) for g in found]
        out.append(sum(weights) / max(1, len(found)))
    return out
