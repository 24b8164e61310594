"""The main text of web pages, by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the tags that open or close a block.
Each block has features of its ancestors (tags, roles, and what their classes and ids say)
and of its text (length, links, punctuation, telling words). The field scores a block's label,
text or not, by its features and by the label of the block before; the best labels of a page
are found by Viterbi. It is trained by maximum likelihood on labelled pages: a few written
ones that have every kind of block, and a bounded sample of the table's own pages that mark
their article, a copy of which is learnt from without those marks.

Scripts, styles and other content that isn't shown are no blocks. Character references are
decoded, white space inside a block is one blank, blocks are joined by a line end.

Null and empty pages have an empty text, as have pages without a block of main text. Markup
that isn't closed ends with the page. Pages are independent, so repeated rows agree.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.batches import text_udf

# At most so many of the table's pages are learnt from, of up to so many blocks each.
MOST_PAGES = 200
MOST_BLOCKS = 120
ROUNDS = 120

# Element names as HTML has them.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre search section"
    " select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script|style|template|noscript|svg|iframe|object|canvas|title|textarea"

# What marks the main part of a page.
_MARKS = {"in:article", "in:main", "says:main"}

# What a class, id or role says about everything inside, by the words in it.
SIGNS = {
    "advert": "ad ads advert adverts advertisement adsense banner promo promoted promotion sponsor sponsored sponsors",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination toc tabs toolbar",
    "comment": "comment comments discussion disqus replies reply respond responses",
    "notice": "alert consent cookie cookies gdpr message modal newsletter notice notification overlay paywall popup subscribe subscription warning",
    "side": "aside complementary recommended related share sharing sidebar social trending widget widgets",
    "foot": "bottom contentinfo copyright credits foot footer legal",
    "head": "brand head header hero logo masthead top topbar",
    "form": "contact form login register search signin signup",
    "main": "article articlebody body content entry main post story text",
}
_SIGN_OF = {word: sign for sign, words in SIGNS.items() for word in words.split()}

# Words that tell what a short block is.
_TELLING = re.compile(
    r"©|\(c\)|copyright|all rights reserved|cookie|privacy policy|terms of|subscribe|newsletter|sign (?:in|up)|log ?in"
    r"|advertisement|sponsored|share (?:this|on)|read more|related|click here|leave a (?:comment|reply)|\d+ comments?",
    re.IGNORECASE,
)

# The rest of a tag: quoted values may hold anything, a stray quote is a sign like any other.
_REST = r"""(?>"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^<>])*+"""
_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{HIDDEN})\b{_REST}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<rest>{_REST})>|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_UNSEEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_CLOSED_BY = {"p": BLOCKS - {"button", "label", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


class Block(NamedTuple):
    text: str
    features: tuple[str, ...]


class _Open(NamedTuple):
    """An open element: its name, and the features of itself and all around it."""

    tag: str
    around: frozenset[str]


def _own(tag: str, rest: str) -> set[str]:
    found = {f"in:{tag}"} if tag in BLOCKS and tag not in ("html", "body", "div") else set()
    if rest:
        for match in _ATTRIBUTE.finditer(rest):
            value = match[2] or match[3] or match[4] or ""
            for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                if word in _SIGN_OF:
                    found.add(f"says:{_SIGN_OF[word]}")
        if _UNSEEN.search(rest):
            found.add("unseen")
    return found


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with their features."""
    stack = [_Open("", frozenset())]
    opened: dict[str, int] = {}
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    at = 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                top = next((e.tag for e in reversed(stack) if e.tag in BLOCKS), "")
                out.append(Block(text, (*_of_text(text, linked), f"own:{top}", *sorted(stack[-1].around))))
        pieces.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if opened.get("a"):
            linked += len(text)

    for match in _PIECE.finditer(page):
        if match.start() > at:
            put(page[at : match.start()])
        at = match.end()
        tag = match["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if match["close"]:
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close_to(depth)
            continue
        if tag in VOID:
            continue
        for inner, closers in _CLOSED_BY.items():
            if tag in closers and opened.get(inner):
                scope = _SCOPES.get(inner, BLOCKS - {"p"})
                depth = len(stack) - 1
                while depth and stack[depth].tag != inner and stack[depth].tag not in scope:
                    depth -= 1
                if stack[depth].tag == inner:
                    close_to(depth)
        own = _own(tag, match["rest"])
        around = stack[-1].around
        if tag in ("header", "footer") and not around & _MARKS:
            own.add(f"outer:{tag}")
        stack.append(_Open(tag, around | own if own - around else around))
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        put(page[at:])
    flush()
    return out


def _of_text(text: str, linked: int) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    found = [f"words:{min(words, 400).bit_length()}", f"links:{min(4, 4 * linked // n)}"]
    if text[-1] in ".!?…。\"”":
        found.append("sentence")
    if n < 200 and _TELLING.search(text):
        found.append("telling")
    return found


class Field(NamedTuple):
    """Weights of the features for main text against the rest, and of label after label."""

    weights: dict[str, float]
    steps: np.ndarray
    start: np.ndarray


def labels(found: list[Block], field: Field) -> list[bool]:
    """The best labels of a page's blocks: True for main text."""
    get = field.weights.get
    (s00, s01), (s10, s11) = field.steps.tolist()
    a, b = field.start.tolist()
    back = []
    first = True
    for block in found:
        score = sum(get(f, 0.0) for f in block.features)
        if first:
            b += score
            first = False
            continue
        from0, from1 = a + s01 > b + s11, a + s00 >= b + s10
        back.append((not from1, not from0))
        a, b = (a + s00 if from1 else b + s10), (a + s01 if from0 else b + s11) + score
    label = b > a
    out = [label] if found else []
    for to0, to1 in reversed(back):
        label = to1 if label else to0
        out.append(label)
    return out[::-1]


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page) if page else []
    return "\n".join(block.text for block, kept in zip(found, labels(found, field), strict=True) if kept)


def train(pages: list[list[tuple[tuple[str, ...], bool]]], rounds: int = ROUNDS, ridge: float = 0.1) -> Field:
    """Fit the field to labelled pages by maximum likelihood, all pages step by step together."""
    names = sorted({f for page in pages for features, _ in page for f in features})
    number = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(map(len, pages), default=0)
    gold = np.zeros((longest, n), np.int64)
    live = np.zeros((longest, n), bool)
    at, feature = [], []
    for k, page in enumerate(pages):
        for t, (features, label) in enumerate(page):
            gold[t, k], live[t, k] = label, True
            at += [t * n + k] * len(features)
            feature += [number[f] for f in features]
    at, feature = np.array(at, np.int64), np.array(feature, np.int64)
    m = len(names)
    pairs = live[1:] & live[:-1]
    true_steps = np.zeros((2, 2))
    np.add.at(true_steps, (gold[:-1][pairs], gold[1:][pairs]), 1)
    true_start = np.bincount(gold[0], minlength=2) if longest else np.zeros(2)
    x, speed, size = np.zeros(m + 6), np.zeros(m + 6), np.zeros(m + 6)
    for step in range(1, rounds + 1):
        score = np.bincount(at, x[feature], longest * n).reshape(longest, n)
        steps, start = x[m : m + 4].reshape(2, 2), x[m + 4 :]
        both = np.stack([np.zeros_like(score), score], axis=2)
        forward, backward = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        for t in range(longest):
            into = start if t == 0 else np.logaddexp.reduce(forward[t - 1][:, :, None] + steps, axis=1)
            forward[t] = np.where(live[t][:, None], into + both[t], forward[t - 1] if t else 0)
        for t in range(longest - 2, -1, -1):
            out = np.logaddexp.reduce(steps + (both[t + 1] + backward[t + 1])[:, None, :], axis=2)
            backward[t] = np.where(live[t + 1][:, None], out, 0)
        total = np.logaddexp.reduce(forward[-1], axis=1) if longest else np.zeros(n)
        share = np.exp(forward + backward - total[None, :, None]) * live[:, :, None]
        joint = np.exp(forward[:-1][:, :, :, None] + steps + (both[1:] + backward[1:])[:, :, None, :] - total[None, :, None, None])
        gap = (gold - share[:, :, 1]) * live
        slope = np.concatenate(
            [
                np.bincount(feature, gap.reshape(-1)[at], m),
                (true_steps - (joint * pairs[:, :, None, None]).sum((0, 1))).reshape(-1),
                true_start - (share[0].sum(0) if longest else 0),
            ]
        )
        slope -= ridge * x
        speed, size = 0.9 * speed + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        x = x + 0.2 * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, x[:m].tolist(), strict=True)), x[m : m + 4].reshape(2, 2), x[m + 4 :])


# Written pages for training: every block of text opens with + if it is main text, else with -.
WRITTEN = [
    "<body><header><h1>-The Daily Example</h1><p>-All the news from the valley, every day.</p><nav><a>-Home</a> <a>News</a> <a>Sport</a></nav></header>"
    "<div class=cookie-notice><p>-We use cookies to give you the best experience. By going on you agree to our privacy policy.</p><button>-Accept</button></div>"
    "<main><article><h1>+Rain returns to the valley</h1><p class=byline>+By a reporter in the north of the country</p>"
    "<p>+After three dry months, rain fell on the valley on Monday night, and farmers were seen dancing.</p>"
    "<div class=ad>-Buy our umbrellas today, the best in town, for half the price.</div>"
    "<p>+The river rose by a hand, which is less than was hoped, but more than in any week since spring.</p>"
    "<h2>+What comes next</h2><ul><li>+More rain is expected by the end of the week.</li><li>+Roads may be closed in the south.</li></ul>"
    "<blockquote>+We had given up hope, to be honest, said one of them.</blockquote><p>+All rights reserved.</p><p>+Read more</p></article>"
    "<section class=comments><h3>-12 comments</h3><p>-I was there and saw it myself, it was a great night for all of us.</p><p>-Nobody asked for this, please report on something else, thank you.</p></section></main>"
    "<aside class=sidebar><h3>-Most read</h3><ul><li><a>-Ten ways to cook a potato</a></li><li><a>-Mayor opens bridge</a></li></ul></aside>"
    "<footer><p>-© The Daily Example. All rights reserved.</p></footer></body>",
    "<body><div id=top><div class=menu><ul><li><a>-Start</a></li><li><a>-About</a></li><li><a>-Contact</a></li></ul></div></div>"
    "<div class=breadcrumb><a>-Start</a> / <a>Garden</a></div><div id=content><h1>+How to plant a hedge</h1>"
    "<p>+A hedge wants a trench, some patience and a good deal of water in its first year.</p>"
    "<p>+Dig the trench two spades deep. Mix the earth with compost, and let it rest.</p>"
    "<form class=newsletter><label>-Your address</label><p>-Subscribe to our newsletter and never miss a story.</p><button>-Sign up</button></form>"
    "<p>+Plant in autumn. Water every evening, but not at noon.</p><table><tr><td>+Beech</td><td>+two a metre</td></tr></table></div>"
    "<div class=related><h4>-Related</h4><a>-How to cut a hedge</a></div><div id=respond><h3>-Leave a reply</h3><form><label>-Name</label><button>-Send</button></form></div>"
    "<ol class=commentlist><li class=comment><p>-Thanks for this, my hedge has never looked any better than it does now.</p></li></ol>"
    "<div class=footer><ul><li><a>-Imprint</a></li></ul><p>-Copyright by the gardeners.</p></div></body>",
    "<body><nav><ul><li><a>-One</a></li><li><a>-Two</a></li></ul></nav><div class=banner>-Sponsored: the new car is here, and it is faster than any other.</div>"
    "<article><header><h1>+A short history of salt</h1></header><p>+Salt was money once. Wars were fought for it, and roads were built.</p>"
    "<p>+Today it is cheap, and we eat too much of it, as doctors say.</p><figure><figcaption>+A salt mine, about a hundred years ago.</figcaption></figure>"
    "<div class=share><a>-Share this</a></div><aside><p>-Read more: our special on pepper, with pictures and recipes, is out now.</p></aside>"
    "<p>+In some places it is still carried by camels.</p><p>+Cookies need it too.</p><p>+Related</p><p>+© 1999</p><p>+See</p><div class=comments><p>-First! What a nice piece, I liked it a lot, and will tell my friends.</p></div></article>"
    "<footer>-Salt and Sons, all the news on salt since a long time.</footer></body>",
    "<body><header><h1>-My notebook</h1></header><div class=post><h2>+On walking</h2><p>+I walked to the sea today.</p><p>+It was further than I thought, and I came home late.</p>"
    "<p>+Good.</p></div><div class=sidebar><h3>-Archive</h3><p>-January, February, March, and all the other months.</p></div>"
    "<div class=alert role=dialog><p>-This site needs your consent, please read the following with care.</p></div>"
    "<div class=footer><p>-Written by me, in my own time, and not for sale.</p></div></body>",
    "<body><p>+It began with a letter, which nobody opened for a week.</p><p>+Then came a second one. It was longer, and it was from the same town.</p>"
    "<p>+Nobody knows what was in the third.</p><p>-© all rights reserved</p></body>",
    "<body><div role=navigation><a>-Up</a><a>Down</a></div><div role=main><h1>+Terms used in sailing</h1><dl><dt>+Bow</dt><dd>+The front of a boat, where it meets the waves.</dd>"
    "<dt>+Stern</dt><dd>+The back of a boat, where the rudder is.</dd></dl><pre>+a knot in four steps</pre></div>"
    "<div role=complementary><p>-Join our sailing school, the oldest on the coast, and learn it in a week.</p></div>"
    "<div role=contentinfo><p>-The sailing pages, made on the coast.</p></div><form role=search><label>-Search</label><button>-Go</button></form></body>",
    "<p>+A single paragraph is all there is on this page. It has two sentences, and no frame.",
    "<body>+Plain words without any element, which are the page's main text all the same.</body>",
    "<body><div>+The first part of a page made of plain boxes, which say nothing of what they hold.</div>"
    "<div>+And the second part, which is just as long, and just as much a part of the text.</div></body>",
    "<html><body><ul><li><a>-Home</a></li><li><a>-Log in</a></li></ul></body></html>",
]


def written_pages() -> list[list[tuple[tuple[str, ...], bool]]]:
    """The written pages' blocks; a sign is taken for the rest of a block's features as it is."""
    found = []
    for page in WRITTEN:
        own = blocks(page)
        plain = blocks(re.sub(r">[+-]", ">", page))
        found.append([(b.features, a.text[0] == "+") for a, b in zip(own, plain, strict=True)])
    return found


_NEVER = {"in:nav", "in:aside", "in:footer", "in:form", "says:advert", "says:menu", "says:comment", "says:notice", "says:side", "unseen"}


def marked_pages(sample: list[str]) -> list[list[tuple[tuple[str, ...], bool]]]:
    """Pages labelled by the article they mark, once as they are and once without the marks."""
    found = []
    for page in sample:
        if len(re.findall(r"<article\b", page)) != 1:
            continue
        own = [(b.features, "in:article" in b.features and not _NEVER & set(b.features)) for b in blocks(page)]
        if 0 < len(own) <= MOST_BLOCKS:
            found.append(own)
            found.append([(tuple(f for f in features if f not in _MARKS), label) for features, label in own])
    return found


def fitted(pages: DataFrame, page: str = "html", most: int = MOST_PAGES) -> Field:
    """A field trained on the written pages and on up to ``most`` of the table's, chosen by a hash.

    The hashes of all pages say which; only then are these pages fetched. The written pages
    count as much as the sampled ones.
    """
    text = F.col(f"`{page}`")
    small = pages.select(text.alias("page"), F.xxhash64(text).alias("mark")).where(F.length("page") <= 50_000)
    marks = [row.mark for row in small.select("mark").distinct().orderBy("mark").limit(most).collect()]
    few = small.where(F.col("mark") <= F.lit(marks[-1])) if marks else small.limit(0)
    sample = few.groupBy("mark").agg(F.min("page").alias("page")).orderBy("mark").collect()
    own = marked_pages([row.page for row in sample])
    written = written_pages()
    return train(written * max(4, len(own) // len(written)) + own)


def extracted(page: Column, field: Field) -> Column:
    """The main text of a page."""

    def work(texts: pa.Array) -> pa.Array:
        return pa.array([main_text(t, field) for t in texts.to_pylist()], pa.string())

    make: Callable[[], Callable] = lambda: work
    return text_udf(make, "string")(page)
