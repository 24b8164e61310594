"""A hierarchical Pitman-Yor language model: counted over all texts, seated by Gibbs sampling.

A text is a row of tokens, its words and one end. The ``words`` most frequent words are symbols of
their own; every other word belongs to one of ``classes`` classes, chosen by its last letters, and a
class is a symbol too. There are three kinds of Chinese restaurants. One for each context, that is
the symbol before: its customers are the symbols that follow. They share a parent, the restaurant
of single symbols, whose customers are the tables of all contexts. And one for each class, whose customers
are the class's words, the unknown one among them. So

    P(word | context) = P(symbol of the word | context) * P(word | class, if it is one)

A restaurant with ``c`` customers and ``t`` tables gives a dish with ``c_d`` customers at ``t_d``
tables the probability ``(c_d - discount * t_d + (strength + discount * t) * parent(d)) / (strength + c)``.

How customers sit is not known and drawn by Gibbs sampling. The seats of all customers of a dish in a
restaurant are drawn together, given those of all others: they come in one by one and open a table
or join one. How many join before the next table is opened follows a beta-geometric law, so a
draw takes a step for each table and not for each customer. As coming in one by one forgets that the
dishes are known already, a draw replaces the old seats with the probability that corrects for it
(Metropolis-Hastings), which leaves the Gibbs conditional as it is. Dishes are drawn side by side in tasks, with
totals of the round before. Probabilities are averages over several rounds. A dish with one
customer has one table, always, so only the others are drawn.

What grows with the corpus stays distributed: counts of all words and of all pairs of symbols,
and the seats. Tasks get the most frequent words and pairs (``MOST_WORDS``, ``MOST_PAIRS``),
for which nothing is shuffled at scoring, so no frequent key meets in one task; the others are joined. Which
is which doesn't change the result. The driver sees these and totals for each symbol. Draws depend on the dish and
the round alone, so a task that is run again draws the same.

Defined results: null is the empty text, which is one end. Texts are told apart by row, so rows
that repeat each have their score. Rows without id are scored but not learnt from. Without any text to learn
from, every token has the probability of an unknown word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.batches import Places, SpanHash, mixed, raw, runs, signed, slices
from marquee.llm.tables import Stored
from marquee.scratch import written

WORDS = 16_384
CLASSES = 1_024
STRENGTH = 1.0
BURN_IN = 2
SAMPLES = 4
# What tasks get beforehand at most: a few megabytes of words, and of pairs.
MOST_WORDS = 1 << 18
MOST_PAIRS = 1 << 19
# Tokens of a task that are counted together before they are sent on.
GATHER = 1 << 21
# Dishes that are drawn at once, and bytes of their rows.
ROWS = 1 << 18
MOST_BYTES = 1 << 28
# Steps between equal cells of a logarithmic histogram of counts.
_STEPS = 16

# A token's key is one number: the sign, twelve bits for its class, and a hash. No pair of symbols has the sign.
_HASH_BITS = 51
END = np.uint64(1 << 63)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- tokens ---


@dataclass
class Tokens:
    """The tokens of a slice of texts: which text each is of, and its key."""

    text: np.ndarray
    keys: np.ndarray
    starts: np.ndarray  # where each text's first token is

    @property
    def classes(self) -> np.ndarray:
        return self.classes_of(slice(None))

    def classes_of(self, which: np.ndarray | slice) -> np.ndarray:
        return (self.keys[which] >> np.uint64(_HASH_BITS) & np.uint64(4095)).astype(np.int64)


def tokens(texts: pa.Array, classes: int) -> Tokens:
    """The words of each text and one end after them."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    data = _LOWER[data]
    first, last = runs(~_SPACE[data], offsets)
    hashes = SpanHash(data).of(first, last) if len(first) else np.zeros(0, np.uint64)
    final = data[last - 1].astype(np.uint64)
    before = np.where(last - first > 1, data[np.maximum(last - 2, 0)], 0).astype(np.uint64)
    own = (before * np.uint64(31) + final) % np.uint64(classes)
    low = np.maximum(hashes & np.uint64((1 << _HASH_BITS) - 1), np.uint64(1))  # zero is the end's
    text = np.searchsorted(offsets[1:], first, side="right")
    per_text = np.bincount(text, minlength=n)
    ends = np.cumsum(per_text + 1) - 1
    keys = np.full(len(first) + n, END, np.uint64)
    keys[np.arange(len(first)) + text] = END | own << np.uint64(_HASH_BITS) | low
    return Tokens(np.repeat(np.arange(n), per_text + 1), keys, ends - per_text)


@dataclass
class Lexicon:
    """The most frequent words: keys in order, counts, and the symbol of each."""

    keys: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray  # -1 for a word that is in its class
    words: int
    classes: int

    @property
    def size(self) -> int:
        """Symbols: the end, the words, the classes. The context at the start comes after them."""
        return 1 + self.words + self.classes

    @cached_property
    def _places(self) -> Places:
        return Places(self.keys)

    @cached_property
    def _symbols(self) -> np.ndarray:
        """The last one is of all words that aren't among the frequent ones."""
        return np.append(self.symbols, -1)

    def __getstate__(self) -> dict:
        """A task makes the tables itself; they aren't sent."""
        return {name: self.__dict__[name] for name in ("keys", "counts", "symbols", "words", "classes")}

    def found(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the frequent words, or -1."""
        return self._places.of(keys)

    def read(self, own: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token the place among the frequent words, the symbol, and the context."""
        place = self.found(own.keys)
        symbol = self._symbols[place]
        apart = np.flatnonzero(symbol < 0)
        symbol[apart] = 1 + self.words + own.classes_of(apart)
        symbol[own.keys == END] = 0
        context = np.empty(len(symbol), np.int64)
        context[1:] = symbol[:-1]
        context[own.starts] = self.size
        return place, symbol, context

    def pair(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return context * self.size + symbol


# --- counts ---


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)


def _counter(keyed: Callable[[pa.Array], np.ndarray], names: list[str]) -> Callable:
    """Counts the keys of a task's texts, a few million tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        for batch in batches:
            for part in slices(batch.column(0)):
                held.append(_summed(keyed(part)))
                size += len(held[-1][0])
                if size > GATHER:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > GATHER // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(signed(held[0][0])), pa.array(held[0][1])], names)
                        held, size = [], 0
        if held:
            keys, counts = merged()
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], names)

    return run


def word_counts(texts: DataFrame, classes: int) -> DataFrame:
    """``key, c``: how often each word occurs, the end included."""

    each = texts.mapInArrow(_counter(lambda part: tokens(part, classes).keys, ["key", "c"]), "key bigint, c bigint")
    return written(each.groupBy("key").agg(F.sum("c").alias("c")))


def frequent(counts: DataFrame, most: int) -> tuple[int, DataFrame]:
    """The smallest count of which no more than ``most`` keys have that or more, and those keys.

    From a histogram with cells of equal logarithm, so counts within a cell stay together.
    """
    cell = F.floor(F.log2(F.col("c").cast("double")) * _STEPS).cast("int")
    cells = counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("cell")).collect()
    total, least = 0, None
    for row in cells:
        total += row.n
        if total > most:
            break
        least = row.least
    if least is None:
        return 0, counts.where(F.lit(False))
    return least, counts.where(F.col("c") >= F.lit(least))


def discount(ones: float, twos: float) -> float:
    """The usual estimate from how many dishes have one customer and how many have two."""
    return float(min(0.9, max(0.1, ones / (ones + 2 * twos)))) if ones + twos else 0.5


# --- seats ---


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive numbers, to about twelve digits."""
    y = np.array(x, np.float64)
    low = np.zeros_like(y)
    small = np.flatnonzero(y < 10)
    if len(small):
        product, z = np.ones(len(small)), y[small]
        for _ in range(10):
            product, z = product * z, z + 1
        low[small], y[small] = np.log(product), z
    r = 1 / y
    series = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - low


def log_rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The logarithm of x (x + 1) ... (x + n - 1)."""
    out = np.zeros(len(x))
    few = n <= 8
    product = np.ones(len(x))
    for i in range(int(n[few].max(initial=0))):
        product *= np.where(few & (n > i), x + i, 1.0)
    out[few] = np.log(product[few])
    many = ~few
    out[many] = log_gamma(x[many] + n[many]) - log_gamma(x[many])
    return out


class Draws:
    """Numbers that depend on a key and how many were drawn for it, and on nothing else."""

    def __init__(self, keys: np.ndarray, seed: int) -> None:
        self.state = mixed(mixed(keys.astype(np.int64).view(np.uint64)) + np.uint64(seed))

    def uniform(self, which: np.ndarray) -> np.ndarray:
        """Between zero and one, neither included."""
        own = self.state[which] + np.uint64(0x9E3779B97F4A7C15)
        self.state[which] = own
        return ((mixed(own) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53

    def gamma(self, which: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Marsaglia and Tsang's method, drawn again until accepted."""
        # A shape below one is drawn as one above, and shrunk; as logarithm, as it may be tiny.
        boost = np.where(shape < 1, np.log(self.uniform(which)) / np.minimum(shape, 1.0), 0.0)
        d = np.where(shape < 1, shape + 1, shape) - 1 / 3
        c = 1 / np.sqrt(9 * d)
        out = np.zeros(len(shape))
        left = np.arange(len(shape))
        while len(left):
            own = which[left]
            u, angle, accept = self.uniform(own), self.uniform(own), self.uniform(own)
            x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * angle)
            v = 1 + c[left] * x
            v = v * v * v
            good = v > 0
            safe = np.where(good, v, 1.0)
            good &= np.log(accept) < 0.5 * x * x + d[left] * (1 - safe + np.log(safe))
            out[left[good]] = np.log(d[left][good]) + np.log(safe[good])
            left = left[~good]
        return out + boost


def _waits(draws: Draws, which: np.ndarray, joining: np.ndarray, opening: np.ndarray, remaining: np.ndarray) -> np.ndarray:
    """How many of the remaining customers join a table before one opens another; all of them or more if none does.

    The weight of joining is ``joining`` at first and grows by one with each customer, that of opening
    stays ``opening``: geometric with a share of joiners from a beta law.
    """
    out = np.empty(len(which), np.int64)
    # The last customer joins or opens, which needs no more than the two weights.
    last = remaining == 1
    own = which[last]
    out[last] = draws.uniform(own) * (joining[last] + opening[last]) < joining[last]
    own = which[~last]
    a, b = draws.gamma(own, joining[~last]), draws.gamma(own, opening[~last])
    # log(v) for v = e^a / (e^a + e^b)
    log_share = -np.logaddexp(0.0, b - a)
    steps = np.log(draws.uniform(own)) / np.minimum(log_share, -1e-300)
    out[~last] = np.floor(np.minimum(steps, 2.0**62))
    return out


@dataclass
class Seats:
    """For each dish its customers and when each table but the first was opened (customers there before)."""

    c: np.ndarray
    opened: np.ndarray  # of all dishes, one after the other
    sizes: np.ndarray

    @property
    def t(self) -> np.ndarray:
        return self.sizes + 1


def _weight(c: np.ndarray, seats: Seats, base: np.ndarray, parent: np.ndarray, d: float) -> np.ndarray:
    """The logarithm of the product of both choices' weights, over all customers after the first."""
    out = np.zeros(len(c))
    start = np.ones(len(c), np.int64)
    ends = np.cumsum(seats.sizes)
    first = ends - seats.sizes
    left = np.arange(len(c))
    k = 1
    while len(left):
        more = seats.sizes[left] >= k
        stop = np.where(more, seats.opened[np.minimum(first[left] + k - 1, max(len(seats.opened) - 1, 0))] + 1 if len(seats.opened) else 0, c[left])
        low = (base[left] + d * k) * parent[left] - d * k
        out[left] += log_rising(low + start[left], stop - start[left])
        start[left] = stop
        left = left[more]
        k += 1
    return out


def seated(keys: np.ndarray, old: Seats | None, c: np.ndarray, base: np.ndarray, parent: np.ndarray, d: float, seed: int) -> Seats:
    """New seats of each dish's customers, given everything else.

    ``base`` is the strength plus the discount for each table of the other dishes, ``parent`` the
    dish's probability in the parent.
    """
    draws = Draws(keys, seed)
    n = len(c)
    at = np.ones(n, np.int64)
    left = np.flatnonzero(c > 1)
    opened: list[tuple[np.ndarray, np.ndarray]] = []
    k = 1
    while len(left):
        wait = _waits(draws, left, at[left] - d * k, (base[left] + d * k) * parent[left], c[left] - at[left])
        inside = wait < c[left] - at[left]
        left, wait = left[inside], wait[inside]
        opened.append((left, at[left] + wait))
        at[left] += wait + 1
        left = left[at[left] < c[left]]
        k += 1
    dish = np.concatenate([x for x, _ in opened]) if opened else np.zeros(0, np.int64)
    time = np.concatenate([x for _, x in opened]) if opened else np.zeros(0, np.int64)
    order = np.argsort(dish, kind="stable")
    new = Seats(c, time[order], np.bincount(dish, minlength=n))
    if old is None:
        return new
    # Two customers make one choice, drawn by its own law.
    several = np.flatnonzero(c > 2)
    gain = np.zeros(n)
    weights = [_weight(c[several], _picked(x, several), base[several], parent[several], d) for x in (new, old)]
    gain[several] = weights[0] - weights[1]
    taken = np.log(draws.uniform(np.arange(n))) < gain
    sizes = np.where(taken, new.sizes, old.sizes)
    kept = np.concatenate([old.opened[np.repeat(~taken, old.sizes)], new.opened[np.repeat(taken, new.sizes)]])
    owner = np.concatenate([np.repeat(np.arange(n), old.sizes)[np.repeat(~taken, old.sizes)], np.repeat(np.arange(n), new.sizes)[np.repeat(taken, new.sizes)]])
    return Seats(c, kept[np.argsort(owner, kind="stable")], sizes)


# --- the model ---


@dataclass
class Model:
    """What tasks need for scoring, and the tables of what they haven't got."""

    lexicon: Lexicon
    tokens: int
    distinct: int
    context_gain: np.ndarray  # for each context and sample: (strength + discount * tables) / (strength + customers)
    symbols: np.ndarray  # for each symbol and sample: its probability without context
    class_gain: np.ndarray  # for each class and sample the same, for its words
    class_sizes: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the frequent pairs, in order
    pair_gains: np.ndarray = field(default_factory=lambda: np.zeros(0))
    word_gains: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the frequent words, within their class
    rest: DataFrame | None = None

    def pair_default(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The probability of a symbol after a context it was never seen in."""
        return np.einsum("ij,ij->i", self.context_gain[context], self.symbols[symbol]) / self.symbols.shape[1]

    def class_default(self, classes: np.ndarray) -> np.ndarray:
        """The probability of an unknown word in its class."""
        return self.class_gain.mean(1)[classes] / (self.class_sizes[classes] + 1)

    @property
    def base_unknown(self) -> float:
        return -float(np.log10(self.tokens + self.distinct + 1))


# ``opened`` holds 64-bit numbers: one value for Spark to move, however many tables there are.
_STATE = "key bigint, context int, symbol int, c bigint, opened binary, tables bigint, t bigint"


def _unigram(customers: np.ndarray, old: Seats | None, strength: float, seed: int) -> tuple[Seats | None, np.ndarray]:
    """The parent restaurant's seats, and the probability of each symbol."""
    used = np.flatnonzero(customers)
    c = customers[used]
    d = discount(float((c == 1).sum()), float((c == 2).sum()))
    level = 1.0 / len(customers)
    before = 0 if old is None else int(old.t.sum())
    own = np.zeros(len(c), np.int64) if old is None else old.t
    # The number of customers changes from round to round, so the seats are drawn from the start.
    seats = seated(used, None, c, strength + d * (before - own), np.full(len(c), level), d, seed)
    tables = np.zeros(len(customers))
    tables[used] = seats.t
    return seats, (customers - d * tables + (strength + d * tables.sum()) * level) / (strength + customers.sum())


def learnt(
    texts: DataFrame,
    words: int = WORDS,
    classes: int = CLASSES,
    strength: float = STRENGTH,
    burn_in: int = BURN_IN,
    samples: int = SAMPLES,
    most_words: int = MOST_WORDS,
    most_pairs: int = MOST_PAIRS,
) -> Model:
    """The model of the texts (one column of them)."""
    if not 0 < classes <= 4096 or burn_in < 0 or samples < 1:
        raise ValueError("there may be 1 to 4096 classes, and one sample at least")
    counted = word_counts(texts, classes)
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    lexicon = _lexicon(counted, words, classes, most_words)
    n_contexts = lexicon.size + 1

    def keyed(part: pa.Array) -> np.ndarray:
        _, symbol, context = lexicon.read(tokens(part, classes))
        return lexicon.pair(context, symbol)

    each = texts.mapInArrow(_counter(keyed, ["key", "c"]), "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))
    size = F.lit(lexicon.size)
    pairs = each.select("key", F.floor(F.col("key") / size).cast("int").alias("context"), F.pmod("key", size).cast("int").alias("symbol"), "c")
    # A word in a class: its restaurant comes after those of the contexts, and it has no symbol.
    key = F.col("key")
    own = F.shiftrightunsigned(key, _HASH_BITS).bitwiseAND(4095).cast("int")
    symbols = lexicon.keys[lexicon.symbols >= 0]
    in_class = _word_filter(counted, symbols).select(key, (own + F.lit(n_contexts)).alias("context"), F.lit(-1).alias("symbol"), "c")
    dishes = written(pairs.unionByName(in_class))

    # Customers and dishes of each restaurant, and those who are alone with their dish.
    stats = dishes.groupBy("context").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).toArrow()
    at = stats["context"].to_numpy()
    n_all = n_contexts + classes
    customers, kinds, one, two = (np.zeros(n_all, np.int64) for _ in range(4))
    for array, name in ((customers, "c"), (kinds, "n"), (one, "one"), (two, "two")):
        array[at] = stats[name].to_numpy()
    discounts = np.array([discount(one[:n_contexts].sum(), two[:n_contexts].sum()), discount(one[n_contexts:].sum(), two[n_contexts:].sum())])
    alone = dishes.where("c = 1 AND symbol >= 0").groupBy("symbol").agg(F.count("*").alias("n")).toArrow()
    alone_symbols = np.zeros(lexicon.size, np.int64)
    alone_symbols[alone["symbol"].to_numpy()] = alone["n"].to_numpy()
    class_sizes = kinds[n_contexts:]

    d_of = np.concatenate([np.full(n_contexts, discounts[0]), np.full(classes, discounts[1])])
    several = dishes.where("c > 1").select("key", "context", "symbol", "c")
    state = None
    tables = np.minimum(kinds, customers)  # a table for each dish to begin with
    probabilities, unigram = _first_guess(lexicon, alone_symbols, several, strength), None
    gains, levels = [], []
    for round_ in range(burn_in + samples):
        step = _Sweep(strength, discounts, n_contexts, tables, probabilities, class_sizes, round_, round_ >= burn_in)
        gone, state = state, Stored((state.frame if state else several).mapInArrow(step.run, _STATE))
        if gone:
            gone.delete()
        by_context, by_symbol = _tables(state.frame, n_all, lexicon.size)
        tables = one + by_context
        unigram, probabilities = _unigram(alone_symbols + by_symbol, unigram, strength, 1_000_003 + round_)
        if round_ >= burn_in:
            gains.append((strength + d_of * tables) / (strength + customers))
            levels.append(probabilities)
    gain = np.stack(gains, 1)
    model = Model(lexicon, int(total.n), int(total.v), gain[:n_contexts], np.stack(levels, 1), gain[n_contexts:], class_sizes)

    single = dishes.where("c = 1").select("key", "context", "symbol", "c", F.lit(samples).cast("bigint").alias("tables"))
    final = single.unionByName(state.frame.select("key", "context", "symbol", "c", "tables"))
    gainer = _Gains(model, strength, discounts, customers, samples, n_contexts)
    gained = written(final.mapInArrow(gainer.run, "key bigint, c bigint, gain double"))
    state.delete()
    least, hot = frequent(gained.where("key >= 0"), most_pairs)
    table = hot.select("key", "gain").toArrow()
    order = np.argsort(table["key"].to_numpy())
    model.pairs, model.pair_gains = table["key"].to_numpy()[order], table["gain"].to_numpy()[order]
    model.word_gains = _own_gains(gained, lexicon)
    cold = F.lit(True) if least == 0 else F.col("c") < F.lit(least)
    # All that a word adds to the score of one nobody knows; its count says so much for the base.
    is_word = F.col("key") < 0
    model.rest = gained.where(is_word | cold).select("key", "gain", F.when(is_word, F.col("c")).alias("known"))
    return model


def _first_guess(lexicon: Lexicon, alone: np.ndarray, state: DataFrame, strength: float) -> np.ndarray:
    """The symbols' probabilities when every dish has one table."""
    rows = state.where("symbol >= 0").groupBy("symbol").agg(F.count("*").alias("n")).toArrow()
    customers = alone.copy()
    customers[rows["symbol"].to_numpy()] += rows["n"].to_numpy()
    return _unigram(customers, None, strength, 1_000_002)[1]


def _tables(state: DataFrame, n_contexts: int, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables of each restaurant's and of each symbol's drawn dishes."""
    by_context = state.groupBy(F.col("context").alias("k")).agg(F.sum("t").alias("t"))
    by_symbol = state.where("symbol >= 0").groupBy((F.col("symbol") + F.lit(n_contexts)).alias("k")).agg(F.sum("t").alias("t"))
    rows = by_context.unionByName(by_symbol).toArrow()
    out = np.zeros(n_contexts + n_symbols, np.int64)
    out[rows["k"].to_numpy()] = rows["t"].to_numpy()
    return out[:n_contexts], out[n_contexts:]


def _lexicon(counted: DataFrame, words: int, classes: int, most: int) -> Lexicon:
    _, hot = frequent(counted, most)
    table = hot.toArrow()
    keys, counts = table["key"].to_numpy().view(np.uint64), table["c"].to_numpy()
    by_count = np.lexsort([keys, -counts])
    symbols = np.full(len(keys), -1, np.int64)
    end = keys == END
    ranked = by_count[~end[by_count]][:words]
    symbols[ranked] = 1 + np.arange(len(ranked))
    symbols[end] = 0
    order = np.argsort(keys)
    return Lexicon(keys[order], counts[order], symbols[order], len(ranked), classes)


def _word_filter(counted: DataFrame, symbols: np.ndarray) -> DataFrame:
    """The words that are no symbol of their own; the end is one."""
    own = np.union1d(symbols, np.array([END]))
    rows = pa.table({"key": signed(own)})
    frame = counted.sparkSession.createDataFrame(rows, T.StructType([T.StructField("key", T.LongType())]))
    return counted.join(F.broadcast(frame), "key", "left_anti")


def _own_gains(gained: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """What the frequent words that are in a class add within it."""
    out = np.zeros(len(lexicon.keys))
    held = lexicon.keys[lexicon.symbols < 0]
    if len(held):
        rows = pa.table({"key": signed(held)})
        frame = gained.sparkSession.createDataFrame(rows, T.StructType([T.StructField("key", T.LongType())]))
        table = gained.where("key < 0").join(F.broadcast(frame), "key").select("key", "gain").toArrow()
        out[np.searchsorted(lexicon.keys, table["key"].to_numpy().view(np.uint64))] = table["gain"].to_numpy()
    return out


@dataclass
class _Sweep:
    """One round over the dishes with more than one customer."""

    strength: float
    discounts: np.ndarray
    n_contexts: int
    tables: np.ndarray
    probabilities: np.ndarray
    class_sizes: np.ndarray
    seed: int
    sample: bool

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Many rows at a time: the steps for each table are few calls over long arrays."""
        held: list[pa.RecordBatch] = []
        size = weight = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                weight += batch.nbytes
            if size >= ROWS or weight >= MOST_BYTES:
                yield from self._batches(pa.concat_batches(held))
                held, size, weight = [], 0, 0
        if held:
            yield from self._batches(pa.concat_batches(held))

    def _batches(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """``opened`` and ``tables`` are missing in the first round."""
        key, context, symbol, c = batch.columns[:4]
        context_, symbol_, c_ = context.to_numpy(), symbol.to_numpy(), c.to_numpy()
        old = None
        if batch.num_columns > 4:
            opened, offsets = raw(batch.column(4))
            old = Seats(c_, opened.view(np.int64), np.diff(offsets) // 8)
        in_class = symbol_ < 0
        t = np.ones(len(c_), np.int64) if old is None else old.t
        parent = np.where(in_class, 1.0, self.probabilities[np.maximum(symbol_, 0)])
        parent[in_class] = 1.0 / (self.class_sizes[context_[in_class] - self.n_contexts] + 1)
        sizes, flats = np.zeros(len(c_), np.int64), [None, None]
        for kind in (0, 1):  # pairs, then words in classes, as their discounts differ
            own = np.flatnonzero(in_class == bool(kind))
            base = self.strength + self.discounts[kind] * (self.tables[context_[own]] - t[own])
            before = None if old is None else _picked(old, own)
            new = seated(key.to_numpy()[own], before, c_[own], base, parent[own], self.discounts[kind], self.seed)
            sizes[own] = new.sizes
            flats[kind] = (np.repeat(own, new.sizes), new.opened)
        owner = np.concatenate([f[0] for f in flats])
        flat = np.concatenate([f[1] for f in flats])[np.argsort(owner, kind="stable")]
        if flat.nbytes >= 1 << 31 and len(flat) > sizes.max():  # more than an array of bytes holds; seats don't depend on the batch
            middle = len(sizes) // 2
            for half in (batch.slice(0, middle), batch.slice(middle)):
                yield from self._batches(half)
            return
        ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
        seats = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        summed = (batch.column(5).to_numpy() if batch.num_columns > 4 else 0) + (sizes + 1) * self.sample
        columns = [key, context, symbol, c, seats, pa.array(summed, pa.int64()), pa.array(sizes + 1, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "context", "symbol", "c", "opened", "tables", "t"])


def _picked(seats: Seats, which: np.ndarray) -> Seats:
    chosen = np.zeros(len(seats.c), bool)
    chosen[which] = True
    return Seats(seats.c[which], seats.opened[np.repeat(chosen, seats.sizes)], seats.sizes[which])


@dataclass
class _Gains:
    """For each dish how much more probable it is, as log10, than one its restaurant has never seen."""

    model: Model
    strength: float
    discounts: np.ndarray
    customers: np.ndarray
    samples: int
    n_contexts: int

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, symbol = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            c, tables = batch.column(3).to_numpy(), batch.column(4).to_numpy() / self.samples
            in_class = symbol < 0
            default = np.empty(len(c))
            default[~in_class] = self.model.pair_default(context[~in_class], symbol[~in_class])
            default[in_class] = self.model.class_default(context[in_class] - self.n_contexts)
            own = (c - self.discounts[in_class.astype(int)] * tables) / (self.strength + self.customers[context])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(np.log10(1 + own / default))], ["key", "c", "gain"])


# --- scores ---

_SUMS = "n_tokens bigint, n_known bigint, base double, score double"


def _scorer(model: Model) -> Callable:
    """Rows of two kinds: a text's sums as far as a task can tell, and what is to be joined (``key``, ``n``)."""
    lexicon = model.lexicon
    # The last entries are those of words that aren't among the frequent ones.
    log_base = np.append(np.log10(lexicon.counts + 1.0), 0.0)
    word_gains = np.append(np.where(lexicon.symbols < 0, model.word_gains, 0.0), 0.0)
    n_pairs = lexicon.size * (lexicon.size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_pairs = Places(model.pairs)
        pair_gains = np.append(model.pair_gains, 0.0)
        for batch in batches:
            schema = pa.schema(
                [
                    *[pa.field(name, pa.int64()) for name in ("row", "key", "n", "n_tokens", "n_known")],
                    *[pa.field(name, pa.float64()) for name in ("base", "score")],
                    pa.field("kept", batch.column(2).type),
                ]
            )

            def part_of(columns: dict, size: int, schema: pa.Schema = schema) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema
                )

            at = 0
            for part in slices(batch.column(1)):
                n = len(part)
                if not n:
                    continue
                rows, kept = batch.column(0).slice(at, n).to_numpy(), batch.column(2).slice(at, n)
                at += n
                own = tokens(part, lexicon.classes)
                place, symbol, context = lexicon.read(own)
                pair, known = lexicon.pair(context, symbol), place >= 0
                score = np.log10(model.pair_default(context, symbol))
                found = frequent_pairs.of(pair)
                score += pair_gains[found]
                apart = np.flatnonzero(symbol > lexicon.words)
                score[apart] += np.log10(model.class_default(own.classes_of(apart)))
                score += word_gains[place]
                sums = {
                    "row": rows,
                    "n_tokens": np.bincount(own.text, minlength=n),
                    "n_known": np.bincount(own.text, weights=known, minlength=n).astype(np.int64),
                    "base": np.bincount(own.text, weights=log_base[place] + model.base_unknown, minlength=n),
                    "score": np.bincount(own.text, weights=score, minlength=n),
                    "kept": kept,
                }
                yield part_of(sums, n)
                # Pairs and words that the task doesn't know.
                cold = np.flatnonzero(found < 0)
                both, counts = _summed(own.text[cold] * np.int64(n_pairs) + pair[cold])
                text, key = np.divmod(both, n_pairs)
                yield part_of({"row": rows[text], "key": key, "n": counts}, len(text))
                rare = np.flatnonzero(~known)
                words, which = np.unique(own.keys[rare], return_inverse=True)
                both, counts = _summed(own.text[rare] * np.int64(max(1, len(words))) + which)
                text, which = np.divmod(both, max(1, len(words)))
                yield part_of({"row": rows[text], "key": signed(words[which]), "n": counts}, len(text))

    return run


def scored(documents: DataFrame, text: str, model: Model, keep: list[str]) -> DataFrame:
    """``kept`` (the columns to keep), ``n_tokens, n_known, base_score, score`` of every row of the documents.

    ``base_score`` is that of single tokens with one added to every count, ``score`` the model's: log10
    probabilities of the whole text, its end included. ``n_known`` tokens were learnt from.
    """
    kept = F.struct(*[F.col(f"`{name}`") for name in keep]).alias("kept")
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"), kept)
    fields = T.StructType([T.StructField(f.name, f.dataType) for f in numbered.schema["kept"].dataType])
    schema = T.StructType.fromDDL(f"row bigint, key bigint, n bigint, {_SUMS}").add("kept", fields)
    rows = written(numbered.mapInArrow(_scorer(replace(model, rest=None)), schema))
    counts = F.when(F.col("known").isNotNull(), F.col("n"))
    more = (
        rows.where("key IS NOT NULL")
        .select("row", "key", "n")
        .join(model.rest, "key")
        .groupBy("row")
        .agg(
            F.coalesce(F.sum(counts), F.lit(0)).alias("more_known"),
            F.coalesce(F.sum(counts * F.log10(F.col("known") + 1.0)), F.lit(0.0)).alias("more_base"),
            F.sum(F.col("n") * F.col("gain")).alias("more_score"),
        )
    )
    sums = rows.where("key IS NULL").select("row", "kept", "n_tokens", "n_known", "base", "score").join(more, "row", "left")

    def both(name: str) -> Column:
        return F.col(name) + F.coalesce(f"more_{name.removeprefix('n_')}", F.lit(0))

    return sums.select("kept", "n_tokens", both("n_known").alias("n_known"), both("base").alias("base_score"), both("score").alias("score"))
