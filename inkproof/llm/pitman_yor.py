"""Scores texts with a hierarchical Pitman-Yor language model.

Tokens are runs of anything but ASCII white space, A-Z lower-cased, and one end per text. A word is
known by a 64-bit hash. All words are dishes; no word is put in a class with others.

Restaurants. The word before a token, or the start of its text, names the context whose restaurant
serves the token. Every word has a restaurant, however seldom it is; all share the root as their
parent, over the uniform distribution of all training words and one more place for unknown ones.

Gibbs sampling. A sweep removes all customers of a dish and seats them anew given the other dishes:
``draw`` takes the number of their tables from its exact conditional distribution (generalised
Stirling numbers times the weights of new tables) for up to ``EXACT`` customers; further ones are
seated at these by the restaurant's rule, in blocks of a sixteenth. Each table is a customer of the
parent, whose dish is reseated next. A dish's restaurants are sampled where its pairs are; what all
dishes of a restaurant share, its number of tables, is that of the round before, as in other
distributed samplers. After ``ROUNDS`` rounds of ``SWEEPS`` sweeps each, the tables
averaged over the last round's sweeps after ``BURN_IN`` give the predictive probabilities of the score.
The restaurants of seldom contexts are whole where they are sampled: once, after the first counts at the
root, by as many sweeps; their mean tables are customers of the root in the rounds after.

Distribution. One shuffle deals the counted (text, context, word) triples of groups of texts out by
word, so that a word's pairs, its root dish and the texts that ask for it come together; it is
written as a table, a row for each bucket of words, which every round reads again. Rows hold packed
arrays; what the buckets add to a text is summed per task and group before it is shuffled. Words with at
least the share ``HOT`` (1 / HOT at most) are dealt out by word and context, and their pairs with
contexts as frequent (1 / HOT^2 at most) are counted apart and sampled on the driver, so no bucket
gets a pair with more than the share HOT. The ``KNOWN`` most frequent contexts at most, the hot ones and
the start are told to all tasks; a round returns their tables as slices of vectors that Spark sums. Pairs
of any other context are sent to the part of its hash, which has the whole restaurant, and what it
answers is joined to the buckets, without moving them, as both tables are written by bucket. Random
numbers depend on bucket or part and round alone, so a task that runs again draws the same.

A null or empty text is the end alone. Rows that repeat get a row each. Without training rows no
word is known. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, shared_dir, slices
from .linear import segments

HOT, KNOWN = 1e-3, 1 << 16
ROUNDS, SWEEPS, BURN_IN, EXACT = 2, 5, 2, 128
#: The strength of contexts and of the root; their discounts are estimated from how many pairs and words occur once and twice, or else this one.
STRENGTH, ROOT_STRENGTH, DISCOUNT = 1.0, 1.0, 0.6
END = b"\n"
_TEXT_BYTES, _TEXTS, _HELD, _SLICE, _BUCKET, _PART, _FILES = 1 << 22, 30_000, 1 << 20, 1 << 13, 250_000, 1_000_000, 100_000


@lru_cache(4)
def _stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers: entry n, t for n customers at t tables, up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for n in range(EXACT):
            stay = np.log(np.maximum(n - discount * np.arange(EXACT + 1), 0))
            s[n + 1] = np.logaddexp(s[n] + stay, np.concatenate(([-np.inf], s[n, :-1])))
    return s


@lru_cache(4)
def _ratios(discount: float) -> np.ndarray:
    """Entry t, n: the Stirling number of n, t + 1 over that of n, t, or 0 if there are no t + 1 tables."""
    with np.errstate(invalid="ignore"):
        s = np.exp(np.diff(_stirling(discount), axis=1, append=-np.inf))
    return np.ascontiguousarray(np.nan_to_num(s, nan=0.0, posinf=0.0).T)


#: Dishes are drawn together whose customers are more than one of these and not more than the next; further ones seat them in blocks.
_SIZES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, EXACT])
_SIZE_OF = np.searchsorted(_SIZES, np.arange(EXACT + 1)).astype(np.uint8)
#: So many weights at once stay in a core's cache.
_WEIGHTS = 1 << 17


def alike(n: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Which dishes :func:`draw` takes together, and the most customers they have."""
    some = np.flatnonzero(n > 1)
    size = _SIZE_OF[np.minimum(n[some], EXACT)]
    rows = np.split(some[np.argsort(size, kind="stable")], np.bincount(size, minlength=len(_SIZES)).cumsum()[:-1])
    return [(int(hi), r) for hi, r in zip(_SIZES, rows) if len(r)]


def draw(n: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng: np.random.Generator, groups: list[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
    """The tables of dishes with ``n`` customers, all reseated given ``others``, the tables of other dishes there, and ``p``, what the parent gives the dish; ``groups``: ``alike(n)``, if made before."""
    t = np.minimum(n, 1).astype(np.float64)
    ratios = _ratios(discount)
    for hi, rows in alike(n) if groups is None else groups:
        for part in np.array_split(rows, len(rows) * hi // _WEIGHTS + 1):
            m, b = np.minimum(n[part], EXACT), p[part]
            a = (strength + discount * others[part]) * b
            b *= discount
            # Weights are products where no product can leave the range of numbers, else sums of logarithms.
            fit = (a + hi * b) * ratios[1].take(m) < 10.0 ** (280 / hi)
            if not fit.all():
                far = part[~fit]
                w = np.log((strength + discount * (others[far, None] + np.arange(hi))) * p[far, None]).cumsum(axis=1)
                w += _stirling(discount)[m[~fit], 1 : hi + 1]
                w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
                t[far] = 1 + (w < (rng.random(len(far)) * w[:, -1])[:, None]).sum(axis=1)
                part, m, a, b = part[fit], m[fit], a[fit], b[fit]
            w, c, more = np.ones(len(part)), np.ones((hi, len(part))), np.empty(len(part))
            for k in range(1, hi):
                a += b
                np.multiply(a, ratios[k].take(m), out=more)
                w *= more
                np.add(c[k - 1], w, out=c[k])
            t[part] = 1 + (c < rng.random(len(part)) * c[-1]).view(np.uint8).sum(axis=0, dtype=np.uint8)
    todo, seated = np.flatnonzero(n > EXACT), EXACT
    while len(todo):
        new = (strength + discount * (others[todo] + t[todo])) * p[todo]
        new = np.minimum(1.0, new / (new + seated - discount * t[todo]))
        t[todo] += rng.binomial(np.minimum(seated // 16, n[todo] - seated), new)
        seated += seated // 16
        todo = todo[n[todo] > seated]
    return t


@dataclass
class Pairs:
    """A bucket's pairs of a word and the context before it."""

    word: np.ndarray  # the number of the word in the bucket
    context: np.ndarray  # the known context, or -1 - the number of another one in the bucket
    n: np.ndarray  # how often texts to learn from have the pair
    hot: np.ndarray  # of each word: its number among the hot ones, or -1
    cold: np.ndarray  # the pairs whose context isn't known, with its customers and tables, and the pair's own tables
    customers: np.ndarray
    tables: np.ndarray
    seated: np.ndarray


def _find(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash is among ``known`` ones, which are in order, or -1."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


@dataclass
class Model:
    """What all tasks know. Known contexts are the words of ``known`` in order, and the start of a text as the last one."""

    known: np.ndarray  # the hashes of the words that are contexts, in order
    customers: np.ndarray  # of each context
    hot: np.ndarray  # which of the known words are hot
    total: int
    kinds: int
    discount: float = DISCOUNT
    root_discount: float = DISCOUNT
    buckets: int = 1
    parts: int = 1  # of the other contexts, by hash
    #: For each round, as it was left: tables of each context, what the root gives the hot words, customers and tables of the root.
    tables: list[np.ndarray] = field(default_factory=list)
    hot_p: list[np.ndarray] = field(default_factory=list)
    root: list[tuple[float, float]] = field(default_factory=list)
    hot_pairs: np.ndarray | None = None  # log10 of a hot word's probability in a hot context

    def __post_init__(self):
        self.hot_ids = np.flatnonzero(self.hot)
        self.hot_contexts = np.flatnonzero(self.customers >= HOT * self.total) if self.total else np.empty(0, int)

    def context_of(self, hashes: np.ndarray) -> np.ndarray:
        """The known context that each word names, or -1."""
        return _find(self.known, hashes)

    def hot_of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word among the hot ones, or -1."""
        return _find(self.known[self.hot_ids], hashes)

    def hot_context_of(self, context: np.ndarray) -> np.ndarray:
        number = np.full(len(self.customers) + 1, -1)
        number[self.hot_contexts] = np.arange(len(self.hot_contexts))
        return number[np.minimum(context, len(self.customers))]

    def part_of(self, cold: np.ndarray) -> np.ndarray:
        return ((cold.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.kinds + 1)))

    def root_p(self, customers, tables, k: int):
        """What the root gives a dish, with the totals that round k left; a dish without customers is new to it."""
        n, t = self.root[k]
        return (customers - self.root_discount * tables + (ROOT_STRENGTH + self.root_discount * t) / (self.kinds + 1)) / (ROOT_STRENGTH + n)

    def served(self, pairs: Pairs, tables: np.ndarray, parent: np.ndarray, k: int) -> np.ndarray:
        """What the restaurants of the contexts give the pairs' words, where the root gives ``parent``."""
        at = np.maximum(pairs.context, 0)
        n, t = self.customers[at], self.tables[k][at]
        n[pairs.cold], t[pairs.cold] = pairs.customers, pairs.tables
        return (pairs.n - self.discount * tables + (STRENGTH + self.discount * t) * parent) / (STRENGTH + n)

    def sampled(self, pairs: Pairs, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mean tables of the pairs, and the mean customers and tables of the words' root dishes, that round k leaves."""
        word, context, n, hot = pairs.word, pairs.context, pairs.n, pairs.hot
        if not k:
            c0 = np.bincount(word[n > 0], minlength=len(hot)).astype(np.float64)
            return np.minimum(n, 1).astype(np.float64), c0, np.minimum(c0, 1)
        inner = np.flatnonzero((context >= 0) & (n > 0))
        once = inner[n[inner] == 1]  # these have one table always
        means = [np.zeros(len(n)), np.zeros(len(hot)), np.zeros(len(hot))]
        means[0][once] = SWEEPS - BURN_IN
        inner = inner[n[inner] > 1]
        direct, alone = np.bincount(word[pairs.cold], pairs.seated, len(hot)), np.bincount(word[once], minlength=len(hot))
        t, mine = np.ones(len(inner)), hot < 0
        rng = np.random.default_rng([k, seed])
        m, w, tables = n[inner], word[inner], self.tables[k - 1][context[inner]]
        t0, groups = None, alike(m)
        for sweep in range(SWEEPS):
            c0 = direct + (alone + np.bincount(w, t, len(hot)))
            whole = np.round(c0).astype(np.int64)
            total = np.full(len(hot), self.root[k - 1][1])
            t0 = draw(np.where(mine, whole, 0), np.maximum(0, total - (t0 if t0 is not None else 1)), np.full(len(hot), 1 / (self.kinds + 1)), self.root_discount, ROOT_STRENGTH, rng)
            p0 = self.root_p(c0, t0, k - 1)
            p0[~mine] = self.hot_p[k - 1][hot[~mine]]
            t = draw(m, np.maximum(0, tables - t), p0[w], self.discount, STRENGTH, rng, groups)
            if sweep >= BURN_IN:
                means[0][inner] += t
                means[1] += direct + (alone + np.bincount(w, t, len(hot)))
                means[2] += t0
        kept = SWEEPS - BURN_IN
        means[0][pairs.cold] = pairs.seated * kept
        return means[0] / kept, means[1] / kept, means[2] / kept


def _read(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts: the first's number, how many, the distinct words' hashes, each token's word, and its text."""
    from xxhash import xxh3_64_intdigest

    group, size, first = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if group and (t is None or size + len(t) > _TEXT_BYTES or len(group) == _TEXTS):
            words, owner = _words(group)
            words = words.dictionary_encode()
            distinct, number = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
            hashes = np.fromiter(map(xxh3_64_intdigest, [*distinct, END]), np.uint64, len(distinct) + 1).view(np.int64)
            ends = np.searchsorted(owner, np.arange(len(group)), "right")
            yield first, len(group), hashes, np.insert(number, ends, len(distinct)), np.insert(owner, ends, np.arange(len(group)))
            group, size, first = [], 0, i
        if t is not None:
            group.append(t)
            size += len(t)


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts, A-Z lower-cased, and the text of each."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at, letters, sizes, before = 0, [], [], np.zeros(len(begins), np.int64)
    for part in segments(b" ".join(texts)):
        data = np.frombuffer(part.lower(), np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = (data != 32) & (data - np.uint8(9) > 4)  # not a space, nor from tab to carriage return
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        letters.append(data[inside[1:-1]])
        sizes.append((edges[1::2] - edges[::2]).astype(np.int32))
        before += np.searchsorted(edges[::2], begins - at)
        at += len(data)
    letters, offsets = np.concatenate(letters), np.cumsum(np.concatenate(([0], *sizes), dtype=np.int32), dtype=np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words, np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(before))


def _counted(batches: Iterator[pa.RecordBatch], keys: Callable) -> Iterator[pa.RecordBatch]:
    """``key, n`` summed over a task's texts as far as they fit the bound; ``keys(group)``: keys and their counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

    def batch(key, n):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    for b in slices(batches, 1, _TEXT_BYTES):
        for group in _read([t or b"" for t in b.column(1).to_pylist()]):
            held.append(keys(group))
            if sum(len(k) for k, _ in held) > 2 * _HELD:
                held = [merged()]
                if len(held[0][0]) > _HELD:
                    yield batch(*held.pop())
    if held:
        yield batch(*merged())


def _total(rows: DataFrame, keys: Callable) -> DataFrame:
    return rows.mapInArrow(lambda b: _counted(b, keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _word_counts(group) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, tokens, _ = group
    return hashes, np.bincount(tokens, minlength=len(hashes))


def _before(model: Model, hashes: np.ndarray, tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each token's context: a known one, or the number of known ones and that of the word in the group."""
    known = model.context_of(hashes)
    c = np.concatenate(([0], np.where(known >= 0, known, len(model.customers) + np.arange(len(known)))[tokens[:-1]]))
    return np.where(np.concatenate(([True], owner[1:] != owner[:-1])), len(model.customers) - 1, c)


#: The packed arrays: little-endian numbers of these kinds.
_KINDS = {
    "words": np.int64, "sizes": np.int32, "context": np.int32, "doc": np.int16, "n": np.int32, "groups": np.int64, "pairs": np.int32, "entries": np.int32, "trained": np.int64, "at": np.int32, "ids": np.int64,
    "cold": np.int64, "customers": np.int32, "tables": np.float32, "seated": np.float32, "p": np.float32,
    "null": np.bool_, "tokens": np.int32, "known": np.int32, "base": np.float64, "score": np.float32, "seldom": np.int16, "values": np.float64,
}


def _packed(name: str, values: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """A column of packed arrays: ``values`` cut into runs of ``sizes``, or all in one row."""
    kind = np.dtype(_KINDS[name])
    values = np.ascontiguousarray(values, kind)
    ends = np.cumsum([len(values)] if sizes is None else sizes)
    if kind.kind == "i":  # all first bytes of a run, then all second ones: most high bytes are alike, which compresses
        each, planes = values.view(np.uint8).reshape(-1, kind.itemsize), np.empty(values.nbytes, np.uint8)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            planes[a * kind.itemsize : b * kind.itemsize].reshape(kind.itemsize, -1)[:] = each[a:b].T
        values = planes
    offsets = (np.concatenate(([0], ends)) * kind.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unpacked(name: str, data) -> np.ndarray:
    kind = np.dtype(_KINDS[name])
    if kind.kind != "i":
        return np.frombuffer(data, kind)
    planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1)
    values = np.empty(planes.shape[::-1], np.uint8)
    for k, plane in enumerate(planes):
        values[:, k] = plane
    return values.view(kind).ravel()


def _schema(longs: tuple[str, ...], packed: tuple[str, ...]) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in longs] + [(n, pa.binary()) for n in packed])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` " + ("binary" if pa.types.is_binary(f.type) else "long") for f in schema)


def _batch(schema: pa.Schema, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The batch's rows, with their packed arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name, c in zip(batch.schema.names, batch.columns):
            x = c[i]
            row[name] = (_unpacked(name, x.as_buffer()) if x.is_valid else None) if pa.types.is_binary(c.type) else x.as_py()
        yield row


#: What every row of texts has: the ids, the tokens, and what the words that are contexts add to each text.
_TEXT_ROW = ("ids", "null", "tokens", "known", "base")
#: What the shuffle deals out: of a group of texts a row for each bucket of words, and one (bucket < 0) with its texts and their hot pairs.
_DEALT = _schema(("bucket", "group"), ("words", "sizes", "context", "cold", "doc", "n", *_TEXT_ROW))
#: A row for each bucket: its words, how many pairs each has, the pairs' contexts, entries and training counts, and the entries; rows of texts stay as they are.
_STORED = _schema(("bucket", "group"), ("groups", "words", "pairs", "context", "cold", "entries", "trained", "at", "doc", "n", *_TEXT_ROW))
#: What a task's buckets add to the texts of a group: ``score`` to each of ``doc``, ``known`` and ``base`` to those of ``seldom``; or the row of its texts.
_ADDED = _schema(("group", "texts"), ("doc", "score", "seldom", "known", "base", "ids", "null", "tokens"))


def _deal(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows of ``_DEALT``; an entry's n is negative if its text isn't learned from."""
    from xxhash import xxh3_64

    log_base = model.log_base(model.customers[:-1])
    for b in slices(batches, 1, _TEXT_BYTES):
        texts, learned = [t or b"" for t in b.column(1).to_pylist()], b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, size, hashes, tokens, owner in _read(texts):
            ids = b.column(0).slice(first, size)
            name = xxh3_64(repr(ids.to_pylist()).encode())
            for t in texts[first : first + size]:
                name.update(b"%d " % len(t))
                name.update(t)
            group = int(np.uint64(name.intdigest()).view(np.int64))
            known, context, sign = model.context_of(hashes)[tokens], _before(model, hashes, tokens, owner), np.where(learned[first : first + size], 1, -1)
            hot_word = model.hot_of(hashes)
            hot, hot_context = hot_word[tokens], model.hot_context_of(context)
            both = (hot >= 0) & (hot_context >= 0)
            width = len(model.customers) + len(hashes)
            code, n = np.unique(((tokens[~both].astype(np.int64) * width + context[~both]) << 15) | owner[~both], return_counts=True)
            doc, pair = code & (1 << 15) - 1, code >> 15
            word, context = pair // width, pair % width
            name_of = np.concatenate((np.arange(2, len(model.customers) + 2).astype(np.uint64), hashes.view(np.uint64)))
            # Ordinary words are dealt out by their hash, hot ones by hash and context.
            mixed = hashes[word].view(np.uint64) ^ np.where(hot_word[word] >= 0, name_of[context] * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
            bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(model.buckets)
            order = _order(bucket, model.buckets)
            bucket, word, context, doc, n = bucket[order], word[order], context[order], doc[order], n[order]
            if len(bucket):
                new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
                starts, words = np.flatnonzero(new), np.flatnonzero(new | np.concatenate(([True], word[1:] != word[:-1])))
                entries, distinct = np.diff(np.append(starts, len(bucket))), np.diff(np.append(np.searchsorted(words, starts), len(words)))
                row = np.repeat(np.arange(len(starts)), entries)
                context, cold, colds = _numbered(row, context, len(model.customers), hashes, len(starts))
                yield _batch(
                    _DEALT, len(starts), cold=_packed("cold", cold, colds), bucket=pa.array(bucket[starts].astype(np.int64)), group=pa.array(np.full(len(starts), group)), words=_packed("words", hashes[word[words]], distinct),
                    sizes=_packed("sizes", np.diff(np.append(words, len(word))), distinct), context=_packed("context", context, entries), doc=_packed("doc", doc, entries), n=_packed("n", n * sign[doc], entries),
                )
            code, n = np.unique((hot_context[both] * max(1, len(model.hot_ids)) + hot[both]) << 15 | owner[both], return_counts=True)
            doc = code & (1 << 15) - 1
            seen = known >= 0
            yield _batch(
                _DEALT, 1, bucket=pa.array([-1 - group % model.buckets]), group=pa.array([group]), context=_packed("context", code >> 15), doc=_packed("doc", doc), n=_packed("n", n * sign[doc]),
                ids=_packed("ids", np.array([i or 0 for i in ids.to_pylist()])), null=_packed("null", ids.is_null().to_numpy(zero_copy_only=False)), tokens=_packed("tokens", np.bincount(owner, minlength=size)),
                known=_packed("known", np.bincount(owner[seen], minlength=size)), base=_packed("base", np.bincount(owner[seen], log_base[known[seen]], size)),
            )


def _order(values: np.ndarray, below: int) -> np.ndarray:
    """The order of numbers, equal ones as they come; small ones are sorted by their digits."""
    return np.argsort(values.astype(np.uint16 if below <= 1 << 16 else np.int64), kind="stable")


def _numbered(row: np.ndarray, context: np.ndarray, known: int, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts with those beyond the known ones as -1 - their number in the row; the hashes of these row by row, and how many each row has."""
    at = np.flatnonzero(context >= known)
    code, inverse = np.unique(row[at] * len(hashes) + context[at] - known, return_inverse=True)
    sizes = np.bincount(code // len(hashes), minlength=rows)
    context = context.copy()
    context[at] = -1 - (inverse - (np.cumsum(sizes) - sizes)[row[at]])
    return context, hashes[code % len(hashes)], sizes


def _merge(rows: list[dict]) -> pa.RecordBatch:
    """A bucket's row of ``_STORED``: the entries of all groups in order of word and context."""
    values = lambda name: np.concatenate([r[name] for r in rows])
    words, inverse = np.unique(values("words"), return_inverse=True)
    word, context, n = np.repeat(inverse, values("sizes")), values("context"), values("n")
    at = np.repeat(np.arange(len(rows)), [len(r["n"]) for r in rows])
    cold, number = np.unique(values("cold"), return_inverse=True)
    sizes, few = np.array([len(r["cold"]) for r in rows]), np.flatnonzero(context < 0)
    context[few] = -1 - number[(np.cumsum(sizes) - sizes)[at[few]] - 1 - context[few]]
    least = context.min(initial=0)
    order = np.argsort(word * (int(context.max(initial=0)) - int(least) + 1) + (context - least), kind="stable")
    word, context, n = word[order], context[order], n[order]
    pair = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (context[1:] != context[:-1]))))
    made = {
        "groups": np.array([r["group"] for r in rows]), "words": words, "pairs": np.bincount(word[pair], minlength=len(words)), "context": context[pair], "cold": cold,
        "entries": np.diff(np.append(pair, len(word))), "trained": np.add.reduceat(np.maximum(n, 0).astype(np.int64), pair), "at": at[order], "doc": values("doc")[order], "n": n,
    }
    return _batch(_STORED, 1, bucket=pa.array([rows[0]["bucket"]]), **{k: _packed(k, v) for k, v in made.items()})


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_STORED`` from the rows of ``_DEALT``, which come in order of bucket."""
    held: list[dict] = []
    for b in batches:
        for i, r in enumerate(_rows(b)):
            if held and held[0]["bucket"] != r["bucket"]:
                yield _merge(held)
                held = []
            if r["bucket"] >= 0:
                held.append(r)
            else:
                row = b.slice(i, 1)
                yield _batch(_STORED, 1, **{f.name: row.column(f.name) for f in _DEALT if f.name in _STORED.names and f.name != "words"})
    if held:
        yield _merge(held)


def _pairs_of(r: dict, model: Model) -> Pairs:
    """A bucket's pairs; what the restaurants of contexts that aren't known answered is there once they were asked."""
    context = r["context"].astype(np.int64)
    cold = np.flatnonzero(context < 0)
    found = Pairs(np.repeat(np.arange(len(r["words"])), r["pairs"]), context, r["trained"], model.hot_of(r["words"]), cold, *np.zeros((3, len(cold))))
    if len(cold) and r.get("seated") is not None:
        order = _order(model.part_of(r["cold"][-1 - context[cold]]), model.parts)
        for name in _ANSWERED:
            getattr(found, name)[order] = r[name]
    return found


#: What buckets ask the restaurants of contexts that aren't known: of each pair its context, how often it occurs, and what the root gives its word.
_ASKED = _schema(("part", "bucket"), ("cold", "n", "p"))
#: What they answer: customers and tables of the restaurant, and tables of the pair.
_ANSWERED = ("customers", "tables", "seated")
_ANSWERS = _schema(("part", "bucket"), _ANSWERED)


def _asked(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in _rows(b):
            pairs = _pairs_of(r, model)
            _, c0, t0 = model.sampled(pairs, 0, 0)
            p = model.root_p(c0, t0, 0)
            p[pairs.hot >= 0] = model.hot_p[0][pairs.hot[pairs.hot >= 0]]
            cold = r["cold"][-1 - pairs.context[pairs.cold]]
            part = model.part_of(cold)
            order = _order(part, model.parts)
            at = pairs.cold[order]
            parts, sizes = np.unique(part, return_counts=True)
            if len(parts):
                yield _batch(
                    _ASKED, len(parts), part=pa.array(parts), bucket=pa.array(np.full(len(parts), r["bucket"])),
                    cold=_packed("cold", cold[order], sizes), n=_packed("n", pairs.n[at], sizes), p=_packed("p", p[pairs.word[at]], sizes),
                )


def _seated(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ANSWERS`` from those of ``_ASKED``, which come in order of part and bucket: the whole restaurants of a part are sampled."""

    def done(held: list[dict]) -> pa.RecordBatch:
        n, p = (np.concatenate([r[name] for r in held]) for name in ("n", "p"))
        names, c = np.unique(np.concatenate([r["cold"] for r in held]), return_inverse=True)
        rng, some = np.random.default_rng([ROUNDS + 1, held[0]["part"]]), np.flatnonzero(n > 0)
        t, mean = np.ones(len(some)), np.zeros(len(n))
        for sweep in range(SWEEPS):
            others = np.bincount(c[some], t, len(names))[c[some]] - t
            t = draw(n[some], others, p[some].astype(np.float64), model.discount, STRENGTH, rng)
            mean[some] += t * (sweep >= BURN_IN) / (SWEEPS - BURN_IN)
        sizes = [len(r["n"]) for r in held]
        columns = {"customers": np.bincount(c, n, len(names))[c], "tables": np.bincount(c, mean, len(names))[c], "seated": mean}
        return _batch(_ANSWERS, len(held), part=pa.array([r["part"] for r in held]), bucket=pa.array([r["bucket"] for r in held]), **{k: _packed(k, v, sizes) for k, v in columns.items()})

    for held in _runs(batches, "part"):
        yield done(held)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket from rows of ``_ANSWERS`` in order of bucket and part."""
    for held in _runs(batches, "bucket"):
        yield _batch(_ANSWERS, 1, bucket=pa.array([held[0]["bucket"]]), **{k: _packed(k, np.concatenate([r[k] for r in held])) for k in _ANSWERED})


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows that follow each other with the same key."""
    held: list[dict] = []
    for b in batches:
        for r in _rows(b):
            if held and held[0][key] != r[key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _by_bucket(df: DataFrame, files: int) -> DataFrame:
    """Cut the lineage as :func:`materialise` does, by a table whose rows Spark knows to lie by bucket, so that it joins them where they are."""
    spark, name = df.sparkSession, f"stage_{uuid.uuid4().hex}"
    df.write.bucketBy(files, "bucket").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def _with_answers(stored: DataFrame, model: Model, files: int) -> DataFrame:
    """The stored buckets with what the restaurants of their contexts answer."""
    asked = stored.where("bucket >= 0").select("bucket", "words", "pairs", "context", "cold", "trained").mapInArrow(lambda b: _asked(b, model), _ddl(_ASKED))
    kind = _ddl(_ANSWERS)
    answers = asked.repartition(model.parts, "part").sortWithinPartitions("part", "bucket").mapInArrow(lambda b: _seated(b, model), kind)
    answers = answers.repartition(files, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(_answered, kind)
    return stored.join(_by_bucket(answers, files).select("bucket", *_ANSWERED).hint("shuffle_hash"), "bucket", "left")


def _left(batches: Iterator[pa.RecordBatch], model: Model, k: int) -> Iterator[pa.RecordBatch]:
    """``part, values``: slices of the vector of tables of contexts, customers of hot words at the root, customers and tables of other words there, and how many pairs occur once and twice."""
    contexts, hot = len(model.customers), len(model.hot_ids)
    out = np.zeros(contexts + hot + 4)
    for b in batches:
        for r in _rows(b):
            pairs = _pairs_of(r, model)
            context, n, mine = pairs.context, pairs.n, pairs.hot
            t, c0, t0 = model.sampled(pairs, k, r["bucket"])
            out[:contexts] += np.bincount(context[context >= 0], t[context >= 0], contexts)
            out[contexts : contexts + hot] += np.bincount(mine[mine >= 0], c0[mine >= 0], hot)
            out[-4:] += [c0[mine < 0].sum(), t0[mine < 0].sum(), (n == 1).sum(), (n == 2).sum()]
    for part in range(0, len(out), _SLICE):
        if out[part : part + _SLICE].any():
            yield _batch(_SLICES, 1, part=pa.array([part]), values=_packed("values", out[part : part + _SLICE]))


_SLICES = _schema(("part",), ("values",))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for r in _rows(b):
            sums[r["part"]] = sums[r["part"]] + r["values"] if r["part"] in sums else r["values"]
    for part, values in sums.items():
        yield _batch(_SLICES, 1, part=pa.array([part]), values=_packed("values", values))


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, n``: how often a task's texts to learn from have each hot pair."""
    sums: dict[int, int] = defaultdict(int)  # 1 / HOT^2 keys at most
    for b in batches:
        for r in _rows(b):
            at, inverse = np.unique(r["context"], return_inverse=True)
            for key, n in zip(at.tolist(), np.bincount(inverse, np.maximum(r["n"], 0), len(at)).tolist()):
                sums[key] += int(n)
    yield pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})


def _hot_pairs(stored: DataFrame, model: Model) -> np.ndarray:
    """How often each hot word follows each hot context."""
    hot = len(model.hot_ids)
    out = np.zeros((len(model.hot_contexts), hot), np.int64)
    found = stored.where("bucket < 0").select("context", "n").mapInArrow(_hot_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    for r in found.collect():  # 1 / HOT^2 rows at most
        out[r["key"] // hot, r["key"] % hot] = r["n"]
    return out


def _fit(stored: DataFrame, hot_n: np.ndarray, model: Model, files: int) -> DataFrame:
    """Sample the rounds; ``hot_n``: how often each hot word follows each hot context. Returns the buckets with the answers of contexts that aren't known."""
    c, w = np.nonzero(hot_n)
    pair_context, pair_n, contexts, hot = model.hot_contexts[c], hot_n[c, w], len(model.customers), len(model.hot_ids)
    needed, kind = ["bucket", "words", "pairs", "context", "cold", "trained"], _ddl(_SLICES)
    t, t0 = np.ones(len(c)), np.ones(hot)
    for k in range(ROUNDS + 1):
        pairs = stored.where("bucket >= 0").select(*needed, *(_ANSWERED if k else ()))
        found = pairs.mapInArrow(lambda b, k=k: _left(b, model, k), kind).repartition("part").mapInArrow(_summed, kind)
        out = np.zeros(contexts + hot + 4)
        for r in found.collect():  # a few thousand numbers for each slice of the contexts and hot words, whose number is bounded
            values = np.frombuffer(r["values"], np.float64)
            out[r["part"] : r["part"] + len(values)] = values
        rng = np.random.default_rng(k)
        if k:
            mean = np.zeros(len(c))
            for sweep in range(SWEEPS):
                t = draw(pair_n, np.maximum(0, model.tables[k - 1][pair_context] - t), model.hot_p[k - 1][w], model.discount, STRENGTH, rng)
                mean += t * (sweep >= BURN_IN) / (SWEEPS - BURN_IN)
        else:
            mean = t
            once, twice = out[-2:] + [(pair_n == 1).sum(), (pair_n == 2).sum()]
            model.discount = float(once / (once + 2 * twice)) if once and twice else DISCOUNT
        tables, c0 = out[:contexts] + np.bincount(pair_context, mean, contexts), out[contexts : contexts + hot] + np.bincount(w, mean, hot)
        if k:
            t0 = draw(np.round(c0).astype(np.int64), np.maximum(0, model.root[k - 1][1] - t0), np.full(hot, 1 / (model.kinds + 1)), model.root_discount, ROOT_STRENGTH, rng)
        model.root.append((float(c0.sum() + out[-4]), float(t0.sum() + out[-3])))
        model.tables.append(tables)
        model.hot_p.append(model.root_p(c0, t0, k))
        if not k:
            stored = _with_answers(stored, model, files)
    p = np.tile(model.hot_p[-1], (len(model.hot_contexts), 1))
    tables = np.zeros_like(p)
    tables[c, w] = mean
    if p.size:
        none, at = np.empty(0, np.int64), np.repeat(model.hot_contexts, hot)
        p = np.log10(model.served(Pairs(none, at, hot_n.ravel(), none, none, none, none, none), tables.ravel(), p.ravel(), ROUNDS)).reshape(p.shape)
    model.hot_pairs = p
    return stored


def _weighed(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ADDED``: what a task's buckets add to the texts of each group, and the rows of texts with what their hot pairs add."""
    scores: dict[int, np.ndarray] = {}
    seldom: dict[int, np.ndarray] = {}
    for b in batches:
        for r in _rows(b):
            n, texts = np.abs(r["n"]), r["doc"].astype(np.int64)
            if r["bucket"] < 0:
                hot, size = max(1, len(model.hot_ids)), len(r["tokens"])
                log = model.hot_pairs[r["context"] // hot, r["context"] % hot] if len(n) else n
                columns = {"doc": np.arange(size), "score": np.bincount(texts, n * log, size), "seldom": np.arange(size), **{c: r[c] for c in _TEXT_ROW}}
                yield _batch(_ADDED, 1, group=pa.array([r["group"]]), texts=pa.array([1]), **{c: _packed(c, v) for c, v in columns.items()})
                continue
            pairs = _pairs_of(r, model)
            word, trained, hot = pairs.word, pairs.n, pairs.hot
            t, c0, t0 = model.sampled(pairs, ROUNDS, r["bucket"])
            p0 = model.root_p(c0, t0, ROUNDS)
            p0[hot >= 0] = model.hot_p[ROUNDS][hot[hot >= 0]]
            p = model.served(pairs, t, p0[word], ROUNDS)
            counts = np.bincount(word, trained, len(hot))
            rare = (model.context_of(r["words"]) < 0)[word]
            each = np.repeat(np.arange(len(word)), r["entries"])
            _add(scores, r["groups"], r["at"], texts, (n * np.log10(p)[each],))
            mine = np.flatnonzero(rare[each])
            w = word[each[mine]]
            _add(seldom, r["groups"], r["at"][mine], texts[mine], (n[mine] * (counts[w] > 0), n[mine] * model.log_base(counts[w])))
    for group, (seen, score) in scores.items():
        seen_few, known, base = seldom.get(group, (seen[:0],) * 3)
        doc, few = np.flatnonzero(seen), np.flatnonzero(seen_few)
        score, known, base = score[doc], known[few], base[few]
        yield _batch(_ADDED, 1, group=pa.array([group]), texts=pa.array([0]), doc=_packed("doc", doc), score=_packed("score", score), seldom=_packed("seldom", few), known=_packed("known", known), base=_packed("base", base))


def _add(sums: dict[int, np.ndarray], groups: np.ndarray, at: np.ndarray, texts: np.ndarray, values: tuple[np.ndarray, ...]) -> None:
    """Add the values to their texts: each group has a row of how often a text was seen, and a row of sums for each kind of value."""
    sizes = np.zeros(len(groups), np.int64)
    np.maximum.at(sizes, at, texts + 1)
    ends = np.cumsum(sizes)
    key = (ends - sizes)[at] + texts
    totals = np.array([np.bincount(key, v, ends[-1]) for v in (None, *values)])
    for group, end, size in zip(groups.tolist(), ends.tolist(), sizes.tolist()):
        if size:
            new, old = totals[:, end - size : end], sums.get(group)
            if old is not None and old.shape[1] >= size:
                old[:, :size] += new
            else:
                sums[group] = new.copy()
                if old is not None:
                    sums[group][:, : old.shape[1]] += old


_SCORED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SCORED`` from rows of ``_ADDED``, which come in order of group; a group that occurs more than once gives its rows as often."""

    def done(held: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = [r for r in held if r["texts"]]
        ids, size, copies = rows[0], len(rows[0]["ids"]), len(rows)
        total = lambda at, name: sum(np.bincount(r[at], r[name], size) for r in held) / copies
        columns = [pa.array(ids["ids"], mask=ids["null"]), pa.array(ids["tokens"].astype(np.int64)), pa.array(np.round(total("seldom", "known")).astype(np.int64)), pa.array(total("seldom", "base")), pa.array(total("doc", "score"))]
        for _ in range(copies):
            yield pa.RecordBatch.from_arrays(columns, schema=_SCORED)

    held: list[dict] = []
    for b in batches:
        for r in _rows(b):
            if held and held[0]["group"] != r["group"]:
                yield from done(held)
                held = []
            held.append(r)
    if held:
        yield from done(held)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row ``id, n_tokens, n_known, train_tokens, base_score`` and ``score``; ``training``: a condition on ``id``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select("id", "text", F.coalesce(training, F.lit(False)).alias("learned"))
    learned = rows.where("learned")
    vocabulary = materialise(_total(learned, _word_counts))
    n = F.col("n")
    total, kinds, once, twice = vocabulary.agg(F.coalesce(F.sum(n), F.lit(0)), F.count("*"), F.count_if(n == 1), F.count_if(n == 2)).first()
    from xxhash import xxh3_64_intdigest

    end = int(np.uint64(xxh3_64_intdigest(END)).view(np.int64))
    least, words = None, 0
    for r in vocabulary.groupBy(F.floor(F.log2(n) * 16).alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect():  # a thousand sizes at most
        words += r["words"]
        if words > KNOWN:
            break
        least = r["size"]
    frequent = vocabulary.where((F.floor(F.log2(n) * 16) >= F.lit(least)) | (n >= HOT * total) | (F.col("key") == end)).orderBy("key").toArrow()  # KNOWN + 1 / HOT + 1 rows at most
    discard(vocabulary)
    known, counts = frequent["key"].to_numpy().astype(np.int64), frequent["n"].to_numpy().astype(np.int64)
    ends = counts[known == end].sum()  # as many as texts, so as many starts
    model = Model(known, np.append(counts, ends), counts >= HOT * total, total, kinds)
    model.root_discount = float(once / (once + 2 * twice)) if once and twice else DISCOUNT
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model.buckets = max(4 * shuffled, total // _BUCKET)
    model.parts = int(max(shuffled, (total - counts.sum()) // _PART))
    files = int(min(max(shuffled, model.buckets // 2), _FILES))
    dealt = rows.mapInArrow(lambda b: _deal(b, model), _ddl(_DEALT))
    dealt = dealt.repartition(files, "bucket").sortWithinPartitions("bucket")
    stored = _by_bucket(dealt.mapInArrow(_gathered, _ddl(_STORED)), files)
    stored = _fit(stored, _hot_pairs(stored, model), model, files)
    added = stored.mapInArrow(lambda b: _weighed(b, model), _ddl(_ADDED)).repartition(shuffled, "group").sortWithinPartitions("group")
    scored = added.mapInArrow(_totals, "id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """``n_tokens, base_perplexity, perplexity`` over all given rows."""
    n = F.sum("n_tokens")
    return scored.agg(n.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("base_score") / n).alias("base_perplexity"), F.pow(F.lit(10.0), -F.sum("score") / n).alias("perplexity"))
