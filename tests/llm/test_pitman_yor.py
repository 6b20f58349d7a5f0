import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from inkproof.llm import linear
from inkproof.llm import pitman_yor as p
from inkproof.llm.common import fold


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def corpus(n=200):
    r = random.Random(9)
    head, tail = ["the", "of", "And", "a"], [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 60)):
            words.append(r.choice(head) if words and words[-1] in tail and r.random() < 0.8 else r.choice(tail[: r.randint(1, 60)]))
        rows.append((i, " ".join(words), "x", 1))
    return rows + [(500, None, "x", 1), (501, "", "x", 1), (502, "never\tseen  BEFORE\n", "x", 1), (7, rows[7][1], "x", 1), (7, "another of the w1", "x", 1), (None, "the w1 the", "x", 1), (None, "the w1 the", "x", 1)]


def trained(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0


class Restaurants:
    """One customer at a time, with every table kept: the textbook sampler."""

    def __init__(self, pairs, kinds, contexts, d, d0, seed):
        self.r, self.d, self.d0, self.kinds, self.contexts = random.Random(seed), d, d0, kinds, contexts
        self.tables = defaultdict(lambda: defaultdict(list))  # context (or None, the root) -> dish -> customers at each table
        self.pairs = [(c if c in contexts else None, w) for c, w in pairs]

    def p(self, c, w):
        if c is None:
            up, d, s = 1 / (self.kinds + 1), self.d0, p.ROOT_STRENGTH
        elif c not in self.contexts:
            return self.p(None, w)
        else:
            up, d, s = self.p(None, w), self.d, p.STRENGTH
        all_tables = [t for dish in self.tables[c].values() for t in dish] if not hasattr(self, "sums") else None
        n, k = (sum(all_tables), len(all_tables)) if all_tables is not None else self.sums[c]
        mine = self.tables[c].get(w, [])
        return (sum(mine) - d * len(mine) + (s + d * k) * up) / (s + n)

    def seat(self, c, w):
        d, s = (self.d0, p.ROOT_STRENGTH) if c is None else (self.d, p.STRENGTH)
        up = 1 / (self.kinds + 1) if c is None else self.p(None, w)
        dish = self.tables[c][w]
        weights = [n - d for n in dish] + [(s + d * self.sums[c][1]) * up]
        k = self.r.choices(range(len(weights)), weights)[0]
        self.sums[c][0] += 1
        if k == len(dish):
            dish.append(1)
            self.sums[c][1] += 1
            if c is not None:
                self.seat(None, w)
        else:
            dish[k] += 1

    def leave(self, c, w):
        dish = self.tables[c][w]
        k = self.r.choices(range(len(dish)), dish)[0]
        dish[k] -= 1
        self.sums[c][0] -= 1
        if not dish[k]:
            dish.pop(k)
            self.sums[c][1] -= 1
            if c is not None:
                self.leave(None, w)

    def sample(self, texts, sweeps, burn):
        self.sums = defaultdict(lambda: [0, 0])
        for c, w in self.pairs:
            self.seat(c, w)
        mean = defaultdict(float)
        for sweep in range(sweeps):
            for c, w in self.pairs:
                self.leave(c, w)
                self.seat(c, w)
            if sweep >= burn:
                for pair in {x for t in texts for x in t}:
                    mean[pair] += self.p(*pair) / (sweeps - burn)
        return mean


def discount(counts, otherwise=p.DISCOUNT):
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    return once / (once + 2 * twice) if once and twice else otherwise


@pytest.mark.parametrize("hot,known", [(1e-3, 1 << 16), (0.03, 0), (0.03, 30), (1.1, 0), (1.1, 20)])
def test_counts_and_scores_against_a_sampler_of_single_customers(spark, monkeypatch, hot, known):
    monkeypatch.setattr(p, "HOT", hot)
    monkeypatch.setattr(p, "KNOWN", known)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n int").repartition(3)
    out = p.score(docs, fold("id", 10) != 0).collect()
    seen = [tokens(t) for i, t, *_ in rows if trained(i)]
    c = Counter(x for t in seen for x in t)
    total, kinds = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in tokens(t))
    got = Counter((x.id, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in out)
    assert got == Counter((i, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), total, round(base(t), 6)) for i, t, *_ in rows)
    follow = lambda t: list(zip(["<start>", *t], t))
    pairs = [x for t in seen for x in follow(t)]
    brute = Restaurants(pairs, kinds, {*c, "<start>"}, discount(Counter(pairs)), discount(c), 5).sample([follow(tokens(t)) for _, t, *_ in rows], 30, 5)
    want = {(i, round(base(t), 6)): sum(math.log10(brute[x]) for x in follow(tokens(t))) for i, t, *_ in rows}
    off = [abs(x.score / want[x.id, round(x.base_score, 6)] - 1) for x in out]
    assert max(off) < 0.03 and np.mean(off) < 0.006, (max(off), np.mean(off))
    held = [x for x in out if not trained(x.id)]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(p, "HOT", 0.05)
    monkeypatch.setattr(p, "KNOWN", 30)
    models = []
    fit = p._fit

    def kept(stored, hot_n, model, files):
        stored = fit(stored, hot_n, model, files)
        models.append((model, stored, hot_n))
        return stored

    monkeypatch.setattr(p, "_fit", kept)
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string, row string, n int")
    p.score(docs, fold("id", 10) != 0).collect()
    (model, stored, hot_n), = models
    root, by_context = 0.0, np.zeros(len(model.customers))
    cold = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])  # of a context that isn't known: customers and tables as answered, and as its pairs add up
    k = p.ROUNDS
    for r in (r for b in stored.where("bucket >= 0").toArrow().to_batches() for r in p._rows(b)):
        pairs = p._pairs_of(r, model)
        context, n, hot = pairs.context, pairs.n, pairs.hot
        t, c0, t0 = model.sampled(pairs, k, r["bucket"])
        for i, customers, tables in zip(pairs.cold, pairs.customers, pairs.tables):
            x = cold[r["cold"][-1 - context[i]]]
            x[:] = customers, tables, x[2] + n[i], x[3] + t[i]
        real = (hot < 0) & (c0 > 0)
        root += model.root_p(c0, t0, k)[real].sum()
        at = (context >= 0) & (n > 0)
        by_context += np.bincount(context[at], (n - model.discount * t)[at], len(by_context))
    root += model.hot_p[k].sum() + model.root_p(0, 0, k)
    assert math.isclose(root, 1, rel_tol=1e-9)
    by_context[model.hot_contexts] += (hot_n - discounted(model, hot_n, k)).sum(axis=1)
    total = (by_context + p.STRENGTH + model.discount * model.tables[k]) / (p.STRENGTH + model.customers)
    assert len(cold) > 20 and np.allclose([x[:2] for x in cold.values()], [x[2:] for x in cold.values()], rtol=1e-5)
    assert np.allclose(total[by_context > 0], 1) and (by_context == 0).sum() == 1  # no word follows an end


def discounted(model, hot_n, k):
    """discount times tables of the hot pairs, from their probabilities."""
    n, t = model.customers[model.hot_contexts][:, None], model.tables[k][model.hot_contexts][:, None]
    return hot_n + (p.STRENGTH + model.discount * t) * model.hot_p[k] - 10.0**model.hot_pairs * (p.STRENGTH + n)


def test_tables_follow_their_distribution():
    """Against sums over all partitions of the customers, and the restaurant's rule for the customers beyond ``EXACT``."""
    rng = np.random.default_rng(1)
    for n, others, prob, d, s in ((1, 3, 0.1, 0.5, 1.0), (2, 3, 0.2, 0.5, 1.0), (5, 0, 0.7, 0.3, 2.0), (9, 40, 0.05, 0.8, 1.0), (9, 4, 0.5, 0.0, 1.0)):
        weights = np.zeros(n + 1)

        def walk(tables, left):  # noqa: B023
            if not left:
                w = np.prod([np.prod([j - d for j in range(1, k)]) for k in tables]) * np.prod([(s + d * (others + i)) * prob for i in range(len(tables))])  # noqa: B023
                weights[len(tables)] += w  # noqa: B023
                return
            for i in range(len(tables)):
                walk([*tables[:i], tables[i] + 1, *tables[i + 1 :]], left - 1)
            walk([*tables, 1], left - 1)

        walk([1], n - 1)
        want = weights / weights.sum()
        got = np.bincount(p.draw(np.full(20_000, n), np.full(20_000, others), np.full(20_000, prob), d, s, rng).astype(int), minlength=n + 1) / 20_000
        assert np.abs(got - want).max() < 0.02, (n, got, want)
    big = p.draw(np.full(500, 3000), np.full(500, 10_000), np.full(500, 1e-3), 0.5, 1.0, rng)

    r = random.Random(2)
    start = p.draw(np.full(500, p.EXACT), np.full(500, 10_000), np.full(500, 1e-3), 0.5, 1.0, rng)

    def one_by_one(t):
        for k in range(p.EXACT, 3000):
            a = (1.0 + 0.5 * (10_000 + t)) * 1e-3
            t += r.random() < a / (a + k - 0.5 * t)
        return t

    want = np.mean([one_by_one(t) for t in start])
    assert abs(big.mean() / want - 1) < 0.04, (big.mean(), want)
    # Both ways of weighing give the same law: a huge number of other tables needs logarithms.
    for n, others, prob in ((100, 200, 0.05), (128, 1e4, 0.5), (40, 1e5, 1e-4)):
        weights = np.log((1.0 + 0.6 * (others + np.arange(n))) * prob).cumsum() + p._stirling(0.6)[n, 1 : n + 1]
        weights = np.exp(weights - weights.max())
        got = p.draw(np.full(20_000, n), np.full(20_000, others), np.full(20_000, prob), 0.6, 1.0, rng)
        assert abs(got.mean() / (weights @ np.arange(1, n + 1) / weights.sum()) - 1) < 0.01
    zero = p.draw(np.array([0, 1, 200]), np.zeros(3), np.full(3, 0.1), 0.5, 1.0, rng)
    assert zero[:2].tolist() == [0, 1] and 1 <= zero[2] <= 200


def test_pairs_that_occur_once_are_not_drawn(monkeypatch):
    """They have one table always; of the others each sweep draws all."""
    r = np.random.default_rng(3)
    model = p.Model(np.arange(50), np.full(51, 100), np.zeros(50, bool), 5000, 50, discount=0.5, root_discount=0.3)
    model.tables, model.root, model.hot_p = [np.full(51, 20.0)], [(1000.0, 40.0)], [np.empty(0)]
    none, n = np.empty(0, np.int64), r.integers(0, 5, 1000)
    n[:3] = 1, p.EXACT, 3000
    pairs = p.Pairs(np.repeat(np.arange(40), 25), np.tile(np.arange(25), 40), n, np.full(40, -1), none, none, none, none)
    drawn, draw = [], p.draw

    def seen(n, others, prob, discount, *rest):
        drawn.append((discount, n))
        return draw(n, others, prob, discount, *rest)

    monkeypatch.setattr(p, "draw", seen)
    t, c0, t0 = model.sampled(pairs, 1, 7)
    of_pairs = [x for d, x in drawn if d == 0.5]
    assert len(of_pairs) == p.SWEEPS and all(x.tolist() == n[n > 1].tolist() for x in of_pairs)
    assert (t[n < 2] == n[n < 2]).all() and (t[n > 1] >= 1).all() and (t <= n).all() and t[n > 1].max() > 1
    assert np.allclose(c0, np.bincount(pairs.word, t)) and (t0 <= c0).all()


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_words_as_read(monkeypatch, block):
    monkeypatch.setattr(linear, "BLOCK", block)
    monkeypatch.setattr(p, "_TEXTS", 7)
    texts = [b"", b" \t\r\n\x0b\x0c", b"a", b" The the\tTHE ", b"x\0y \0", b"\x1c \x85 \xc2\xa0b \xff\xfe", "Ä ä É".encode(), b"a" * 300 + b" b", b"", b"w " * 200 + b"end", b"\n", b"a"]
    got = {}
    for first, size, hashes, number, owner in p._read(texts):
        assert size <= 7 and len(set(hashes.tolist())) == len(hashes)
        for i in range(size):
            got[first + i] = hashes[number[owner == i]].view(np.uint64).tolist()
        assert (np.diff(owner) >= 0).all()
    assert got == {i: [xxh3_64_intdigest(w) for w in [*t.lower().split(), p.END]] for i, t in enumerate(texts)}


def test_long_texts_keep_their_words(spark, monkeypatch):
    long = [(1, "a" * (1 << 20) + "bcd efg"), (2, "\t".join(f"w{i % 5000}" for i in range(300_000))), (3, "x" * (3 << 20)), (4, "a " * (1 << 19) + "b"), (5, "a" * ((1 << 20) - 1) + " b\r\x0bc"), (6, "")]
    docs = spark.createDataFrame(long, "doc_id long, text string")
    got = {x.id: x for x in p.score(docs, fold("id", 10) != 0).collect()}
    assert [got[i].n_tokens for i in range(1, 7)] == [len(t.split()) + 1 for _, t in long] == [3, 300_001, 2, (1 << 19) + 2, 4, 1]
    assert got[1].train_tokens == sum(got[i].n_tokens for i in got if trained(i))
    monkeypatch.setattr(linear, "BLOCK", 100)
    assert {x.id: x.n_tokens for x in p.score(docs, fold("id", 10) != 0).collect()} == {i: x.n_tokens for i, x in got.items()}


def test_a_text_that_occurs_twice_scores_higher(spark):
    r = random.Random(4)
    say = lambda: " ".join(f"word{r.randrange(3000)}" for _ in range(80))
    rows = [(i, say()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: x.score / x.n_tokens for x in p.score(docs, fold("id", 10) >= 0).collect()}
    twice, once = [got[i] for i in range(40)], [got[i] for i in range(40, 400)]
    assert min(twice) > max(once)


def test_empty_tables_and_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    x = p.score(docs, fold("id", 10) < 0).first()
    assert (x.n_tokens, x.n_known, x.train_tokens) == (3, 0, 0) and x.score <= 0
    assert p.score(docs.where("false"), fold("id", 10) != 0).count() == 0
    assert p.score(docs.unionByName(docs).unionByName(docs.select("doc_id", F.lit("a").alias("text"))), fold("id", 10) != 0).count() == 3
