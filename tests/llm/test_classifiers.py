import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from inkproof.llm import linear, quality, toxicity
from inkproof.llm.common import fold
from inkproof.llm.linear import blocks, char_grams, word_grams


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in range(i, i + 5)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def labelled(n, seed=0):
    r = random.Random(seed)
    good = ["the", "river", "été", "stone", "walk", "under", "morning", "über", "light", "table"]
    rows, labels = [], []
    for i in range(n):
        words = r.choices(good, k=r.randint(12, 60))
        toxic, bad = i % 7 == 3, i % 5 == 2
        if toxic:
            words[r.randrange(len(words))] = r.choice(["vilefool", "Nastygit"])
        text = " | ".join(words) + " ***" if bad else " ".join(words)
        rows.append((i, text, "x", 1.5))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


ODD = [(9001, None, "x", 0.0), (9002, "", "x", 0.0), (9003, "\n \t", "x", 0.0), (9004, "a b c d e f g a b c d e x\na b\na b\n\n\n", "x", 0.0), (9005, "q w é " * 4000, "x", 0.0), (None, "no id at all", "x", 0.0)]


def test_counts_and_verdicts(spark):
    rows, labels = labelled(400)
    docs, known = frames(spark, rows + ODD, labels + [(None, 1, 1), (5, None, None)])
    got = {x.id: x for x in quality.judge(docs, quality.model_for(docs, known)).collect()}
    assert len(got) == len(rows) + len(ODD)
    right = 0
    for key, text, *_ in rows + ODD:
        x, want = got[key], brute_counts(text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, key
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (x.base_failed and x.kept) and 0 <= x.probability <= 1
        right += key is not None and key < 9000 and x.kept == (key % 5 != 2)
    assert right >= 0.98 * len(rows)
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {k for k, x in got.items() if x.kept}


def test_toxic_texts_of_held_out_rows_are_found(spark):
    rows, labels = labelled(600)
    docs, known = frames(spark, rows + ODD, labels)
    got = {x.id: x.score for x in toxicity.toxicity(docs, known, fold("id", 5) != 0).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 7 == 3) for i, *_ in rows]) >= 0.98


def test_without_labels_or_rows(spark):
    rows, labels = labelled(30)
    docs, known = frames(spark, rows, labels)
    none = known.where("false")
    assert {x.score for x in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert all(x.kept != x.base_failed for x in quality.judge(docs, quality.model_for(docs, none)).collect())
    assert toxicity.toxicity(docs.where("false"), known).count() == 0
    assert quality.keep_good(docs.where("false"), known).count() == 0


def grams_of(texts, grams):
    out = [[] for _ in texts]
    for data, owner, seen in blocks(texts):
        for at, f in grams(data, seen):
            for i, x in zip(owner[at], f):
                out[i].append(int(x))
    return [sorted(x) for x in out]


KINDS = (lambda d, seen: char_grams(d, (2, 4), 20, seen), lambda d, seen: word_grams(d, 20, seen))


def test_features_do_not_depend_on_the_batch():
    texts = [b"The cat  sat", b"", b"on", "é x".encode() * 3]
    for grams in KINDS:
        assert grams_of(texts, grams) == [grams_of([t], grams)[0] for t in texts]


def test_features_do_not_depend_on_the_block(monkeypatch):
    r = random.Random(4)
    say = lambda n: b"".join(r.choice([b"a", b"Bc", b"def" * r.choice([1, 1, 9]), b"x" * 40]) + r.choice([b" ", b"\t", b"\n ", b" " * 30]) for _ in range(n))
    texts = [say(n) for n in (1, 40, 300, 300)] + [b"x" * 500, b" " * 500, b"a" + b" " * 300 + b"b c", b"w" * 63 + b" v", b"w" * 64 + b" v", b"w" * 65 + b"\tv"]
    for grams in KINDS:
        monkeypatch.setattr(linear, "BLOCK", 1 << 20)
        want = grams_of(texts, grams)
        for size in (64, 65, 100, 128):
            monkeypatch.setattr(linear, "BLOCK", size)
            assert grams_of(texts, grams) == want, size
            assert all(b"".join(linear.segments(t)) == t and sum(len(x.split()) for x in linear.segments(t)) == len(t.split()) for t in texts)


def brute_grams(text, sizes):
    t = re.sub(r"[\t\n\x0b\x0c\r]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(t[i : i + n] for n in sizes for i in range(len(t) - n + 1)), len(t)


def toxic_feature(gram):
    (data, owner, seen), = blocks([gram.encode()])
    chars, *_ = linear.characters(data, owner, seen)
    return int(next(iter(char_grams(chars, (len(gram),), toxicity.BITS)))[1][0])


def test_characters_are_code_points(monkeypatch):
    texts = ["aé日🙂b" * 9 + " x", "", "ünïcödé words and 🙂🙂 more " * 5, "plain"]
    for size in (1 << 20, 64, 100):
        monkeypatch.setattr(linear, "BLOCK", size)
        row, feature, value = toxicity._values([t.encode() for t in texts])
        got = {(int(r), int(f)): float(v) for r, f, v in zip(row, feature, value)}
        want = {}
        for i, t in enumerate(texts):
            grams, n = brute_grams(t, toxicity.SIZES)
            for g, c in grams.items():
                want[i, toxic_feature(g)] = math.log1p(1000 * c / n)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_toxicity_against_brute_force(spark):
    """The same model over the n-grams themselves (no hashing): ratios, fit and score."""
    rows, labels = labelled(150)
    docs, known = frames(spark, rows + [(9005, "NASTYGIT " + "river été " * 200, "x", 0.0), (9006, "", "x", 0.0)], labels)
    got = {x.id: x.score for x in toxicity.toxicity(docs, known).collect()}
    tox = {i: t for i, _, t in labels}
    shares = {i: {g: math.log1p(1000 * c / n) for g, c in grams.items()} for i, (grams, n) in ((i, brute_grams(t, toxicity.SIZES)) for i, t, *_ in rows)}
    one, zero, texts = Counter(), Counter(), Counter()
    for i, y in tox.items():
        for g, v in shares[i].items():
            (one if y else zero)[g] += v
            texts[g] += 1
    dims = 1 << toxicity.BITS  # each n-gram has one of so many smoothed sums, most of them empty
    ratio = {g: math.log((one[g] + 1) / (sum(one.values()) + dims)) - math.log((zero[g] + 1) / (sum(zero.values()) + dims)) for g in texts}
    ratio = {g: x for g, x in ratio.items() if abs(x) >= toxicity.LEAST_RATIO and texts[g] >= toxicity.LEAST_TEXTS}
    names, ids = sorted(ratio), sorted(tox)

    def scaled(i):
        v = np.array([ratio[g] * shares[i].get(g, 0.0) for g in names])
        return v / max(np.linalg.norm(v), 1e-12)

    x, y = np.array([scaled(i) for i in ids]), np.array([tox[i] for i in ids], float)
    w, b, w8 = np.zeros(len(names)), 0.0, np.full(len(ids), 1 / len(ids))
    for _ in range(20_000):  # plain proximal gradient steps
        error = w8 * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w = w - 2 * (x.T @ error + toxicity.L2 * w)
        w, b = np.sign(w) * np.maximum(np.abs(w) - 2 * toxicity.L1, 0), b - 2 * error.sum()
    loss = lambda w, b: (w8 * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w + b))).sum() + toxicity.L1 * np.abs(w).sum() + toxicity.L2 / 2 * (w * w).sum()
    sample = [{"id": i, "label": tox[i], "share": sum(tox[j] == tox[i] for j in tox) / len(tox), "text": dict((k, t) for k, t, *_ in rows)[i].encode()} for i in ids]
    features, ratios, weights, bias, slope, intercept = toxicity.learn(sample)
    assert set(features.tolist()) == {toxic_feature(g) for g in names}
    at = {int(f): k for k, f in enumerate(features)}
    assert all(math.isclose(ratios[at[toxic_feature(g)]], ratio[g], rel_tol=1e-4) for g in names)
    mine = np.array([weights[at[toxic_feature(g)]] for g in names])
    assert loss(mine, bias) <= loss(w, b) * 1.1 + 1e-4  # stopped early
    for i in (*ids, 9005, 9006):
        v = scaled(i) if i in shares else None
        raw = (float(v @ mine) if v is not None else 0.0) + bias
        if i != 9005:
            assert math.isclose(got[i], 1 / (1 + math.exp(-(slope * raw + intercept))), abs_tol=2e-3), i
    assert got[9005] > got[9006]


def test_toxic_stems_that_other_texts_use_too(spark):
    """In four made-up languages toxic texts use a stem more often than others do, in many shapes."""
    r = random.Random(7)
    stems = {"a": "réeuf", "b": "achlos", "c": "groñad", "d": "nasty"}
    words = {k: ["".join(r.choice("abcdeéfgñhilmoprstu") for _ in range(r.randint(2, 9))) for _ in range(300)] for k in stems}
    rows, labels = [], []
    for i in range(1200):
        lang, toxic = "abcd"[i % 4], i % 5 == 0
        n, share = r.randint(20, 120), 0.15 if toxic else 0.01
        text = " ".join(stems[lang] + r.choice(["", "e", "en", "ado", "s"]) if r.random() < share else r.choice(words[lang]) for _ in range(n))
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: x.score for x in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), fold("id", 5) != 0).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    for k in range(4):
        mine = [i for i in held if i % 4 == k]
        pairs = [(got[i] > got[j]) for i in mine if i % 5 == 0 for j in mine if j % 5]
        assert np.mean(pairs) >= 0.95, k
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) >= 0.93


def quality_shares(text):
    """The share of each word or pair among words and pairs, and of each n-gram of characters among n-grams, by hashed feature."""
    t, half = re.sub("[A-Z]", lambda m: m[0].lower(), text or ""), quality.BITS - 1
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [t[i : i + n] for n in quality.SIZES for i in range(len(t) - n + 1)]

    def one(gram, place):  # the hashed feature of one word (place 0), pair (1) or n-gram (None)
        ((data, owner, seen),) = blocks([gram.encode()])
        if place is None:
            chars, *_ = linear.characters(data, owner, seen)
            return (1 << half) + int(next(iter(char_grams(chars, (len(gram),), half)))[1][0])
        return int(list(word_grams(data, half))[place][1][0])

    said = [one(w, 0) for w in words] + [one(" ".join(p), 1) for p in zip(words, words[1:])]
    spelt = [one(g, None) for g in grams]
    return {f: n / len(group) for group in (said, spelt) for f, n in Counter(group).items()}


def test_quality_fit_against_brute_force():
    """Plain gradient steps over shares taken from the text itself, and the calibration's loss at its minimum."""
    rows, labels = labelled(90)
    texts, good = {i: t for i, t, *_ in rows}, {i: y for i, y, _ in labels}
    ids = sorted(good)
    y, apart = np.array([good[i] for i in ids], float), np.array([zlib.crc32(str(i).encode()) % 5 == 1 for i in ids])
    prior = np.where(y > 0, y.mean(), 1 - y.mean())
    weights, bias, slope, intercept = quality.learn([{"id": i, "label": good[i], "share": p, "text": texts[i].encode(), "calibration": bool(a)} for i, p, a in zip(ids, prior, apart)])
    shares = [quality_shares(texts[i]) for i in ids]
    names = sorted({f for s in shares for f in s})
    raw = np.array([[s.get(f, 0.0) for f in names] for s in shares])
    scale = 1 / np.sqrt(raw[~apart].sum(axis=0) / len(ids) + 1e-4)
    x, use = raw * scale, np.where(apart, 0.0, 1.0) / (~apart).sum()
    loss = lambda w, b: (use * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w + b))).sum() + quality.L1 * np.abs(w).sum() + quality.L2 / 2 * (w * w).sum()
    w, b = np.zeros(len(names)), 0.0
    step = 4 / ((x * x).sum(axis=1).max() + 2)
    for _ in range(400):
        error = use * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w = w - step * (x.T @ error + quality.L2 * w)
        w, b = np.sign(w) * np.maximum(np.abs(w) - step * quality.L1, 0), b - step * error.sum()
    mine = weights[names] / scale
    assert np.count_nonzero(weights) <= len(names)
    assert loss(mine, bias) <= loss(w, b) * 1.02 < 0.5 * loss(0 * w, 0.0)
    z, t = (raw @ weights[names] + bias)[apart], y[apart]
    wanted = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    each = (prior / np.bincount(y[apart].astype(int))[y.astype(int)])[apart]
    platt = lambda a, b: -(each * (wanted * np.log(p := 1 / (1 + np.exp(-(a * z + b)))) + (1 - wanted) * np.log(1 - p))).sum()
    least = platt(slope, intercept)
    assert all(least <= platt(slope * (1 + d), intercept + e) + 1e-3 for d in (-0.2, 0, 0.2) for e in (-0.3, 0, 0.3))


def test_counts_do_not_depend_on_the_step(monkeypatch):
    r = random.Random(8)
    say = lambda n: "".join(r.choice(["a", "bé", "cd#", "🙂x", "", "w" * 70, "x" * 64 + "yz"]) + r.choice([" ", " ", "\n", "\n \t\n"]) for _ in range(n))
    texts = ["", "a", "\n", " \n ", "a\na\n", "a b c d e f a b c d e", "a b c d e a b c d e a", "x" * 300] + [say(n) for n in range(1, 140, 4)]
    for step in (1, 2, 7, 64, 1 << 16):
        monkeypatch.setattr(quality, "STEP", step)
        for t in texts:
            assert quality.counts(t.encode()) == brute_counts(t), (step, t)


def test_counts_need_few_bytes_for_each_of_a_text():
    r = random.Random(9)
    words = [str(r.randrange(10**6)) for _ in range(400_000)]
    for text in (" ".join(words), " ".join(words[:1000] * 400), "ab\ncd é\n" * 300_000):
        text = text.encode()
        tracemalloc.start()
        quality.counts(text)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 24 * len(text.split()) + len(text) + 4_000_000  # of usual words under 5 bytes a byte


def test_quality_probability_against_brute_force(spark):
    rows, labels = labelled(120)
    docs, known = frames(spark, rows + ODD, labels)
    model = quality.model_for(docs, known)
    weights, bias, slope, intercept = model
    got = {x.id: x for x in quality.judge(docs, model).collect()}

    for key, text, *_ in (rows + ODD)[::7] + ODD:
        shares = quality_shares(text) if len(text or "") < 2000 else None
        if shares is None:
            continue
        raw = sum(weights[f] * x for f, x in shares.items()) + bias
        p = 1 / (1 + math.exp(-(slope * raw + intercept)))
        assert math.isclose(got[key].probability, p, abs_tol=1e-4), key
        assert got[key].kept == (not got[key].base_failed and got[key].probability >= quality.LEAST_PROBABILITY), key
