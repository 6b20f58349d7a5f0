import random

import numpy as np
from xxhash import xxh64_intdigest

from inkproof.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in fps:
        for e in fps:
            if e < d and (fps[d] ^ fps[e]).bit_count() <= 2:
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in fps}


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, fp string, component_id int")
    got = {r.id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    assert got == {i: (fps[i], want[i]) for i in texts}


def test_copies_near_copies_nulls_and_empty_texts(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdeÉfghi", k=4))
    base = [word() for _ in range(400)]
    texts = {0: None, 1: "", 2: " \t\n", 3: "One", 4: "one two", 5: "one TWO", 6: "a b c", 7: "a b c d"}
    for i in range(8, 60):
        words = list(base)
        words[r.randrange(400)] = word()
        texts[i] = " ".join(words)
    texts |= {60: texts[8], 61: texts[8].replace(" ", "\n"), 62: " ".join(word() for _ in range(90))}
    check(spark, texts)


def test_large_buckets_without_pairs_link_the_same(spark, monkeypatch):
    r = np.random.default_rng(3)
    center = int(r.integers(1 << 62))
    fps = {center}
    for f in [center] * 60:
        for _ in range(4):
            f ^= 1 << int(r.integers(64))
            fps.add(f)
    fps = dict(enumerate(sorted(fps)))
    want = brute_components(fps)
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, d) for d, f in fps.items()], "fp long, rep long")
    for limit in (64, 1):
        monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
        found = {r.node: r.component for r in simhash.connected_components(simhash.links(reps)).collect()}
        assert {d: found.get(d, d) for d in fps} == want


def test_every_two_bits_share_a_table():
    for i in range(64):
        for j in range(64):
            assert any(m >> i & 1 and m >> j & 1 for m in simhash.BLANKS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.deduplicate(docs).columns == ["doc_id", "text"]


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e", 1), (3, "a b c d e", 2), (3, "a b c d e", 2), (9, None, 3), (None, "z", 4), (None, "z", 4), (7, "quite another text here", 5)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, component_id int"))
    assert sorted((r.doc_id or 0, r.component_id) for r in kept.collect()) == [(0, 4), (0, 4), (3, 2), (7, 5), (9, 3)]


def test_one_row_of_each_class_stays_and_other_texts_of_an_id_too(spark):
    r = random.Random(3)
    say = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(80))
    a, b, c, d = (say() for _ in range(4))
    rows = [(5, a), (3, a), (9, a + "\n"), (7, b), (7, b), (7, c), (2, c), (None, a), (None, a), (4, d), (8, None), (6, ""), (10, " ")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _own int").repartition(3)
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=repr)
    assert got == sorted([(3, a), (7, b), (2, c), (None, a), (None, a), (4, d), (6, "")], key=repr)
    assert simhash.deduplicate(docs.where("false")).count() == 0
