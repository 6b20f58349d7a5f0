import random

import numpy as np

from inkproof.llm import substring

from . import brute


def word(r):
    return "".join(r.choices("abcdefgéhij", k=r.randint(2, 9)))


def say(r, n):
    return " ".join(word(r) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def test_passages_stay_in_the_first_document_only(spark):
    r = random.Random(8)
    passages = [say(r, 51) for _ in range(20)]
    texts = {i: say(r, 200) for i in range(60)}
    holders = {}
    for k, p in enumerate(passages):
        for i in r.sample(range(60), 5):
            holders.setdefault(k, []).append(i)
            words = texts[i].split(" ")
            at = r.randrange(len(words))
            texts[i] = " ".join([*words[:at], p, *words[at:]])
    whole = {k: [i for i in h if passages[k] in texts[i]] for k, h in holders.items()}
    texts |= {100: None, 101: "", 102: say(r, 80)}
    rows = [(i, t, "x", 7) for i, t in texts.items()] + [(None, passages[0], "n", 7), (102, texts[102], "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, no string, digest int")
    out = substring.deduplicate(docs)
    assert out.columns == [*docs.columns, "_n_cut"]
    found = out.collect()
    got = {x.doc_id: x.text for x in found if x.no == "x"}
    assert got[100] is None and got[101] == "" and got[102] == texts[102]
    assert [x.text for x in found if x.no in "ny"] in ([passages[0], texts[102]], [texts[102], passages[0]])
    for k, h in whole.items():
        p = passages[k]
        assert p in got[min(h)] or sum(passages[j] in texts[min(h)] for j in whole) > 1
        for i in sorted(h)[1:]:
            assert p not in got[i]
            left = [w for w in p.split() if len(w) > 6 and w in got[i]]
            assert len(left) <= 22, (k, i, len(left))
    lost = sum(len(texts[i].split()) - len(got[i].split()) for i in range(60))
    assert 0.6 * 51 * 4 * 20 < lost < 51 * 4 * 20 + 60


def test_texts_chunks_and_windows_against_brute_force(spark):
    """Boundaries, windows, owners and the cut texts, from the definitions alone; long stretches without boundaries included."""
    r = random.Random(11)
    parts = [say(r, r.choice([3, 12, 25, 60])) for _ in range(12)] + ["no " * 70, "la li " * 50, say(r, 400)]
    texts = [(i, " ".join(r.choice([*parts, say(r, 15)]) for _ in range(6))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, " \n\t "), (103, "é" * 300), (5, texts[9][1]), (None, texts[3][1]), (104, texts[20][1]), (105, " " + texts[20][1] + "\n")]
    for t in [t for _, t in texts if t] + ["no " * 100, "x\0y z " * 30]:
        _, number, start, words, _ = substring.chunks_of([t.encode()])
        want = brute.chunks(t.encode())
        assert [(int(a), int(n)) for a, n in zip(start, words)] == [(c[0], c[2]) for c in want]
    rows = [(i, t, f"row {k}") for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    want = {f"row {k}": (t, n) for k, (_, t, n) in enumerate(brute.substring_dedup(texts))}
    got = {x.key: (x.text, x._n_cut) for x in substring.deduplicate(docs).collect()}
    assert got == want and sum(n > 0 for _, n in want.values()) > 20
    kept = {x.key for x in substring.deduplicate(docs, count_col=None, keep_emptied=False).collect()}
    emptied = {k for k, (t, n) in want.items() if n and not t.strip()}
    assert kept == set(want) - emptied and emptied


def test_one_insertion_moves_few_chunks():
    r = random.Random(7)
    text = say(r, 3000)
    words = text.split(" ")
    moved = " ".join([*words[:1000], "inserted", *words[1000:]])
    digests = [set(substring.chunks_of([t.encode()])[4].tolist()) for t in (text, moved)]
    assert len(digests[0] - digests[1]) <= 2 and len(digests[1] - digests[0]) <= 3


def test_chunks_cover_the_text_and_do_not_depend_on_neighbours():
    r = random.Random(3)
    texts = [say(r, n).encode() for n in (0, 1, 5, 400)] + [b"", b" \n", b"x" * 5000, b"a " * 3000, "é".encode() * 10]
    owner, number, start, words, digest = substring.chunks_of(texts)
    for i, t in enumerate(texts):
        mine = owner == i
        assert words[mine].sum() == len(t.split())
        assert words[mine].max(initial=0) <= substring.MOST_WORDS
        alone = substring.chunks_of([t])
        assert alone[2].tolist() == start[mine].tolist() and alone[4].tolist() == digest[mine].tolist()
        every = [{"no": int(k), "digest": int(d)} for k, d in zip(number[mine], digest[mine])]
        assert substring.cut_out(t, every).strip() == b""


def test_empty_table(spark):
    assert substring.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_words_in_a_row_of_one_earlier_document_are_cut(spark):
    r = random.Random(5)
    texts = {i: say(r, 600) for i in (0, 1)}
    parts = []
    for i in (0, 1):
        t = texts[i].encode()
        start = [*substring.chunks_of([t])[2].tolist(), len(t)]
        parts += [t[a:b].decode() for a, b in zip(start, start[1:]) if b - a > 30 and len(t[a:b].split()) < 15]
    texts |= {k: "".join(r.sample(parts, len(parts))) for k in (2, 3)}
    texts |= {4: "no " * 3, 5: "so it is no no " + "no " * 60, 6: "so it is no no " + "no " * 60, 7: say(r, 40) + " " + texts[1][600:1100]}
    texts |= {k: texts[1][600:1100] + " " + say(r, 30) for k in range(8, 30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def shared(i):
        rows = lambda t: [tuple(w[a : a + 20]) for w in [t.split()] for a in range(len(w) - 19)]
        earlier = {w for j in range(i) for w in rows(texts[j])}
        return {a + k for a, w in enumerate(rows(texts[i])) if w in earlier for k in range(20)}

    for n in (1, 3, 30):  # across batches and within one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
        got = {x.doc_id: (x.text, x._n_cut) for x in substring.deduplicate(docs).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for i, t in texts.items():
            lost = len(t.split()) - len(got[i][0].split())
            assert lost <= len(shared(i)) and (lost > 0) == (got[i][1] > 0), i
            assert lost >= len(shared(i)) - 2 * substring.MOST_WORDS, i
        assert [got[i][0] for i in range(6)] == [texts[i] for i in range(6)] and len(got[6][0]) < len(texts[6]) / 2
        assert all(len(got[k][0].split()) < len(texts[k].split()) - 20 for k in range(7, 30))


def test_windows_within_a_repeat_cover_it():
    r = random.Random(2)
    for _ in range(30):
        words = [r.choice([1, 2, 4, 9, 19, 20, 32]) for _ in range(r.randint(1, 12))]
        each = np.array(words)
        first, n, _ = substring.windows_of(each * 0, each, each)
        found = list(zip(first.tolist(), n.tolist()))
        assert len(set(found)) == len(found)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                inside = {k for i, m in found if a <= i and i + m <= b for k in range(i, i + m)}
                assert inside == (set(range(a, b)) if sum(words[a:b]) >= substring.LEAST_WORDS else set())
