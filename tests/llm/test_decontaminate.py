import random
import re

from inkproof.llm import decontaminate


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = set()
    for key, text in items:
        w = words(text)
        n = min(13, len(w))
        windows |= {(key, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    out = {}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, part in windows:
            for i in range(len(w) - len(part) + 1):
                if tuple(w[i : i + len(part)]) == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(item)
        out[key] = (len(w), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def data():
    r = random.Random(4)
    vocabulary = ["alpha", "Été", "x1", "of", "the", "q", "über", "9"]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    long = [say(40) for _ in range(5)]
    items = [(i, t) for i, t in enumerate(long)] + [(10, "Two Words"), (11, "..."), (12, None), (13, "solo"), (14, long[0][:90]), (15, long[1])]
    docs = [(0, None), (1, ""), (2, "!?"), (3, "two--words and solo"), (4, say(300)), (5, say(20) + " " + long[0].upper() + ", " + say(900)), (6, long[1].replace(" ", "\n") + say(5))]
    docs += [(7, say(2000) + " " + " ".join(long)), (8, "été ÉTÉ Été"), (9, " ".join(long[2].split()[3:17]))]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = data()
    want = brute(docs, items)
    d = spark.createDataFrame([(*x, 1, "a") for x in docs], "doc_id long, text string, w int, window string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1_000_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        got = {x.id: (x.n_words, x.n_hit, x.n_items, x["items"], x.contaminated) for x in decontaminate.contamination(d, b).collect()}
        assert got == want
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns
    assert {x.doc_id for x in kept.collect()} == {k for k, v in want.items() if not v[-1]}


def test_empty_tables_null_ids_and_repeated_rows(spark):
    docs, items = data()
    d = spark.createDataFrame([(None, docs[6][1]), (3, "solo"), (3, "solo")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.id or 0, x.contaminated) for x in decontaminate.contamination(d, b).collect())
    assert got == [(0, True), (3, True), (3, True)]
    assert decontaminate.decontaminate(d, b).count() == 0
    assert decontaminate.contamination(d, b.where("false")).where("n_hit = 0").count() == 3
    assert decontaminate.contamination(d.where("false"), b).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_themselves(spark):
    docs, items = data()
    texts = [docs[6][1], "a b c", docs[6][1], None, "solo", docs[6][1] + " and more"]
    b = spark.createDataFrame(items, "item_id long, text string")
    for key in (1, None):
        d = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string")
        want = sorted(brute([(0, t)], items)[0] for t in texts)
        assert sorted((x.n_words, x.n_hit, x.n_items, x["items"], x.contaminated) for x in decontaminate.contamination(d, b).collect()) == want
        assert sorted(x.text or "" for x in decontaminate.decontaminate(d, b).collect()) == ["", "a b c"]
