import random
import tracemalloc

import numpy as np
import pyarrow as pa

from inkproof.llm import language
from inkproof.llm.common import fold


def brute_phrases(sample, text):
    at, n = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at : at + size + 1] in s for s in sample):
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_of_whole_texts_against_brute_force(monkeypatch):
    r = random.Random(1)
    for trial in range(60):
        monkeypatch.setattr(language, "LANE", r.choice([1, 2, 3, 7, 64]))
        monkeypatch.setattr(language, "PART", r.choice([5, 40, 1 << 20]))
        say = lambda n, letters="abcé日": " " + " ".join("".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(n)) + " "
        samples = {"x": [say(15), say(2)], "y": [say(4)], "z": [" a "]}
        samples["x"].append(" " + "ab" * 20 + " ")
        model = language.Model(samples)
        texts = [say(r.randint(1, 40), "abcéd日") for _ in range(8)] + [samples["x"][0] * 3, " " + "ab" * 60 + " ", " d ", " " + "a" * 50 + " "]
        names, scores = language.judge(pa.array([*texts, None, "12"]), model)
        assert names[-2:] == ["und", "und"] and scores[-2:].tolist() == [0.0, 0.0]
        for t, name, score in zip(map(" {} ".format, (" ".join(t.split()) for t in texts)), names, scores):
            letters = len(t.replace(" ", ""))
            bits = [brute_phrases(samples[k], t) * np.log2(max(2, sum(map(len, samples[k])))) / letters for k in "xyz"]
            assert name == "xyz"[int(np.argmin(bits))], (trial, t)
            assert abs(score - 1 / sum(np.exp(min(bits) - b) for b in bits)) < 1e-9


def test_ties_go_to_the_first_language():
    model = language.Model({"b": [" ab "], "a": [" ab "], "c": [" xy "]})
    assert language.judge(pa.array(["ab", "q", "xy"]), model)[0] == ["a", "a", "c"]


def test_scripts_of_many_letters_need_little_memory():
    r = random.Random(3)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    rows = [{"label": f"l{k:03}", "text": "".join(r.choices(han[k * 20 :], k=900)), "cut": False} for k in range(40) for _ in range(2)]
    tracemalloc.start()
    model = language.learn(rows)
    names, _ = language.judge(pa.array([r["text"][100:200] for r in rows]), model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == [r["label"] for r in rows] and len(model.names) == 40
    assert peak < 200e6 and len(model.owner) < 5e6


def test_languages_are_told_apart(spark):
    r = random.Random(2)
    stems = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["été", "ois", "que", "aux"]}
    rows = []
    for i in range(300):
        lang = r.choice(list(stems))
        words = ["".join(r.choices(stems[lang], k=3)) for _ in range(30)]
        rows.append((i, " ".join(words).capitalize() + ".", lang, 0.5))
    want = {i: k for i, _, k, _ in rows}
    odd = [(900, None, "aa", 0.0), (901, "", None, 0.0), (902, "12 _ +-", "bb", 0.0), (903, "X" * 500, None, 0.0), (None, rows[0][1], None, 0.0), (0, *rows[0][1:])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    got = [tuple(x) for x in language.identify(docs, fold("id", 5) != 0).collect()]
    assert len(got) == len(rows + odd)
    by = {i: (k, s) for i, k, s in got}
    assert [by[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[None][0] == want[0] and by[903][0] in stems
    assert sum(by[i][0] == k for i, k in want.items()) >= 0.99 * len(want)
    assert all(0 <= s <= 1 for _, s in by.values())
    assert {x.lang_pred for x in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} == {"und"}
    assert language.identify(docs.where("false")).count() == 0


def test_long_texts_are_learned_from_and_every_language_is_kept(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 20)}" for k in range(3000 if i % 2 else 5)), f"l{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.id: x.lang_pred for x in language.identify(docs).collect()}
    assert sum(got[i] == f"l{i}" for i in range(300)) >= 290
    found = language.sample(docs, None, "doc_id", "text", "lang").collect()
    assert len(found) == 300 and max(len(x.text) for x in found) == language.STRETCH
