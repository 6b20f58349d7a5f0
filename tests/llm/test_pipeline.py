import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from corpus_pipeline import STAGES, run
from inkproof.llm import quality

from . import brute
from .test_classifiers import brute_counts
from .test_decontaminate import brute as brute_contamination
from .test_simhash import brute_components, brute_fingerprint


def test_run_equals_the_stages_in_plain_python(spark, tmp_path):
    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choices("abcdeéfghij", k=r.randint(2, 8))) for _ in range(n))
    shared, bench = say(60), [say(30), say(16), "two words"]
    rows = {i: say(r.randint(5, 90)) for i in range(60)}
    for i in (3, 8, 20):
        rows[i] = say(40) + " " + shared + " " + say(30)
    rows |= {22: say(20) + " " + bench[0] + " " + say(10), 23: say(900) + " " + bench[1], 24: "so two words are here with some more to be no short text at all"}
    rows |= {30: rows[10], 31: rows[10].upper(), 32: None, 33: "", 34: "a b c d e f " * 9, 35: shared, 36: say(3)}
    bad = {i: say(30) + " | $$$ ###" * 20 for i in range(100, 130)}
    rows |= bad
    labels = [(i, int(i not in bad), 0) for i in rows if i % 3]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.model_for(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))  # its probability is tested by itself
    good = {}
    for i, t in rows.items():
        n, _, _, _, repeated = brute_counts(t)
        if n >= 10 and 100 * repeated <= 20 * n and quality.probabilities([t.encode()], model)[0] >= quality.LEAST_PROBABILITY:
            good[i] = t
    assert not set(good) & set(bad) and len(good) > 40
    of = brute_components({i: brute_fingerprint(t) for i, t in good.items()})
    unlike = [(i, t) for i, t in good.items() if of[i] == i]
    cut = [(i, t) for i, t, n in brute.substring_dedup(unlike) if not (n and not t.strip())]
    dirty = brute_contamination(cut, list(enumerate(bench)))
    clean = {i: t for i, t in cut if not dirty[i][4]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in clean.items():
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        first = (n - 1) % 1024 + 1
        want.update((i, k, size) for k, size in enumerate([first, *[1024] * ((n - first) // 1024)]))
    got = run(spark, str(tmp_path)).collect()
    assert Counter((p.doc_id, p.piece, p.length) for p in got) == want
    filled = defaultdict(int)
    for p in got:
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 1024 and len(filled) <= -(-sum(filled.values()) // 1024) + 1
    assert len(unlike) < len(good) and len(clean) < len(cut) and re.search(r"two words", rows[24])


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    base = "Many words about rivers and stones make a text that nobody needs to read in full today"
    rows = []
    for i in range(40):
        words = [f"{w}{i * 7 % 23}" for w in base.split()] + [f"tail{i}x{j}" for j in range(60)]
        rows.append((i, " ".join(words), "en", "s", 1))
    shared = " ".join(f"passage{j}" for j in range(60))
    bench = " ".join(f"question{j}" for j in range(20))
    rows[5] = (5, rows[5][1] + " " + shared, "en", "s", 1)
    rows[9] = (9, rows[9][1] + " " + shared, "en", "s", 1)
    rows[11] = (11, rows[11][1] + " " + bench, "en", "s", 1)
    rows += [(50, rows[3][1], "en", "s", 1), (51, None, "en", "s", 1), (52, "too short", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out
        ids.append({x.doc_id for x in docs.collect()})
    all_ids = set(range(40))
    assert ids == [all_ids | {50}, all_ids, all_ids, all_ids - {11}]
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert shared in texts[5] and shared not in texts[9] and texts[20] == rows[20][1]
    pieces = run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == ids[-1]
