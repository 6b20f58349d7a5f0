"""Every operator and stage on nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkproof.llm import queries

CLASHING = ("id", "_id", "_ID2", "_cuts", "_bad", "_n_cut", "n", "fp", "rep", "label", "share", "order", "key", "hash", "window", "item", "host", "rule", "kept", "score", "digest", "words", "run")
LONG = " ".join(f"word{i % 5000}" for i in range(150_000))
TEXTS = [
    (1, "a short clean text about rivers, hills and the long way home past the old mill", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "de"),
    (5, LONG, "en"),
    (6, "x" * 200_000, None),
    (7, "ein Text auf Deutsch über Flüsse und Berge und den langen Weg nach Hause", "de"),
    (7, "ein Text auf Deutsch über Flüsse und Berge und den langen Weg nach Hause", "de"),
    (8, "ein Text auf Deutsch über Flüsse und Berge und den langen Weg nach Hause", "de"),
    (None, "a row that has no id but a text of more than ten words to be read in full", None),
    (None, None, None),
]


def write(spark, path, empty):
    extra = [F.lit(None if i % 2 else "x").cast("string").alias(c) for i, c in enumerate(CLASHING)]

    def save(name, rows, schema):
        df = spark.createDataFrame(rows, schema)
        taken = {c.lower() for c in df.columns}
        df = df.select("*", *(e for c, e in zip(CLASHING, extra) if c.lower() not in taken))
        (df.where("false") if empty else df).write.parquet(f"{path}/{name}.parquet")

    save("documents", [(i, t, lang, None, None) for i, t, lang in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    save("benchmark", [(1, "past the old mill"), (1, None), (None, "no such words here"), (2, ""), (2, "past the old mill")], "item_id long, text string")
    save("labels", [(1, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (5, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    save("pages", [(1, "http://a.com/x", None), (1, "http://a.com/x", None), (2, None, "<p>"), (None, "", ""), (3, "://" + "y" * 100_000, LONG)], "page_id long, url string, html string")
    save("embeddings", [(1, [0.5] * 32, 1), (1, [0.5] * 32, 1), (2, None, 1), (3, [None] + [0.1] * 31, None), (4, [float("nan")] * 32, 2), (None, [float(i) for i in range(32)], None), (5, [], 2), (6, [1e300] * 33, 3)], "vec_id long, embedding array<double>, label int")
    save("conversations", [(1, 0, "user", "hello"), (1, 0, "user", "hello"), (1, 1, None, None), (None, None, "assistant", LONG), (2, 5, "assistant", "")], "conv_id long, turn long, role string, text string")
    return str(path)


#: For queries over other tables than documents: the key, and the ids of the rows wanted; what an empty table gives.
OTHERS = {"op5": ("page_id", [1, 1, 2, None, 3], []), "op11": ("vec_id", [1, 1, None, 5, 6], []), "op12": ("conv_id", [1, None, 2, -1], [-1])}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), True)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_a_row_for_each_row(spark, odd, empty, name):
    query = queries.queries()[name]
    rows = query(spark, odd).collect()
    key, want, left = OTHERS.get(name.split("_")[0], ("doc_id", [i for i, _, _ in TEXTS], []))
    if name.startswith("op1_"):
        rows = [r for r in rows if r.piece == 0]
    order = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
    assert order(r[key] for r in rows) == order(want)
    none = query(spark, empty)
    assert [r[key] for r in none.collect()] == left and none.columns == query(spark, odd).columns


def test_stages(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.collect()]
        assert set(ids) <= {i for i, _, _ in TEXTS}, name
        if name == "simhash_near_dedup":
            assert 8 not in ids and ids.count(7) == 1 and ids.count(None) == 2
        if name == "substring_dedup":
            kept = {r.doc_id: (r._cuts, r.text) for r in out.collect()}
            assert kept[5] == (None, LONG) and ids.count(None) == 2
        if name == "benchmark_decontamination":
            assert 1 not in ids and 5 in ids
    none = spark.read.parquet(f"{empty}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, empty).count() == 0, name
        assert stage(spark, none, odd).count() == 0, name
