import random

import public_tokenizers
from tokenizers import Tokenizer

from inkproof.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library_for_any_chunks(spark):
    r = random.Random(2)
    parts = ["the ", "ouvert", "é", "  ", "\n", "12", "'ll", " it's", "<|endoftext|>", "中文", "   \n ", "!!", "naïve "]
    texts = ["".join(r.choices(parts, k=r.choice([5, 300, 2000]))) for _ in range(25)]
    texts += [None, "", "x" * 3000, " " * 3000, "y" * 700 + " end", "<|endoftext|>" * 200, texts[0], "a" * 500 + "".join(r.choices(parts, k=900)) + "b" * 600]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_tokens int")
    library = Tokenizer.from_file(PATH)
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    for step, overlap in ((100, 60), (500, 100)):
        got = {x.id: (x.n_bytes, x.n_tokens) for x in token_count.token_counts(docs, PATH, step=step, overlap=overlap).collect()}
        assert got == want


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c " * 400)] * 2, "doc_id long, text string")
    got = sorted((x.id or 0, x.n_tokens) for x in token_count.token_counts(docs, PATH, step=100, overlap=50).collect())
    n = len(Tokenizer.from_file(PATH).encode("c " * 400, add_special_tokens=False).ids)
    assert got == [(0, n)] * 2 + [(1, 2)] * 4
    assert token_count.token_counts(docs.where("false"), PATH).count() == 0
