import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkproof.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_length_as_often_as_it_is_counted(seed):
    r = random.Random(seed)
    counts = Counter(min(64, int(r.expovariate(0.05)) + 1) for _ in range(r.choice([3, 200, 5000])))
    used, n = Counter(), 0
    for times, pattern in packing.plan(counts, 64):
        assert times > 0 and sum(x * k for x, k in pattern.items()) <= 64
        n += times
        for x, k in pattern.items():
            used[x] += times * k
    assert used == counts
    least = -(-sum(x * k for x, k in counts.items()) // 64)
    assert least <= n <= least * 1.05 + 2


def test_exact_complements_come_first():
    assert packing.plan({7: 2, 3: 2}, 10) == [(2, Counter({7: 1, 3: 1}))]
    assert packing.plan({6: 5, 3: 5, 1: 5}, 10) == [(5, Counter({6: 1, 3: 1, 1: 1}))]
    assert packing.plan({5: 5}, 10) == [(2, Counter({5: 2})), (1, Counter({5: 1}))]
    assert packing.plan({}) == []


def test_pieces_and_sequences(spark):
    r = random.Random(5)
    words = ["the", "of", "ouvert", "naïve", "12", "it's", "\n", "中文"]
    rows = [(i, " ".join(r.choices(words, k=int(r.expovariate(1 / 300)))), 1, 2) for i in range(120)]
    rows += [(200, None, 1, 2), (201, "", 1, 2), (202, "a " * 5000, 1, 2), (203, "b<|endoftext|>c", 1, 2), (3, rows[3][1], 1, 2), (None, "no id", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, bucket int")
    got = packing.pack(packing.pieces(docs, PATH), buckets=3).collect()
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for key, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())] += 1
    assert Counter((p.id, p.piece, p.start, p.length, p.ids_crc32) for p in got) == want
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.pieces(docs.where("doc_id < 0"), PATH)).count() == 0


def test_both_libraries_give_the_same_ids():
    e = bpe.encoder(PATH)
    chars = [chr(c) for c in range(1, 0x30000, 37) if not 0xD800 <= c < 0xE000] + list("\u0085    　\x1c\x1f'’")
    texts = [f"a{c}b1{c}2 {c} {c}{c}x\n{c} " for c in chars] + ["it's we'll I'M", "a  b\t\tc \n\n d", "x<|endoftext|> y", "  ", "日本語テキスト", "٣٤ ½ Ⅷ"]
    for t in texts:
        want = e.library.encode(t, add_special_tokens=False).ids
        assert e.ids(t) == want, t
        ends, counts = e.boundaries(t)
        assert ends[-1] == len(t) and counts[-1] == len(want), t
