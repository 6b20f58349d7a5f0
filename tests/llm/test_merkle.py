"""The Merkle manifest against plain hashing, for many shapes of trees, and tampered rows."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from inkproof.llm import merkle, queries


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    """The root, and for each leaf the siblings left and right at each level."""
    nodes, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, a in enumerate(at):
            run, place = runs[a // fanout], a % fanout
            proofs[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[k] = a // fanout
        nodes = [h(*r) for r in runs]
    return nodes[0], proofs


def plain(rows, fanout):
    """``(id, leaf, subroot, root, proof)`` for each row."""
    out, tops, groups = [], [], sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r)) for r in rows if r[2] == g))
        root, proofs = plain_tree([x[2] for x in mine], fanout)
        tops.append(root)
        out.append([(x[1] if x[0] else None, x[2], root, p) for x, p in zip(mine, proofs)])
    root, proofs = plain_tree(tops, fanout)
    return [(i, lf, sub, root, p + top) for part, top in zip(out, proofs) for i, lf, sub, p in part]


def rows_of(n, langs):
    return [(i * 7 % 1000, "src" if i % 5 else None, langs[i * i % len(langs)], i if i % 3 else None, None if i % 11 == 0 else f"Text ünï {i} " * (i % 4)) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
CASES = [(1, ["en"], 8, 3), (2, ["en", None], 2, 1), (9, ["en"], 8, 1), (70, ["en", None, "de", "ü"], 2, 1), (131, ["a", "b", "c"], 3, 1), (140, ["a"], 2, 2), (150, ["a", "a", "a", "b"], 8, 1), (40, [str(i) for i in range(40)], 3, 1)]


@pytest.mark.parametrize("n, langs, fanout, local", CASES)
def test_equals_plain_hashing(spark, n, langs, fanout, local):
    rows = rows_of(n, langs)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), fanout=fanout, local=local)
    found = sorted(((r.id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got.withColumn("back", merkle.fold(F.col("leaf"), F.col("proof"))).collect() if r.back == r.root), key=repr)
    assert found == sorted(plain(rows, fanout), key=repr)


def test_repeated_ids_and_copies(spark):
    rows = [(1, "s", "en", 1, "x")] * 30 + [(1, "s", "en", 1, f"y{i}") for i in range(20)] + [(None, None, "en", None, None)] * 3 + [(2, "s", None, 1, "")]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=2, local=1)
    found = sorted(((r.id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got.collect()), key=repr)
    assert found == sorted(plain(rows, 2), key=repr)


def test_each_block_gets_its_proof_by_swaps_alone(spark):
    """After the last round every block has as many levels as its tree, and all of a group have one root."""
    for n in (2, 5, 7, 8, 9, 17, 26):
        up = spark.createDataFrame([("g", i, n, h(str(i)), []) for i in range(n)], "group string, block long, blocks long, node string, proof array<struct<left: string, right: string>>")
        span = 1
        while span < n:
            up, span = merkle._swap(up, span, 3), span * 3
        root, proofs = plain_tree([h(str(i)) for i in range(n)], 3)
        got = {r.block: (r.node, [tuple(p) for p in r.proof]) for r in up.collect()}
        assert got == {i: (root, p) for i, p in enumerate(proofs)}


def test_query_finds_tampered_rows(spark, tmp_path):
    rows = [(i, "s", "en" if i % 2 else None, 3, "lower case" if i % 4 == 0 else "Upper Case") for i in range(1, 200)] + [(200, None, None, None, None), (201, "s", "de", 1, "ÄÖÜ only")]
    spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()}
    from zlib import crc32

    for i, _, lang, _, text in rows:
        changed = crc32(str(i).encode()) % 3 == 0 and text == "Upper Case"
        assert got[i].verified == (not changed) == (got[i].folded_root == got[i].root), i
    want = {r[0]: r for r in plain(rows, 8)}
    assert all(got[i].proof_sha256 == h(*(a + b for a, b in want[i][4])) and got[i].root == want[i][3] for i in got)


def test_stored_rows_are_leaves(spark, monkeypatch):
    """No stored row holds a block's members: a reader takes thousands of rows at a time, whatever their size."""
    stored, real = [], merkle.materialise
    monkeypatch.setattr(merkle, "materialise", lambda df: stored.append(real(df)) or stored[-1])
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(1500)]
    got = {r.id: (r.root, [tuple(p) for p in r.proof]) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (root, p) for i, _, _, root, p in plain(rows, 8)}
    most = max(df.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] or 0 for df in stored)
    assert most < 8_000
