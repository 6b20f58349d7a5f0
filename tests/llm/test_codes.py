"""Vector codes against plain Lloyd rounds, exact distances, and what stays where it is."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkproof.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds):
    """Codes and errors by row, and the codebooks, in Python's own integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    hold = lambda x: int(max(-(1 << 26), min(1 << 26, math.floor(x * 256)))) if abs(x) < 1e200 else (1 << 26) * (1 if x > 0 else -1)
    whole = [[hold(x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        at = place()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    at = place()
    error = [sum(far(v[p], books[p][a[p]]) for p in range(parts)) for v, a in zip(cut, at)]
    return [(i, label, "".join(f"{e:02x}" for e in a), err) for (i, _, label), a, err in zip(kept, at, error)], books


def rows_of(n, dims, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in r.normal(0, spread, dims)], int(r.integers(0, 5)) if i % 7 else None) for i in r.permutation(n)]


@pytest.mark.parametrize("rows, parts, entries, rounds", [
    (rows_of(300, 32, 1), 16, 64, 2),
    (rows_of(90, 7, 2) + [(900, [0.25] * 7, 1)] * 120, 3, 9, 3),  # a vector that many rows have; 7 isn't divided by 3
    (rows_of(12, 16, 3) + [(3, [0.0] * 4, 9), (None, [0.5] * 16, 9), (None, None, 1), (5, [None] + [0.0] * 15, 1), (6, [float("inf")] * 16, 1), (7, [float("nan")] * 16, 1), (8, [], None)], 16, 64, 2),
    (rows_of(60, 16, 4, 40_000.0) + [(61, [1e300, -1e300] * 8, 1)], 4, 8, 2),  # beyond what products of doubles hold
])
def test_equals_plain_rounds(spark, rows, parts, entries, rounds):
    got, books = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=parts, entries=entries, rounds=rounds)
    want, plain_books = plain(rows, parts, entries, rounds)
    assert books.tolist() == plain_books
    assert sorted((tuple(r) for r in got.select("id", "label", "code", "error").collect()), key=repr) == sorted(want, key=repr)
    totals = {}
    for _, label, _, err in want:
        totals[label] = totals.get(label, 0) + err
    assert all(r.label_error == totals[r.label] for r in codes.with_label_errors(got).collect())
    assert codes.with_label_errors(got).count() == len(want)
    flat = ",".join(str(x) for part in plain_books for e in part for x in e)
    assert codes.codebooks_digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_ties_go_to_the_lower_entry():
    x = np.array([[0, 0], [5, 5]])
    for big in (1, 1 << 24):
        entry, far = codes.nearest(x * big, np.array([[1, 1], [-1, -1], [1, 1], [9, 9], [1, 9]]) * big)
        assert entry.tolist() == [0, 0] and far.tolist() == [2 * big * big, 32 * big * big]


def test_members_that_stay_are_not_shuffled(spark):
    """A round's movers are written anew by their owners; the others keep the files of the round's own map tasks."""
    rows = rows_of(400, 8, 5)
    df = spark.createDataFrame(rows, SCHEMA).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    books = np.array([[codes.whole(np.array(v[p * 4 : p * 4 + 4])) for _, v, _ in rows[:6]] for p in range(2)])
    from inkproof.llm.common import materialise

    members = materialise(codes._owned(codes._placed(df, books, 8)))
    new = codes._updated(members, books)
    after = codes._moved(members, new)
    old, now = ({(r.row, r.position): (r.entry, r.part) for r in d.collect()} for d in (members, after))
    assert old.keys() == now.keys() and all(old[k][1] == now[k][1] for k in old)
    entry = lambda k: int(codes.nearest(np.array([old[k][1]]), new[k[1]])[0][0])
    assert all(now[k][0] == entry(k) for k in now)
    stayed = sum(old[k][0] == now[k][0] for k in old)
    files = after.withColumn("f", F.input_file_name()).withColumn("stay", F.contains("f", F.lit("moved=false"))).groupBy("stay").count().collect()
    assert {r["stay"]: r["count"] for r in files} == {True: stayed, False: len(old) - stayed} and 0 < stayed < len(old)


def test_no_vectors(spark):
    got, books = codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert got.count() == 0 and books.shape == (16, 1, 1)
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA), entries=300)
