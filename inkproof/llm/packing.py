"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids and one end id, cut into pieces of ``SEQUENCE`` ids if longer; the
first piece is then the shorter one. Only the number of pieces of each length (``SEQUENCE``
counts, whatever the corpus) goes to the driver, which plans patterns of lengths: from the
longest length down, the gap's exact complement is looked up among single lengths, pairs and
triples hashed by their sums, and the pattern is taken as often as the counts allow; where none
fills the gap, the longest available length that fits narrows it first (best fit). Each pattern uses up a length, so the plan is bounded, and is broadcast. Pieces get
ranks within their length over hashed buckets, so that a length with a third of all pieces is
dealt to many tasks, and a piece's rank picks its place in the plan.

A null or empty text is the end id alone. Rows that repeat are packed as often as they occur. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialise, slices

SEQUENCE, END_ID = 1024, 2


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32`` for each piece of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), END_ID.to_bytes(4, "little")
        for b in slices(batches, 1):
            rows: list[list] = [[], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.pack(text or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % SEQUENCE + 1 if not at else SEQUENCE
                    for column, value in zip(rows, (key, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]))):
                        column.append(value)
                    at, k = at + size, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


class Complements:
    """The available lengths, and their pairs and triples hashed by their sums, under counts of what is left.

    An entry of a sum is kept while it can be had; one whose lengths have run out is dropped when it
    comes up, as counts never grow. ``pairs[s]`` has the longer length of each pair with the sum s,
    ``triples[s]`` the longest of each triple, the rest being a pair; longest last, so that it comes
    up first. A sum under ``size`` has fewer than ``size`` entries, so the index is bounded.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = Counter({k: n for k, n in counts.items() if n > 0})
        self.pairs: dict[int, list[int]] = defaultdict(list)
        self.triples: dict[int, list[int]] = defaultdict(list)
        lengths = sorted(self.left)
        for i, a in enumerate(lengths):
            for b in lengths[: i + 1]:
                if a + b >= size:
                    break
                self.pairs[a + b].append(a)
        sums = sorted(self.pairs)
        for a in lengths:
            for rest in sums:
                if a + rest >= size:
                    break
                if self.pairs[rest][0] <= a:
                    self.triples[a + rest].append(a)

    def has(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def _pair(self, total: int, most: int, *taken: int) -> tuple[int, int] | None:
        """The pair with the longest length of at most ``most`` that can be had besides ``taken``."""
        found = self.pairs.get(total, ())
        for a in reversed(found[: bisect_right(found, most)]):
            if self.has(a, total - a, *taken):
                return a, total - a
        return None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that can be had and exactly fill the gap."""
        if self.left[gap] > 0:
            return (gap,)
        while (found := self.pairs.get(gap)) and not self.has(found[-1], gap - found[-1]):
            found.pop()
        if found:
            return found[-1], gap - found[-1]
        while found := self.triples.get(gap):
            a = found[-1]
            if self.left[a] > 0 and (rest := self._pair(gap - a, a, a)):
                return a, *rest
            found.pop()
        return None

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, Counter]]:
    """Patterns (how often, lengths) that together use each length as often as it is counted."""
    stock, out = Complements(counts, size), []
    lengths = sorted(stock.left)
    while lengths:
        pattern, gap = Counter({lengths[-1]: 1}), size - lengths[-1]
        stock.take(lengths[-1])
        while gap:
            got = stock.filling(gap)
            if not got:  # best fit of a single one, then try again
                i = bisect_left(lengths, gap + 1) - 1
                while i >= 0 and not stock.left[lengths[i]]:
                    i -= 1
                if i < 0:
                    break
                got = (lengths[i],)
            for x in got:
                pattern[x] += 1
                stock.take(x)
                gap -= x
        more = min(stock.left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            stock.take(x, n * more)
        out.append((1 + more, pattern))
        lengths = [x for x in lengths if stock.left[x]]
    return out


def slots(patterns: list[tuple[int, Counter]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, lo, hi, first sequence, per sequence, offset``: the ranks lo to hi - 1 of a length fill these places."""
    used, sequence, out = Counter(), 0, []
    for times, pattern in patterns:
        offset = 0
        for x, n in sorted(pattern.items(), reverse=True):
            out.append((x, used[x], used[x] + times * n, sequence, n, offset))
            used[x] += times * n
            offset += x * n
        sequence += times
    return out


def pack(cut: DataFrame, buckets: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``pieces``."""
    spark = cut.sparkSession
    cut = materialise(cut)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = materialise(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # SEQUENCE rows at most
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    kind = "length long, lo long, hi long, sequence long, per long, base long"
    places = F.broadcast(spark.createDataFrame(slots(plan(counts)), kind))
    placed = ranked.join(places, (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(places["length"])
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )
