"""Near-duplicates by SimHash and covering bit masks.

Fingerprints are 64 bits over 3-word shingles. Two fingerprints link if they differ in at most
two bits. The 64 bits are dealt into five blocks; each of the ten masks blanks two blocks, so
whichever two bits differ, one mask blanks both: every pair within the radius shares a key.

A bucket (mask, key) with up to ``PAIR_LIMIT`` fingerprints is joined with itself. A larger one
is handled exactly, without pairs: two fingerprints lie within two bits if and only if some word
is within one bit of both, so each fingerprint is sent to itself and its one-bit neighbours in
the blanked blocks, and the smallest visitor of a word is linked with the others.

Nulls and texts without words get fingerprint zero and link like any other. Repeated rows and
copies share a fingerprint and are compared once. An empty table gives no rows. Only the named
id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, unused
from .components import connected_components

BITS, BLOCKS, RADIUS, SHINGLE, SEED = 64, 5, 2, 3, 42
PAIR_LIMIT = 64


def _block(i: int) -> int:
    """The bits of block i as a mask."""
    lo, hi = BITS * i // BLOCKS, BITS * (i + 1) // BLOCKS
    return (1 << hi) - (1 << lo)


#: The bits that each table blanks: one pair of blocks.
BLANKS = [_block(i) | _block(j) for i in range(BLOCKS) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    """SimHash of one text: a bit is 1 if more than half of the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    ends = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(ends + 1) - 1
    starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
    h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """``id, fp`` (a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fp = np.fromiter((fingerprint(t) if t else 0 for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, fp long")


def links(reps: DataFrame) -> DataFrame:
    """Edges ``a, b`` between the representatives of ``reps`` (fp, rep; each fp once) that connect all fingerprints within the radius."""
    keys = reps.select(
        "fp",
        "rep",
        F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(~m & (1 << 64) - 1))).alias("k")) for t, m in enumerate(BLANKS)))).alias("_"),
    ).select("fp", "rep", "_.t", "_.k")
    shared = keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keys.join(shared, ["t", "k"]))
    few, many = shared.where(F.col("n") <= PAIR_LIMIT), shared.where(F.col("n") > PAIR_LIMIT)
    x, y = few.select("t", "k", F.col("fp").alias("f"), F.col("rep").alias("a")), few.select("t", "k", F.col("fp").alias("g"), F.col("rep").alias("b"))
    near = x.join(y, ["t", "k"]).where((F.col("f") < F.col("g")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS)).select("a", "b")
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS) if m >> i & 1)) for m in BLANKS))
    visits = many.select("t", "rep", "fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip")).select("t", "rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    first = visits.groupBy("t", "v").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = visits.withColumnRenamed("rep", "b").join(first, ["t", "v"]).where("a <> b").select("a", "b")
    return near.unionByName(star)


def _classes(fps: DataFrame) -> DataFrame:
    """``fp, class``: each fingerprint's class of linked ones, named by one of them."""
    reps = fps.select("fp").distinct().withColumn("rep", F.col("fp"))
    linked = connected_components(links(reps))
    return reps.join(linked, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``id``, ``fp`` and ``component_id``: the smallest id reachable over links, its own included."""
    fps = materialise(fingerprints(docs, id_col, text_col))
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    classes = materialise(_classes(fps).join(least, "fp"))
    smallest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return fps.join(classes.join(smallest, "class").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Up to so many rows to drop (some 50 MB) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each near-duplicate class: the one with the smallest id, of equal ids the one with the smallest text digest.

    Rows with the same id but texts that aren't near-duplicates all stay. Rows without an id can't
    be told apart: each stays. The rows to drop are found first, by id and digest alone, so whole
    texts are shuffled only where equal rows repeat.
    """
    text = lambda: F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)
    own, mine = unused("_own", docs.columns), unused("_mine", docs.columns)
    marked = docs.select(F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.substring(text(), 1, 32).alias("digest")).alias(own), F.col(f"`{text_col}`").alias("text"))
    fps = materialise(fingerprints(marked.where(F.col(own)["id"].isNotNull()), own, "text", "struct<id: long, digest: string>"))
    row = fps.groupBy("fp", "id").agg(F.count("*").alias("n")).select("fp", F.col("id").alias("row"), "n")
    classed = materialise(row.join(_classes(fps), "fp"))
    keep = classed.groupBy("class").agg(F.min("row").alias("first"))
    known = materialise(classed.join(keep, "class").select("row", (F.col("row") == F.col("first")).alias("kept"), "n"))
    gone, again = known.where("not kept").select(F.col("row").alias(mine)), known.where("kept and n > 1").select(F.col("row").alias(mine))
    small = lambda part: F.broadcast(part) if part.count() <= BROADCAST_ROWS else part
    key = F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.substring(text(), 1, 32).alias("digest"))
    same, again = key == F.col(mine), small(again)
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.join(small(gone), same, "left_anti").join(again, same, "left_anti")
    several = docs.join(again, same, "left_semi").dropDuplicates([id_col, text_col])
    return once.select(*names).unionByName(several.select(*names))
