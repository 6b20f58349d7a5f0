"""Token counts of whole texts; a huge text is encoded in overlapping chunks by many tasks.

Chunk i covers ``step`` code points and the ``overlap`` beyond. Both neighbours report where
pre-tokens end inside their overlap, and how many tokens they have up to there. The pre-tokeniser
reads left to right and depends only on what follows, so from a boundary that both chunks have,
the right chunk reads what a pass over the whole text would read; and the left chunk is right up
to there if the boundary is further from its cut end than the longest look-ahead (``MARGIN``).
The text's count is spliced at the first such common boundary of each seam. Where a seam has none
(a run without any boundary), those texts are cut anew with four times the chunk and overlap,
until all seams align or a text is one chunk.

A null or empty text has 0 tokens and bytes. Rows that repeat each get their count; equal huge
texts are encoded once. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialise, slices

STEP, OVERLAP, MARGIN = 1 << 16, 1 << 12, 32


def _whole(rows: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in slices(batches, 2):
            n = [len(enc.ids(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return rows.select("id", "n_bytes", "text").mapInArrow(run, "id long, n_bytes long, n_tokens long")


def _chunks(rows: DataFrame, step: int, overlap: int) -> DataFrame:
    """``key, no, last, text``: the overlapping chunks of each distinct text, dealt out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // step))
                for k in range(n):
                    part = text[k * step : (k + 1) * step + overlap] if k + 1 < n else text[k * step :]
                    yield pa.RecordBatch.from_pylist([{"key": key.as_py(), "no": k, "last": k + 1 == n, "part": part}], schema)

    schema = pa.schema([("key", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("part", pa.string())])
    return rows.select("key", "text").mapInArrow(run, "key string, no long, last boolean, part string").dropDuplicates(["key", "no"])


def _encoded(chunks: DataFrame, tokenizer: str, step: int, overlap: int) -> DataFrame:
    """``key, no, last, total`` and the boundaries (offset in the overlap, tokens up to there) at either end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for row in b.to_pylist():
                part = row.pop("part")
                ends, counts = enc.boundaries(part)
                spots = list(zip(ends, counts))
                row["total"] = counts[-1] if counts else 0
                row["head"] = [{"at": 0, "n": 0}, *({"at": e, "n": c} for e, c in spots if e <= overlap)] if row["no"] else []
                row["tail"] = [] if row["last"] else [{"at": e - step, "n": c} for e, c in spots if step <= e <= len(part) - MARGIN]
                yield pa.RecordBatch.from_pylist([row], schema)

    spot = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("key", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("total", pa.int64()), ("head", spot), ("tail", spot)])
    kind = "array<struct<at: long, n: long>>"
    return chunks.mapInArrow(run, f"key string, no long, last boolean, total long, head {kind}, tail {kind}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """``key, n_tokens``; null where a seam has no common boundary."""
    left = encoded.select("key", "no", "last", "total", "tail")
    right = encoded.select("key", (F.col("no") - 1).alias("no"), "head")
    at = F.array_min(F.array_intersect("tail.at", "head.at"))
    there = lambda side: F.element_at(F.filter(side, lambda x: x["at"] == F.col("common")), 1)["n"]
    seams = left.join(right, ["key", "no"], "left").withColumn("common", at)
    part = F.when(F.col("last"), F.col("total")).when(F.col("common").isNotNull(), there("tail") - there("head"))
    return seams.select("key", part.alias("n")).groupBy("key").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """``id, n_bytes, n_tokens`` for each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    is_huge = F.length("text") > step + overlap
    small = _whole(rows.where(~is_huge), tokenizer)
    huge = rows.where(is_huge).withColumn("key", F.sha2("text", 256))
    todo, done = huge, None
    while True:
        found = materialise(_spliced(_encoded(_chunks(todo, step, overlap), tokenizer, step, overlap)))
        ok = found.where("n_tokens is not null")
        done = ok if done is None else done.unionByName(ok)
        failed = found.where("n_tokens is null").select("key")
        if failed.isEmpty():
            break
        todo, step, overlap = huge.join(failed, "key", "left_semi"), 4 * step, 4 * overlap
    return small.unionByName(huge.select("key", "id", "n_bytes").join(done, "key").select("id", "n_bytes", "n_tokens"))
