"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk begins at a word where the hash of the bytes
just before it has zeros under a mask (one word in four), so chunks depend on their content alone
and an insertion moves no boundary but the nearest. A stretch of ``MOST_WORDS`` words without a
boundary takes those of a second, weaker mask; what then still has none is a repetition of a few
words, the same wherever it begins, and is cut every ``MOST_WORDS`` words. Consecutive chunks that together have just ``LEAST_WORDS`` words or more, counted on from
each chunk and back from each chunk, are a window with a joint digest. Each joint digest belongs to
the smallest id that has it; a document loses the chunks of windows that belong to others. So one
earlier document has all words of a window, in a row. The first document keeps the passage, and
repeats within one document are left alone.

A batch keeps for each joint digest the rows of its smallest id to be compared with other batches;
the rest are lost whatever those have and are dealt out by id, so a common passage fills no task.

Null texts stay null, and texts without such runs stay as they are. Documents without an id lose
nothing and own nothing. Rows that repeat an id are one document: none loses to the other. An
empty table gives no rows. Extra columns pass through, whatever their names and nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import slices, unused

MOST_WORDS, LEAST_WORDS = 32, 20
#: The hash has 16 bits; bit k depends on the last k + 1 bytes, so these two see 12 bytes.
_MASK, _WEAK = np.uint16(0b11 << 10), np.uint16(0b1 << 12)
#: A fixed random number for each byte; the zero byte that separates texts has 0.
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256).astype(np.uint16)
_GEAR[0] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_APART = b"\0" * 16
_BLOCK, _SLICE = 1 << 22, 1 << 24


def _gear(data: np.ndarray) -> np.ndarray:
    """h = 2 h + gear[byte], rolled over all bytes; doubling covers 16 bytes in four steps."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def _cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks begin, where their last word ends, and how many words they have; a zero byte ends a chunk."""
    space = _SPACE[data]
    word = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(word):
        return word, word, word
    stop = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    first = np.concatenate(([True], np.logical_or.reduceat(data == 0, word)[:-1]))
    hashed = _gear(data)[np.maximum(word, 1) - 1]
    starts = first | ((hashed & _MASK) == 0)
    begin = np.flatnonzero(starts)
    size = np.diff(np.append(begin, len(word)))
    long = np.repeat(size > MOST_WORDS, size)
    starts |= long & ((hashed & _WEAK) == 0)
    begin = np.flatnonzero(starts)
    size = np.diff(np.append(begin, len(word)))
    for b, n in zip(begin[size > MOST_WORDS], size[size > MOST_WORDS]):
        starts[b : b + n : MOST_WORDS] = True
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], len(word))
    return word[begin], stop[end - 1], end - begin


def _digested(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For a group of texts at a time: the first's number, the joined bytes with their chunks."""
    group, size, first = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if group and (t is None or size + len(t) > _BLOCK):
            joined = _APART.join(group) + _APART
            yield first, group, joined, *_cuts(np.frombuffer(joined, np.uint8))
            group, size, first = [], 0, i
        if t is not None:
            group.append(t)
            size += len(t) + len(_APART)


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk: its text's number, its number in the text, where it begins there, its words and its digest."""
    from xxhash import xxh3_64_intdigest

    found = [[np.empty(0, np.int64)] for _ in range(5)]
    for first, group, joined, start, stop, words in _digested(texts):
        base = np.cumsum([0, *(len(t) + len(_APART) for t in group)])
        owner = np.searchsorted(base, start, "right") - 1
        number = np.arange(len(start)) - np.searchsorted(owner, owner)
        digest = np.fromiter((xxh3_64_intdigest(joined[a:b]) for a, b in zip(start.tolist(), stop.tolist())), np.uint64, len(start))
        for column, new in zip(found, (owner + first, number, start - base[owner], words, digest.view(np.int64))):
            column.append(new)
    return tuple(map(np.concatenate, found))


def windows_of(owner: np.ndarray, words: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the chunks: its first chunk, how many it has, and their joint digest."""
    total = np.cumsum(words)
    before = total - words
    to = np.searchsorted(total, before + LEAST_WORDS)
    on = np.flatnonzero(to < np.searchsorted(owner, owner, "right"))
    since = np.searchsorted(before, total - LEAST_WORDS, "right") - 1
    back = np.flatnonzero(since >= np.searchsorted(owner, owner))
    back = back[to[since[back]] != back]
    first = np.concatenate((on, since[back]))
    n = np.concatenate((to[on], back)) - first + 1
    joint, each = np.zeros(len(first), np.uint64), digest.view(np.uint64)
    for k in range(n.max(initial=0)):
        at = np.flatnonzero(n > k)
        h = (joint[at] ^ each[first[at] + k]) * np.uint64(0x9E3779B97F4A7C15)
        joint[at] = h ^ (h >> np.uint64(32))
    return first, n, joint.view(np.int64)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, place, digest, lost`` for each window of each row; ``place`` is 32 times its first chunk's number and how many it has, ``lost`` the id if a smaller one in the batch has the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, _SLICE):
            owner, number, _, words, digest = chunks_of([t or b"" for t in b.column(1).to_pylist()])
            first, n, joint = windows_of(owner, words, digest)
            ids = b.column(0).to_numpy()[owner[first]]
            order = np.lexsort((ids, joint))
            group = joint[order]
            least = np.empty_like(ids)
            least[order] = ids[order][np.searchsorted(group, group)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(number[first] << 5 | n), pa.array(joint), pa.array(ids, mask=ids == least)], names=["id", "place", "digest", "lost"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, place long, digest long, lost long")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, cuts``: the windows (place, digest) that each document with any loses."""
    seen = Window.partitionBy("digest", "lost").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    others = windows(docs, id_col, text_col).withColumn("owner", F.min("id").over(seen)).where("lost is not null or id > owner")
    return others.groupBy("id").agg(F.collect_list(F.struct("place", "digest")).alias("cuts"))


def cut_passages(text: bytes, cuts: list[dict]) -> tuple[bytes, int]:
    """The text without the chunks of the given windows, and how many they are; a place whose digest differs is another text's and is left."""
    owner, _, _, words, digest = chunks_of([text])
    mine = {(a << 5 | n, d): (a, n) for a, n, d in zip(*(x.tolist() for x in windows_of(owner, words, digest)))}
    gone = {k for c in cuts if (w := mine.get((c["place"], c["digest"]))) for k in range(w[0], sum(w))}
    return cut_out(text, [{"no": k, "digest": int(digest[k])} for k in gone]), len(gone)


def cut_out(text: bytes, cuts: list[dict]) -> bytes:
    """The text without the given chunks; a number whose digest differs is another text's and is left."""
    _, _, start, _, digest = chunks_of([text])
    ends = np.append(start[1:], len(text)).tolist()
    start, digest, kept, at = start.tolist(), digest.tolist(), [], 0
    for c in sorted(cuts, key=lambda c: c["no"]):
        k = c["no"]
        if k < len(start) and digest[k] == c["digest"]:
            kept.append(text[at : start[k]])
            at = ends[k]
    return b"".join(kept) + text[at:]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "_n_cut", keep_emptied: bool = True) -> DataFrame:
    """The rows with repeated passages cut from the text; ``count_col`` counts the chunks cut (none if null; underscores are added to a name that is taken).

    Without ``keep_emptied``, rows of whose text nothing but white space is left go.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    added = [unused(count_col, names)] if count_col else []
    schema = StructType([*docs.schema.fields, *(StructField(c, IntegerType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            cuts = b.column(b.num_columns - 1).to_pylist()
            columns = list(b.columns[:-1])
            filled = None
            if any(cuts):
                texts = columns[at].to_pylist()
                texts = [(t, 0) if not (c and t) else ((cut := cut_passages(t.encode(), c))[0].decode(), cut[1]) for t, c in zip(texts, cuts)]
                columns[at] = pa.array([t for t, _ in texts], columns[at].type)
                filled = pa.array([not (n and not t.strip()) for t, n in texts])
            if added:
                columns.append(pa.array([n for _, n in texts] if any(cuts) else [0] * len(cuts), pa.int32()))
            out = pa.RecordBatch.from_arrays(columns, names=[*names, *added])
            yield out if keep_emptied or filled is None else out.filter(filled)

    own, cuts = unused("_id", names), unused("_cuts", names)
    found = passages(docs, id_col, text_col).select(F.col("id").alias(own), F.col("cuts").alias(cuts))
    joined = docs.join(found, F.col(f"`{id_col}`").cast("long") == F.col(own), "left").drop(own)
    return joined.mapInArrow(run, schema)
