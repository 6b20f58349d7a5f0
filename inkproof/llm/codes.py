"""Vector code compression: product codes whose codebooks come from Lloyd rounds over resident members.

A vector becomes integers (floor of ``SCALE`` times each component) and is cut into equal parts. The
part rows live with the owner of their (position, entry, salt), in a written table. Each round
an owner's members are summed up where they are, entry by entry, and only those sums (positions times
entries for each task at most) are shuffled and give the new codebook, which is all that the driver holds.
Then members are assigned again in place; those that keep their entry stay in the files of their
owner, and only those that change it are shuffled to their new one. The salt, from the row's number,
splits entries that many rows share. After the last round each vector's codes are brought together.

Vectors that are null, or hold null or non-finite components, are left out. Shorter vectors, and those whose
length the parts don't divide, are filled with zeros up to the longest. Components are held within +-2^26 (so
that distances are exact); distances are integers, and ties go to the lower entry. With fewer vectors than
entries there are as many entries. Null ids come after all others when codebooks are begun, and rows
that repeat an id are vectors of their own, ordered by their components. An empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: An entry's members are dealt out over so many owners.
SALTS = 16
_MOST = 1 << 26
#: Distances (rows times entries) held at a time.
_HELD = 1 << 22


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # no number is above all others
    return vector.isNotNull() & finite


def whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -_MOST, _MOST).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch as integers, filled with zeros up to ``dims``."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = whole(column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest entry (the lowest of equally near ones) and the squared distance, exactly."""
    found, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    small = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 50
    step = max(1, _HELD // (len(entries) * (1 if small else max(1, x.shape[1]))))
    c = entries.astype(np.float64)
    for a in range(0, len(x), step):
        part = x[a : a + step]
        if small:  # all sums of products are integers that a double holds
            d = (c * c).sum(1) - 2 * (part.astype(np.float64) @ c.T)
        else:
            d = ((part[:, None, :] - entries) ** 2).sum(2)
        best = d.argmin(1)
        found[a : a + step], far[a : a + step] = best, ((part - entries[best]) ** 2).sum(1)
    return found, far


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel().astype(np.int32)))


def _owned(rows: DataFrame) -> DataFrame:
    """Dealt out to the owners of (position, entry, salt)."""
    return rows.repartition("position", "entry", F.pmod(F.xxhash64("row"), F.lit(SALTS)))


def _placed(vectors: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """A row for each part of each vector, with its nearest entry; id and label go with the first part only."""
    parts, width = books.shape[0], books.shape[2]
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            step = max(1, (1 << 20) // dims)
            for a in range(0, whole_batch.num_rows, step):
                b = whole_batch.slice(a, step)
                n, x = b.num_rows, _matrix(b.column(3), dims)
                entry = np.concatenate([nearest(x[:, p * width : (p + 1) * width], books[p])[0] for p in range(parts)])
                once = lambda c: pa.concat_arrays([c, pa.nulls(n * (parts - 1), c.type)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(b.column(0).to_numpy(), parts)), pa.array(np.repeat(np.arange(parts, dtype=np.int32), n)), pa.array(entry.astype(np.int32)), _lists(x.reshape(n, parts, width).swapaxes(0, 1).reshape(-1, width)), once(b.column(1)), once(b.column(2))],
                    names=["row", "position", "entry", "part", "id", "label"],
                )

    return vectors.mapInArrow(run, f"row long, position int, entry int, part array<int>, id {kinds['id']}, label {kinds['label']}")


def _again(members: DataFrame, books: np.ndarray, keep_part: bool) -> DataFrame:
    """Members assigned where they are: ``entry`` is the new one, ``moved`` whether it changed, ``far`` the squared distance."""
    kinds = dict(members.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            position, old = b.column(1).to_numpy(), b.column(2).to_numpy()
            x = b.column(3).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, books.shape[2])
            entry, far = np.empty(b.num_rows, np.int32), np.empty(b.num_rows, np.int64)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                entry[at], far[at] = nearest(x[at], books[p])
            more = [b.column(3), pa.array(entry != old)] if keep_part else [pa.array(far)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(entry), *more, b.column(4), b.column(5)], names=names)

    names = ["row", "position", "entry", *(["part", "moved"] if keep_part else ["far"]), "id", "label"]
    more = "part array<int>, moved boolean" if keep_part else "far long"
    return members.mapInArrow(run, f"row long, position int, entry int, {more}, id {kinds['id']}, label {kinds['label']}")


def _updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry that has members at their mean, rounded down."""
    sums = [F.sum(F.col("part")[j].cast("long")).alias(f"s{j}") for j in range(books.shape[2])]
    new = books.copy()
    for r in members.groupBy("position", "entry").agg(F.count("*").alias("n"), *sums).collect():  # positions times entries at most
        new[r["position"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(books.shape[2])]
    return new


def _moved(members: DataFrame, books: np.ndarray) -> DataFrame:
    """The members after a round: those that stay, in files of their owners, and those that moved, shuffled to their new ones."""
    columns = members.columns
    done = _again(members, books, True)
    path = f"{shared_dir(members.sparkSession)}/owners-{uuid.uuid4().hex}"
    done.write.partitionBy("moved").parquet(path)
    written = members.sparkSession.read.schema(done.schema).parquet(path)
    came = materialise(_owned(written.where("moved").select(columns)))
    return written.where("not moved").select(columns).unionByName(came)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of each usable vector, and the codebooks (part, entry, component).

    ``code``: two hex digits for each part; ``error``: its squared distance from the vector.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a part's code is one byte")
    vector = F.col(vector_col)
    found = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector")).where(usable(F.col("vector")))
    longest = found.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    seeds = found.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()  # as many as entries
    books = np.zeros((max(1, len(seeds)), parts * width), np.int64)
    for k, r in enumerate(seeds):
        books[k, : len(r["vector"])] = whole(np.array(r["vector"], float))
    books = np.ascontiguousarray(books.reshape(-1, parts, width).swapaxes(0, 1))

    rows = found.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector")
    members = materialise(_owned(_placed(rows, books, parts * width)))
    for k in range(rounds):
        if k:
            before, members = members, _moved(members, books)
            discard(before)
        books = _updated(members, books)

    final = _again(members, books, False)
    words = range(-(-parts // 8))
    byte = F.expr("shiftleft(cast(entry as bigint), cast(8 * (7 - position % 8) as int))")
    word = [F.bit_or(F.when(F.floor(F.col("position") / 8) == w, byte).otherwise(0)).alias(f"w{w}") for w in words]
    out = final.groupBy("row").agg(*word, F.sum("far").alias("error"), F.max("id").alias("id"), F.max("label").alias("label"))
    code = F.substring(F.concat(*(F.lpad(F.lower(F.hex(f"w{w}")), 16, "0") for w in words)), 1, 2 * parts)
    return out.select("id", "label", code.alias("code"), "error"), books


def codebooks_digest(books: np.ndarray) -> str:
    """sha256 of all integers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of all vectors of a label; nulls are one label."""
    codes = materialise(codes)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")  # a label that many rows share is dealt out
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error", salts)
    rows = codes.withColumn("_mine", F.pmod(F.xxhash64("code", "id"), F.lit(SALTS)).cast("int"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_mine") == F.col("_salt"))).drop("_label", "_salt", "_mine")
