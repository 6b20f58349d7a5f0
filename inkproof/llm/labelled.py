"""A bounded sample of labelled rows, and one task that fits a model to it."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise

#: At most so many rows of each class are learned from, and only texts of at most so many bytes.
PER_CLASS, MOST_BYTES = 1000, 8_000
#: Of the sampled rows, those with crc32 of the id modulo 5 equal to 1 are for calibration.
CALIBRATION = 1


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``id, label, calibration, share, text``; share: of the label among all labelled rows.

    Of each class the rows with the smallest hashed ids are taken, among those with a text of a
    usable length. Labels other than 0 and 1 and null ids are left out; a row with both labels
    counts as 1. ``allowed`` is a condition on ``id``.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(allowed) if allowed is not None else known
    known = materialise(known.groupBy("id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where(F.octet_length("text").between(1, most_bytes))
    usable, ids = materialise(known.join(texts.select("id"), "id", "left_semi")), None
    for k in (0, 1):
        part = usable.where(F.col("label") == k).withColumn("share", F.lit(counts.get(k, 0) / max(1, sum(counts.values()))))
        part = part.orderBy(F.xxhash64("id"), "id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    return texts.join(F.broadcast(ids), "id").select("id", "label", (fold("id", 5) == CALIBRATION).alias("calibration"), "share", "text")


def train(rows: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """What ``fit`` makes of the rows of a bounded sample, in one task; its pickled size is bounded by the model's."""

    def run(batches):
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["label"], r["id"], r["text"]))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(found))]})

    found = rows.repartition(1).mapInArrow(run, "model binary").first()  # none without rows
    return pickle.loads(found["model"]) if found else fit([])
