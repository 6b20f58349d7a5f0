"""Toxicity: a linear classifier of hashed character n-grams, scaled by naive Bayes log-count ratios.

A feature is an n-gram of 4 or 5 characters (A-Z lower-cased, white space as spaces); its value in a text grows with the
logarithm of its share, times the log ratio of its summed values among toxic and among other texts; each
text's values are scaled to length one. The classifier is a logistic regression with an elastic net, fitted to
a bounded sample of labelled rows (see ``labelled``), all of them; it is calibrated on the scores that
models fitted without a fold give that fold. Whole texts are scored.

Null and empty texts, and those without a known n-gram, have no features: their score is that of the intercept alone. Without
labelled rows of both classes every score is 0. Rows that repeat get equal scores. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import slices
from .linear import blocks, calibrate, char_grams, characters, fit, sigmoid

BITS, SIZES = 20, (4, 5)
L1, L2, ROUNDS, FOLDS = 1e-4, 1e-4, 100, 3
#: N-grams whose log ratio is smaller, or that fewer sampled texts have, aren't features.
LEAST_RATIO, LEAST_TEXTS = 1.0, 3
#: A share is counted in so many parts of the text before its logarithm is taken.
PER = 1000.0


def _values(texts: list[bytes], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text's number, feature and value, for each (useful) feature that a text has."""
    keys, sizes, length = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.zeros(len(texts))
    for data, owner, seen in blocks(texts):
        chars, of, seen = characters(data, owner, seen)
        chars[(chars >= 9) & (chars <= 13)] = 32
        length += np.bincount(of[seen:], chars[seen:] != 0, len(texts))
        for at, f in char_grams(chars, SIZES, BITS, seen):
            if useful is not None:
                hit = np.flatnonzero(useful[f])
                at, f = at[hit], f[hit]
            key, n = np.unique(of[at] << BITS | f.astype(np.int64), return_counts=True)
            keys.append(key)
            sizes.append(n)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    row, feature = key >> BITS, key & (1 << BITS) - 1
    return row, feature, np.log1p(PER * np.bincount(where, np.concatenate(sizes), len(key)) / length[row])


def _scaled(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Each text's values, scaled to length one."""
    return x / np.sqrt(np.bincount(row, x * x, n))[row]


def _ratios(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray) -> np.ndarray:
    toxic, other = (np.bincount(feature, value * y[row], 1 << BITS) + 1 for y in (label, 1 - label))
    ratio = np.log(toxic / toxic.sum()) - np.log(other / other.sum())
    ratio[(np.abs(ratio) < LEAST_RATIO) | (np.bincount(feature, minlength=1 << BITS) < LEAST_TEXTS)] = 0
    return ratio


def _fitted(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Ratios, intercept, weights, and raw scores of all rows, from the rows in ``use``."""
    mine = use[row]
    ratio = _ratios(row[mine], feature[mine], value[mine], label)
    told = ratio[feature] != 0
    row, feature, mine = row[told], feature[told], mine[told]
    x = _scaled(row, value[told] * ratio[feature], len(label))
    w, b = fit(row[mine], feature[mine], x[mine], label, use.astype(float), 1 << BITS, L1, L2, ROUNDS)
    return ratio, b, w, np.bincount(row, x * w[feature], len(label)) + b


def learn(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float, float] | None:
    """The features, their ratios and weights; intercept, and the calibration's slope and intercept."""
    label = np.array([r["label"] for r in rows], float)
    if len(set(label)) < 2:
        return None
    fold = np.array([zlib.crc32(str(r["id"]).encode()) // 5 % FOLDS for r in rows])
    data = _values([r["text"] for r in rows])
    ratio, b, w, raw = _fitted(*data, label, np.ones(len(rows), bool))
    apart = raw.copy()
    for k in range(FOLDS):
        use = fold != k
        if len(set(label[use])) == 2:
            apart[~use] = _fitted(*data, label, use)[3][~use]
    share, size = np.array([r["share"] for r in rows]), np.bincount(label.astype(int), minlength=2)
    slope, intercept = calibrate(apart, label, share / size[label.astype(int)] * size.sum())
    known = np.flatnonzero(ratio)
    return known.astype(np.int32), ratio[known].astype(np.float32), w[known].astype(np.float32), b, slope, intercept


def scores(texts: list[bytes], features: np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float, slope: float, intercept: float) -> np.ndarray:
    """``features``: at each one's number its place in ``ratios`` and ``weights``, else -1."""
    row, feature, value = _values(texts, features >= 0)
    at = features[feature]
    raw = np.bincount(row, _scaled(row, value * ratios[at], len(texts)) * weights[at], len(texts)) + bias
    return sigmoid(slope * raw + intercept)


def toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``id, score`` (0 to 1) for each row; ``allowed``: a condition on ``id`` for rows to learn from."""
    model = labelled.train(labelled.sample(docs, labels, label_col, allowed, id_col, text_col), learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.full(1 << BITS, -1, np.int32)
        if model:
            places[model[0]] = np.arange(len(model[0]))
        for b in slices(batches, 1):
            score = scores([t or b"" for t in b.column(1).to_pylist()], places, *model[1:]) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, score double")
