"""Quality rules: counted rules, then a calibrated logistic regression of hashed n-grams against a fixed threshold.

Words are runs of anything but ASCII white space. The classifier's features are the shares of
words, pairs of adjacent words and n-grams of 2 to 4 characters (A-Z lower-cased), hashed, each
divided by the root of its share in the sample, so that a text's raw score is one weighted mean.
It is fitted to a bounded sample of labelled rows (see ``labelled``), calibrated on rows kept
apart, and scores whole texts in Arrow batches.

A null or empty text has no words, so the counted rules reject it. Without labelled rows of both
classes the counted rules alone decide. Rows that repeat are judged alike. An empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import slices
from .linear import blocks, calibrate, char_grams, characters, fit, sigmoid, word_grams

BITS, SIZES = 17, (2, 3, 4)
L1, L2, ROUNDS = 1e-5, 1e-5, 100
#: A text needs so many words, at most such a share (in %) of repeated ones, and such a probability of being good.
LEAST_WORDS, MOST_REPEATED, LEAST_PROBABILITY = 10, 20, 0.4
REPEAT_WINDOW = 5
SPACE, SYMBOLS, CONTINUED = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))
#: Texts are hashed in steps of so many bytes.
STEP = 1 << 16
_WHITE, _LINE = (np.isin(np.arange(256), list(cut)) for cut in (SPACE, b"\n"))
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS, _INVERSES = (np.cumprod(np.array([1] + [k] * STEP, np.uint64), dtype=np.uint64) for k in (int(_PRIME), pow(int(_PRIME), -1, 1 << 64)))


def _pieces(text: bytes, cut: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece between bytes in ``cut`` that has more than white space; equal pieces have equal ones."""
    found, hashed, size, solid = [np.empty(0, np.uint64)], np.uint64(0), 0, 0
    for at in range(0, len(text), STEP):  # what a piece has before the step is carried on
        data = np.frombuffer(text, np.uint8, min(STEP, len(text) - at), at)
        sums, marks = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.int64)
        np.cumsum((data + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:])
        np.cumsum(~_WHITE[data], out=marks[1:])
        ends = np.flatnonzero(cut[data])
        begins, stops = np.append(0, ends + 1), np.append(ends, len(data))
        h, has = (sums[stops] - sums[begins]) * _INVERSES[begins], marks[stops] - marks[begins]
        h[:1] = h[:1] * np.power(_PRIME, np.uint64(size), dtype=np.uint64) + hashed
        has[0] += solid
        size = len(data) - int(begins[-1]) + (0 if len(ends) else size)
        hashed, solid = h[-1], has[-1]
        found.append(h[:-1][has[:-1] > 0])
    return np.append(np.concatenate(found), hashed) if solid else np.concatenate(found)


def _covered(words: np.ndarray) -> int:
    """Words in windows of ``REPEAT_WINDOW`` words that are found twice or more."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for i in range(REPEAT_WINDOW):
        window += words[i : i + n]
        window ^= window >> np.uint64(29)
        window *= _MIX
    window ^= window >> np.uint64(32)
    order = np.sort(window)
    same = order[1:] == order[:-1]
    twice = order[1:][same & ~np.append(False, same[:-1])]
    del order
    if not len(twice):
        return 0
    covered, end = 0, 0  # up to where words are counted already
    for i in range(0, n, STEP):
        part = window[i : i + STEP]
        at = i + np.flatnonzero(twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part)
        if len(at):
            stops = at + REPEAT_WINDOW
            covered += int((stops - np.maximum(at, np.append(end, stops[:-1]))).sum())
            end = int(stops[-1])
    return covered


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = _pieces(text, _LINE)
    dup = len(lines) - len(np.unique(lines))
    del lines
    words = _pieces(text, _WHITE)
    chars = len(text.translate(None, SPACE + CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, dup, _covered(words)


def _features(data: np.ndarray, owner: np.ndarray, seen: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The text's number of each feature of a block, the feature and its group: words in the lower half, n-grams in the upper."""
    half = 1 << BITS - 1
    for at, f in word_grams(data, BITS - 1, seen):
        yield owner[at], f.astype(np.int64), 0
    chars, owner, seen = characters(data, owner, seen)
    for at, f in char_grams(chars, SIZES, BITS - 1, seen):
        yield owner[at], f.astype(np.int64) + half, 1


def _shares(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and share for each feature that a text has."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int32))]
    for data, owner, seen in blocks(texts):
        key, n = np.unique(np.concatenate([mine << BITS | f for mine, f, _ in _features(data, owner, seen)] or [found[0][0]]), return_counts=True)
        if seen:  # more of the text in the block before
            before = found.pop()
            key, where = np.unique(np.append(before[0], key), return_inverse=True)
            n = np.bincount(where, np.append(before[1], n), len(key))
        found.append((key, n.astype(np.int32)))
    row, feature = (np.concatenate([part(key).astype(np.int32) for key, _ in found]) for part in (lambda k: k >> BITS, lambda k: k & (1 << BITS) - 1))
    n = np.concatenate([n for _, n in found])
    del found
    group = 2 * row + (feature >> BITS - 1)
    return row, feature, (n / np.bincount(group, n, 2 * len(texts))[group]).astype(np.float32)


def learn(rows: list[dict]) -> tuple[np.ndarray, float, float, float] | None:
    """Weight of each feature's share, intercept, and the calibration's slope and intercept."""
    label = np.array([r["label"] for r in rows], float)
    apart = np.array([r["calibration"] for r in rows], bool)
    if len(set(label[~apart])) < 2:
        return None
    n, prior = len(rows), np.array([r["share"] for r in rows])
    row, feature, share = _shares([r["text"] for r in rows])
    use = ~apart[row]
    scale = 1 / np.sqrt(np.bincount(feature[use], share[use], 1 << BITS) / n + 1e-4)
    value = share * scale[feature]
    w, b = fit(row[use], feature[use], value[use], label, np.where(apart, 0.0, 1.0), 1 << BITS, L1, L2, ROUNDS)
    raw = np.bincount(row, value * w[feature], n) + b
    held = apart if len(set(label[apart])) == 2 else ~apart
    size = np.bincount(label[held].astype(int), minlength=2)
    slope, intercept = calibrate(raw[held], label[held], (prior / size[label.astype(int)] * size.sum())[held])
    return (w * scale).astype(np.float32), b, slope, intercept


def probabilities(texts: list[bytes], model: tuple[np.ndarray, float, float, float]) -> np.ndarray:
    weights, bias, slope, intercept = model
    total, size = np.zeros((2, len(texts))), np.zeros((2, len(texts)))
    for data, owner, seen in blocks(texts):
        for mine, f, group in _features(data, owner, seen):
            total[group] += np.bincount(mine, weights[f], len(texts))
            size[group] += np.bincount(mine, minlength=len(texts))
    return sigmoid(slope * ((total / np.maximum(size, 1)).sum(axis=0) + bias) + intercept)


def model_for(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    return labelled.train(labelled.sample(docs, labels, label_col, allowed, id_col, text_col), learn)


def judge(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the counts, ``base_failed``, ``probability`` and ``kept`` for each row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            texts = [t or b"" for t in b.column(1).to_pylist()]
            found = np.array([counts(t) for t in texts], np.int64).reshape(-1, 5)
            failed = (found[:, 0] < LEAST_WORDS) | (100 * found[:, 4] > MOST_REPEATED * found[:, 0])
            p = probabilities(texts, model) if model else np.ones(len(texts))
            columns = [b.column(0), *map(pa.array, found.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= LEAST_PROBABILITY))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *names, "base_failed", "probability", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows that :func:`judge` keeps, with all their columns, in one pass over the rows."""
    model, names, at = model_for(docs, labels, None, id_col, text_col, label_col), docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            ok = []
            for t in texts:
                n, *_, repeated = counts(t)
                ok.append(n >= LEAST_WORDS and 100 * repeated <= MOST_REPEATED * n)
            kept = np.array(ok, bool) & ((probabilities(texts, model) >= LEAST_PROBABILITY) if model else True)
            yield b.filter(pa.array(kept))

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, docs.schema)
