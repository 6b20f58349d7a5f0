"""Hashed n-grams and logistic regression in numpy, for one task's batch of texts.

A text over ``BLOCK`` bytes is read in blocks that end before white space. Each begins with the end
of the block before (its last word, and at least ``_OVERLAP`` bytes), so no word, pair or n-gram is
cut or lost: those that lie in the repeated bytes alone are left to the block before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 18
_OVERLAP = 16
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_PRIME, _GOLDEN = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_POWERS = np.cumprod(np.full(64, _PRIME, np.uint32), dtype=np.uint32)


def segments(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``BLOCK`` bytes, each but the first beginning with white space; no word is cut."""
    at = 0
    while len(text) - at > BLOCK and (cut := _WHITE.search(text, at + BLOCK)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _end_of(segment: bytes) -> bytes:
    """What the next block repeats of this one: its last word, from that word's beginning on, and at least ``_OVERLAP`` bytes."""
    stop = len(segment.rstrip(b" \t\n\x0b\x0c\r"))
    begin = max((segment.rfind(w, 0, stop) for w in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")), default=-1) + 1
    if len(segment) - stop > _OVERLAP:  # of long white space its end will do
        return segment[begin:stop] + segment[-_OVERLAP:]
    return segment[min(begin, max(0, len(segment) - _OVERLAP)) :]


def blocks(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts, A-Z lower-cased and each ended by a zero byte, in blocks: the bytes, the text's number for each, and how many the block before had already."""
    part, owner, size = [], [], 0
    for i, text in enumerate(texts):
        if part and size + len(text) > BLOCK:
            yield *_joined(part, owner), 0
            part, owner, size = [], [], 0
        if len(text) > BLOCK:
            before = b""
            for segment in segments(text.lower()):
                yield *_joined([before + segment], [i]), len(before)
                before = _end_of(before + segment)
        else:
            part.append(text.lower())
            owner.append(i)
            size += len(text) + 1
    if part:
        yield *_joined(part, owner), 0


def _joined(part: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"\0".join(part) + b"\0", np.uint8), np.repeat(np.array(owner, np.int64), [len(p) + 1 for p in part])


def characters(data: np.ndarray, owner: np.ndarray, seen: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """A block's characters, each as a number made of its UTF-8 bytes, with the text's number; and how many of them the block before had."""
    first = (data & 0xC0) != 0x80
    if first.all():
        return data.astype(np.uint32), owner, seen
    starts = np.flatnonzero(first)
    inner = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = data[starts[0] :].astype(np.uint32) << (8 * np.minimum(inner, 3)).astype(np.uint32)
    return np.add.reduceat(value, starts - starts[0], dtype=np.uint32), owner[starts], int(np.count_nonzero(first[:seen]))


def _index(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    return (h * _GOLDEN) >> np.uint32(32 - bits)


def char_grams(data: np.ndarray, sizes: tuple[int, ...], bits: int, seen: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the positions at which an n-gram of bytes (or characters) begins, and its feature; none within the first ``seen``."""
    wide, inside = data.astype(np.uint32), data != 0
    h, ok = wide, inside
    for n in range(2, max(sizes) + 1):
        h, ok = h[:-1] * _PRIME + wide[n - 1 :], ok[:-1] & inside[n - 1 :]
        if n in sizes:
            at = np.flatnonzero(ok)
            at = at[at > seen - n] if seen else at
            yield at, _index(h[at] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF), bits)


def word_grams(data: np.ndarray, bits: int, seen: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and pairs of adjacent words: the position where each begins, and its feature; none within the first ``seen`` bytes."""
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return
    at = np.flatnonzero(~space)
    word = np.cumsum(np.isin(at, starts, assume_unique=True)) - 1
    value = data[at] * _POWERS[(at - starts[word]) & 63]
    h = np.add.reduceat(value, np.searchsorted(at, starts), dtype=np.uint32)
    new = starts >= seen
    yield starts[new], _index(h[new], bits)
    joined = ~np.logical_or.reduceat(data == 0, starts)[:-1] & new[1:]  # no text ends between the two
    yield starts[:-1][joined], _index((h[:-1] * _PRIME ^ h[1:])[joined], bits)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, features: np.ndarray, values: np.ndarray, label: np.ndarray, weight: np.ndarray, dims: int, l1: float, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of an elastic-net logistic regression over a sparse matrix, by accelerated proximal steps.

    rows, features, values: the matrix's entries; label: 0 or 1, weight: of each row.
    """
    n = len(label)
    weight = weight / weight.sum()
    norm = np.bincount(rows, values * values, n)
    step = 4 / (np.max(norm, initial=0) * 1.0 + 1 + 4 * l2)
    w, b = np.zeros(dims), 0.0
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        error = weight * (sigmoid(np.bincount(rows, values * v[features], n) + c) - label)
        grad = np.bincount(features, values * error[rows], dims) + l2 * v
        moved = v - step * grad
        new_w, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0), c - step * error.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / new_t
        v, c = new_w + k * (new_w - w), new_b + k * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def calibrate(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of Platt's scaling: label ~ sigmoid(slope * raw + intercept); targets are smoothed by its rule."""
    if not len(raw):
        return 1.0, 0.0
    ones = label.sum()
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    mean, spread = raw.mean(), raw.std() + 1e-9
    x = (raw - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method on two parameters
        p = sigmoid(a * x + b)
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-12
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(g * x).sum() + 1e-3 * a, g.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return a / spread, b - a * mean / spread
