"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton is built of a bounded sample of its labelled text. A text is
cross-parsed with each: from where a phrase begins, the automaton follows the longest stretch that
occurs in the language's sample; where it ends, the next phrase begins. The language that needs
the fewest phrases wins, each phrase weighted with the bits that name a place in that sample
(log2 of its length) and the sum divided by the letters read. Texts and samples are read as one
string of lower-cased letters, with a mark for all that lies between two words and at either end,
and phrases run across words.

A batch's texts are parsed abreast, in lanes of ``LANE`` letters. Each lane is first parsed as if a
phrase began there, then mended from the state in which the lane before it ends, until both parses
begin a phrase at the same place; from there on they are one. A lane whose end is changed by this
mends the next. So the count is that of a parse from left to right.

Transitions of all automata lie in one array, each state's shifted to where its slots are free, so
its size is that of the transitions, whatever the scripts. No language is left out.

A null text or one without letters is ``und`` with score 0, as is every text if nothing was
learned. Ties go to the language first in order. The score is the softmax of the negative bits per
letter. Rows that repeat are judged alike. An empty table gives no rows. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .labelled import train

#: Rows of each language to learn from, and the characters in a row that are used of each, from a place given by its id's hash.
PER_LANGUAGE, STRETCH = 60, 1_000
#: Letters in a lane, and letters that are parsed at a time.
LANE, PART = 256, 1 << 22
UNKNOWN = "und"
_MARK, _OTHER = 0, 1


def sample(docs: DataFrame, allowed: Column | None, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``id, label, text, cut``: of each language the rows with the smallest hashed ids (limited on each task before the shuffle), of long texts a stretch."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.where(allowed) if allowed is not None else rows
    rows = rows.withColumn("order", F.xxhash64("id"))
    n = F.char_length("text")
    place = F.pmod(F.xxhash64("order"), F.greatest(n - STRETCH, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("id", "label", "order", F.substring("text", place, F.lit(STRETCH)).alias("text"), (n > STRETCH).alias("cut"))
    first = F.row_number().over(Window.partitionBy("label").orderBy("order", "id", "text"))
    return rows.withColumn("n", first).where(F.col("n") <= PER_LANGUAGE).select("id", "label", "text", "cut")


def strings_of(texts: pa.Array) -> list[str]:
    """Each text as one string of letters and marks; empty without letters."""
    found = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\PL+", " "), " ")
    return [f" {t} " if t else "" for t in found.to_pylist()]


def automaton(strings: list[np.ndarray]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of all strings."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for string in strings:
        last = 0
        for c in string.tolist():
            if c in moves[last]:  # a generalised automaton: the prefix is there already
                q = moves[last][c]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    moves.append(dict(moves[q])), link.append(link[q]), length.append(length[last] + 1)
                    clone, p = len(moves) - 1, last
                    link[q] = clone
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    last = clone
                continue
            moves.append({}), link.append(0), length.append(length[last] + 1)
            new, p = len(moves) - 1, last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    moves.append(dict(moves[q])), link.append(link[q]), length.append(length[p] + 1)
                    clone = len(moves) - 1
                    link[q] = link[new] = clone
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
            last = new
    return moves


def shifted(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, owner, to``: state s moves with letter c to to[base[s] + c] if owner[base[s] + c] is s.

    States with over 32 moves lie one after another. Others with several moves draw shifts until one
    fits, those with most moves first, all of a size at a time, in a table that grows if they don't
    find room; states with one move then take what is left. So the table is little larger than its moves.
    """
    sizes = np.fromiter(map(len, moves), np.int64, len(moves))
    many, single = int(sizes[sizes > 1].sum()), int((sizes == 1).sum())
    large = np.flatnonzero(sizes > 32)
    spans = np.array([max(moves[s]) + 1 for s in large.tolist()], np.int64)
    room = 2 * width + int(spans.sum()) + max(3 * many, many + single)
    base, owner, to = np.zeros(len(moves), np.int32), np.full(room + width, -1, np.int32), np.zeros(room + width, np.int32)
    for s, at in zip(large.tolist(), (width + np.cumsum(spans) - spans).tolist()):
        base[s] = at
        for c, t in moves[s].items():
            owner[at + c], to[at + c] = s, t
    rng, most, rounds = np.random.default_rng(0), 32, 0
    while most > 1:
        states = np.flatnonzero((sizes > most // 2) & (sizes <= most) & (sizes > 1))
        most //= 2
        codes = np.array([c for s in states.tolist() for c in moves[s]], np.int64)
        target = np.array([t for s in states.tolist() for t in moves[s].values()], np.int32)
        while len(states):
            rounds += 1
            if rounds % 16 == 0:
                more = room // 4
                room, owner, to = room + more, np.append(owner, np.full(more, -1, np.int32)), np.append(to, np.zeros(more, np.int32))
            which = np.repeat(np.arange(len(states)), sizes[states])
            shift = rng.integers(0, room, len(states))
            slots = shift[which] + codes
            fits = owner[slots] < 0
            first = np.zeros(len(slots), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            ok = np.logical_and.reduceat(fits & first, np.cumsum(sizes[states]) - sizes[states])
            here = ok[which]
            owner[slots[here]], to[slots[here]] = states[which[here]], target[here]
            base[states[ok]] = shift[ok]
            states, codes, target = states[~ok], codes[~here], target[~here]
    alone = np.array([(s, *next(iter(m.items()))) for s, m in enumerate(moves) if len(m) == 1], np.int64).reshape(-1, 3)
    slots = width + np.flatnonzero(owner[width:] < 0)[: len(alone)]
    base[alone[:, 0]], owner[slots], to[slots] = slots - alone[:, 1], alone[:, 0], alone[:, 2]
    return base, np.append(owner, np.full(width, -1, np.int32)), np.append(to, np.zeros(width, np.int32))


class Model:
    """All languages' automata in one sparse table."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        letters = sorted({c for strings in samples.values() for c in "".join(strings)} - {" "})
        self.letters, width = letters, len(letters) + 2
        self.lut = None
        self.roots, self.bits, moves = [], [], []
        for name in self.names:
            root = len(moves)
            found = automaton([self.encode(t) for t in samples[name]])
            moves += [{c: root + t for c, t in m.items()} for m in found]
            self.roots.append(root)
            self.bits.append(float(np.log2(max(2, sum(map(len, samples[name]))))))
        self.base, self.owner, self.to = shifted(moves, width)
        self.starts = [np.array([moves[r].get(c, r) for c in range(width)], np.int32) for r in self.roots]
        self.lut = None  # made in each worker

    def encode(self, text: str) -> np.ndarray:
        if self.lut is None:
            self.lut = np.full(0x110000, _OTHER, np.int32)
            self.lut[[ord(c) for c in self.letters]] = np.arange(2, len(self.letters) + 2)
            self.lut[ord(" ")] = _MARK
        return self.lut[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def _step(self, state: np.ndarray, c: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The states after letter ``c``, and whether a phrase begins with it."""
        slot = self.base[state] + c
        goes = self.owner[slot] == state
        return np.where(goes, self.to[slot], self.starts[j][c]), ~goes | (state == self.roots[j])

    def phrases(self, parts: list[np.ndarray], entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of phrases that begin in each part, and the states at its end, for each language; ``entry``: the states in which the parts are entered."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        lanes = np.maximum(1, -(-sizes // LANE))
        part = np.repeat(np.arange(len(parts)), lanes)
        number = np.arange(len(part)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        length = np.minimum(LANE, sizes[part] - number * LANE)
        inside = np.arange(LANE)[:, None] < length
        letters = np.full((len(part), LANE), _OTHER, np.int32)
        letters[inside.T] = np.concatenate(parts) if len(parts) else np.empty(0, np.int32)
        letters = np.ascontiguousarray(letters.T)
        counts, ends = np.zeros((len(parts), len(self.names)), np.int64), np.zeros((len(parts), len(self.names)), np.int32)
        for j, root in enumerate(self.roots):
            begins, exits = np.zeros(letters.shape, bool), np.full(len(part), root, np.int32)
            state = np.full(len(part), root, np.int32)
            for k in range(LANE):
                state, begins[k] = self._step(state, letters[k], j)
                exits = np.where(length == k + 1, state, exits)
            enter = np.concatenate(([root], exits[:-1])).astype(np.int32)
            firsts = number == 0
            enter[firsts] = root if entry is None else entry[:, j]
            todo = np.flatnonzero(enter != root)
            while len(todo):
                now, state, old = todo, enter[todo], exits.copy()
                for k in range(LANE):
                    state, begun = self._step(state, letters[k, now], j)
                    apart = ~(begun & begins[k, now]) & (k < length[now])  # else the parses have met
                    begins[k, now] = np.where(k < length[now], begun, False)
                    over = apart & (k + 1 == length[now])
                    exits[now[over]] = state[over]
                    now, state = now[apart & ~over], state[apart & ~over]
                    if not len(now):
                        break
                moved = np.flatnonzero((exits[:-1] != old[:-1]) & (number[1:] > 0))
                enter[moved + 1] = exits[moved]
                todo = moved + 1
            counts[:, j] = np.bincount(part, (begins & inside).sum(axis=0), len(parts))
            ends[:, j] = exits[np.cumsum(lanes) - 1]
        return counts, ends


def learn(rows: list[dict]) -> Model | None:
    samples: dict[str, list[str]] = {}
    for r, t in zip(rows, strings_of(pa.array([r["text"] for r in rows], pa.string()))):
        words = t.split()
        if r.get("cut") and len(words) > 2:  # the words at either end may be cut
            t = f" {' '.join(words[1:-1])} "
        if words:
            samples.setdefault(r["label"], []).append(t)
    return Model(samples) if samples else None


def judge(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """The winning language of each text, and its score."""
    n, strings = len(texts), strings_of(texts)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n)
    letters = np.array([len(t) - t.count(" ") for t in strings])
    found = np.zeros((n, len(model.names)), np.int64)
    group: list[int] = []
    for i in [*np.flatnonzero(letters).tolist(), None]:
        if group and (i is None or sum(len(strings[g]) for g in group) + len(strings[i]) > PART):
            found[group] = _counted([strings[g] for g in group], model)
            group = []
        if i is not None:
            group.append(i)
    bits = found * np.array(model.bits) / np.maximum(letters, 1)[:, None]
    best = bits.argmin(axis=1)
    share = np.exp(bits.min(axis=1, keepdims=True) - bits)
    score = np.where(letters > 0, 1 / share.sum(axis=1), 0.0)
    return [model.names[j] if k else UNKNOWN for j, k in zip(best, letters)], score


def _counted(strings: list[str], model: Model) -> np.ndarray:
    """Phrases of each string; a huge one comes alone, and is read in parts of ``PART`` letters, each entered where the one before ends."""
    if len(strings) > 1 or len(strings[0]) <= PART:
        codes = model.encode("".join(strings))
        return model.phrases(np.split(codes, np.cumsum([len(t) for t in strings])[:-1]))[0]
    total, state = 0, None
    for k in range(0, len(strings[0]), PART):
        count, state = model.phrases([model.encode(strings[0][k : k + PART])], state)
        total = total + count
    return total


def identify(docs: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, lang_pred, score`` for each row; ``allowed``: a condition on ``id`` for rows to learn from."""
    model = train(sample(docs, allowed, id_col, text_col, lang_col), learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            names, score = judge(b.column(1), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")
