"""Plain versions of operators, written from their definitions, for small texts."""

import re
from collections import defaultdict

from inkproof.llm import substring

GEAR = [int(x) for x in substring._GEAR]


def chunks(text):
    """(start, end, words, bytes) of each chunk: boundaries by a hash that is rolled byte by byte."""
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00\x20\x09-\x0D]+", text)]
    if not words:
        return []
    h, after = 0, {}
    for i, b in enumerate(text):
        h = (2 * h + GEAR[b]) % 65536
        after[i] = h
    strong = [k == 0 or b"\0" in text[words[k - 1][1] : a] or after[a - 1] & (0b11 << 10) == 0 for k, (a, _) in enumerate(words)]
    begins = [k for k, s in enumerate(strong) if s]
    out = []
    for b, e in zip(begins, [*begins[1:], len(words)]):
        inner = [b]
        if e - b > 32:
            inner += [k for k in range(b + 1, e) if after[words[k][0] - 1] & (1 << 12) == 0]
        for x, y in zip(inner, [*inner[1:], e]):
            out += range(x, y, 32) if y - x > 32 else [x]
    return [(words[x][0], words[y - 1][1], y - x, text[words[x][0] : words[y - 1][1]]) for x, y in zip(out, [*out[1:], len(words)])]


def windows(found):
    """(first, last) of the shortest runs of 20 words or more, on from each chunk and back from each."""
    n = [c[2] for c in found]
    out = set()
    for i in range(len(n)):
        on = next((j for j in range(i, len(n)) if sum(n[i : j + 1]) >= 20), None)
        back = next((j for j in range(i, -1, -1) if sum(n[j : i + 1]) >= 20), None)
        out |= {(i, on)} if on is not None else set()
        out |= {(back, i)} if back is not None else set()
    return out


def substring_dedup(texts):
    """id -> the text without the windows that a smaller id has, and how many chunks went; ``texts``: pairs of id and text."""
    cut = [(i, t, chunks(t.encode())) if i is not None and t else (i, t, []) for i, t in texts]
    owner = defaultdict(lambda: 1 << 62)
    key = lambda found, w: tuple(c[3] for c in found[w[0] : w[1] + 1])
    for i, _, found in cut:
        for w in windows(found):
            owner[key(found, w)] = min(owner[key(found, w)], i)
    out = []
    for i, t, found in cut:
        gone = {k for w in windows(found) if owner[key(found, w)] < i for k in range(w[0], w[1] + 1)}
        kept, raw = b"", (t or "").encode()
        at = 0
        for k in sorted(gone):
            kept += raw[at : found[k][0]]
            at = found[k + 1][0] if k + 1 < len(found) else len(raw)
        out.append((i, None if t is None else (kept + raw[at:]).decode(), len(gone)))
    return out
