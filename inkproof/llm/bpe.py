"""Byte-level BPE ids of a public tokenizer file, fast enough for a whole corpus.

The file's own library defines the ids, at about a megabyte a second. The usual text is encoded
by a second library from the same file's vocabulary, whose ids are its merge ranks; that takes a
sixth of the time and gives the same ids, which the tests compare. Texts with the special string,
or with characters newer than the Unicode version that both libraries' tables surely share, go to
the file's own library.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Pre-tokens whose token counts a worker keeps while it looks for boundaries.
CACHED = 60_000


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        chars = _byte_of_char()
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self._words: dict[str, int] = {}

    def own(self, text: str) -> bool:
        """Whether only the file's own library may encode this text."""
        return bool(self._special.search(text)) or not text.isascii() and bool(_newer().search(text))

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids if self.own(text) else self.ranked.encode_ordinary(text)

    def pack(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return array("I", self.ids(text)).tobytes()

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """Where pre-tokens end, in code points, and the number of tokens up to there."""
        ends, counts, n = [], [], 0
        if self.own(text):
            e = self.library.encode(text, add_special_tokens=False)
            for k, (word, (_, end)) in enumerate(zip(e.word_ids, e.offsets)):
                if k + 1 == len(e.word_ids) or e.word_ids[k + 1] != word:
                    ends.append(end)
                    counts.append(k + 1)
        else:
            at = 0
            for piece in self.pattern.findall(text):
                at += len(piece)
                size = self._words.get(piece)
                if size is None:
                    size = len(self.ranked.encode_ordinary(piece))
                    if len(self._words) < CACHED:
                        self._words[piece] = size
                n += size
                ends.append(at)
                counts.append(n)
        return ends, counts


@lru_cache(1)
def _newer() -> re.Pattern:
    """Characters that Unicode 3.2 didn't have: engines may class them differently."""
    import unicodedata

    old = unicodedata.ucd_3_2_0
    newer, start = [], None
    for c in range(128, 0x110001):
        is_new = c < 0x110000 and old.category(chr(c)) == "Cn"
        if is_new and start is None:
            start = c
        elif not is_new and start is not None:
            newer.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(newer)}]")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
