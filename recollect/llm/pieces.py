"""Token ids of short pieces of text, encoding what many pieces share only once.

A piece is cut by the tokenizer's own splitting pattern into the parts that it encodes independently, and
each distinct part is given to the tokenizers library once. Only Latin text is cut here, where the pattern
means the same to every regex library; other pieces go to the library whole.
"""

from __future__ import annotations

import gc
import os
from array import array

import regex

#: Latin text, without the one letter that becomes two characters in lower case.
_LATIN = regex.compile("[\\0-įı-ɏ]*").fullmatch
_BATCH = 4096


def one_core() -> None:
    """For a Python worker: no threads of the library's own, and no search for cycles among millions of strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    gc.freeze()
    gc.set_threshold(200_000, 50, 100)


class Parts:
    """Ids of pieces as bytes, in the array code given; lower where the tokenizer itself starts with that."""

    def __init__(self, tokenizer, pattern: str, code: str, lower: bool = False, whole: str | None = None) -> None:
        self.tokenizer, self.code, self.lower, self.whole = tokenizer, code, lower, whole
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _cut(self, piece: str) -> list[str]:
        if not _LATIN(piece) or self.whole and self.whole in piece:
            return [piece]
        return self.split(piece.lower() if self.lower else piece)

    def of(self, pieces: list[str]) -> list[bytes]:
        cut, known = [self._cut(p) for p in pieces], self.known
        new = list({a for parts in cut for a in parts if a not in known})
        for at in range(0, len(new), _BATCH):
            some = new[at : at + _BATCH]
            for a, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[a] = array(self.code, e.ids).tobytes()
        return [b"".join([known[a] for a in parts]) for parts in cut]
