"""Words, hashes and shingles of many texts at once, in numpy.

A word is a longest run of ASCII letters and digits and of non-ASCII characters, in lower case. Hashes
are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_PIECE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _tables[name] = np.multiply.accumulate(out)
    return _tables["up"][:n], _tables["down"][:n]


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, hash of each word) in a piece of UTF-8 that ends no word's middle."""
    word = _IS_WORD[data]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets: text i has words offsets[i] to offsets[i+1])."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        if not group:
            return
        sizes = np.array([len(x) + 1 for x in group])
        start, h = _hash_piece(np.frombuffer(b"\n".join(group) + b"\n", np.uint8))
        per = np.bincount(np.searchsorted(np.cumsum(sizes), start, side="right"), minlength=len(group))
        np.add.at(counts, owners, per[: len(group)])
        hashes.append(h)
        group.clear()
        owners.clear()

    held = 0
    for i, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        while len(data) > _PIECE:  # a very long text goes in pieces, cut between words where there is such a place
            cut = max(data.rfind(b" ", 1, _PIECE), data.rfind(b"\n", 1, _PIECE))
            if cut < 1:
                cut = min((x for x in (data.find(b" ", 1), data.find(b"\n", 1)) if x > 0), default=len(data))
            flush()
            group.append(data[:cut])
            owners.append(i)
            flush()
            data, held = data[cut:], 0
        group.append(data)
        owners.append(i)
        held += len(data)
        if held >= _PIECE:
            flush()
            held = 0
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; a shorter text with any word is one shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, k)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += words[j : n - k + 1 + j] * _STEP[j]
    return mix(out + U(k))


def shingle_bags(texts: list[str | None], k: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, sorted, and how often each occurs."""
    words, at = word_hashes(texts)
    for i in range(len(texts)):
        yield np.unique(shingle_hashes(words[at[i] : at[i + 1]], k), return_counts=True)


def bag_overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of two multisets: sum of minima over sum of maxima; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)
