"""Periodic runs of words: descending-LCP Kruskal over the suffixes of each text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no
neighbouring word extends. If a run of period q spans n words, then its first word and the word q later begin
suffixes whose longest common prefix (LCP) is n - q; and as q is the smallest period, no other member of that
class of suffixes lies between the two. So: sort the suffixes, take the LCPs of neighbours in that order, and
unite classes by decreasing LCP in a union-find whose classes keep their positions in order. Two positions that
become neighbours in a union at level l have exactly the LCP l; if they are at most l apart they seed a
repetition. It is kept if it can't be extended to the left, and of seeds with the same bounds the smallest
period counts, which drops multiples of the period.

LEAST words make a run, so its seed has an LCP of LEAST / 2 at least: n >= max(LEAST, 2 q) gives
n - q >= max(LEAST - q, q). Descending therefore ends there, and only positions whose LEAST / 2 words come
again in the same text are sorted at all. Many texts share one sort, kept apart by their number.

A text is one row: its runs are found in the task that holds it, in time n log n, with memory of some 100
bytes a word; texts are put together up to CHUNK words only.

Defined cases: a null text has no words. A text of a null doc_id is never rewritten. Repeated rows give
repeated results, an empty table none. Columns other than doc_id and text aren't looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, CHUNK = 12, 200_000
_WORDS = re.compile("[^ \t-\r]+").findall
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]  # start, length, period


def rewritten(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a planted repetition, in one document of ten by the hash of its id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def _joined(rank: np.ndarray, second: np.ndarray, by: int, end: np.ndarray) -> np.ndarray:
    """Ranks of what rank stands for followed by what second stands for, `by` words later; nothing follows an end."""
    at = np.arange(len(rank))
    follows = np.where(at + by < end, second[np.minimum(at + by, len(rank) - 1)] + 1, 0)
    return np.unique(rank * (len(rank) + 1) + follows, return_inverse=True)[1]


def _suffixes(word: np.ndarray, end: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, class of each by its first `least` words), for positions whose class has several."""
    n = len(word)
    rank = np.unique(text * (int(word.max()) + 1) + word, return_inverse=True)[1]
    known, spans = {1: rank}, 1
    while spans * 2 <= least:
        known[spans * 2] = _joined(known[spans], known[spans], spans, end)
        spans *= 2
    rank, covered = known[spans], spans
    for part in sorted(known, reverse=True):  # least as a sum of powers of two
        if covered + part <= least:
            rank, covered = _joined(rank, known[part], covered, end), covered + part
    size = np.bincount(rank)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = first[rank]  # the place of a suffix in the order, as far as it is known: that of its class
    several = np.flatnonzero((size[rank] > 1) & (np.arange(n) + least <= end))
    open_, span = several, least
    while len(open_):
        follows = np.where(open_ + span < end[open_], place[np.minimum(open_ + span, n - 1)], -1)
        order = np.lexsort((follows, place[open_]))
        now, follows = open_[order], follows[order]
        was = place[now]
        begins = np.concatenate(([True], (was[1:] != was[:-1]) | (follows[1:] != follows[:-1])))
        index = np.arange(len(now))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], was[1:] != was[:-1])), index, 0))
        part = np.maximum.accumulate(np.where(begins, index, 0))
        place[now] = was + part - group
        alone = begins & np.concatenate((begins[1:], [True]))
        open_, span = now[~alone], span * 2
    several = several[np.argsort(place[several])]
    return several, rank[several]


def _common(word: list[int], end: list[int], order: list[int], known: list[int], least: int) -> list[tuple[int, int, int]]:
    """(LCP, position, the position before it in suffix order), positions of one class only; in the order of the text each LCP is at least the last one less one."""
    before = {p: q for p, q, c, d in zip(order[1:], order, known[1:], known, strict=False) if c == d}
    found, last, lcp = [], -2, 0
    for p in sorted(before):
        q = before[p]
        lcp = max(lcp - 1, least) if p == last + 1 else least
        most = end[p] - max(p, q)
        while lcp < most and word[p + lcp] == word[q + lcp]:
            lcp += 1
        found.append((lcp, p, q))
        last = p
    return found


def _seeds(links: list[tuple[int, int, int]]) -> Iterator[Run]:
    """(position, next position, LCP) of positions that become neighbours at a distance within their LCP."""
    owner: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        root = x
        while (up := owner.get(root, root)) != root:
            root = up
        while x != root:
            owner[x], x = root, owner.get(x, x)
        return root

    for lcp, p, q in sorted(links, reverse=True):
        a, b = find(p), find(q)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(small) > len(large):
            a, b, large, small = b, a, small, large
        for i, x in enumerate(small):
            at = bisect(large, x)
            if at and x - large[at - 1] <= lcp and (not i or small[i - 1] < large[at - 1]):
                yield large[at - 1], x, lcp
            if at < len(large) and large[at] - x <= lcp and (i + 1 == len(small) or small[i + 1] > large[at]):
                yield x, large[at], lcp
        owner[b] = a
        if len(small) * 8 < len(large):
            for x in small:
                large.insert(bisect(large, x), x)
        else:
            large = sorted(large + small)
        members[a] = large


def runs_of(texts: list[list[str]], least: int = LEAST) -> list[list[Run]]:
    """The runs of each text (start, length, period), by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return [[] for _ in texts]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    text = np.repeat(np.arange(len(texts)), lengths)
    word = pd.factorize(np.array([w for t in texts for w in t], object))[0].astype(np.int64)
    end = (first + lengths)[text]
    shortest = -(-least // 2)
    order, known = _suffixes(word, end, text, shortest)
    if not len(order):
        return [[] for _ in texts]
    words, ends = word.tolist(), end.tolist()
    begin, owner = first.tolist(), text.tolist()
    periods: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    for a, b, lcp in _seeds(_common(words, ends, order.tolist(), known.tolist(), shortest)):
        start = begin[owner[a]]
        if b - a + lcp >= least and (a == start or words[a - 1] != words[b - 1]):
            bounds, found = (a - start, b - a + lcp), periods[owner[a]]
            found[bounds] = min(b - a, found.get(bounds, b - a))
    return [sorted(((s, n, q) for (s, n), q in p.items()), key=lambda r: (r[0], r[2])) for p in periods]


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without what repeats the first period of a run."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _row(doc_id: int | None, words: list[str], runs: list[Run]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = _sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, digest, _sha(" ".join(collapsed(words, runs))))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and words of rows, at most CHUNK words together unless one row has more."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            words = _WORDS(text.as_py() or "")
            if texts and n + len(words) > CHUNK:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(words)
            n += len(words)
    if texts:
        yield ids, texts


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    for ids, texts in _chunks(batches):
        texts = [rewritten(w, i) for w, i in zip(texts, ids, strict=True)]
        rows = [_row(*r) for r in zip(ids, texts, runs_of(texts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def run_digests(docs: DataFrame) -> DataFrame:
    """One row for each document: its runs, after the planted repetition, as counts, the longest run and digests."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_digests, SCHEMA)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _chunks(batches):
        rows = [(i, *r) for i, found in zip(ids, runs_of(texts), strict=True) for r in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "period"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Every run of every text as it is: doc_id, start (word number), length, period."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_listed, "doc_id long, start long, length long, period long")


def _without(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            texts = part.column(at).to_pylist()
            words = [_WORDS(t or "") for t in texts]
            short = [t if not r else " ".join(collapsed(w, r)) for t, w, r in zip(texts, words, runs_of(words), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(short, pa.string()), *part.columns[at + 1 :]], schema=part.schema)


def without_periodic_runs(docs: DataFrame) -> DataFrame:
    """docs, where texts with runs are their kept words joined by one space; other texts and columns stay as they are."""
    at = [c.lower() for c in docs.columns].index("text")
    return docs.mapInArrow(lambda batches: _without(batches, at), docs.schema)
