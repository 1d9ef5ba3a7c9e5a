"""Language of code-switched text by a linear-chain conditional random field over its words.

A word's score for a language comes from hashed affixes, character n-grams, its script, and what a lexicon says:
how much likelier the word is in one language than in others, counted over all labelled texts. Learned transitions
tie neighbouring words together. Forward-backward gives each word its probabilities; a text's language is the one
with the greatest sum of these over its words, its score their mean.

Labels are of whole texts, so the field is fitted on sequences put together from stretches of texts in different
languages, each word labelled by its text's language: at most SAMPLE labelled texts, the same number of each language
where there are enough, the first by a hash of doc_id, and STRETCHES stretches of each, from anywhere in it. The
lexicon has the LEXICON commonest words; counts are of all labelled texts.

A chain is a product of small matrices, so all words that a task has at hand are one chain, in which a text's first
word forgets what was before: it is cut into blocks whose products are formed side by side, whatever the lengths
of the texts.

Defined cases: a text that is null or without letters is `und` with score 0, and so are all texts if nothing could be
learned. Ties go to the language that sorts first. A null doc_id is neither held out nor learned from. Repeated rows
give repeated results, an empty table none. Columns other than doc_id, text and, to learn from, lang aren't looked at.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, STRETCHES, STRETCH, LEXICON = 2_000, 4, (3, 30), 20_000
BUCKETS, CHUNK, KNOWN, COUNTED = 1 << 15, 200_000, 300_000, 500_000
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def _buckets(codes: list[np.ndarray], salt: int) -> np.ndarray:
    """Buckets of tuples of characters, given by place."""
    h = np.full(len(codes[0]), salt * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for c in codes:
        h = (h ^ c) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def features(distinct: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of all words' affixes, n-grams, scripts and lexicon entries."""
    code = np.frombuffer("".join([f"<{w}>" for w in distinct]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in distinct])
    first = np.cumsum(length + 2) - length - 1  # behind the edge
    word = np.repeat(np.arange(len(distinct)), length + 2)
    found = [(_buckets([code[first] >> np.uint64(7)], 1), np.arange(len(distinct)))]
    for n in (2, 3):
        inner = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :])
        found.append((_buckets([code[inner + i] for i in range(n)], n), word[inner]))
    for n in (1, 2, 3, 4):
        some = np.flatnonzero(length >= n)
        if n < 4:
            found.append((_buckets([code[first[some] + i] for i in range(n)], 10 + n), some))
        found.append((_buckets([code[first[some] + length[some] - n + i] for i in range(n)], 20 + n), some))
    power = np.cumprod(np.full(int(length.max()) + 2, 0x100000001B3, np.uint64))
    whole = np.add.reduceat(code * power[np.arange(len(code)) - (first - 1)[word]], first - 1)
    found.append((_buckets([whole], 30), np.arange(len(distinct))))
    entries = [lexicon.get(w) for w in distinct]
    some = np.array([i for i, e in enumerate(entries) if e is not None], np.int64)
    none = np.array([i for i, e in enumerate(entries) if e is None], np.int64)
    found.append((_buckets([np.zeros(len(none), np.uint64)], 40), none))
    steps = np.array([entries[i] for i in some], np.uint64).reshape(len(some), len(next(iter(lexicon.values()), [])))
    found += [(_buckets([steps[:, i]], 50 + i), some) for i in range(steps.shape[1])]
    return np.concatenate([b for b, _ in found]), np.concatenate([w for _, w in found])


def _summed(weight: np.ndarray, bucket: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(word, weight[bucket, j], n) for j in range(weight.shape[1])], 1)


def _blocks(first: np.ndarray) -> tuple[int, int]:
    steps = max(1, int(len(first) ** 0.5) // 2)
    return -(-len(first) // steps), steps


def chain(potential: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages (each row scaled to sum to one) of all words of a chain.

    potential (words x labels, positive), first (whether a word begins a text), start (labels), move (labels x labels).
    """
    n, k = potential.shape
    blocks, steps = _blocks(first)
    pad = blocks * steps - n
    e = np.concatenate([potential, np.ones((pad, k))]).reshape(blocks, steps, k)
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, steps)
    scaled = lambda x, axes: x / x.sum(axes, keepdims=True)
    # products of the blocks
    whole = np.broadcast_to(np.eye(k), (blocks, k, k))
    for t in range(steps):
        moved = np.where(f[:, t, None, None], whole.sum(2, keepdims=True) * start, whole @ move)
        whole = scaled(moved * e[:, t, None, :], (1, 2))
    # messages into each block, from either end
    into, back = np.ones((blocks, k)) / k, np.ones((blocks, k)) / k
    for b in range(1, blocks):
        into[b] = scaled(into[b - 1] @ whole[b - 1], 0)
    for b in range(blocks - 2, -1, -1):
        back[b] = scaled(whole[b + 1] @ back[b + 1], 0)
    alpha, beta = np.empty((blocks, steps, k)), np.empty((blocks, steps, k))
    for t in range(steps):
        into = scaled(np.where(f[:, t, None], start, into @ move) * e[:, t], 1)
        alpha[:, t] = into
    for t in range(steps - 1, -1, -1):
        beta[:, t] = back
        weighed = e[:, t] * back
        back = np.where(f[:, t, None], 1.0 / k, scaled(weighed @ move.T, 1))
    return alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]


@dataclass
class Field:
    """A linear-chain field over the words of a text."""

    labels: list[str]
    lexicon: dict[str, list[int]]
    weight: np.ndarray  # buckets x labels
    start: np.ndarray
    move: np.ndarray
    _row: dict[str, int] = field(default_factory=dict)
    _score: np.ndarray | None = None

    def emissions(self, distinct: list[str]) -> np.ndarray:
        """Scores of words, those of the last KNOWN or more words remembered."""
        if len(self._row) > KNOWN:
            self._row, self._score = {}, None
        new = [w for w in distinct if w not in self._row]
        if new:
            score = _summed(self.weight, *features(new, self.lexicon), len(new))
            self._row.update(zip(new, range(len(self._row), len(self._row) + len(new)), strict=True))
            self._score = score if self._score is None else np.concatenate([self._score, score])
        return self._score[[self._row[w] for w in distinct]]

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        """Probabilities (words x labels) of the words of all texts, one after the other."""
        code, distinct = pd.factorize(np.array([w for t in texts for w in t], object))
        first = np.zeros(len(code), bool)
        lengths = np.array([len(t) for t in texts if t])
        first[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = True
        score = self.emissions(list(distinct))
        potential = np.exp(score - score.max(1, keepdims=True))[code]
        alpha, beta = chain(potential, first, np.exp(self.start), np.exp(self.move))
        both = alpha * beta
        return both / both.sum(1, keepdims=True)


def gradient(score: np.ndarray, first: np.ndarray, label: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of minus the log likelihood of the labels: by the words' scores, the start and the transitions."""
    k, n = score.shape[1], len(score)
    potential = np.exp(score - score.max(1, keepdims=True))
    alpha, beta = chain(potential, first, np.exp(start), np.exp(move))
    both = alpha * beta
    by_score = both / both.sum(1, keepdims=True)
    by_score[np.arange(n), label] -= 1
    later = np.flatnonzero(~first)
    pairs = alpha[later - 1][:, :, None] * np.exp(move) * (potential[later] * beta[later])[:, None, :]
    by_move = (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)
    np.add.at(by_move, (label[later - 1], label[later]), -1)
    return by_score, by_score[first].sum(0), by_move.reshape(k, k)


def train(labels: list[str], lexicon: dict[str, list[int]], sequences: list[list[tuple[str, int]]], epochs: int = 6, batch: int = 40, rate: float = 0.2, decay: float = 1e-3, seed: int = 5) -> Field:
    """AdaGrad over sequences of (word, label)."""
    k, rng = len(labels), np.random.default_rng(seed)
    weight, start, move = np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k))
    seen = [np.full_like(x, 1e-3) for x in (weight, start, move)]
    code, distinct = pd.factorize(np.array([w for s in sequences for w, _ in s], object))
    all_buckets, all_words = features(list(distinct), lexicon)
    by_word_first = np.argsort(all_words, kind="stable")
    all_buckets, ends = all_buckets[by_word_first], np.concatenate(([0], np.cumsum(np.bincount(all_words, minlength=len(distinct)))))
    parts = np.split(code, np.cumsum([len(s) for s in sequences])[:-1])
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), batch):
            part = [sequences[i] for i in order[at : at + batch]]
            first = np.zeros(sum(map(len, part)), bool)
            first[np.cumsum([0, *[len(s) for s in part[:-1]]])] = True
            some, code = np.unique(np.concatenate([parts[i] for i in order[at : at + batch]]), return_inverse=True)
            sizes = ends[some + 1] - ends[some]
            bucket = all_buckets[np.repeat(ends[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            word = np.repeat(np.arange(len(some)), sizes)
            score = _summed(weight, bucket, word, len(some))[code]
            by_score, by_start, by_move = gradient(score, first, np.array([y for s in part for _, y in s]), start, move)
            by_word = np.stack([np.bincount(code, by_score[:, j], len(some)) for j in range(k)], 1)
            used, place = np.unique(bucket, return_inverse=True)
            by_bucket = np.stack([np.bincount(place, by_word[word, j]) for j in range(k)], 1) / len(part) + decay * weight[used]
            seen[0][used] += by_bucket**2
            weight[used] -= rate * by_bucket / np.sqrt(seen[0][used])
            for x, g, s in ((start, by_start, seen[1]), (move, by_move, seen[2])):
                g = g / len(part) + decay * x
                s += g**2
                x -= rate * g / np.sqrt(s)
    return Field(labels, lexicon, weight.astype(np.float32), start, move)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) summed up within the task, as far as COUNTED entries go."""
    counts: dict[str, Counter] = {}

    def given() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            counts.setdefault(lang.as_py(), Counter()).update(w for w in words(text.as_py()) if len(w) <= 40)
            if sum(map(len, counts.values())) > COUNTED:
                yield given()
    if any(counts.values()):
        yield given()


def lexicon_of(docs: DataFrame, labels: list[str], size: int = LEXICON) -> dict[str, list[int]]:
    """Entries of the commonest words: for each label how likely the word is in it against all, in 5 steps. Words of over 40 letters aren't counted."""
    rows = _labelled(docs)
    counts = rows.select("text", "lang").mapInArrow(_counted, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    both = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
    top = both.orderBy(F.desc("n"), "word").limit(size).collect()  # at most `size` words
    share = np.array([[r.by.get(x, 0) for x in labels] for r in top], float).reshape(len(top), len(labels))
    share /= np.maximum(share.sum(0), 1)
    share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
    return {r.word: np.minimum(4, row * 5).astype(int).tolist() for r, row in zip(top, share, strict=True)}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, lang in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            rng, found = random.Random(zlib.crc32(f"{doc_id} {lang}".encode())), words(text)
            for _ in range(STRETCHES if found else 0):
                n = rng.randint(*STRETCH)
                at = rng.randrange(max(1, len(found) - n + 1))
                rows.append((doc_id, lang, " ".join(found[at : at + n])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "lang", "words"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field learned from the labelled texts of docs (doc_id, text, lang) that aren't held out."""
    rows = _labelled(docs)
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    labels = sorted(counts)
    if not labels:
        return Field([], {}, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    lexicon, each = lexicon_of(docs, labels), max(1, sample // len(labels))
    # of each language some three times as many by the hash as are wanted, and the first of these
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3.0 * each / n))])
    likely = rows.select("doc_id", "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < part[F.col("lang")] * float(1 << 31))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = likely.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).drop("r").distinct()
    found = rows.join(F.broadcast(few), ["doc_id", "lang"]).select("doc_id", "text", "lang").mapInArrow(_stretches, "doc_id long, lang string, words string")
    stretches = [(r.words.split(" "), labels.index(r.lang)) for r in found.orderBy("doc_id", "lang", "words").limit(sample * STRETCHES).collect()]
    rng = random.Random(3)
    rng.shuffle(stretches)
    sequences = []
    while stretches:
        taken = [stretches.pop() for _ in range(min(len(stretches), rng.randint(1, 5)))]
        sequences.append([(w, y) for ws, y in taken for w in ws])
    return train(labels, lexicon, sequences)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of rows, of some CHUNK words together (six characters each) unless one row has more."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            if texts and n + len(text or "") > 6 * CHUNK:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(text)
            n += len(text or "")
    if texts:
        yield ids, texts


def _lettered(text: str | None) -> list[str]:
    """The words that have a letter; other number signs count as letters to the pattern."""
    found = words(text)
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def predicted(docs: DataFrame, by: Field) -> DataFrame:
    """One row for each document: doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*by.labels, UNKNOWN], object)
        for ids, texts in _chunks(batches):
            found = [_lettered(t) for t in texts]
            best, score = np.full(len(ids), len(by.labels)), np.zeros(len(ids))
            some = np.flatnonzero([bool(f) for f in found])
            if len(some) and by.labels:
                lengths = np.array([len(found[i]) for i in some])
                sums = np.add.reduceat(by.marginals(found), np.concatenate(([0], np.cumsum(lengths)[:-1])), 0)
                best[some] = sums.argmax(1)
                score[some] = np.minimum(1.0, sums.max(1) / lengths)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_stretches(docs: DataFrame, by: Field) -> DataFrame:
    """Each text cut where its likeliest language changes: doc_id, start and n_words (of words with letters), lang, score (mean of its words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            found = [_lettered(t) for t in texts]
            if not any(found) or not by.labels:
                continue
            marginal = by.marginals(found)
            lengths = np.array([len(f) for f in found])
            text, number = np.repeat(np.arange(len(ids)), lengths), np.concatenate([np.arange(n) for n in lengths])
            best = marginal.argmax(1)
            cut = np.flatnonzero((number == 0) | np.concatenate(([True], best[1:] != best[:-1])))
            sizes = np.diff(np.append(cut, len(best)))
            score = np.add.reduceat(marginal.max(1), cut) / sizes
            columns = [pa.array([ids[i] for i in text[cut]], pa.int64()), pa.array(number[cut], pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([by.labels[i] for i in best[cut]], pa.string()), pa.array(score)], names=["doc_id", "start", "n_words", "lang", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, start long, n_words long, lang string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, by a field learned from docs itself."""
    return predicted(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
