"""Personal data: four exact kinds, and more of them by bootstrapped contexts.

Base spans are found by rule: e-mail and IPv4 addresses, payment cards (Luhn) and phone numbers. They are
the seeds. Around every seed and every other token that has the looks of an identifier (see MIN_DIGITS)
stand lexical patterns: the words before it and behind it, together with its look (an @, or three dots and the
order of magnitude of its digits; the exact shape isn't asked for, or nothing new in looks could be found).
Candidates are tokens without white space, and groups of digits joined by single spaces, dots, hyphens and
brackets. Patterns and instances (the strings themselves, as hashes) form a graph that Spark scores in rounds:

    confidence of a pattern for a kind = sum of its known instances' scores / (its instances + 1)
    score of an unknown instance       = 1 - product over its confident patterns of (1 - confidence)

A pattern counts with MIN_KNOWN distinct known instances and MIN_PATTERN confidence; an instance that
reaches MIN_INSTANCE is known in the next round. Scores only grow as more is known, and rounds go on until
nothing new is. In the end unknown tokens whose string is known are spans of
that kind too. They never overlap base spans, which all stay.

Defined cases: null counts as the empty text and has no span. Positions count code points, ends are
exclusive. Rows that repeat are separate rows, and one instance to the graph. A pattern that much of a
corpus shares is a sum over pre-aggregated rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.shared import written

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS, MIN_KNOWN, MIN_PATTERN, MIN_INSTANCE = 4, 2, 0.5, 0.6
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_EDGE = ".,;:!?\"'`()[]{}<>|*#$%&="
_GROUPS = re.compile(r"\+?[0-9(][0-9]*(?:[ .()-]{1,2}[0-9]+)+")
_FIND, _SPACE, _WORD = re.compile("[0-9@]"), re.compile(r"\s"), re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ belongs to one match at most: the longest run before it that no match before has taken."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind in the order of KINDS, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def _others(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Candidates with MIN_DIGITS digits or an @ that overlap no taken span (sorted by start, and so by end)."""
    starts, at = [s for s, _ in taken], 0
    while m := _FIND.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, m.start())
        end = space.start() if space else len(text)
        groups = _GROUPS.match(text, start)
        if groups and groups.end() > end:
            end = groups.end()
        at = max(end, m.end())
        while start < end and text[start] in _EDGE and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        token = text[start:end]
        if sum("0" <= c <= "9" for c in token) < MIN_DIGITS and "@" not in token:
            continue
        i = bisect_right(starts, end - 1)
        if not any(e > start for _, e in taken[max(0, i - 2) : i]):
            yield start, end


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _look(token: str) -> str:
    """What patterns ask of a token: an @, or three dots and how many digits (as a power of two)."""
    return "@" if "@" in token else f"{'.' * (token.count('.') >= 3)}{sum('0' <= c <= '9' for c in token).bit_length()}"


def _words_before(text: str, end: int, most: int) -> list[str]:
    """The last words (runs of letters and digits) before a place, in order."""
    out: list[str] = []
    while len(out) < most:
        while end and not text[end - 1].isalnum():
            end -= 1
        start = end
        while start and text[start - 1].isalnum():
            start -= 1
        if start == end:
            break
        out.append(text[start:end].lower())
        end = start
    return out[::-1]


def _mention(text: str, start: int, end: int) -> tuple[int, list[int]]:
    """The instance and its patterns."""
    token, left, look = text[start:end], _words_before(text, start, 2), _look(text[start:end])
    word = _WORD.search(text, end)
    right, patterns = word.group().lower() if word else "", []
    if left:
        glued = "" if text[start - 1].isspace() else "glued"
        patterns.append(_hash("L1", look, glued, left[-1]))
        if len(left) > 1:
            patterns.append(_hash("L2", look, glued, *left))
        if right:
            patterns.append(_hash("LR", look, glued, left[-1], right))
    if right:
        patterns.append(_hash("R1", look, "" if text[end].isspace() else "glued", right))
    return _hash(token.lower()), patterns


_FOUND = pa.schema([
    ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.list_(pa.string())), ("base_sha256", pa.string()),
    ("mentions", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))),
])
_FOUND_DDL = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, base_sha256 string, "
    "mentions array<struct<kind: string, start: int, end: int, instance: long, patterns: array<long>>>"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = base_spans(text or "")
            merged: list[tuple[int, int]] = []
            for s, e in sorted((s, e) for _, s, e in spans):
                if merged and s < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            named = [(k, s, e, *_mention(text, s, e)) for k, s, e in spans]
            named += [(None, s, e, *_mention(text, s, e)) for s, e in _others(text or "", merged)]
            base = [f"{k}:{s}:{e}" for k, s, e in spans]
            count = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
            mentions = [dict(zip(("kind", "start", "end", "instance", "patterns"), m, strict=True)) for m in named]
            rows.append((doc_id, *count, base, hashlib.sha256(",".join(base).encode()).hexdigest(), mentions))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)] if rows else [pa.array([], f.type) for f in _FOUND], schema=_FOUND)


def learned_instances(mentions: DataFrame) -> DataFrame:
    """From mentions (kind or null, instance, patterns): the unknown instances that became known, (instance, kind)."""
    edges = written(mentions.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "edges")
    seeds = written(mentions.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    known, new, before = seeds, seeds.limit(0), (0, 0.0)
    while True:
        support = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support"), F.count("*").alias("known"))
        confident = (
            support.where(F.col("known") >= MIN_KNOWN).join(sizes, "pattern")
            .withColumn("confidence", F.col("support") / (F.col("size") + 1)).where(F.col("confidence") >= MIN_PATTERN)
            .select("pattern", "kind", "confidence")
        )
        scores = (
            edges.join(confident, "pattern").join(seeds.select("instance").distinct(), "instance", "left_anti")
            .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        )
        best = scores.groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score")
        new = written(best.where(F.col("score") >= MIN_INSTANCE), "known")
        now = new.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if now[0] <= before[0] and now[1] <= before[1] + 1e-6 * now[0]:
            return new.select("instance", "kind")
        known, before = seeds.unionByName(new), now


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_learned."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(texts.mapInArrow(_find, _FOUND_DDL).withColumn("uid", F.monotonically_increasing_id()), "found")
    mentions = found.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    learned = learned_instances(mentions)
    order = F.expr(f"array_position(array({', '.join(repr(k) for k in KINDS)}), kind)")
    more = mentions.where("kind is null").drop("kind").join(learned, "instance").select("uid", F.struct(order.alias("at"), "start", "end", "kind").alias("s"))
    more = more.groupBy("uid").agg(F.collect_list("s").alias("more"))
    base = F.expr(
        f"transform(filter(mentions, m -> m.kind is not null), m -> named_struct('at', array_position(array({', '.join(repr(k) for k in KINDS)}), m.kind), "
        "'start', m.start, 'end', m.end, 'kind', m.kind))"
    )
    joined = found.join(more, "uid", "left").withColumn("all", F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<at: bigint, start: int, end: int, kind: string>>")))))
    return joined.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256",
        F.expr("array_join(transform(all, s -> concat_ws(':', s.kind, s.start, s.end)), ',')").alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).alias("n_learned"),
    )
