"""Line dedup by an edit join over segments, in DataFrame functions only.

Lines that occur before, exactly or within EDITS edits, are taken out of documents. A line is trimmed of
spaces. From MIN_CHARS on it takes part in the edit join; shorter ones, where a few edits make another
word, are compared exactly if at least `shortest` long (1 in the query and the pipeline: every line that
isn't empty). Order is that of (doc_id, line), so the first of a class of alike lines stays where it is.

Exact repeats meet by two 64-bit hashes and the text itself. For the rest (after Li et al., "Pass-Join",
2011), lines are indexed by ranges of length, each a quarter of an octave. All lines of a range are split
alike: EDITS + 1 segments of one length, half of them counted from the line's start and half from its end.
Of two lines within EDITS edits, some segment i from the start is whole and stands at most i places from its
own in the other line, or one from the end likewise: otherwise i segments hold more than i edits each way,
EDITS + 1 together. So a line asks its own range, and the one below if that is within EDITS, for the
substrings at those few places, by equality of (range, segment, hash).

Where a segment is shared by many lines that aren't alike, they are dealt anew by what is left of a line
if only some of its characters are kept: characters fall into 2 EDITS + 2 classes, each edit touches two, so
two classes at least are kept whole, and lines that may be alike share the hash of such two.

Candidates are verified by a bit-parallel program in a band of EDITS around the diagonal (after Wu and
Manber, "Fast text searching allowing errors", 1992): bit k of word e says that the characters so far can be
matched with e edits, k - EDITS places off the diagonal; one step for each character moves all words.

Defined cases: null counts as the empty text and stays null. A document whose lines all go has the empty
text; no document goes. Rows that repeat a doc_id with the same text are one document to the join and keep
the same lines. A null doc_id comes last. Lines end at \\n only. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.links import BROADCAST_KEYS, linked
from recollect.shared import filtered_early, forget, written

EDITS, MIN_CHARS, SHORTEST = 3, 24, 1
#: Characters, the most frequent ones, that are dealt to classes one by one; all others are of class 0.
DEALT = 96
#: Characters, the most frequent ones, whose counts are compared before lines of one group are paired: 16 to a number.
COUNTED = 32


def _places(edits: int) -> list[tuple[int, int]]:
    """(segment, shift): segments from 0 at the start and from -1 at the end."""
    left = (edits + 2) // 2
    sides = [(i, i) for i in range(left)] + [(-1 - j, j) for j in range(edits + 1 - left)]
    return [(i, shift) for i, most in sides for shift in range(-most, most + 1)]


def _range(size: str) -> str:
    """SQL of the least length of the range of size: ranges are 8 wide, from 64 on a quarter of the octave."""
    return f"({size} - {size} % greatest(8, shiftleft(1, length(bin({size})) - 3)))"


def segment_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """From lines (id, line, size): (key, id, own); own keys are those of the line's own segments, the others are asked for only."""
    places = lambda *below: "array(" + ", ".join(f"named_struct('i', {i}, 'shift', {s}, 'below', {b})" for b in below for i, s in _places(edits)) + ")"
    each = lines.select("id", "line", "size", F.expr(_range("size")).alias("own_low"))
    each = each.withColumn("low_below", F.expr(f"if(size - {edits} < own_low and own_low > {MIN_CHARS}, {_range('(own_low - 1)')}, null)"))
    # of a line with one byte to a character, parts are cut from its bytes: their hash is the same, and nothing before them is read
    each = each.withColumn("bytes", F.expr("if(octet_length(line) = size, cast(line as binary), null)"))
    each = each.withColumn("p", F.explode(F.expr(f"if(low_below is null, {places(0)}, {places(0, 1)})")))
    each = each.withColumn("low", F.expr("if(p.below = 1, low_below, own_low)")).withColumn("m", F.expr(f"cast(low div {edits + 1} as int)"))
    each = each.withColumn("start", F.expr("cast(p.i * m + p.shift + if(p.i < 0, size, 0) + 1 as int)"))
    key = "if(bytes is null, xxhash64(low, p.i, substring(line, start, m)), xxhash64(low, p.i, substring(bytes, start, m)))"
    return each.select(F.expr(key).alias("key"), "id", F.expr("p.below = 0 and p.shift = 0").alias("own"))


def frequent(lines: DataFrame) -> list[tuple[str, int]]:
    """The DEALT most frequent characters with their counts, the most frequent first."""
    count = lines.select(F.explode(F.split("line", "")).alias("c")).where("c <> ''").groupBy("c").count()
    return [(r["c"], r["count"]) for r in count.orderBy(F.desc("count"), "c").limit(DEALT).collect()]


def class_sets(counts: list[tuple[str, int]], edits: int) -> list[str]:
    """The characters of classes 1, 2 ...: frequent ones are dealt so that classes weigh about the same."""
    weights, sets = [0] * (2 * edits + 2), [""] * (2 * edits + 2)
    for c, n in counts:
        k = weights.index(min(weights))
        weights[k], sets[k] = weights[k] + n, sets[k] + c
    return sets[1:]


def kept_classes(sets: list[str]) -> list[Column]:
    """For each class the line without the characters of all others."""
    dealt, named = "".join(sets), F.col("line")
    if dealt:
        named = F.regexp_replace("line", "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in dealt) + "]", "")
    others = lambda s: "".join(x for x in sets if x != s)
    return [F.translate("line", dealt, ""), *[F.translate(named, others(s), "") if s else F.lit("") for s in sets]]


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _trimmed(a: str, b: str) -> str:
    """SQL of a struct of a and b without most of their common start and end, found by comparing ever smaller parts."""
    pair = f"named_struct('a', {a}, 'b', {b})"
    for start in (True, False):
        at = "p + 1" if start else "length(z.{0}) - p - n div k + 1"
        part = lambda x: f"substring(z.{x}, {at.format(x)}, n div k)"
        step = f"(p, k) -> cast(p + if({part('a')} = {part('b')}, n div k, 0) as int)"
        common = _let("n", "least(length(z.a), length(z.b))", f"aggregate(array(2, 4, 8, 16), 0, {step})")
        rest = "substring(z.{0}, p + 1)" if start else "left(z.{0}, length(z.{0}) - p)"
        pair = _let("z", pair, _let("p", common, f"named_struct('a', {rest.format('a')}, 'b', {rest.format('b')})"))
    return pair


def within(a: str, b: str, edits: int) -> Column:
    """Whether two texts are within a number of edits (4 at most, for the bits of a number).

    Lane e of a number has a bit k if the characters of a so far are within e edits of those of b up to
    k - edits places further. A step keeps a bit if the next characters are the same; a bit of the lane below
    comes in place (a replaced character), one lower (one of a left out) or, as soon as it is new, one higher
    (one of b left out)."""
    if not 0 <= edits <= 4:
        raise ValueError(f"edits must be from 0 to 4, not {edits}")
    lane, lanes = 2 * edits + 2, edits + 1
    every = sum(1 << lane * e for e in range(lanes))
    low = lambda bits: f"{every * ((1 << bits) - 1)}L"
    begin = sum(1 << lane * e + edits + j for e in range(lanes) for j in range(e + 1))
    same = " | ".join(f"if(get(ys, c.i + {k - edits}) = c.x, {every << k}L, 0L)" for k in range(2 * edits + 1))
    moved = f"((s & ({same})) | (shiftleft(s, {lane}) | shiftleft(s, {lane - 1})) & {low(2 * edits + 1)})"
    further = " | ".join(["m", *[f"shiftleft(m & {low(2 * edits + 1 - j)}, {j * (lane + 1)})" for j in range(1, lanes)]])
    step = _let("m", moved, f"({further}) & {(1 << lane * lanes) - 1}L")
    places = "transform(split(z.a, ''), (x, i) -> named_struct('x', x, 'i', i))"
    last = _let("ys", "split(z.b, '')", f"aggregate({places}, {begin}L, (s, c) -> if(s = 0L, 0L, {step}))")
    gap = "(length(z.b) - length(z.a))"
    test = f"case when abs{gap} > {edits} then false when z.a = '' or z.b = '' then true else shiftright({last}, {lane * edits + edits} + {gap}) & 1L = 1L end"
    return F.expr(f"if(abs(length({a}) - length({b})) > {edits}, false, {_let('z', _trimmed(a, b), test)})")


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    """(d, h, n, line, size, x, y) of the lines that take part; d and h name the document, x and y the line."""
    whole = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), F.split("text", "\n", -1).alias("lines"))
    each = whole.select("d", "h", F.posexplode("lines").alias("n", "line"))
    each = each.withColumn("line", F.trim("line")).withColumn("size", F.length("line")).where(F.col("size") >= shortest)
    return each.withColumn("x", F.xxhash64("line")).withColumn("y", F.xxhash64(F.lit(1), "line"))


def count_bits(characters: list[str]) -> list[Column]:
    """Numbers of 16 characters' counts in a line, each in four bits of which one changes when a count changes by one."""
    count = lambda c: F.col("size") - F.length(F.replace("line", F.lit(c), F.lit("")))
    left = lambda x, n: F.call_function("shiftleft", x.cast("long"), n)
    four = lambda n: F.shiftright(left(F.lit(15), n % 8), 4).bitwiseAND(F.lit(15))  # noqa: E731 - 0, 1, 3, 7, 15, 14, 12, 8
    either = lambda x, y: x.bitwiseOR(y)
    return [reduce(either, [left(four(count(c)), F.lit(4 * j)) for j, c in enumerate(characters[i : i + 16])]) for i in range(0, len(characters), 16)]


def _bound(x: str, y: str, bits: list[str], edits: int) -> Column:
    """What lines within the edits meet: an edit changes the length by one at most, and the counts of two characters by one each."""
    apart = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in bits) or "0"
    return F.expr(f"abs({x}.size - {y}.size) <= {edits} and {apart} <= {2 * edits}")


def verified(pairs: DataFrame, texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """The pairs (a, b) of ids whose lines are within the edits."""
    side = lambda name: texts.select(F.col("id").alias(name), F.col("line").alias(f"line_{name}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").where(within("line_a", "line_b", edits)).select("a", "b")


def alike_lines(distinct: DataFrame, edits: int = EDITS) -> DataFrame:
    """From distinct lines (id, line, size): the components (id, component) of those within the edits of another."""
    long = distinct.where(F.col("size") >= MIN_CHARS).select("id", "line", "size")
    stored: list[DataFrame] = []

    def fetch(ids: DataFrame) -> DataFrame:
        with filtered_early(ids.sparkSession):
            return written(long.join(ids.where("id >= 0"), "id"), "wanted")

    def finer(ids: DataFrame, texts: DataFrame) -> DataFrame:
        open_lines = written(texts.join(ids, "id"), "open")
        characters = frequent(open_lines)
        kept = kept_classes(class_sets(characters, edits))
        counts = [n.alias(f"n{i}") for i, n in enumerate(count_bits([c for c, _ in characters[:COUNTED]]))]
        stored[:] = [written(open_lines.select("id", "size", *[k.alias(f"k{i}") for i, k in enumerate(kept)], *counts), "classes")]
        two = [f"xxhash64({i}, {j}, k{i}, k{j})" for i, j in combinations(range(len(kept)), 2)]
        return stored[0].select(F.expr(f"explode(array({', '.join(two)}))").alias("key"), "id", F.lit(True).alias("own"))

    def bound(ids: DataFrame, texts: DataFrame) -> tuple[DataFrame, Callable[[str, str], Column]]:
        counts = [c for c in stored[0].columns if c.startswith("n")]
        return stored[0].join(ids, "id").select("id", "size", *counts), lambda x, y: _bound(x, y, counts, edits)

    return linked(segment_keys(long, edits), fetch, lambda pairs, texts: verified(pairs, texts, edits), bound, finer)[1]


def dropped_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(d, h, n, near): the lines to take out; near if the line has no exact match before it."""
    lines = _lines(docs, shortest)
    distinct = lines.groupBy("x", "y", "line", "size").agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id())
    distinct = written(distinct, "distinct")
    component = written(alike_lines(distinct, edits), "components")
    classes = distinct.select("id", "x", "y", "times").join(component, "id", "left").where("times > 1 or component is not null")
    classes = written(classes.select("id", "x", "y", F.coalesce("component", "id").alias("class")), "classes")
    forget(distinct)  # the texts: from here on lines are numbers
    few = classes.count() <= BROADCAST_KEYS
    found = written(lines.select("x", "y", "d", "h", "n").join(F.broadcast(classes) if few else classes, ["x", "y"]).drop("x", "y"), "found")
    place = F.struct(F.col("d").isNull().alias("none"), "d", "h", "n")
    firsts = found.groupBy("id", "class").agg(F.min(place).alias("first"))
    stays = firsts.groupBy("class").agg(F.min("first").alias("stays"))
    firsts = written(firsts.join(stays, "class").select("id", "first", "stays"), "firsts")
    return found.join(firsts, "id").where("not (d <=> stays.d and h = stays.h and n = stays.n)").select(
        "d", "h", "n", F.expr("d <=> first.d and h = first.h and n = first.n").alias("near")
    )


def line_decisions(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """docs in a struct (row) with n_lines, n_dropped, n_near and kept_text."""
    gone = dropped_lines(docs, edits, shortest).groupBy("d", "h", "n").agg(F.max("near").alias("near"))
    gone = gone.groupBy("d", "h").agg(F.sort_array(F.collect_list("n")).alias("gone"), F.count_if("near").alias("n_near"))
    gone = gone.withColumnsRenamed({"d": "gone_d", "h": "gone_h"})
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"))
    joined = rows.join(gone.hint("shuffle_hash"), F.expr("h = gone_h and d <=> gone_d"), "left")  # so texts aren't sorted
    # a mark for each line up to the last that goes, so that lines are looked up by position; named by _let, as a column would be made again for each line
    marks = "split(array_join(transform(gone, (x, i) -> concat(repeat('0', x - coalesce(get(gone, i - 1), -1) - 1), '1')), ''), '')"
    kept = F.expr(_let("marks", marks, "array_join(filter(split(row.text, '\n', -1), (x, i) -> not coalesce(get(marks, i) = '1', false)), '\n')"))
    return joined.select(
        "row", "d", F.expr("coalesce(octet_length(row.text) - octet_length(replace(row.text, '\n', '')) + 1, 0)").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("kept_text"),
    )


def line_digests(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped, n_near, text_sha256 of what stays."""
    found = line_decisions(docs.select("doc_id", "text"), edits, shortest)
    return found.select(F.col("d").alias("doc_id"), "n_lines", "n_dropped", "n_near", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """docs with the text that stays, and n_chars, where there is such a column, counted anew."""
    found = line_decisions(docs, edits, shortest)
    new = {"text": F.col("kept_text"), **({"n_chars": F.length("kept_text").cast("long")} if "n_chars" in docs.columns else {})}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
