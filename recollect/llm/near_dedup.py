"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A text is the multiset of its five-word shingles, and two texts are near copies if the Jaccard similarity
of the multisets (sum of minima over sum of maxima) is 0.8 or more. Signatures follow Ertl, "BagMinHash"
(2018): every shingle owns independent Poisson processes over its discretised weight. The levels are
dyadic blocks (0,1], (1,2], (2,4], (4,8] ...; the process of a block has a rate in proportion to the
block's width, each of its points carries a component and a weight level, and a text takes part in those
points whose level does not exceed its count. A component of the signature is the identity of the earliest
point that reaches it, so two texts agree in it with a probability equal to their similarity. Points are
made up to a horizon at which all components are reached with high probability; a text that misses one
is done again with twice the horizon, so the work of a text hardly depends on its length.

Signatures are cut into bands; texts that share a band are candidates, and each link is verified on the
true multisets. 30 bands of 6 miss a pair at 0.8 once in 9,000 times, and one at 0.85 once in a million.

Defined cases: null and empty texts, and texts without a word, have no shingle and stay alone. A text
of fewer than five words is one shingle of all its words. Rows with the same multiset (exact copies
among them) are one node, whatever their ids. Of a class the row with the smallest doc_id stays, nulls
last; among rows that repeat one doc_id any one row. Columns of the input are carried in a struct and
can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.links import linked
from recollect.llm.words import U, bag_overlap, mix, shingle_bags
from recollect.shared import filtered_early, written

BANDS, ROWS, SHINGLE, THRESHOLD = 30, 6, 5, 0.8
_GROUP = 256


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Signatures (one row of m 64-bit values for each bag) of bags that aren't empty."""
    out = np.zeros((len(bags), m), np.uint64)
    todo, horizon = np.arange(len(bags)), 4.0
    while len(todo):
        got, full = _signatures([bags[i] for i in todo], m, horizon)
        out[todo[full]] = got[full]
        todo, horizon = todo[~full], horizon * 2
    return out


def _signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int, horizon: float) -> tuple[np.ndarray, np.ndarray]:
    size = [len(x) for x, _ in bags]
    owner = np.repeat(np.arange(len(bags)), size)
    element, count = np.concatenate([x for x, _ in bags]), np.concatenate([c for _, c in bags])
    until = (np.log(m) + horizon) / np.bincount(owner, count, len(bags))
    best = np.full(len(bags) * m, np.inf)
    slots, times, names = [], [], []
    for block in range(int(count.max()).bit_length() + 1):
        low, width = (1 << block - 1, 1 << block - 1) if block else (0, 1)
        held = np.flatnonzero(count > low)
        if not len(held):
            break
        seed, who, most = mix(element[held] + U((0xD1B54A32D192ED03 * (block + 1)) % (1 << 64))), owner[held], count[held]
        end, rate, time = until[who], float(m * width), np.zeros(len(held))
        for step in range(1, 1 << 40):
            draw = mix(seed + U((0x9E3779B97F4A7C15 * step) % (1 << 64)))
            time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
            keep = time <= end
            if not keep.all():
                seed, who, most, end, time, draw = seed[keep], who[keep], most[keep], end[keep], time[keep], draw[keep]
            if not len(seed):
                break
            name = mix(draw ^ U(0xA0761D6478BD642F))
            slot = who * m + ((name >> U(32)) * U(m) >> U(32)).astype(np.int64)
            if width > 1:
                inside = low + 1 + ((name & U(0xFFFFFFFF)) * U(width) >> U(32)).astype(np.int64) <= most
                slot, name, at = slot[inside], name[inside], time[inside]
            else:
                at = time
            np.minimum.at(best, slot, at)
            slots.append(slot)
            times.append(at)
            names.append(name)
    slot, at, name = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
    first = at == best[slot]
    got = np.zeros(len(bags) * m, np.uint64)
    got[slot[first]] = name[first]
    return got.reshape(-1, m), np.isfinite(best.reshape(-1, m)).all(1)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signatures.reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U(0xE7037ED1A0B428DB), cut.shape[:2]).copy()
    for j in range(rows):
        out = mix(out ^ cut[:, :, j]) + U(j)
    return mix(out).view(np.int64)


def _with_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _GROUP):
            part = batch.slice(at, _GROUP)
            bags = list(shingle_bags(part.column("row").field("text").to_pylist(), SHINGLE))
            some = [i for i, (x, _) in enumerate(bags) if len(x)]
            bands: list[list[int] | None] = [None] * len(bags)
            node: list[int | None] = [None] * len(bags)
            check: list[int | None] = [None] * len(bags)
            if some:
                found = band_hashes(bag_minhash([bags[i] for i in some], BANDS * ROWS), BANDS, ROWS)
                for i, row in zip(some, found, strict=True):
                    name = hashlib.blake2b(bags[i][0].tobytes() + bags[i][1].astype("<i8").tobytes(), digest_size=16).digest()
                    node[i], check[i], bands[i] = *np.frombuffer(name, "<i8").tolist(), row
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array([int(c.sum()) for _, c in bags], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["row", "doc_id", "node", "check", "size", "bands"],
            )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            bags = list(shingle_bags(part.column("t").to_pylist(), SHINGLE))
            ids = np.repeat(np.array(part.column("id").to_pylist(), np.int64), [len(x) for x, _ in bags])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.concatenate([x for x, _ in bags]).view(np.int64)), pa.array(np.concatenate([c for _, c in bags]).astype(np.int64))],
                names=["id", "shingle", "n"],
            )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            a = list(shingle_bags(part.column("ta").to_pylist(), SHINGLE))
            b = list(shingle_bags(part.column("tb").to_pylist(), SHINGLE))
            keep += [bag_overlap(x, y) >= THRESHOLD for x, y in zip(a, b, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def signed(docs: DataFrame) -> DataFrame:
    """docs as a table in the shared folder: row (a struct of its columns), doc_id, node and check (which name the multiset), size, bands, uid."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in ("node", "check", "size")], T.StructField("bands", T.ArrayType(T.LongType()))])
    return written(rows.mapInArrow(_with_signatures, schema).withColumn("uid", F.monotonically_increasing_id()), "signed")


def near_duplicates(table: DataFrame) -> DataFrame:
    """From signed(): (node, check, class) of every multiset; the class is one number for all near copies."""
    nodes = table.where("node is not null").groupBy("node", "check").agg(F.min("uid").alias("uid"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    groups = nodes.select(F.explode("bands").alias("key"), "id", F.lit(True).alias("own"))

    def fetch(ids: DataFrame) -> DataFrame:
        places = written(nodes.join(ids, "id").select("uid", "id"), "places")
        with filtered_early(ids.sparkSession):
            return written(table.select("uid", F.col("row.text").alias("t")).join(places.where("uid >= 0"), "uid").select("id", "t"), "wanted")

    def bound(ids: DataFrame, texts: DataFrame) -> tuple[DataFrame, Callable[[str, str], Column]]:
        """What no other open text has can't overlap: with size shingles each and met of them met elsewhere,
        two texts overlap in the smaller met at most."""
        shingles = texts.join(ids, "id").mapInArrow(_shingles, "id long, shingle long, n long")
        alone = shingles.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("id").alias("id"), F.sum("n").alias("n")).where("texts = 1")
        alone = alone.groupBy("id").agg(F.sum("n").alias("alone"))
        sizes = nodes.select("id", "size").join(ids, "id").join(alone, "id", "left")
        met = sizes.select("id", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("met"))
        most = lambda x, y: F.least(f"{x}.met", f"{y}.met")
        union = lambda x, y: F.col(f"{x}.size") + F.col(f"{y}.size") - most(x, y)
        return met, lambda x, y: most(x, y) >= F.lit(THRESHOLD - 1e-9) * union(x, y)

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        side = lambda name: texts.select(F.col("id").alias(name), F.col("t").alias(f"t{name}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(_alike, "a long, b long")

    _, component = linked(groups, fetch, verify, bound)
    return nodes.select("node", "check", "id").join(component, "id", "left").select("node", "check", F.coalesce("component", "id").alias("class"))


def decided(table: DataFrame) -> DataFrame:
    """For each row of signed(): uid, doc_id, class_id (doc_id of the row that stays), class_size, kept."""
    classes = written(near_duplicates(table), "classes")
    placed = written(table.select("uid", "doc_id", "node", "check").join(classes, ["node", "check"], "left"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))
    stays = placed.where("class is not null").groupBy("class").agg(F.min(order).alias("best"), F.count("*").alias("class_size"))
    best = F.coalesce("best.uid", "uid")
    return placed.join(stays, "class", "left").select(
        "uid", "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), (best == F.col("uid")).alias("kept"),
    )


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id, class_size, kept."""
    return decided(signed(docs)).drop("uid")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, one for each class of near copies."""
    table = signed(docs)
    return table.join(decided(table).where("kept").select("uid"), "uid").select("row.*")
