"""Hard negatives by inner product: coordinate pruning over length buckets.

Rows are dealt at random into blocks of about BLOCK and each anchor visits
every block. A block sorts its rows by length into buckets whose lengths differ
by less than SHRINK; each bucket keeps, for every coordinate of its unit
vectors, a list sorted by value. An anchor whose score must reach theta needs a
cosine of at least theta over both lengths: buckets that would need more than 1
are passed over with all that are shorter, and in the others the angle between
the anchor and an axis bounds the values that a row may have on it. The ranges
of the anchor's FOCUS largest coordinates are read off the sorted lists and
intersected, and what is left is multiplied out in whole numbers. theta rises
as better rows are found. Where even the narrowest range holds over half of a
bucket the whole bucket is multiplied out. No row that could count is lost.

A block sends on at most the wanted number of rows for each anchor (or anchor
and positive); the best of these are the result. A task holds one block and
one batch of anchors at a time, and no block is fuller because a label or a
vector is frequent.

Rows with a null id, label or vector, or with null or non-finite components,
take no part. Of rows with the same id the smallest by label, then vector,
takes part. Vectors are held against those of their own number of components.
Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm._common import stored, table

#: Expected rows of a block.
BLOCK = 8192
#: A bucket's shortest row has at least this share of its longest one's length.
SHRINK = 0.9
#: Rows of a bucket at most.
BUCKET = 2048
#: Coordinates whose lists are intersected.
FOCUS = 4
#: Room for rounding in the bounds, which are in floating point; scores are exact.
EPSILON = 1e-9
#: Whole numbers up to this are exact in floating point.
EXACT = 1 << 53

ANCHORS, POSITIVES, NEGATIVES = 100, 5, 10
#: Share of a positive's score that a negative's must have, in hundredths.
LOW, HIGH = 30, 90


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows with q."""
    if rows.size and int(np.abs(rows).max()) * int(np.abs(q).max()) * q.size >= EXACT:
        return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows], dtype=np.int64)
    return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)


class Bucket(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    longest: float
    #: By coordinate: values of the unit vectors in rising order, and whose they are.
    values: np.ndarray
    order: np.ndarray


class Lists:
    """Rows with one number of components in length buckets with sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        falling = np.lexsort((ids, -length))
        self.buckets, at = [], 0
        while at < len(falling):
            top = length[falling[at]]
            end = min(at + BUCKET, at + int(np.searchsorted(-length[falling[at:]], -SHRINK * top, side="right")))
            own = falling[at : max(end, at + 1)]
            unit = (rows[own] / np.maximum(length[own], 1e-300)[:, None]).T
            order = np.argsort(unit, axis=1).astype(np.int32)
            self.buckets.append(Bucket(ids[own], labels[own], rows[own], top, np.take_along_axis(unit, order, axis=1), order))
            at += len(own)

    def feasible(self, b: Bucket, q: np.ndarray, length: float, theta: float) -> np.ndarray | None:
        """Places of rows in b that may score theta or more; None: all of them."""
        if theta <= 0 or not length or not b.longest:
            return None if theta <= 0 else np.empty(0, np.int64)
        need = theta / (length * b.longest)
        if need > 1 + EPSILON:
            return np.empty(0, np.int64)
        unit, reach = q / length, math.acos(min(1.0, need))
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        ranges = []
        for f in focus:
            angle = math.acos(max(-1.0, min(1.0, unit[f])))
            low, high = math.cos(min(math.pi, angle + reach)) - EPSILON, math.cos(max(0.0, angle - reach)) + EPSILON
            ranges.append((int(np.searchsorted(b.values[f], low, side="left")), int(np.searchsorted(b.values[f], high, side="right"))))
        if min(y - x for x, y in ranges) * 2 > len(b.ids):
            return None
        hits = np.zeros(len(b.ids), dtype=np.uint8)
        for f, (x, y) in zip(focus, ranges, strict=True):
            hits[b.order[f, x:y]] += 1
        return np.flatnonzero(hits == len(focus))

    def visit(self, q: np.ndarray, theta) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, labels and scores of what may reach theta(), which is asked anew for each bucket, the longest rows first."""
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        for b in self.buckets:
            if theta() > length * b.longest * (1 + EPSILON):
                return  # all that follow are shorter
            own = self.feasible(b, q, length, theta())
            if own is None:
                yield b.ids, b.labels, products(b.rows, q)
            elif len(own):
                yield b.ids[own], b.labels[own], products(b.rows[own], q)


class Best:
    """The k best of low <= score <= high by score, then id."""

    def __init__(self, k: int, low: float = -math.inf, high: float = math.inf):
        self.k, self.low, self.high = k, low, high
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def theta(self) -> float:
        return float(self.scores[-1]) if len(self.ids) == self.k else self.low

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = (scores >= self.theta()) & (scores <= self.high)
        if fits.any():
            ids, scores = np.concatenate([self.ids, ids[fits]]), np.concatenate([self.scores, scores[fits]])
            first = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[first], scores[first]


def _positives(block: list[pd.DataFrame], anchors: pd.DataFrame, cache: dict) -> Iterator[tuple]:
    """The block's best rows of each anchor's own label."""
    for a, label, vector in zip(anchors["vec_id"], anchors["label"], anchors["vector"], strict=True):
        lists = _lists(block, cache, len(vector), label)
        best, q = Best(POSITIVES), np.asarray(vector, np.int64)
        for ids, _, scores in lists.visit(q, best.theta):
            other = ids != a
            best.add(ids[other], scores[other])
        yield from ((a, p, s) for p, s in zip(best.ids, best.scores, strict=True))


def _negatives(block: list[pd.DataFrame], anchors: pd.DataFrame, cache: dict) -> Iterator[tuple]:
    """The block's best rows of other labels in each positive's range."""
    for a, label, vector, wants in zip(anchors["vec_id"], anchors["label"], anchors["vector"], anchors["wants"], strict=True):
        best = {(w["positive_id"], w["score"]): Best(NEGATIVES, -(-LOW * w["score"] // 100), HIGH * w["score"] // 100) for w in wants}
        live = [b for b in best.values() if b.low <= b.high]
        if not live:
            continue
        lists = _lists(block, cache, len(vector), None)
        for ids, labels, scores in lists.visit(np.asarray(vector, np.int64), lambda: min(b.theta() for b in live)):  # noqa: B023 - used within the turn
            other = labels != label
            for b in live:
                b.add(ids[other], scores[other])
        yield from ((a, p, s, x, y) for (p, s), b in best.items() for x, y in zip(b.ids, b.scores, strict=True))


def _lists(block: list[pd.DataFrame], cache: dict, size: int, label: object) -> Lists:
    """The block's rows of one size, and of one label if asked for, as lists; made at the first anchor that needs them."""
    if "all" not in cache:
        cache["all"] = pd.concat(block, ignore_index=True) if block else None
    if (size, label) not in cache:
        rows = cache["all"]
        if rows is not None:
            rows = rows[(rows["vector"].map(len) == size) & (True if label is None else rows["label"] == label)]
        if rows is None or rows.empty:
            cache[size, label] = Lists(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, size), np.int64))
        else:
            cache[size, label] = Lists(rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), np.stack(rows["vector"].to_numpy()).astype(np.int64).reshape(len(rows), size))
    return cache[size, label]


def _visiting(look, columns: list[str]):
    """mapInPandas over blocks: of each the rows first, then its anchors in batches."""
    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block, cache = None, [], {}
        for part in parts:
            for number, own in part.groupby("block", sort=True):
                if number != now:
                    now, block, cache = number, [], {}
                block.extend([rows] if len(rows := own[~own["anchor"]]) else [])
                if len(anchors := own[own["anchor"]]):
                    found = list(look(block, anchors, cache))
                    yield pd.DataFrame(found, columns=columns) if found else pd.DataFrame({c: np.empty(0, np.int64) for c in columns})

    return fold


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector: rows that take part, one for each id, with labels moved and components as whole numbers."""
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    own = vectors.where(good).select("vec_id", F.struct(label.alias("label"), whole.alias("vector")).alias("_row"))
    return own.groupBy("vec_id").agg(F.min("_row").alias("_row")).select("vec_id", "_row.label", "_row.vector")


def _meeting(rows: DataFrame, anchors: DataFrame, blocks: int, look, columns: list[str]) -> DataFrame:
    """What look gives for every anchor in every block."""
    wants = "array<struct<positive_id:bigint,score:bigint>>"
    one = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(False).alias("anchor"), "vec_id", "label", "vector", F.expr(f"cast(null as {wants})").alias("wants"))
    two = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("anchor"), "vec_id", "label", "vector", F.col("wants").cast(wants).alias("wants"))
    return one.union(two).repartition("block").sortWithinPartitions("block", "anchor").mapInPandas(_visiting(look, columns), ", ".join(f"{c} long" for c in columns))


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label)."""
    rows = stored(prepared(vectors), "vectors")
    blocks = max(1, -(-rows.count() // BLOCK))
    anchors = rows.where(F.col("vec_id") % ANCHORS == 0)
    near = _meeting(rows, anchors.withColumn("wants", F.lit(None)), blocks, _positives, ["anchor_id", "positive_id", "score"])
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id"))
    wants = near.withColumn("_p", place).where(F.col("_p") <= POSITIVES).groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("wants"))
    wanting = stored(anchors.join(wants, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", "wants"), "anchors")
    far = _meeting(rows, wanting, blocks, _negatives, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id"))
    return far.withColumn("rank", place).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
