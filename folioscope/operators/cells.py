"""Approximate vector search through coarse cells.

Lloyd's k-means in rounds over the table gives the centres of some cells; every
unit vector is written to the folder of its cell. A query is held against the
vectors of its nearest `probes` cells alone; the scan prunes all other folders.
With as many probes as cells the result is that of the exact search.

The centres are what passes through the driver: a fixed number of them. A round
sums up vectors by cell in each task, so a cell that holds a third of all rows
is one row a task. Zero vectors, nulls and vectors with null or non-finite
components are in no cell and never found; nor are vectors of another length
than the centres have, which is that of most vectors drawn for them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTS = 100
ROUNDS = 10
PROBES = 10
#: Vectors that a task compares with the centres at a time.
TOGETHER = 4096
#: Queries that they are held against at a time, so that no more than these products are held at once.
ASKED = 512
CELLS = "id long, cell int, unit array<double>"


def _units(vectors: pd.Series, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of those that have one and are so long, else as long as most, the shorter length among equals."""
    whole = {i: np.asarray(v, dtype=float) for i, v in enumerate(vectors) if v is not None and len(v)}
    lengths = Counter(len(v) for i, v in whole.items() if np.isfinite(v).all() and v.any())
    width = min(lengths, key=lambda n: (-lengths[n], n), default=0) if width is None else width
    good = [i for i, v in whole.items() if len(v) == width and np.isfinite(v).all() and v.any()]
    if not good:
        return np.empty(0, np.int64), np.empty((0, width))
    rows = np.stack([whole[i] for i in good])
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that no square leaves the range
    return np.array(good), rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest(units: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the n nearest centres of each, the smaller number first among equals."""
    found = [np.argsort(-np.round(units[a : a + TOGETHER] @ centres.T, 12), axis=1, kind="stable")[:, :n] for a in range(0, len(units), TOGETHER)]
    return np.concatenate(found) if found else np.empty((0, n), np.int64)


def _sums(centres: np.ndarray):
    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for part in parts:
            _, units = _units(part["vector"], centres.shape[1])
            if len(units):
                cell = nearest(units, centres)[:, 0]
                np.add.at(total, cell, units)
                n += np.bincount(cell, minlength=len(centres))
        held = np.flatnonzero(n)
        if len(held):  # a task without a vector has no row: an empty column has no type that fits
            yield pd.DataFrame({"cell": held, "n": n[held], "total": list(total[held])})

    return sums


def centres_of(vectors: DataFrame, key: str, vector: str, lists: int = LISTS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of at most `lists` cells. They begin as vectors drawn by a hash of their keys; one that no vector is nearest to stays where it is."""
    rows = vectors.select(F.col(vector).alias("vector"))
    drawn = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(2 * lists).select(F.col(vector).alias("vector")).toPandas()
    _, units = _units(drawn["vector"])
    centres = np.unique(units, axis=0)[:lists] if len(units) else np.empty((0, 0))
    if not len(centres):
        return centres
    add = F.aggregate(F.array_agg("total"), F.array_repeat(F.lit(0.0), centres.shape[1]), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    for _ in range(rounds):
        found = rows.mapInPandas(_sums(centres), "cell int, n long, total array<double>").groupBy("cell").agg(add.alias("total")).collect()
        moved = centres.copy()
        for r in found:
            length = np.linalg.norm(r["total"])
            if length > 0:
                moved[r["cell"]] = np.asarray(r["total"]) / length
        if np.abs(moved - centres).max() < 1e-9:
            break
        centres = moved
    return centres


class CellIndex:
    """Vectors by cell in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, key: str, vector: str, path: str, lists: int = LISTS, rounds: int = ROUNDS) -> CellIndex:
        out = cls(vectors.sparkSession, path)
        centres = centres_of(vectors, key, vector, lists, rounds)
        out.spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, centre array<double>").coalesce(1).write.parquet(f"{out.path}/centres")
        out.add(vectors, key, vector)
        return out

    def centres(self) -> np.ndarray:
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows])

    def add(self, vectors: DataFrame, key: str, vector: str) -> None:
        """Put more vectors into the cells there are."""
        centres = self.centres()
        width = centres.shape[1] if len(centres) else 0

        def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                places, units = _units(part["vector"], width)
                if len(places) and len(centres):
                    yield pd.DataFrame({"id": part["id"].to_numpy()[places], "cell": nearest(units, centres)[:, 0], "unit": list(units)})

        rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null").mapInPandas(assign, CELLS)
        # a cell's vectors are written by a few tasks, whatever share of all it holds
        rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/cells")

    def cells(self) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, query: str, vector: str, k: int = 10, probes: int = PROBES, threshold: float | None = None) -> DataFrame:
        """query, id, similarity: the k nearest of each query among the vectors of its probed cells, by similarity, then id.

        Queries are few beside the table: they come to the driver, as their
        cells decide what is read.
        """
        asked = queries.select(query, vector).toPandas()
        centres = self.centres()
        places, units = _units(asked[vector], centres.shape[1] if len(centres) else 0)
        schema = f"query {queries.schema[query].dataType.simpleString()}, id long, similarity double"
        if not len(places) or not len(centres):
            return self.spark.createDataFrame([], schema)
        names = [asked[query].iloc[i] for i in places]
        probed = nearest(units, centres, probes)
        by_cell = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, list[tuple[float, int]]] = {}
            for part in parts:
                for cell, own in part.groupby("cell"):
                    rows, ids, at = np.stack(own["unit"].to_numpy()), own["id"].to_numpy(), by_cell[int(cell)]
                    for a, b in product(range(0, len(rows), TOGETHER), range(0, len(at), ASKED)):
                        found = np.round(rows[a : a + TOGETHER] @ units[at[b : b + ASKED]].T, 12)
                        for j, column in zip(at[b : b + ASKED].tolist(), found.T, strict=True):
                            held = best.setdefault(j, [])
                            least = -held[-1][0] if len(held) == k else -np.inf
                            hits = np.flatnonzero(column >= (least if threshold is None else max(least, threshold)))
                            if len(hits):
                                best[j] = sorted([*held, *zip((-column[hits]).tolist(), ids[a + hits].tolist(), strict=True)])[:k]
            if best:
                yield pd.DataFrame([(names[j], i, -s) for j, own in best.items() for s, i in own], columns=["query", "id", "similarity"])

        read = self.cells().where(F.col("cell").isin(list(by_cell)))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
        return read.mapInPandas(score, schema).withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: of the exact pairs (query, id), how many were found, and the share, null where there are none."""
    hit = exact.select("query", "id").join(found.select("query", "id").withColumn("_hit", F.lit(1)), ["query", "id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"), F.try_divide(F.count("_hit"), F.count(F.lit(1))).alias("recall"))
