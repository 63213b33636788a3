"""Hashed bag-of-words vectors, sparse and dense, in Arrow batches, and cosine similarity as native columns."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts that are scored against queries at a time.
TOGETHER = 256


def embed_sparse(df: DataFrame, key: str, text: str, dimensions: int = 1536, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows key, dim, weight of the unit vector of each row's text, with the columns of carry; a text without tokens has none.

    One pass in Arrow batches and no shuffle; a worker hashes each distinct
    token once while it remembers it.
    """
    pair = F.explode(_sparse_udf(dimensions)(F.col(text))).alias("_p")
    return df.select(key, *carry, pair).select(key, *carry, F.col("_p.dim").alias("dim"), F.col("_p.weight").alias("weight"))


@lru_cache(maxsize=100_000)
def _placed(token: str) -> tuple[int, int]:
    """A token's number, whose rest by the dimensions is its dimension, and its sign."""
    digest = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(digest[:4], "big"), 1 if digest[4] % 2 == 0 else -1


def _sparse_udf(dimensions: int):
    def embed(texts: pa.Array) -> pa.Array:
        dims, weights, ends = array("q"), array("d"), array("i", [0])  # packed: a batch has millions of weights
        for text in texts:
            own = sparse(text.as_py(), dimensions)
            dims.extend(own)
            weights.extend(own.values())
            ends.append(len(dims))
        pairs = pa.StructArray.from_arrays([pa.array(np.array(dims, np.int64)), pa.array(np.array(weights, np.float64))], names=["dim", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pairs)

    return F.arrow_udf(embed, T.ArrayType(T.StructType([T.StructField("dim", T.LongType()), T.StructField("weight", T.DoubleType())])))


def sparse(text: str | None, dimensions: int) -> dict[int, float]:
    """The weights of a text's unit vector that aren't zero, by dimension."""
    sums: dict[int, int] = {}
    for token, n in Counter(re.findall("[a-z0-9]+", (text or "").lower())).items():
        number, sign = _placed(token)
        sums[number % dimensions] = sums.get(number % dimensions, 0) + sign * n
    length = math.sqrt(sum(x * x for x in sums.values()))
    return {k: x / length for k, x in sums.items() if x}


def matrix(texts: list[str | None], dimensions: int) -> np.ndarray:
    """Their vectors as rows."""
    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts, strict=True):
        own = sparse(text, dimensions)
        row[list(own)] = list(own.values())
    return out


def similarities(texts: pd.Series, queries: np.ndarray, ordered: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first text, similarities by text and query) of some texts at a time; NaN where no dimension is shared.

    If ordered, products are added in order of dimensions, a query at a time, so that equal texts have the same sum to its last bit.
    """
    for at in range(0, len(texts), TOGETHER):
        own = matrix(texts.iloc[at : at + TOGETHER].tolist(), queries.shape[1])
        met = (own != 0).astype(np.float32) @ (queries != 0).astype(np.float32).T
        yield at, np.where(met > 0, np.stack([_added(own, q) for q in queries], axis=1) if ordered else own @ queries.T, np.nan)


def _added(texts: np.ndarray, query: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for dim in np.flatnonzero(query):
        out += texts[:, dim] * query[dim]
    return out


def sparse_similarity(items: DataFrame, item: str, queries: DataFrame, query: str) -> DataFrame:
    """Cosines of the pairs that share a dimension: an equi-join on dim, added up."""
    q = queries.select(query, "dim", F.col("weight").alias("_w"))
    return items.join(q, "dim").groupBy(query, item).agg(F.sum(F.col("weight") * F.col("_w")).alias("similarity"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where either is a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def dense(text: str | None, dimensions: int) -> np.ndarray:
    out = np.zeros(dimensions)
    for token in re.findall("[a-z0-9]+", (text or "").lower()):
        number, sign = _placed(token)
        out[number % dimensions] += sign
    length = np.sqrt((out * out).sum())
    return out / length if length else out


def embed_dense(text: Column, dimensions: int = 1536) -> Column:
    """Dense unit vector of a text, zeros where it has no tokens; for searches prefer the sparse form."""
    return _dense_udf(dimensions)(text)


def _dense_udf(dimensions: int):
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: dense(t, dimensions))

    return F.pandas_udf(embed, T.ArrayType(T.DoubleType()))
