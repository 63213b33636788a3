"""Rate limiters over logged hits. What was admitted before decides, so each key is a fold in order of time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OUT = [T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.IntegerType())]


class SlidingLog:
    """Admits while fewer than `limit` admitted hits are at most `window` old; a refused hit leaves no trace.

    Hits come in order of time, so the last `limit` admitted ones decide and
    are all that is held.
    """

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.kept = limit, window, deque(maxlen=max(limit, 1))

    def hit(self, at: float) -> tuple[bool, int]:
        recent = sum(t >= at - self.window for t in self.kept)
        admitted = self.limit <= 0 or recent < self.limit
        if admitted:
            self.kept.append(at)
        return admitted, max(0, self.limit - recent - admitted)


class FixedWindow:
    """Counts every hit in a window that begins with a key's first hit and ends `window` later."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.began, self.count = limit, window, None, 0

    def hit(self, at: float) -> tuple[bool, int]:
        if self.limit <= 0:
            return True, 0
        if self.began is None or at >= self.began + self.window:
            self.began, self.count = at, 0
        self.count += 1
        return self.count <= self.limit, max(0, self.limit - self.count)


def admit(hits: DataFrame, key: str, at: str, tie: str, kind: type, limit: int, window: float) -> DataFrame:
    """hits (key, at in seconds, tie) with allowed and remaining.

    Rows are dealt by key and sorted, then read as a stream: the state of one
    key at a time is held, never its rows.
    """
    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, limiter = object(), None
        for part in parts:
            out = []
            for k, t in zip(part[key], part[at], strict=True):
                if limiter is None or k != now:
                    now, limiter = k, kind(limit, window)
                out.append(limiter.hit(t))
            yield pd.concat([part.reset_index(drop=True), pd.DataFrame(out, columns=["allowed", "remaining"])], axis=1)

    rows = hits.select(key, at, tie).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, at, tie).mapInPandas(fold, T.StructType([*rows.schema.fields, *_OUT]))


def limiter_key(scope: str, address: Column) -> Column:
    return F.concat(F.lit(scope), F.lit(":"), address)
