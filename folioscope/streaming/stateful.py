"""Stateful streams whose results don't depend on how rows come: folds in order of event time, retries and sweeps by timers.

All are StatefulProcessors over the RocksDB state store. Rows of a key wait in a
list until the watermark has passed them, are then folded in order of time and
tie, and go; what a fold remembers is one small text a key, which goes too once
a timer says that it can't matter any more. `late` is how much older than the
newest row a row may be; it bounds what waits. A row that is later still is
dropped by the engine. The last rows of a stream are folded once something newer
moves the watermark past them.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def _store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Sliding:
    """Admits while fewer than `limit` of the admitted rows are at most `window` seconds old: the last `limit` admitted times decide."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.last = limit, int(window * MICROS), deque(maxlen=max(limit, 1))

    def load(self, text: str) -> None:
        self.last.extend(json.loads(text))

    def text(self) -> str:
        return json.dumps(list(self.last))

    def row(self, at: int, tie: int) -> list[tuple]:
        if self.limit <= 0:
            return [(at, tie, True, 0)]
        recent = sum(t >= at - self.window for t in self.last)
        if recent < self.limit:
            self.last.append(at)
        return [(at, tie, recent < self.limit, max(0, self.limit - recent - (recent < self.limit)))]

    def until(self) -> int | None:
        """When what is remembered stops to matter."""
        return self.last[-1] + self.window if self.last else None

    def over(self) -> list[tuple]:
        return []


class Silence:
    """Tells of a key that was heard of and then not for `age` seconds or more: the time it was last heard of."""

    def __init__(self, age: float):
        self.age, self.seen = int(age * MICROS), None

    def load(self, text: str) -> None:
        self.seen = json.loads(text)

    def text(self) -> str:
        return json.dumps(self.seen)

    def row(self, at: int, tie: int) -> list[tuple]:
        last, self.seen = self.seen, at
        return [(last,)] if last is not None and at - last >= self.age else []

    def until(self) -> int | None:
        return None if self.seen is None else self.seen + self.age

    def over(self) -> list[tuple]:
        """What there is to tell when `until` has passed without a row."""
        return [(self.seen,)]


class InOrder(StatefulProcessor):
    """Folds a key's rows in order of event time as the watermark passes them; one timer a key is set at a time."""

    def __init__(self, key: str, at: str, tie: str, fold: Callable[[], object], columns: list[str]):
        self.key, self.at, self.tie, self.fold, self.columns = key, at, tie, fold, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")  # what a batch brings is one value: pairs of at and tie
        self.memory = handle.getValueState("memory", "fold string, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([part[[self.at, self.tie]].to_numpy(np.int64) for part in rows])
        self.waiting.appendList([(new.tobytes(),)])
        fold, timer = self.memory.get() if self.memory.exists() else (None, None)
        self._set(fold, timer, int(new[:, 0].min()), timerValues)
        yield pd.DataFrame({c: [] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.concatenate([np.frombuffer(r[0], np.int64).reshape(-1, 2) for r in self.waiting.get()] or [np.empty((0, 2), np.int64)])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        fold = self.fold()
        text = self.memory.get()[0] if self.memory.exists() else None
        if text is not None:
            fold.load(text)
        ready = int(np.searchsorted(rows[:, 0], passed))
        out = [x for r in rows[:ready].tolist() for x in fold.row(*r)]
        rest = rows[ready:]
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
        else:
            self.waiting.clear()
        until = fold.until()
        first = int(rest[0, 0]) if len(rest) else None
        if until is not None and until < passed and not (first is not None and first <= until):
            out += fold.over()
            until = None
        if until is None and first is None:
            self.memory.clear()  # nothing of the key stays
        else:
            nexts = [x for x in (first, until) if x is not None]
            self._set(None if until is None else fold.text(), None, min(nexts), timerValues)
        name = key[0] if isinstance(key, tuple) else key
        yield pd.DataFrame([(name, *x) for x in out], columns=self.columns)

    def _set(self, fold: str | None, timer: int | None, due: int, timerValues) -> None:
        """A timer a moment after `due`, unless an earlier one is set."""
        due = max(due // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.memory.update((fold, timer))

    def close(self) -> None:
        pass


def _timed(df: DataFrame, at: str, late: str, *columns: str) -> DataFrame:
    """Rows with the watermark (the engine renames columns that begin with _), and their time in microseconds as `event_micros`; rows without a time are left out."""
    moment = F.col(at).cast("timestamp")
    return df.select(*columns, moment.alias("event_moment")).where("event_moment is not null").withColumn("event_micros", F.unix_micros("event_moment")).withWatermark("event_moment", late)


def in_order(df: DataFrame, key: str, at: str, tie: str, late: str, fold: Callable[[], object], out: str) -> DataFrame:
    """What a fold (Sliding, Silence or one like them) gives for each key's rows in order of time; rows without a key are left out."""
    _store(df.sparkSession)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {out}"
    rows = _timed(df, at, late, key, F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("event_tie")).where(F.col(key).isNotNull())
    columns = [key, *[c.strip().split(" ")[0] for c in out.split(",")]]
    return rows.groupBy(key).transformWithStateInPandas(InOrder(key, "event_micros", "event_tie", fold, columns), schema, "append", "eventtime")


def limit_in_order(hits: DataFrame, key: str, at: str, tie: str, limit: int, window: float, late: str) -> DataFrame:
    """Sliding-log admission: key, at in microseconds, tie, allowed, remaining, the same for any order of rows and files."""
    return in_order(hits, key, at, tie, late, lambda: Sliding(limit, window), "at bigint, tie bigint, allowed boolean, remaining int")


def silent(beats: DataFrame, key: str, at: str, age: float, late: str) -> DataFrame:
    """key, last_seen in microseconds: each time that a key was silent for `age` seconds or more."""
    return in_order(beats.withColumn("event_zero", F.lit(0)), key, at, "event_zero", late, lambda: Silence(age), "last_seen bigint")


class Recent(StatefulProcessor):
    """Sliding-log admission in order of arrival; a key's times go by themselves once they are `ttl_ms` old."""

    def __init__(self, key: str, at: str, limit: int, window: float, ttl_ms: int | None):
        self.key, self.at, self.limit, self.window, self.ttl_ms = key, at, limit, window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "at bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for part in rows for t in part[self.at])
        fold = Sliding(self.limit, self.window)
        fold.last.extend(r[0] for r in self.kept.get())
        found = [fold.row(int(round(t * MICROS)), 0)[0] for t in times]
        if fold.last:
            self.kept.put([(t,) for t in fold.last])
        yield pd.DataFrame({self.key: key[0], self.at: times, "allowed": [f[2] for f in found], "remaining": [f[3] for f in found]})

    def close(self) -> None:
        pass


def limit_on_arrival(hits: DataFrame, key: str, at: str, limit: int, window: float, ttl_ms: int | None = None) -> DataFrame:
    """key, at (seconds), allowed, remaining as hits come, those of a batch in order of time. With ttl_ms an idle key leaves no state."""
    _store(hits.sparkSession)
    schema = f"{key} {hits.schema[key].dataType.simpleString()}, {at} double, allowed boolean, remaining int"
    rows = hits.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("double").alias(at))
    return rows.groupBy(key).transformWithStateInPandas(Recent(key, at, limit, window, ttl_ms), StructType.fromDDL(schema), "append", "none" if ttl_ms is None else "processingtime")


#: Groups of jobs that share their state: a group's is read and written as a whole, not job by job.
GROUPS = 2048


class Retries(StatefulProcessor):
    """Runs a job when it comes and, after each failure, again once its back-off has passed; after `most` failures it is dead.

    Keys are groups of jobs, so that calls of the state store grow with groups
    and batches, not with jobs. A group holds the jobs it has taken and those
    that wait for their next attempt.
    """

    def __init__(self, job: str, kind: str, work: Callable[[object, int], bool], most: int):
        self.job, self.kind, self.work, self.most = job, kind, work, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getListState("taken", f"job {self.kind}")
        self.waiting = handle.getListState("waiting", f"job {self.kind}, attempts int, due bigint")

    def _attempt(self, job, number: int, at: int) -> tuple[tuple, tuple | None]:
        """One attempt: its row, and what waits after it."""
        ok = self.work(job, number)
        outcome = "completed" if ok else "retry" if number < self.most else "dead"
        return (job, number, at, outcome), (job, number, at + MICROS * 2**number) if outcome == "retry" else None

    def _timer(self, waiting: list[tuple], now: int) -> None:
        """A timer for what waits the shortest."""
        if waiting:
            self.handle.registerTimer(max(min(due for *_, due in waiting) // 1000, now + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict = {}
        for part in rows:
            for job, at in zip(part[self.job], part["event_micros"], strict=True):
                first[job] = min(int(at), first.get(job, int(at)))
        for (job,) in self.taken.get():
            first.pop(job, None)  # a message that is delivered again starts nothing
        made = [self._attempt(job, 1, at) for job, at in first.items()]
        if made:
            self.taken.appendList([(job,) for job in first])
        if waiting := [w for _, w in made if w]:
            self.waiting.appendList(waiting)
            self._timer(waiting, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame([row for row, _ in made], columns=[self.job, "attempt", "at", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rest, out, ran = [], [], False
        for w in self.waiting.get():
            w = tuple(w)
            while w and w[2] // 1000 <= now:  # all that has come due while the watermark leapt
                row, w = self._attempt(w[0], w[1] + 1, w[2])
                out.append(row)
                ran = True
            if w:
                rest.append(w)
        if ran:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        self._timer(rest, now)
        yield pd.DataFrame(out, columns=[self.job, "attempt", "at", "outcome"])

    def close(self) -> None:
        pass


def with_retries(jobs: DataFrame, job: str, at: str, work: Callable[[object, int], bool], late: str, most: int = 3, groups: int = GROUPS) -> DataFrame:
    """job, attempt, at in microseconds, outcome (completed, retry or dead) of each attempt.

    work(job, attempt) does the job and says whether it succeeded. Attempt n + 1
    is 2**n seconds after attempt n, in event time: it runs once the watermark
    has reached that moment, never before. Each job is taken once, at the first
    of its messages in the batch that brings it. A group's jobs are in memory
    while it is worked on; `groups` stays the same while a stream is restarted.
    """
    _store(jobs.sparkSession)
    kind = jobs.schema[job].dataType.simpleString()
    rows = _timed(jobs, at, late, job).where(F.col(job).isNotNull()).withColumn("event_group", F.pmod(F.xxhash64(job), F.lit(groups)))
    return rows.groupBy("event_group").transformWithStateInPandas(Retries(job, kind, work, most), f"{job} {kind}, attempt int, at bigint, outcome string", "append", "eventtime")


def closing(spark: SparkSession, schema: StructType, at: str, moment: str, **values: object) -> DataFrame:
    """One row that moves the watermark past all that a finite stream holds: the last message of its input."""
    names = {f.name: F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields}
    names[at] = F.lit(moment).cast(schema[at].dataType).alias(at)
    return spark.range(1).select(*[names[f.name] for f in schema.fields])
