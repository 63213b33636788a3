"""The work queue as Structured Streaming: claim once, retry, sweep, limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.streaming.stateful import limit_on_arrival


def jobs_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """A folder of Parquet messages, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def claim_once(jobs: DataFrame, key: str, at: str | None = None, late: str | None = None) -> DataFrame:
    """One message of each job, in whatever order messages and files come.

    The keys seen so far are the state. With `at` and `late` a key is forgotten
    once the watermark has passed it, which bounds the state of a stream that
    never ends; messages that come later than that are then dropped, so `late`
    must cover all the backlog that a query may start on.
    """
    return jobs.dropDuplicates([key]) if late is None else jobs.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Hits in event-time windows.

    With `late` a window is final, and its state goes, once the watermark has
    passed it; hits that come later are dropped. Without it every hit counts,
    in the output modes complete and update.
    """
    return (events if late is None else events.withWatermark(at, late)).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("hits")).select(F.col("w.start").alias("start"), key, "hits")


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, to Parquet, exactly once by its checkpoint, then end."""
    df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def each_batch(df: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """A function on every micro-batch: re-queueing of failures, sweeps of stale jobs."""
    df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_every(df: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], seconds: int):
    """A function on every micro-batch, one each so many seconds until the returned query is stopped: periodic sweeps."""
    return df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def requeue(failed: DataFrame, count: str, now: Column, most: int = 3) -> DataFrame:
    """Failed jobs that get another try, with the time before which it must not begin."""
    again = failed.where(F.col(count) < most).withColumn(count, F.col(count) + 1)
    return again.withColumn("not_before", F.timestamp_seconds(F.unix_timestamp(now) + F.pow(F.lit(2), F.col(count)).cast("long")))


def limited(hits: DataFrame, key: str, at: str, limit: int, window: float, idle_ms: int | None = None) -> DataFrame:
    """Sliding-log admission in order of arrival; stateful.limit_in_order decides in order of time.

    With idle_ms a key's state goes once it has been idle so long; that asks
    for a query that keeps running, as its timer makes batches for ever.
    """
    return limit_on_arrival(hits, key, at, limit, window, idle_ms)
