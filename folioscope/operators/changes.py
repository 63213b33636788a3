"""State changes as pure functions: new rows from old rows and requests, with a flag `affected`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.conf import UnknownColumn

#: Longest error text that is stored.
ERROR_CHARS = 2000


def patch(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of changes put in where they aren't null; a column that df lacks is refused."""
    cols = [c for c in changes.columns if c != key]
    if missing := [c for c in cols if c not in df.columns]:
        raise UnknownColumn(f"no such column: {', '.join(missing)}")
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = df.join(new, F.col(key) == F.col("_key"), "left")
    out = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns]
    return joined.select(*out, F.col("_key").isNotNull().alias("affected"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Rows of new come in; where a key is there, only the `update` columns change (all that aren't keys, if None; none, if empty)."""
    cols = [c for c in old.columns if c not in keys]
    update = cols if update is None else update
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")

    def value(c: str) -> Column:
        if c in update and c in new.columns:
            return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        fresh = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        return F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(fresh).alias(c)

    return both.select(*keys, *[value(c) for c in cols], F.coalesce(F.col("_new"), F.lit(False)).alias("affected"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new, each key once, that old hasn't: what an insert that skips conflicts adds."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def claim(jobs: DataFrame, status: str, free: list[str], taken: str, wanted: Column) -> DataFrame:
    """Jobs asked for that are free become taken; the others stay, so that a second claim does nothing."""
    hit = F.coalesce(wanted & F.col(status).isin(free), F.lit(False))
    return jobs.withColumn("affected", hit).withColumn(status, F.when(F.col("affected"), F.lit(taken)).otherwise(F.col(status)))


def consume(users: DataFrame, used: str, limit: str, n: Column) -> DataFrame:
    """One request each: used grows by n only within the limit; n of 0 or less is granted and costs nothing."""
    granted = F.coalesce((n <= 0) | (F.col(used) + n <= F.col(limit)), F.lit(False))
    return users.withColumn("affected", granted).withColumn(used, F.when(F.col("affected") & (n > 0), F.col(used) + n).otherwise(F.col(used)))


def consume_in_order(requests: DataFrame, user: str, order: str, n: str, limit: str) -> DataFrame:
    """Many requests of a user in turn: each is granted whole or not at all.

    What was granted before decides, so the fold can't be a running sum. Rows
    are dealt by user and sorted, then read as a stream: what one user has used
    is held, never the requests. A null request is refused.
    """
    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, 0
        for part in parts:
            granted, after = [], []
            for who, want, most in zip(part[user], part[n], part[limit], strict=True):
                if now is None or who != now[0]:
                    now, used = (who,), 0
                ok = not (pd.isna(want) or want > 0 and (pd.isna(most) or used + want > most))
                used += int(want) if ok and want > 0 else 0
                granted.append(ok)
                after.append(used)
            yield pd.DataFrame({user: part[user], order: part[order], "granted": granted, "used": after})

    rows = requests.select(user, order, F.col(n).cast("long").alias(n), F.col(limit).cast("long").alias(limit)).where(F.col(user).isNotNull())
    out = T.StructType([rows.schema[user], rows.schema[order], T.StructField("granted", T.BooleanType()), T.StructField("used", T.LongType())])
    return rows.repartition(user).sortWithinPartitions(user, order).mapInPandas(fold, out)


def stale(df: DataFrame, status: str, running: str, since: str, cutoff: Column) -> Column:
    """Running since strictly before the cut-off."""
    return (F.col(status) == running) & (F.col(since) < cutoff)


def cutoff(now: Column, minutes: int) -> Column:
    """The moment so many minutes before."""
    return now - F.expr(f"interval {int(minutes)} minutes")


def iso_text(moment: Column) -> Column:
    """A moment in UTC as text, to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def recover(jobs: DataFrame, audits: DataFrame, audit_key: str, job_status: str, audit_status: str, is_stale: Column, crawling: str, failed: str) -> DataFrame:
    """Audits with those failed whose stale job still ran and which were crawling."""
    hit = jobs.where(is_stale).select(F.col(audit_key).alias("_hit")).distinct()
    out = audits.join(hit, F.col(audit_key) == F.col("_hit"), "left").withColumn("affected", F.col("_hit").isNotNull() & (F.col(audit_status) == crawling))
    return out.withColumn(audit_status, F.when(F.col("affected"), F.lit(failed)).otherwise(F.col(audit_status))).drop("_hit")


def retry(count: Column, most: int = 3) -> Column:
    """What follows a failure: another try, or the end."""
    return F.when(count < most, "retry").otherwise("failed")


def failure(kind: Column, count: Column, most: int = 3) -> Column:
    """Struct of what a failed job becomes: status, whether it is tried again, and robots_allowed, which only a refusal by robots rules makes false.

    count is the number of tries with this one. A refusal is tried again like any failure.
    """
    again = F.coalesce(count < most, F.lit(False))
    return F.struct(F.when(again, "pending").otherwise("failed").alias("status"), again.alias("again"), F.when(kind == "robots", F.lit(False)).alias("robots_allowed"))


def backoff_seconds(count: Column) -> Column:
    return F.pow(F.lit(2.0), count + 1)


def cut_error(text: Column) -> Column:
    return F.substring(text, 1, ERROR_CHARS)


def error_after(status: Column, message: Column, old: Column) -> Column:
    """A new message wins; without one the old stays only where the status is failed."""
    return F.coalesce(cut_error(message), F.when(status == "failed", old))


def delete(df: DataFrame, gone: Column) -> DataFrame:
    """The rows that stay: those for which the condition isn't true."""
    return df.where(~F.coalesce(gone, F.lit(False)))


def cascade(parents: DataFrame, *levels: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What stays at each level below surviving parents: (children, foreign key, the parent's key), from the top down."""
    out, above = [], parents
    for frame, on, key in levels:
        above = frame.join(above.select(F.col(key).alias("_p")).distinct(), F.col(on) == F.col("_p"), "left_semi")
        out.append(above)
    return out


def latest_first(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie))))


def detail(parents: DataFrame, key: str, jobs: DataFrame, job: str, at: str, chunks: DataFrame, embedded: Column, most: int = 20) -> DataFrame:
    """Parents with their newest jobs as an array, the newest first, and two counts: of chunks and of those with a vector.

    Jobs are cut to `most` before they are collected; chunks are counted before
    they are joined. jobs and chunks hold the parents' key.
    """
    newest = latest_first(jobs.select(key, job, at), key, at, job).where(F.col("nth") <= most)
    listed = newest.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", job))), lambda x: x[job]).alias("jobs"))
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"), F.count_if(embedded).alias("embedded_chunk_count"))
    out = parents.join(listed, key, "left").join(counts, key, "left")
    empty = F.array().cast(listed.schema["jobs"].dataType)
    return out.withColumns({"jobs": F.coalesce("jobs", empty), "chunk_count": F.coalesce("chunk_count", F.lit(0)), "embedded_chunk_count": F.coalesce("embedded_chunk_count", F.lit(0))})
