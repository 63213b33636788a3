"""Tables stored by the hash of a key, so that joins and groupings on it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from folioscope.sources.tables import shared_path

BUCKETS = 16


def bucketed(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """df as a table of so many buckets of a key, sorted by it in each: one file for each bucket.

    Tables that are joined must have the same number of buckets. A key that
    holds a large share of all rows makes a large bucket; such a table is
    better left unbucketed, so that its join can be split.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def exchanges(df: DataFrame) -> int:
    """How many shuffles the plan of df has before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "BroadcastExchange" not in line for line in plan.splitlines())
