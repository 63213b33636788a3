"""Every query of the engine by name, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import corpus, machinery, tenant

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return tenant.QUERIES | corpus.QUERIES | machinery.QUERIES


def oracle_sql() -> dict[str, str]:
    return tenant.ORACLE | corpus.ORACLE | machinery.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.page_scorecard(spark, sf_dir)
