"""Citation analytics: probabilities with Wilson intervals, trends, drift, shares, position weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Normal quantile of a 95 % interval.
Z = 1.96
#: Days or weeks that drift is measured against, and how many deviations count.
TRAILING, SIGMAS = 8, 3


def wilson(hits: Column, n: Column, z: float = Z) -> dict[str, Column]:
    p = hits / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return {"p": F.when(n > 0, p), "low": F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), "high": F.when(n > 0, F.least(F.lit(1.0), centre + half))}


def citation_probability(runs: DataFrame, cited: Column, *keys: str) -> DataFrame:
    """p, low and high for each key, over its runs."""
    own = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.count_if(cited).alias("hits"))
    return own.select(*keys, "runs", "hits", *[c.alias(n) for n, c in wilson(F.col("hits"), F.col("runs")).items()])


def change(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The step from the period before, in points."""
    return df.withColumn("delta", (F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))) * 100)


def change_since(df: DataFrame, key: str, day: str, value: str, days: int) -> Column:
    """The step in points from the same key's value exactly so many days before; null where that day has none."""
    place = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    before = F.max(value).over(Window.partitionBy(key).orderBy(place).rangeBetween(-days, -days))
    return (F.col(value) - before) * 100


def drift(df: DataFrame, key: str, order: str, value: str, trailing: int = TRAILING, sigmas: float = SIGMAS) -> DataFrame:
    """Whether a value leaves the mean of the periods before by more than `sigmas` deviations; only with a whole trail behind it."""
    trail = Window.partitionBy(key).orderBy(order).rowsBetween(-trailing, -1)
    mean, spread, n = F.avg(value).over(trail), F.stddev_samp(value).over(trail), F.count(value).over(trail)
    return df.withColumn("trail_mean", mean).withColumn("drift", F.coalesce((n == trailing) & (F.abs(F.col(value) - mean) > sigmas * spread), F.lit(False)))


def significant(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Two intervals that don't overlap."""
    return (high_a < low_b) | (high_b < low_a)


def trend(runs: DataFrame, period: Column, engine: str, engines: list[str], cited: Column) -> DataFrame:
    """Probability by period, a column for each engine."""
    return runs.groupBy(period.alias("period")).pivot(engine, engines).agg(F.round(F.avg(F.when(cited, 1.0).otherwise(0.0)), 6))


def share_of_voice(runs: DataFrame, cited: Column, *keys: str) -> DataFrame:
    """Each key's part of all citations; the total is one row of partial counts."""
    own = runs.groupBy(*keys).agg(F.count_if(cited).alias("citations"))
    total = own.agg(F.sum("citations").alias("_all"))
    return own.crossJoin(F.broadcast(total)).select(*keys, "citations", F.when(F.col("_all") > 0, F.col("citations") / F.col("_all")).alias("share"))


def position_weighted(words: Column, position: Column, n: Column) -> Column:
    """A citation's words, less the further down it stands among n."""
    return words * F.exp(-position.cast("double") / n)


def plan_grid(prompts: DataFrame, runs: int, temperatures: list[float]) -> DataFrame:
    """A row for each run and temperature of each prompt; the grid is runs * temperatures long, made in place by exploding."""
    grid = prompts.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    return grid.withColumn("run_index", F.explode(F.sequence(F.lit(1), F.lit(runs))))
