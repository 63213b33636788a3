"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words. A source's target is its share of all words, capped at
CAP times what it has, with the excess shared again by weight (the fixed point
is a water level, found by one pass over sources in order of cap to weight).
A source takes as many complete epochs as fit its target, then a fraction:
each document draws an exponential key scaled by its quality weight, keys are
sorted within the source and sizes are summed along them up to the budget.
Documents are taken whole; the one that crosses the budget is taken if that
leaves the sum nearer to it.

The weight is a model's chance that a document is good: Bradley-Terry weights
(quality.fit) over a few ratios that DataFrame functions give, fitted on a
bounded sample of labelled rows. A column of weights can be passed instead.

The sum along the keys needs no sort of a whole source. Keys are cut by the
logarithm into steps, and each step into parts: whatever the weights, a step
holds at most 1 / (e * STEPS) of a source's keys, and their number doesn't grow
with the table. Sums of the steps find the one that crosses the budget, sums of
its parts the part, and only that part's rows are sorted. Only DataFrame
functions run on the documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import quality
from folioscope.llm._common import WORD, hash_sample, stored, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times what it has.
CAP = 3
#: Steps of the keys in each unit of their logarithm, and parts of a step.
STEPS = 64
PARTS = 64
#: Least weight of a document.
FLOOR = 0.05
#: Seed of the keys: another one draws another mix.
SEED = 20_240_601


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


#: What the weight is made of, each a ratio over the whole text.
RATIOS = ("log_size", "mean_word", "upper", "digits", "symbols", "blanks")


def ratios(text: Column, size: Column) -> list[Column]:
    """RATIOS of a text with so many words; all 0 for one without characters."""
    n = F.length(text)

    def share(chars: str) -> Column:
        return (n - F.length(F.translate(text, chars, ""))) / n

    upper, symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*|!<>{}[]\\^~=_@+/"
    found = [F.log1p(size), n / (size + 1) / 10, share(upper), share("0123456789"), share(symbols), share(" \t\n\x0b\f\r")]
    return [F.when(n > 0, x.cast("double")).otherwise(F.lit(0.0)) for x in found]


def fitted_weight(docs: DataFrame, labels: DataFrame) -> Column:
    """Weight in [FLOOR, 1] over the columns of RATIOS: the fitted chance that label 1 is right.

    At most quality.SAMPLE labelled rows outside the held-out fold are looked
    at; without rows of both labels every document weighs alike.
    """
    rows = quality.sampled_labels(labels)
    size = word_count(F.col("text"))
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("_quality", *[c.alias(n) for n, c in zip(RATIOS, ratios(F.coalesce("text", F.lit("")), size), strict=True)]).groupBy(*RATIOS).agg(F.min("_quality").alias("_quality"))
    got = hash_sample(found, quality.SAMPLE, *RATIOS).toPandas()  # bounded, copies counted once
    got = got.sort_values(list(RATIOS))
    model = quality.fit(got[list(RATIOS)].to_numpy(), got["_quality"].to_numpy())
    z = F.lit(float(np.log(quality.CUT / (1 - quality.CUT)) - model.slope * model.cut))
    for name, mean, scale, weight in zip(RATIOS, model.mean, model.scale, model.weights, strict=True):
        z = z + F.least(F.greatest((F.col(name) - float(mean)) / float(scale), F.lit(-8.0)), F.lit(8.0)) * float(model.slope * weight)
    return F.greatest(F.lit(FLOOR), 1 / (1 + F.exp(-z)))


def uniform(*cols: Column) -> Column:
    """In (0, 1), the same at each run."""
    return (F.xxhash64(F.lit(SEED), *cols).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Rows (source, source_size) with their target. One row for each source; a null source comes last.

    With weights w, caps c and the total T, the targets are min(c, level * w)
    for the level at which they sum to T. A source without words has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picked = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (picked + 1).cast("int"))).withColumn("c", cap * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything)).withColumn("all_w", F.sum("w").over(everything))
    # level if this source and all with a smaller ratio are capped and the others not
    rows = rows.withColumn("before_c", F.sum("c").over(upto) - F.col("c")).withColumn("before_w", F.sum("w").over(upto) - F.col("w"))
    level = (F.col("total") - F.col("before_c")) / (F.col("all_w") - F.col("before_w"))
    # the first source that the level of the rest leaves under its cap fixes the level for it and all after it
    fixed = F.when(level * F.col("w") <= F.col("c"), level)
    rows = rows.withColumn("level", F.first(fixed, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("source", "source_size", F.least(F.col("c"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and times of every row of docs (doc_id, text, source).

    weight is a positive column over RATIOS or docs' own columns, 1 if not
    given; null and smaller ones count as FLOOR. taken is times * size, where
    times is how often the mix holds the row. A null text has size 0; empty
    texts are taken with the complete epochs and count nothing. Null sources
    are one source, the last. Repeated rows draw equal keys and are put in a
    fixed order by their texts' hash; which of two rows alike in all columns
    comes first can't be told. An empty table gives an empty result. Columns
    named in `carry` come back too.
    """
    carry = [c for c in carry or [] if c not in ("doc_id", "size")]
    text = F.coalesce("text", F.lit(""))
    key = -F.log(uniform(F.col("doc_id"))) / F.greatest(F.lit(FLOOR), F.coalesce(F.lit(1.0) if weight is None else weight, F.lit(FLOOR)))
    sized = docs.withColumn("size", word_count(F.col("text")))
    rated = sized if weight is None else sized.withColumns(dict(zip(RATIOS, ratios(text, F.col("size")), strict=True)))
    base = stored(rated.select("doc_id", "source", "size", key.alias("key"), F.xxhash64("text").alias("mark"), *[c for c in carry if c != "source"]), "mix")
    place = F.log("key") * STEPS
    base = base.withColumn("step", F.floor(place).cast("int")).withColumn("part", F.floor((place - F.floor(place)) * PARTS).cast("int"))
    steps = base.groupBy("source", "step").agg(F.sum("size").alias("sum_size"))
    goals = targets(steps.groupBy("source").agg(F.sum("sum_size").alias("source_size")))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = stored(goals.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("none", F.lit(0).cast("long")), "goals")  # one row for each source
    edge = stored(_crossing(steps, goals, "step", "none"), "edge")
    inner = base.join(_named(edge, "e", "step", "before"), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("step") == F.col("e_step"))).groupBy("source", "part").agg(F.sum("size").alias("sum_size"))
    part = _crossing(inner, edge, "part", "before")
    edges = stored(edge.join(_named(part, "p", "part", "before"), F.col("source").eqNullSafe(F.col("p_source")), "left").select("source", "step", F.col("p_part").alias("part"), F.col("p_before").alias("start")), "edges")
    known = goals.join(_named(edges, "x", "step", "part", "start"), F.col("source").eqNullSafe(F.col("x_source")), "left").drop("none", "x_source").withColumnRenamed("source", "goal_source")
    rows = base.join(known, F.col("source").eqNullSafe(F.col("goal_source")))
    here, edge_at = F.struct("step", "part"), F.struct(F.col("x_step").alias("step"), F.col("x_part").alias("part"))
    inside = F.col("x_step").isNull() | (here < edge_at)
    plain = rows.where(inside | (here > edge_at)).withColumn("times", F.col("epochs") + F.when(inside & (F.col("budget") > 0), 1).otherwise(0))
    near = Window.partitionBy("goal_source").orderBy("key", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    crossing = rows.where(here == edge_at).withColumn("at", F.col("x_start") + F.sum("size").over(near) - F.col("size"))
    crossing = crossing.withColumn("times", F.col("epochs") + F.when((F.col("at") + F.col("size") / 2 <= F.col("budget")) & (F.col("budget") > 0), 1).otherwise(0))
    out = ["doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), F.col("times").cast("int").alias("times"), *carry]
    return plain.select(*out).union(crossing.select(*out))


def _named(df: DataFrame, prefix: str, *names: str) -> DataFrame:
    return df.select(F.col("source").alias(f"{prefix}_source"), *[F.col(n).alias(f"{prefix}_{n}") for n in names])


def _crossing(sums: DataFrame, goals: DataFrame, place: str, start: str) -> DataFrame:
    """source, budget, the first place at which the sizes of sums, added to goals' column start, exceed the source's budget, and the sum before it."""
    along = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    summed = sums.withColumn("upto", F.sum("sum_size").over(along))
    goal = goals.select(F.col("source").alias("g_source"), "budget", F.col(start).alias("g_start"))
    over = summed.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("upto", F.col("upto") + F.col("g_start")).where(F.col("upto") > F.col("budget"))
    first = over.groupBy("source").agg(F.min_by(F.struct(place, (F.col("upto") - F.col("sum_size")).alias("before")), place).alias("e"), F.first("budget").alias("budget"))
    return first.select("source", "budget", F.col(f"e.{place}").alias(place), F.col("e.before").alias("before"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, fitted_weight(docs, table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken", "times")


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row comes as often as the mix takes it, so not at all where it takes none.

    A null text has no words and is not taken. A null source is a source of its
    own, the last. Repeated rows share out evenly what the mix takes of them.
    An empty table gives an empty result.
    """
    marked = docs.select("doc_id", "text", "lang", "source", "n_chars", F.xxhash64("doc_id", "source", "text").alias("_row"))
    # rows alike in doc_id, source and text share a key: their times are summed and dealt out evenly below
    weight = fitted_weight(docs, table(spark, sf_dir, "labels"))
    times = mix(marked, weight, ["_row"]).groupBy("_row").agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_alike"))
    copies = marked.join(times, "_row").withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("_row")))
    own = F.floor(F.col("_times") / F.col("_alike")) + F.when(F.col("_nth") <= F.col("_times") % F.col("_alike"), 1).otherwise(0)
    return copies.withColumn("_copies", own).where("_copies > 0").select("doc_id", "text", "lang", "source", "n_chars", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")
