"""Sharding by sampled splitters under the law `bytes`: shards of near equal size.

Records are ordered by a hash of their text, so that equal texts stand
together. A sample of the keys, drawn with chances in proportion to size, gives
RANGES - 1 quantile splitters, and every record goes to the range that the
splitters put its key in. Exact sums then say how large each range is. A group
of equal texts above a shard's share makes its range overfull, and its rows are
subdivided by a hash of doc_id; all others are small parts of a share or one
group. Whole ranges are dealt to shards, largest first, each to the emptiest shard, so
neither the sample's error nor a large group reaches the shards' balance.

Only DataFrame functions run on the records. What comes to the driver is
bounded by constants whatever the table's size: the splitters' sample
(RANGES * PER_RANGE keys) and the ranges' sums (RANGES, and PARTS for each
share that an overfull range holds).
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm._common import stored, table

SHARDS = 24
#: Bytes that each record has besides its text.
OVERHEAD = 8
RANGES = 2048
#: Keys sampled for each range, on average.
PER_RANGE = 24
#: An overfull group goes in this many parts for each share of a shard that it holds.
PARTS = 16
#: Cells of the key's range in which splitters are looked up.
CELLS = 4096
#: Slices in which the rows of a range with more than its part are numbered.
SUBS = 64
SEED = 11


def _cell(key: Column) -> Column:
    """Number of the key's cell, in the order of the (signed) keys."""
    return (F.shiftright(key, 52) + F.lit(2048)).cast("int")


def splitters(groups: DataFrame, total: int) -> list[int]:
    """Quantiles of a sample of the keys in groups (key, size), each drawn with a chance in proportion to its size.

    Every group is taken once for each sampling step that its size holds, and
    the rest of its size decides by a hash of the key: about RANGES * PER_RANGE
    draws whatever the table's size, never more than twice that.
    """
    step = max(1.0, total / (RANGES * PER_RANGE))
    chance = F.xxhash64(F.lit(SEED), "key").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    drawn = groups.withColumn("times", F.floor(F.col("size") / step + chance)).where("times > 0").groupBy((F.shiftright("key", 40)).alias("near")).agg(F.min("key").alias("key"), F.sum("times").alias("times"))
    rows = sorted((r["key"], r["times"]) for r in drawn.collect())  # bounded by the draws above
    out, seen, every = [], 0, max(1.0, sum(t for _, t in rows) / RANGES)
    for key, times in rows:
        if seen // every != (seen + times) // every:
            out.append(key)
        seen += times
    return out


def _range_of(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """rows with column cell: how many splitters are at or below their key, looked up by the key's cell."""
    spark = rows.sparkSession
    by_cell: list[list[int]] = [[] for _ in range(CELLS)]
    for c in cuts:
        by_cell[(c >> 52) + 2048].append(c)
    below, table_rows = 0, []
    for i, own in enumerate(by_cell):
        table_rows.append((i, below, own))
        below += len(own)
    lookup = spark.createDataFrame(table_rows, "look int, below int, own array<bigint>")  # CELLS rows: fit to broadcast
    found = rows.join(F.broadcast(lookup), _cell(F.col("key")) == F.col("look"))
    return found.withColumn("cell", (F.col("below") + F.size(F.filter("own", lambda c: c <= F.col("key")))).cast("long")).drop("look", "below", "own")


def deal(units: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(range, part, shard) of units (bytes, range, part): largest first, each to the emptiest shard."""
    heap, dealt = [(0, s) for s in range(shards)], []
    for size, cell, part in sorted(units, key=lambda u: (-u[0], u[1], u[2])):
        fill, s = heapq.heappop(heap)
        dealt.append((cell, part, s))
        heapq.heappush(heap, (fill + size, s))
    return dealt


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text).

    size is the text's UTF-8 bytes plus OVERHEAD; a null text counts as an
    empty one. Equal texts share a shard unless they alone exceed one; then
    rows alike in doc_id stay together. Slots number a shard's rows from 0,
    rows alike in all columns in any order. grown_shard belongs to another law
    and is null. An empty table gives an empty result, and shards may be empty
    where texts are few. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")), "records")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = total / shards
    cuts = splitters(groups, total)
    heavy = {key: -int(-size * PARTS // share) for key, size in groups.where(F.col("size") > max(1.0, share)).collect()}  # fewer than shards
    known = F.broadcast(spark.createDataFrame(list(heavy.items()), "heavy_key long, parts int"))
    cells = _range_of(groups.where(~F.col("key").isin(list(heavy))), cuts).groupBy("cell").agg(F.sum("size").alias("bytes"))
    ranges = [tuple(r) for r in cells.collect()]  # at most RANGES rows
    large = spark.createDataFrame([(cell,) for cell, size in ranges if size > 4 * total / RANGES], "large long")  # at most a quarter of RANGES rows
    by_id = F.xxhash64(F.lit(SEED), "doc_id")
    marked = _range_of(rows, cuts).join(known, F.col("key") == F.col("heavy_key"), "left").join(F.broadcast(large), F.col("cell") == F.col("large"), "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(by_id, F.col("parts"))).cast("int")
    sub = F.when(F.col("parts").isNull() & F.col("large").isNull(), 0).otherwise(F.pmod(F.shiftright(by_id, 20), F.lit(SUBS))).cast("int")
    marked = marked.withColumn("part", part).withColumn("sub", sub).drop("heavy_key", "parts", "large")
    units = [(size, cell, 0) for cell, size in ranges]
    if heavy:
        split = marked.where("part > 0").groupBy("size", "cell", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("cell", "part").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"))
        units += [(r["bytes"], r["cell"], r["part"]) for r in split.collect()]  # at most shards * (PARTS + 1) rows
    homes = spark.createDataFrame(deal(units, shards), "home_cell long, home_part int, shard int")
    placed = marked.join(F.broadcast(homes), (F.col("cell") == F.col("home_cell")) & (F.col("part") == F.col("home_part"))).drop("home_cell", "home_part")
    every = stored(placed.select("doc_id", "size", "text_crc32", "key", "shard", "cell", "part", "sub"), "placed")
    # slots: rows of a shard within a slice of a range, after the shard's rows in the slices before it
    place = ["shard", "cell", "part", "sub"]
    sums = every.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("shard").orderBy("cell", "part", "sub").rowsBetween(Window.unboundedPreceding, 0)
    first = sums.select(*[F.col(c).alias(f"_{c}") for c in place], (F.sum("n").over(upto) - F.col("n")).alias("first"))
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("key", "doc_id", "text_crc32")) - 1
    same = [F.col(c) == F.col(f"_{c}") for c in place]
    numbered = every.withColumn("nth", nth).join(F.broadcast(first), same[0] & same[1] & same[2] & same[3])  # bounded as the units are, times SUBS for the few large ranges
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
