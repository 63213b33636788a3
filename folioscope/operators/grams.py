"""Substring search through an index of trigrams.

The index holds for each text the runs of three characters of its lower-case
form, ended by two marks so that every character begins one. `grams` (part,
gram, id) is partitioned by a hash of a gram's first character and sorted by
gram; `counts` (part, gram, n) says how many texts have each.

A pattern is cut at % and _ into pieces. Every text that fits holds the trigrams
of every piece; a piece of one or two characters is the beginning of some
trigram. The rarest of these are looked up, their texts intersected, and what is
left is held against the pattern itself. The others need no reading: they can
only take out texts that the pattern takes out too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\x00"
PARTS = 32
#: Trigrams or short pieces of a pattern that are looked up, the rarest.
RAREST = 3
#: Texts whose trigrams one task sorts, about.
TOGETHER = 25_000


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(PARTS)).cast("int")


def grams_of(text: Column) -> Column:
    """Distinct runs of three characters of the lower-case text and its end."""
    low = F.lower(text)
    full = F.concat(low, F.lit(END + END))
    return F.when(F.length(low) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(full, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def pieces(pattern: str) -> list[str]:
    """The runs between % and _; a backslash makes the next character plain."""
    out, now, plain = [], "", False
    for c in pattern:
        if plain or c not in "%_\\":
            now, plain = now + c, False
        elif c == "\\":
            plain = True
        else:
            out, now = [*out, now], ""
    return [p for p in [*out, now] if p]


def wanted(pattern: str) -> list[str]:
    """Trigrams that a text which fits must hold, and short pieces that must begin one."""
    return sorted({p[i : i + 3] for p in pieces(pattern) for i in range(max(1, len(p) - 2))})


class GramIndex:
    """Texts (id, text) and their trigrams in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, texts: DataFrame, key: str, text: str, path: str) -> GramIndex:
        """Null ids and texts are left out; repeated ids keep each of their texts."""
        out = cls(texts.sparkSession, path)
        own = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
        own.write.parquet(f"{out.path}/texts")
        rows = out.texts().select("id", F.explode(grams_of(F.col("text"))).alias("gram")).withColumn("part", _part(F.col("gram")))
        # ranges of about as many rows each, whatever the grams: a frequent one is cut by its ids, and a task's rows don't grow with the table
        tasks = 1 + out.texts().count() // TOGETHER
        rows.repartitionByRange(tasks, "part", "gram", "id").dropDuplicates(["part", "gram", "id"]).sortWithinPartitions("part", "gram", "id").write.partitionBy("part").parquet(f"{out.path}/grams")
        out.grams().groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n")).repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{out.path}/counts")
        return out

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def _of(self, frame: DataFrame, gram: str) -> DataFrame:
        """Rows of a trigram, or of all that a short piece begins; the scan reads one folder and skips by the sorted grams."""
        part = self.spark.range(1).select(_part(F.lit(gram))).first()[0]
        own = F.col("gram") == gram if len(gram) == 3 else F.startswith(F.col("gram"), F.lit(gram))
        return frame.where((F.col("part") == part) & own)

    def rarest(self, pattern: str) -> list[tuple[str, int]]:
        """The rarest of what a pattern needs, with the number of texts; one row for each comes to the driver."""
        counts = self.spark.read.parquet(f"{self.path}/counts")
        low = self.spark.range(1).select(F.lower(F.lit(pattern))).first()[0]  # as the texts were folded
        found = [(g, self._of(counts, g).agg(F.sum("n")).first()[0] or 0) for g in wanted(low)]
        return sorted(found, key=lambda x: (x[1], x[0]))[:RAREST]

    def candidates(self, pattern: str) -> DataFrame | None:
        """Ids that hold the rarest trigrams of a pattern; None where the pattern has none, as %_%."""
        held = None
        for gram, _ in self.rarest(pattern):
            own = self._of(self.grams(), gram).select("id").distinct()
            held = own if held is None else held.join(own, "id", "left_semi")
        return held

    def ilike(self, pattern: str) -> DataFrame:
        """Texts (id, text) that fit a pattern, as ILIKE does it."""
        held, texts = self.candidates(pattern), self.texts()
        fits = F.col("text").ilike(pattern)
        return texts.where(fits) if held is None else texts.join(held, "id", "left_semi").where(fits)

    def contains(self, text: str) -> DataFrame:
        """Texts that contain a typed text, trimmed, as relational.contains_text does it: % and _ keep their meaning."""
        return self.ilike(f"%{text.strip()}%")


def folded(text: str) -> str:
    """A typed text as a pattern that means just its characters."""
    return re.sub(r"([%_\\])", r"\\\1", text)
