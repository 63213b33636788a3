"""Secrets in versions of files: an incremental ledger of blobs.

Every version of a file is addressed by its content, the SHA-256 of its bytes.
The ledger is a folder of two tables: `versions` (path, version, blob) and
`scans` (blob, the rules as kind@version that were run on it, what they found).
A commit adds its versions, takes from its blobs the pairs of blob and rule
version that no scan holds yet, runs just these, and adds one row for each such
blob. So a text is scanned once however many paths and versions hold it, and a
new or changed rule is run alone, over what is in the commit. Findings are
joined back to all paths of all versions.

A row of `scans` holds its rules and its findings together, so whatever part of
a commit is there is right by itself; a commit that failed is given again, and
what it had already scanned is passed over.

Base rules are the three of the contract; the others (RULES) are formats of
issued credentials that begin with a fixed sign. Spans are code points of the
whole match, end exclusive. A null text counts as empty. Repeated rows each
keep their findings. Very long texts are matched whole, each rule in time
proportional to the text. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._common import fresh_path, table


def _cased(word: str) -> str:
    """A pattern for a word with its letters in either case, ASCII alone in every engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


class Rule(NamedTuple):
    """What a kind of secret looks like. `sign` is what each text with a match holds; version grows with every change."""

    kind: str
    version: int
    pattern: str
    sign: str
    #: Fewest characters of `group`; shorter matches are dropped and not tried again.
    least: int = 0
    group: int = 0

    @property
    def mark(self) -> str:
        return f"{self.kind}@{self.version}"


_KEY = "|".join(map(_cased, ("password", "passwd", "secret", "token", "api_?key")))
BASE = ("assign", "access", "hex")
# The base rules, then formats that issuers publish for their credentials.
RULES = (
    Rule("assign", 1, rf"({_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", rf"(?:{_KEY})[\"']?\x20*[:=]", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", 20),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{24}", 24),
    Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]+", r"gh[oprsu]_[A-Za-z0-9]", 40),
    Rule("slack", 1, r"xox[abeprs]-[A-Za-z0-9-]+", r"xox[abeprs]-", 15),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]+", r"AIza", 39),
    Rule("stripe", 1, r"[rs]k_live_[A-Za-z0-9]+", r"[rs]k_live_", 32),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
)
SPANS = "array<struct<mark:string,start:int,end:int>>"
SCANS = f"blob binary, marks array<string>, spans {SPANS}"
VERSIONS = "path string, version string, blob binary"
#: Unseen blobs up to so many are broadcast, 32 bytes and the names of their rules each.
BROADCAST = 100_000


def address(text: Column) -> Column:
    """A text's blob: 32 bytes of SHA-256."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def spans_of(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, less those that are too short."""
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]


class Ledger:
    """A ledger in a folder that the driver and all executors see; made where there is none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("scans", SCANS), ("versions", VERSIONS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")

    def scans(self) -> DataFrame:
        return self.spark.read.schema(SCANS).parquet(f"{self.path}/scans")

    def versions(self) -> DataFrame:
        return self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions")

    def unseen(self, blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, marks: of the distinct blobs those with rule versions that no scan has run on them, and which."""
        seen = self.scans().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("_seen"))
        wanted = F.array(*[F.lit(r.mark) for r in rules])
        left = F.array_except(wanted, F.coalesce("_seen", F.expr("cast(array() as array<string>)")))
        return blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", left.alias("marks")).where("size(marks) > 0")

    def commit(self, docs: DataFrame, path: str, text: str, version: str, rules: tuple[Rule, ...] = RULES) -> int:
        """Add a version of docs (columns path and text) and scan what is unseen of it: gives the number of blobs scanned."""
        here = docs.select(F.col(path).cast("string").alias("path"), F.lit(version).alias("version"), address(F.col(text)).alias("blob"))
        here.write.mode("append").parquet(f"{self.path}/versions")
        spare = fresh_path(self.spark, "unseen")
        self.unseen(self.versions().where(F.col("version") == version), rules).write.parquet(spare)
        unseen = self.spark.read.schema("blob binary, marks array<string>").parquet(spare)
        n = unseen.count()
        if n:
            own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.regexp_like("text", F.lit("|".join(r.sign for r in rules))))
            own = own.select(address(F.col("text")).alias("blob"), "text")
            if n <= BROADCAST:  # the usual commit on a grown ledger: texts that are known don't move
                own = own.join(F.broadcast(unseen), "blob").dropDuplicates(["blob"])
            else:
                own = own.dropDuplicates(["blob"]).join(unseen, "blob")
            found = own.mapInPandas(_scan(rules), f"blob binary, spans {SPANS}")
            rows = unseen.join(found, "blob", "left").select("blob", "marks", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))
            rows.write.mode("append").parquet(f"{self.path}/scans")
        return n

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """path, version, blob, spans: all versions with what the given rule versions found in their blobs, by start, then rule."""
        marks = F.array(*[F.lit(r.mark) for r in rules])
        kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.mark, r.kind)])
        placed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(marks, s["mark"]).cast("int").alias("rule"), s["end"].alias("end"), kinds[s["mark"]].alias("kind")))
        own = self.scans().select("blob", F.filter(placed, lambda s: s["rule"] > 0).alias("spans")).where("size(spans) > 0")
        own = own.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
        none = F.expr("cast(array() as array<struct<start:int,rule:int,end:int,kind:string>>)")
        return self.versions().join(own, "blob", "left").select("path", "version", "blob", F.coalesce("spans", none).alias("spans"))


def _scan(rules: tuple[Rule, ...]):
    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [[{"mark": r.mark, "start": a, "end": b} for r in rules if r.mark in marks for a, b in spans_of(text, r)] for text, marks in zip(part["text"], part["marks"], strict=True)]
            yield pd.DataFrame({"blob": part["blob"], "spans": pd.Series(out, dtype=object, index=part.index)})[[bool(x) for x in out]]

    return scan


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of all documents, each the only version of its path."""
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    ledger.commit(table(spark, sf_dir, "documents"), "doc_id", "text", "1")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return ledger.findings().select(F.col("path").cast("long").alias("doc_id"), *map(count, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
