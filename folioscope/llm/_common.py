"""What the training-data operators share: inputs, working tables, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in every contract of this package.
SPACES = " \t\n\x0b\x0c\r"
#: A word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's spark.checkpoint.dir. Only where that is unset and the
    master is local, as in tests on one machine, a temporary folder is made and
    set; on a cluster that setting is asked for.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder is scratch
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete_path, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and a lost executor loses none of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folioscope_path = path  # type: ignore[attr-defined]
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    if path := getattr(df, "_folioscope_path", None):
        delete_path(df.sparkSession, path)


def hash_sample(df: DataFrame, most: int, *key: str) -> DataFrame:
    """At most `most` rows of df, by a hash of its key columns and so the same at each run.

    Rows are thinned out where they are, by their number, so that what meets
    in one task to be cut exactly is about `most` rows whatever df's size.
    """
    n = df.count()
    mark = F.xxhash64(*key)
    if n > most:
        share = (most + 4 * most**0.5) / n
        df = df.where(mark.bitwiseAND(F.lit((1 << 52) - 1)) < int(share * (1 << 52)))
    return df.orderBy(mark, *key).limit(most)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, component): the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and an
    equi-join, so that a node with very many neighbours is pre-aggregated
    before the shuffle and its join partition can be split. A round's edges
    are written to the shared folder, which cuts the lineage. Null nodes and
    self-links are ignored; an empty input gives an empty result.
    """
    def undirected(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = stored(undirected(edges.where("a is not null and b is not null")), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every lower neighbour and the node itself hang on the lowest one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = stored(small, "edges")
        drop_stored(now)
        now, last, seen = nxt, seen, mark(nxt)
        if seen == last:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
