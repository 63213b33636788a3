"""Where frames come from and where they go."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.conf import EngineConf
from folioscope.functions.text import is_html
from folioscope.operators.relational import page


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, by any path that Spark's readers take."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors see, spark.checkpoint.dir; only on one machine a temporary one where that is unset. It goes when the driver's Python ends."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        home = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    path = f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder is scratch
        pass


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of change of a file or folder: what was derived from it holds while these stay."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(target).getLength(), files.getFileStatus(target).getModificationTime()


def accepted(fetched: DataFrame, conf: EngineConf | None = None) -> DataFrame:
    """Fetched pages (status, content_type, html) that may be read: below 400, HTML, not too large."""
    conf = conf or EngineConf()
    return fetched.where((F.col("status") < 400) & is_html(F.col("content_type")) & (F.octet_length(F.coalesce(F.col("html"), F.lit(""))) <= conf.max_page_bytes))


def best_fetch(candidates: DataFrame, key: str, rank: str, good: Column) -> DataFrame:
    """Of each page's attempts the first good one by rank."""
    rest = [c for c in candidates.columns if c != key]
    return candidates.where(good).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(rank)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def with_robots(pages: DataFrame, rules: DataFrame, host: str) -> DataFrame:
    """Pages with the rules of their host, null where there are none: then everything is allowed."""
    known = rules.select(F.col(host).alias("_h"), "rules")
    return pages.join(known, F.col(host) == F.col("_h"), "left").drop("_h")


def choose_fetch(attempts: DataFrame, key: str) -> DataFrame:
    """Of each page's attempts the one that counts, by the policy of escalation.

    attempts: key, transport (primary, http or browser), ok, is_spa, sitemap,
    robots_allowed, robots_sitemap and what else they bring. A page that robots
    rules refuse has none. The primary attempt counts where it is good, else
    the plain one; if that is a shell without content and the browser's is good
    the browser's does, with fallback_used. The sitemap of the page wins over
    that of the robots rules.
    """
    rest = [c for c in attempts.columns if c != key]
    good = attempts.where(F.col("ok") & F.coalesce(F.col("robots_allowed"), F.lit(True)))
    of = {t: F.max(F.when(F.col("transport") == t, F.struct(*rest))).alias(t) for t in ("primary", "http", "browser")}
    first = F.coalesce("primary", "http")
    shell = F.coalesce(first["is_spa"], F.lit(False))
    taken = F.when(shell & F.col("browser").isNotNull(), F.col("browser")).otherwise(F.coalesce(first, F.col("browser")))
    found = good.groupBy(key).agg(*of.values()).select(key, taken.alias("_r"), (shell & F.col("browser").isNotNull()).alias("fallback_used"), shell.alias("_spa"))
    own = [F.col(f"_r.{c}").alias(c) for c in rest if c not in ("sitemap", "is_spa")]
    return found.select(key, *own, F.col("_spa").alias("is_spa"), F.coalesce("_r.sitemap", "_r.robots_sitemap").alias("sitemap"), "fallback_used")


def append(df: DataFrame, path: str) -> int:
    """The number of rows written, counted as they are written."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def replace_parts(df: DataFrame, path: str, *parts: str) -> None:
    """Write and replace only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def page_envelope(df: DataFrame, *order: str, key: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """One row with the JSON of a page: data, and meta with total, skip, limit and has_more."""
    rows = page(df, *order, key=key, skip=skip, limit=limit)  # at most 100 rows
    names = [o.lstrip("-") for o in order]
    down = [o.startswith("-") for o in order]
    place = F.row_number().over(Window.orderBy(*[F.col(n).desc() if d else F.col(n).asc() for n, d in zip(names, down, strict=True)], *([] if key in names else [F.col(key)])))
    data = rows.withColumn("_p", place).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", F.struct(*df.columns).alias("row")))), lambda x: x["row"]).alias("data"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    meta = F.struct("total", F.lit(skip).alias("skip"), F.lit(limit).alias("limit"), (F.col("total") > skip + limit).alias("has_more"))
    return data.crossJoin(F.broadcast(total)).select(F.to_json(F.struct("data", meta.alias("meta"))).alias("json"))


def envelope(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
