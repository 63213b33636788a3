"""Documents into chunks with vectors, and the bookkeeping around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.conf import EngineConf
from folioscope.functions.chunking import chunk_documents
from folioscope.functions.vectors import embed_sparse

#: Chunks that one pass of a scheduler takes, at most.
PENDING = 10_000


def chunk_rows(docs: DataFrame, key: str, text: str, conf: EngineConf | None = None) -> DataFrame:
    """Chunks with a number of their own, key and place in one, and the flag that they have no vector yet."""
    made = chunk_documents(docs, key, text, conf)
    return made.withColumn("chunk_id", F.concat_ws("/", F.col(key).cast("string"), F.col("chunk_index").cast("string"))).withColumn("is_embedded", F.lit(False))


def pending(chunks: DataFrame, key: str | None = None, most: int | None = None) -> DataFrame:
    """Chunks without a vector: all of them, or with `most` (PENDING for a scheduler) one pass, by key and place.

    A pass is a top-k in each task and then of those; passes repeated until
    none is left embed what the call without `most` embeds at once.
    """
    left = chunks.where(~F.col("is_embedded"))
    return left if most is None else left.orderBy(key or "chunk_id", "chunk_index").limit(most)


def vectors_of(chunks: DataFrame, conf: EngineConf | None = None) -> DataFrame:
    """Sparse vectors (chunk_id, dim, weight) of chunks."""
    return embed_sparse(chunks, "chunk_id", "content", (conf or EngineConf()).dimensions)


def attach(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with the flag set where a vector is there; the wide column itself stays where it is."""
    done = vectors.select(F.col("chunk_id").alias("_done")).distinct()
    return chunks.join(done, F.col("chunk_id") == F.col("_done"), "left").withColumn("is_embedded", F.col("is_embedded") | F.col("_done").isNotNull()).drop("_done")


def reingest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Chunks after documents came anew: those of the documents in new are replaced as a whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def counts(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.count_if("is_embedded").alias("embedded"), F.sum("token_count").alias("tokens"))
