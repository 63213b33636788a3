"""The engine's functions under SQL names."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException

from folioscope.functions import html, urls, vectors
from folioscope.functions.chunking import chunks, tokens_of


class MarkdownChunks:
    """Rows for each chunk of a text: SELECT * FROM docs, LATERAL markdown_chunks(text)."""

    def eval(self, text: str):
        for i, c in enumerate(chunks(text)):
            yield i, c.content, tokens_of(c.content), c.heading_path


class FirstRows:
    """The first rows of each partition of any table, with their place: rows come sorted, so one counter is all that is held.

    SELECT * FROM first_rows(TABLE(t) PARTITION BY (k) ORDER BY (v DESC, id), 3). The columns are those of the table behind `place`.
    """

    def __init__(self):
        self.place = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not most.isConstantExpression:
            raise ValueError("first_rows takes a table and a constant number")
        return AnalyzeResult(T.StructType([T.StructField("place", T.IntegerType()), *rows.dataType.fields]))

    def eval(self, row, most: int):
        self.place += 1
        if self.place > most:
            raise SkipRestOfInputTableException("the first rows have been seen")
        yield (self.place, *row)


def wilson_low(hits: pa.Array) -> float | None:
    """Lower end of the 95 % Wilson interval of a column of truths; nulls don't count."""
    n = len(hits) - hits.null_count
    return None if n == 0 else _wilson(pc.sum(hits).as_py() / n, n)


def _wilson(p: float, n: int, z: float = 1.96) -> float:
    return max(0.0, (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def register(spark: SparkSession) -> None:
    """read_page, normalise_url, robots_decision, hashed_embedding, the aggregate wilson_low, and the table functions markdown_chunks and first_rows."""
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: vectors.dense(t, 1536))

    spark.udf.register("read_page", html._read_page)
    spark.udf.register("normalise_url", urls.normalised)
    spark.udf.register("robots_decision", urls.robots_decision)
    spark.udf.register("hashed_embedding", F.pandas_udf(embed, T.ArrayType(T.DoubleType())))
    spark.udtf.register("markdown_chunks", F.udtf(MarkdownChunks, returnType="chunk_index int, content string, token_count int, heading_path string"))
    spark.udtf.register("first_rows", F.udtf(FirstRows))
    spark.udf.register("wilson_low", F.arrow_udf(wilson_low, T.DoubleType(), F.ArrowUDFType.GROUPED_AGG))
