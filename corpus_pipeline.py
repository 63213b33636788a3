"""The corpus pipeline: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import _common, mixing, packing, pii, quality, simhash

STAGES = [
    ("quality", quality.keep_quality),
    ("near_duplicates", simhash.keep_one_of_each),
    ("pii", pii.redact_documents),
    ("mixing", mixing.mix_documents),
    ("packing", packing.pack_documents),
]

#: SQL can express neither the classifier nor the tokenizer: the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
