"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SMALL

from folioscope.plans import catalog, corpus

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries over parsed markup, chunks and stems, which SQL can't express.
WITHOUT_SQL = {"chunk_documents", "chunk_stats", "fts_cover_rank", "fts_stemmed", "html_clean_stats", "ingest_documents", "machine_score", "page_scorecard", "reingest_documents", "vector_cells_recall"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(frame):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(one(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SMALL).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0 and name in WITHOUT_SQL  # each has a test of its own in test_brute_force.py or test_machinery.py
        return
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(want) > 0 or name == "fts_all_terms_match"  # the smallest tables hold no text with both words


def test_flagship(spark):
    rows = catalog.flagship(spark, SMALL).collect()
    assert rows and all(0 <= r.pcs <= 1 for r in rows)


def test_hybrid_orders_by_similarities_as_they_are(spark, tmp_path):
    """Similarities that differ in their last bit alone are no ties."""
    rows = [(a, f"thing x{a} " * a) for a in range(1, 13)] + [(100 + i, " ".join(f"w{j}" for j in range(corpus.ONE - 1))) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'").execute(catalog.oracle_sql()["hybrid_rrf"]).fetchall()
    got = catalog.queries()["hybrid_rrf"](spark, str(tmp_path)).collect()
    assert len(want) == 10 and [tuple(r) for r in got] == want
