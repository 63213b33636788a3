"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import flac, lattice, licences, mixing, packing, pii, quality, sharding, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("key", "score", "code", "first", "component", "size", "bucket", "base", "added", "part", "cell", "shard", "row", "path", "line", "target", "piece", "_key", "vector", "cid", "weight", "label2")


def odd_rows():
    long = " ".join(f"word{i % 977} and+{i % 13}" for i in range(60_000))
    return [
        (1, "a plain text of a few words", "en", "s1", 27), (1, "a plain text of a few words", "en", "s1", 27), (2, None, None, None, None), (3, "", "en", "s2", 0), (4, " \t\n ", "en", "s2", 4),
        (None, "a row without an id", "en", "s1", 19), (None, None, None, None, None), (5, long, "de", "s1", len(long)), (6, "x" * 300_000 + "@", "en", "s3", 300_001), (7, "1." * 40_000, "en", None, 80_000),
        (8, "a plain text of a few words", "fr", "s3", 27), (9, "Licensed under the Apache License, Version 2.0.\nmail me@example.org", "en", "s3", 64), (10, "1" * 200_000, "en", "s3", 1), (11, "🙂 é ́ \x00 \x1c z", "en", "s1", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels for the stages: some null and repeated."""
    path = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(None, 1, 0), (3, None, None), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, odd, folder, name, stage):
    out = stage(spark, odd, folder)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.count() > 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, empty, folder, name, stage):
    assert stage(spark, empty, folder).count() == 0


def test_packing_of_odd_rows(odd):
    rows = packing.packed(odd).collect()
    assert sum(r.piece == 0 for r in rows) == 14
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_simhash_of_odd_rows(odd, empty):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    zero = "0" * 16
    assert rows[(2, zero)] == rows[(3, zero)] == rows[(4, zero)] == 2 and rows[(None, zero)] == 2
    assert {v for (d, _), v in rows.items() if d in (1, 8)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


def test_mixing_of_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 14
    assert all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(empty).count() == 0


def test_sharding_of_odd_rows(odd, empty):
    rows = sharding.shard(odd).collect()
    assert len(rows) == 14
    for s in {r["shard"] for r in rows}:
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {8}
    assert sharding.shard(empty).count() == 0


def test_pii_of_odd_rows(odd, empty):
    rows = {r.doc_id: r for r in pii.find(odd).select("doc_id", "base", "added").collect()}
    assert [b.span for b in rows[9].base] == ["me@example.org"]
    assert rows[2].base == [] and rows[6].base == []
    assert pii.find(empty).count() == 0


def test_flac_of_odd_rows(odd):
    got = odd.select("doc_id", "text", flac.digest(flac.to_flac(F.col("text"))).alias("d")).collect()
    for r in got:
        raw = flac.payload_of(r.text)
        assert (r.d.payload_bytes, r.d.payload_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_licences_of_odd_rows(odd, empty):
    files = odd.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text", "key", "line", "cell")
    rows = licences.scan(files).collect()
    assert len(rows) == 14 and [r.licence for r in rows if r.file_id == 9] == ["Apache-2.0"]
    assert licences.scan(empty.select(F.col("doc_id").alias("file_id"), F.col("text").alias("path"), "text")).count() == 0


def test_quality_of_odd_rows(odd, empty, folder, spark):
    model = quality.train(odd, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = quality.score(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 14
    nothing = quality.train(empty, spark.read.parquet(f"{folder}/labels.parquet").limit(0))
    assert {round(r.score, 9) for r in quality.score(odd, nothing).collect()} == {0.5}


def test_warc_of_odd_rows(spark, tmp_path):
    same = "<p>" + "a" * 200
    rows = [(1, None, same), (2, "http://x/ y\n", same), (2, "http://x/", same), (None, "u", same), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (1, None, same), (7, "u", "WARC/1.1\r\n" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("again", F.lit(1))
    warc.write_archives(pages.select("page_id", "url", "html", "first"), str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    kinds = sorted(((r.page_id or 0), r.record_type, r.refers_to or 0, r.payload_bytes) for r in got)
    assert kinds == [(0, "revisit", 1, 203), (1, "response", 0, 203), (1, "response", 0, 203), (2, "revisit", 1, 203), (2, "revisit", 1, 203), (3, "response", 0, 0), (4, "response", 0, 0), (5, "response", 0, 5), (6, "response", 0, 5), (7, "response", 0, 500)]
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_lattice_of_odd_rows(spark):
    good = [float(i % 5 + 1) for i in range(16)]
    rows = [(1, good, 1), (1, good, 1), (2, good, 1), (3, good, 2), (4, good, None), (5, None, 1), (6, [], 1), (7, [0.0] * 16, 1), (8, [None] * 16, 1), (9, [float("nan")] * 16, 1), (10, [float("inf")] * 16, 1), (11, good[:8], 1), (None, good, 1), (12, [x * 1e-300 for x in good], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"cid": F.lit(1), "key": F.lit(1), "weight": F.lit(1), "first": F.lit(1)})
    got = lattice.near_duplicates(frame).collect()
    assert len(got) == 14
    links = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got}
    assert {(1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, False), (12, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (11, 0, 11, True)} <= links
    assert all(r.n_links == 0 for r in got if r.vec_id in range(3, 12))
    assert lattice.near_duplicates(frame.limit(0)).count() == 0
