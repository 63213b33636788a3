"""Relational operators, state changes, retrieval, limiters, citations and streams on small frames."""

import pytest
from pyspark.sql import functions as F

from folioscope.conf import InvalidInput, UnknownColumn
from folioscope.functions import vectors as vx
from folioscope.operators import changes as ch
from folioscope.operators import citations as ci
from folioscope.operators import limits as li
from folioscope.operators import relational as rel
from folioscope.operators import retrieval as rt
from folioscope.sources import tables


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame([(1, "a", "pending", 5, 1), (2, "a", "running", 5, 2), (3, "b", "running", 9, 3), (4, "b", None, None, 4)], "id int, owner string, status string, at int, n int")


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_filters(jobs):
    assert ids(rel.equal_where(jobs, owner="a", status=None)) == [1, 2] and ids(rel.by_keys(jobs, "id", [1, 4])) == [1, 4] and ids(rel.by_keys(jobs, "id", [])) == []
    with pytest.raises(UnknownColumn):
        rel.equal_where(jobs, nope=1)
    with pytest.raises(UnknownColumn):
        rel.page(jobs, "nope", key="id")
    with pytest.raises(InvalidInput):
        rel.page(jobs, "id", key="id", limit=101)


def test_pages(jobs):
    got = rel.page_with_total(jobs, "-at", key="id", skip=0, limit=2).collect()
    assert [r.id for r in got] == [3, 1] and got[0].total == 4 and got[0].has_more
    assert rel.latest_per(jobs, ["owner"], "at", "id").where("owner = 'a'").first().id == 2
    assert rel.exists(jobs.where("id > 9")).first().found is False
    assert [tuple(r) for r in rel.collect_children(jobs, "owner", "at", "id", 1).orderBy("owner").collect()] == [("a", "1"), ("b", "3")]
    assert rel.status_map(jobs.where("status is not null"), "status", "owner").where("owner = 'a'").first().counts == {"pending": 1, "running": 1}


def test_changes(spark, jobs):
    once = ch.claim(jobs, "status", ["pending"], "running", F.col("id") == 1)
    assert ids(once.where("affected")) == [1] and ids(ch.claim(once, "status", ["pending"], "running", F.col("id") == 1).where("affected")) == []
    new = spark.createDataFrame([(1, "z"), (9, "new")], "id int, owner string")
    up = {r.id: r for r in ch.upsert(jobs, new, ["id"], ["owner"]).collect()}
    assert up[1].owner == "z" and up[1].status == "pending" and up[9].status is None and up[2].affected is False
    assert {r.id: r.owner for r in ch.upsert(jobs, new, ["id"], []).collect()}[1] == "a"
    with pytest.raises(UnknownColumn):
        ch.patch(jobs, new.withColumnRenamed("owner", "nope"), "id")
    assert ids(ch.insert_ignore(jobs.select("id"), new.select("id"), ["id"])) == [9]
    assert ids(ch.delete(jobs, F.col("status") == "running")) == [1, 4]
    seq = spark.createDataFrame([("u", 1, 6, 10), ("u", 2, 5, 10), ("u", 3, 4, 10), ("u", 4, 0, 10)], "u string, o long, n long, l long")
    assert [(r.granted, r.used) for r in ch.consume_in_order(seq, "u", "o", "n", "l").orderBy("o").collect()] == [(True, 6), (False, 6), (True, 10), (True, 10)]
    assert [r.x for r in jobs.select(ch.retry(F.col("n")).alias("x")).collect()] == ["retry", "retry", "failed", "failed"]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red apple pie and red wine"), (2, "apple tart"), (3, "green wine, red hat"), (4, "")], "id long, t string")
    index = rt.postings(docs, "id", "t")
    assert [r.id for r in rt.text_search(index, "id", "red").collect()] == [1, 3]
    assert rt.text_search(index, "id", "red").first()["rank"] == pytest.approx(0.2)
    assert [r.id for r in rt.text_search(index, "id", "red wine").collect()] == [1, 3] and [r.id for r in rt.text_search(index, "id", '"red wine"').collect()] == [1]
    assert [r.id for r in rt.text_search(index, "id", "apple -red").collect()] == [2] and [r.id for r in rt.text_search(index, "id", "tart or hat").collect()] == [2, 3]
    assert rt.text_search(index, "id", "the and").count() == 0
    sparse = vx.embed_sparse(docs, "id", "t")
    got = rt.search(docs, "id", "t", sparse, "apple tart").collect()
    assert got[0].id == 2 and got[0].score == 1 and all(0 <= r.score <= 1 for r in got)
    assert [r.id for r in rt.search(docs, "id", "t", sparse, "apple tart", "semantic", threshold=0.99).collect()] == [2]
    for bad in ({"query": ""}, {"query": "x", "limit": 0}, {"query": "x", "threshold": 2}):
        with pytest.raises(InvalidInput):
            rt.check_request(**bad)


@pytest.mark.parametrize("places,want", [([[1, 5, 9]], 0.3), ([[1], [2]], 0.1), ([[1], [4]], 0.1 / 3), ([[1, 10], [2, 11]], 0.1 + 0.1 + 0.1 / 8)])
def test_cover_rank(places, want):
    assert rt.cover_rank(places) == pytest.approx(want)


def test_tracked_prompts(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(12)], "project int, item int")
    assert sorted((r.project, r.item) for r in rt.tracked(rows, "project", "item", 2).collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]


def test_stem():
    assert [rt.stem(w) for w in ("pages", "running", "rated", "cities", "glass", "quickly")] == ["page", "run", "rate", "citi", "glass", "quick"]


def test_fusion(spark):
    r = spark.createDataFrame([("v", "a", 0.9), ("v", "s", 0.8), ("t", "s", 3.0), ("t", "b", 1.0)], "l string, i string, s double")
    got = {x.i: x.fused for x in rel.fuse_rankings(r, "l", "i", "s").collect()}
    assert max(got, key=got.get) == "s" and got["s"] == 1 and all(0 < v <= 1 for v in got.values())


def test_fusion_of_long_rankings_takes_their_heads(spark):
    """Only the first items of each ranking count, and tasks cut them before the shuffle."""
    rows = spark.range(5000).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("l"), F.col("id").alias("i"), F.when(F.col("l") == "a", F.col("id")).otherwise(-F.col("id")).cast("double").alias("s"))
    fused = rel.fuse_rankings(rows, "l", "i", "s", most=7)
    assert sorted(r.i for r in fused.collect()) == [*range(7), *range(4993, 5000)]
    assert "WindowGroupLimit" in fused._jdf.queryExecution().executedPlan().toString()


def test_folds_in_order_over_many_batches(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("u"), F.col("id").alias("o"), (F.col("id") % 7).alias("n"), F.lit(5000).alias("l"))
    got = ch.consume_in_order(rows, "u", "o", "n", "l").toPandas().sort_values(["u", "o"])
    for u, own in got.groupby("u"):
        used = 0
        for o, granted, after in zip(own.o, own.granted, own.used, strict=True):
            ok = o % 7 <= 0 or used + o % 7 <= 5000
            used += o % 7 if ok else 0
            assert (granted, after) == (ok, used)
    odd = spark.createDataFrame([("u", 1, None, 10), ("u", 2, 3, None), (None, 1, 1, 1), ("u", 3, 4, 10)], "u string, o long, n long, l long")
    assert [(r.o, r.granted, r.used) for r in ch.consume_in_order(odd, "u", "o", "n", "l").orderBy("o").collect()] == [(1, False, 0), (2, False, 0), (3, True, 4)]


def test_details_and_failures(spark):
    parents = spark.createDataFrame([(1,), (2,)], "a int")
    jobs = spark.createDataFrame([(1, 10, 5), (1, 11, 7), (1, 12, 7)], "a int, j int, at int")
    chunks = spark.createDataFrame([(1, True), (1, False), (1, None)], "a int, e boolean")
    got = {r.a: (r.jobs, r.chunk_count, r.embedded_chunk_count) for r in ch.detail(parents, "a", jobs, "j", "at", chunks, F.col("e"), 2).collect()}
    assert got == {1: ([11, 12], 3, 1), 2: ([], 0, 0)}
    f = spark.createDataFrame([("robots", 1), ("timeout", 3), (None, None)], "k string, n int").select(ch.failure(F.col("k"), F.col("n")).alias("f"))
    assert [tuple(r.f) for r in f.collect()] == [("pending", True, False), ("failed", False, None), ("failed", False, None)]


def test_fetch_policy_cases(spark):
    def pick(*attempts):
        rows = [(1, t, ok, spa, site, allowed, "r.xml") for t, ok, spa, site, allowed in attempts]
        got = tables.choose_fetch(spark.createDataFrame(rows, "page int, transport string, ok boolean, is_spa boolean, sitemap string, robots_allowed boolean, robots_sitemap string"), "page").collect()
        return (got[0].transport, got[0].is_spa, got[0].sitemap, got[0].fallback_used) if got else None

    assert pick(("primary", True, False, "s", True), ("http", True, True, None, True)) == ("primary", False, "s", False)
    assert pick(("primary", False, False, "s", True), ("http", True, False, None, None)) == ("http", False, "r.xml", False)
    assert pick(("primary", True, True, None, True), ("browser", True, False, "b", True)) == ("browser", True, "b", True)
    assert pick(("primary", True, True, None, True), ("browser", False, False, "b", True)) == ("primary", True, "r.xml", False)
    assert pick(("browser", True, False, None, True)) == ("browser", False, "r.xml", False)
    assert pick(("primary", True, False, None, False)) is None and pick(("primary", False, False, None, True)) is None


def test_pages_as_envelopes_and_counted_appends(spark, tmp_path):
    import json

    df = spark.createDataFrame([(i, i % 3) for i in range(7)], "id int, g int")
    got = json.loads(tables.page_envelope(df, "-g", key="id", skip=1, limit=3).first().json)
    assert got == {"data": [{"id": 5, "g": 2}, {"id": 1, "g": 1}, {"id": 4, "g": 1}], "meta": {"total": 7, "skip": 1, "limit": 3, "has_more": True}}
    assert json.loads(tables.page_envelope(df.limit(0), "g", key="id").first().json) == {"data": [], "meta": {"total": 0, "skip": 0, "limit": 20, "has_more": False}}
    assert tables.append(df, str(tmp_path / "x")) == 7 and tables.append(df.where("g = 0"), str(tmp_path / "x")) == 3 and spark.read.parquet(str(tmp_path / "x")).count() == 10


def test_changes_over_days(spark):
    days = spark.sql("select 'e' as e, date_add(date'2024-01-01', cast(id as int)) as d, cast(id as double) / 100 as p from range(20) where id <> 3")
    got = {r.d.day: r.x for r in days.select("d", ci.change_since(days, "e", "d", "p", 7).alias("x")).collect()}
    assert got[8] == pytest.approx(7.0) and got[11] is None and got[7] is None and got[20] == pytest.approx(7.0)


def test_limiters(spark):
    log = li.SlidingLog(2, 10)
    assert [log.hit(t)[0] for t in (0, 1, 2, 10, 10.5, 11.5)] == [True, True, False, False, True, True]
    win = li.FixedWindow(2, 10)
    assert [win.hit(t) for t in (0, 1, 2, 10)] == [(True, 1), (True, 0), (False, 0), (True, 1)] and li.SlidingLog(0, 1).hit(5) == (True, 0)
    hits = spark.createDataFrame([("k", float(t), i) for i, t in enumerate((0, 1, 2, 10))] + [("m", 0.0, 9), (None, 1.0, 1)], "k string, at double, i int")
    got = {(r.k, r.i): r.allowed for r in li.admit(hits, "k", "at", "i", li.SlidingLog, 2, 10).collect()}
    assert got == {("k", 0): True, ("k", 1): True, ("k", 2): False, ("k", 3): False, ("m", 9): True}


def test_citations(spark):
    got = spark.range(1).select(*[c.alias(n) for n, c in ci.wilson(F.lit(6.2), F.lit(10)).items()]).first()
    assert (round(got.low, 3), round(got.high, 3)) == (0.329, 0.845)
    days = spark.createDataFrame([("e", i, 0.5 + 0.01 * (i % 2)) for i in range(8)] + [("e", 8, 5.0), ("e", 9, 0.5)], "e string, d int, p double")
    assert [r.d for r in ci.drift(days, "e", "d", "p").where("drift").collect()] == [8]
    assert ci.plan_grid(spark.range(2), 3, [0.0, 1.0]).count() == 12


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, 200, "text/html", "x"), (2, 404, "text/html", "x"), (3, 200, "image/png", "x"), (4, 200, "text/html", "y" * 5_000_001)], "id int, status int, content_type string, html string")
    assert ids(tables.accepted(rows)) == [1]
    assert tables.best_fetch(rows.withColumn("k", F.lit(1)), "k", "id", F.col("status") < 400).first().id == 1
    tables.append(rows.select("id"), str(tmp_path / "a"))
    tables.append(rows.select("id"), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 8
    tables.replace_parts(rows.select("id", "status"), str(tmp_path / "p"), "status")
    tables.replace_parts(rows.where("id = 2").select("id", "status"), str(tmp_path / "p"), "status")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    tables.export_csv(rows.select("id"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4 and tables.envelope(rows.select("id")).first().json == '{"id":1}'


def test_stream_equals_batch(spark, tmp_path):
    from folioscope.streaming import queue

    rows = spark.createDataFrame([(i % 7, float(i)) for i in range(40)], "k int, at double").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    source = queue.jobs_stream(spark, str(tmp_path / "in"), rows.schema)
    got = []
    queue.each_batch(source, str(tmp_path / "s1"), lambda df, _: got.extend(df.collect()))
    assert len(got) == 40
    q = queue.limited(source, "k", "at", 2, 14.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = li.admit(rows.withColumn("i", F.lit(0)), "k", "at", "i", li.SlidingLog, 2, 14.0).select("k", "at", "allowed")
    assert sorted(map(tuple, spark.table("limited").select("k", "at", "allowed").collect())) == sorted(map(tuple, batch.collect()))
    assert queue.requeue(spark.createDataFrame([(1, 0), (2, 3)], "id int, n int"), "n", F.current_timestamp()).count() == 1
