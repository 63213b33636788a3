"""Stored indexes, cells, trigrams, layouts, networks, suffixes, stateful streams and queues, against brute force and stated cases."""

import ipaddress
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from folioscope.functions import networks as nw
from folioscope.functions import register as rg
from folioscope.functions import suffixes as sx
from folioscope.operators import cells, grams
from folioscope.operators import relational as rel
from folioscope.operators import retrieval as rt
from folioscope.operators import textindex as ti
from folioscope.operators.limits import SlidingLog
from folioscope.plans import corpus, machinery
from folioscope.sources import layout, queues
from folioscope.sources.tables import shared_path

# --- text index --------------------------------------------------------------


def plain_search(docs, query, limit, stemmed=False):
    """Every text against the parsed query, word by word."""
    out = []
    alternatives = rt.parse_query(query, stemmed)
    for key, text in docs.items():
        places = {}
        for at, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower()), 1):
            if w not in rt.STOP:
                places.setdefault(rt.stem(w) if stemmed else w, []).append(at)
        has = lambda p: any(all(a + i in places.get(w, ()) for i, w in enumerate(p)) for a in places.get(p[0], ()))  # noqa: B023, E731
        for wanted, refused in alternatives:
            if all(map(has, wanted)) and not any(map(has, refused)):
                out.append((key, rt.cover_rank([places[w] for w in sorted({w for p in wanted for w in p})])))
                break
    out.sort(key=lambda x: (-x[1], x[0]))
    return out if limit is None else out[:limit]


QUERIES = ["red", "red wine", '"red wine"', "wine -red", "red or tart", '"red wine" or tart -apple', "nothing", "-red", "the and", "red red", '"wine red wine"', "apple tart -\"red wine\""]


def texts(draw, n):
    vocabulary = np.array(["red", "wine", "tart", "apple", "the", "boat", "x1", "runs", "and"])
    return {int(i): " ".join(vocabulary[draw.integers(0, 9, int(draw.integers(0, 40)))]) for i in range(n)}


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_equals_plain_search(spark, tmp_path, monkeypatch, stemmed):
    docs = texts(np.random.default_rng(3), 700)
    index = ti.TextIndex(spark, str(tmp_path / "i"), stemmed, shards=3)
    index.add(spark.createDataFrame(list(docs.items()), "id long, t string"), "id", "t")
    for q in QUERIES:
        for limit in (5, None):
            got = sorted((r.key, round(r["rank"], 9)) for r in index.search(q, limit).collect())
            assert got == sorted((k, round(r, 9)) for k, r in plain_search(docs, q, limit, stemmed)), q


def test_index_of_several_generations(spark, tmp_path):
    index = ti.TextIndex(spark, str(tmp_path / "i"), stemmed=False, shards=2)
    first = {1: "red red red", 2: "red wine", 3: None, 4: "old red"}
    assert index.add(spark.createDataFrame(list(first.items()) + [(None, "red"), (2, "red")], "id long, t string"), "id", "t") == 1
    assert index.add(spark.createDataFrame([(1, "tart"), (5, "red red")], "id long, t string"), "id", "t") == 2
    assert index.remove(spark.createDataFrame([(4,)], "id long"), "id") == 3
    now = {1: "tart", 2: "red wine", 3: None, 5: "red red"}
    for q in ("red", "tart", "old", "red wine", "wine or tart"):
        assert [(r.key, r["rank"]) for r in index.search(q).collect()] == plain_search(now, q, 10), q
    assert {r.lexeme: r.documents for r in index.lexicon().collect()}["red"] == 4
    small = index.compact(str(tmp_path / "c"))
    assert {r.lexeme: r.documents for r in small.lexicon().collect()} == {"red": 2, "wine": 1, "tart": 1}
    assert [(r.key, r["rank"]) for r in small.search("red").collect()] == plain_search(now, "red", 10)
    assert ti.TextIndex(spark, str(tmp_path / "i")).stemmed is False  # settings are the index's own
    empty = ti.TextIndex(spark, str(tmp_path / "e"))
    empty.add(spark.createDataFrame([], "id long, t string"), "id", "t")
    assert empty.search("red").count() == 0 and empty.frequent(5) == []


def test_stems_in_an_index_of_unstemmed_words(spark, tmp_path):
    """A word's forms are found as one word: phrases of them, several in one text, and none that a later generation has replaced."""
    docs = texts(np.random.default_rng(5), 500) | {i: t for i, t in enumerate(["boats boat boating", "running boats", "run -boat runs", "boated", None], 500)}
    docs = {k: t and t.replace("tart", "boats").replace("apple", "running") for k, t in docs.items()}
    index = ti.TextIndex(spark, str(tmp_path / "i"), stemmed=False, shards=3)
    index.add(spark.createDataFrame([(k, "boated boats") if k % 7 == 0 else (k, t) for k, t in docs.items()], "id long, t string"), "id", "t")
    index.add(spark.createDataFrame([(k, t) for k, t in docs.items() if k % 7 == 0], "id long, t string"), "id", "t")
    assert index.forms(["boat", "run"]) == {"boat": "boat", "boats": "boat", "boated": "boat", "boating": "boat", "run": "run", "runs": "run", "running": "run"}
    for q in ("boating", '"running boat"', "runs -boated", '"boat boat" or red runs', "nothing", "-boat", "the"):
        for limit in (5, None):
            got = sorted((r.key, round(r["rank"], 9)) for r in index.search(q, limit, stemmed=True).collect())
            assert got == sorted((k, round(r, 9)) for k, r in plain_search(docs, q, limit, True)), q
    assert [r.key for r in index.search("boated").collect()] == [503]  # as it stands


def test_postings_are_gathered_before_they_are_sorted(spark, tmp_path, monkeypatch):
    """What is dealt and sorted is a row for a lexeme and shard of a task's texts, not for each text that has it."""
    sent, write = [], ti.TextIndex._write
    monkeypatch.setattr(ti.TextIndex, "_write", staticmethod(lambda rows, number, path: (sent.append(rows.count()), write(rows, number, path))))
    index = ti.TextIndex(spark, str(tmp_path / "i"), stemmed=False, shards=2)
    index.add(spark.range(1000).selectExpr("999 - id AS id", "'red wine red' AS t").repartition(2), "id", "t")
    assert sent[0] <= 2 * 2 * 2  # words, shards, tasks
    assert index.search("wine -tart", None).count() == 1000 and [r.key for r in index.search("red", 3).collect()] == [0, 1, 2]


def test_blocks_of_rows_in_any_order(monkeypatch):
    """A group's rows are sorted, a long one in parts; numbers are packed alike alone and together."""
    monkeypatch.setattr(ti, "LONG", 300)
    keys = np.random.default_rng(2).choice(1 << 20, 1000, replace=False).astype(np.int64) << 20
    rows = [("red", 0, int(k), [1, 2 + int(k) % 70_000]) for k in keys] + [("wine", 0, 5, [9]), ("wine", 1, 4, [7])]
    batch = pa.RecordBatch.from_pylist([dict(zip(("lexeme", "shard", "key", "places"), r, strict=True)) for r in rows])
    made = [b for x in ti._blocks(1, iter([batch.slice(a, 250) for a in range(0, len(batch), 250)])) for b in x.to_pylist()]
    found = []
    for b in made:
        own = ti.Block(b["first"], b["last"], b["impact"], 1, (b["keys"], b["counts"], b["places"])).open({})
        assert (np.diff(own.keys) > 0).all() and len(own.keys) == b["n"] <= ti.BLOCK and (own.keys[0], own.keys[-1]) == (b["first"], b["last"])
        assert b["counts"] == ti.pack(own.counts)
        found += [(b["lexeme"], b["shard"], k, x.tolist()) for k, x in zip(own.keys.tolist(), own.lists, strict=True)]
    assert sorted(found) == sorted(rows)


def test_search_reads_the_partitions_of_its_words(spark, tmp_path):
    index = ti.TextIndex(spark, str(tmp_path / "i"), stemmed=False)
    index.add(spark.createDataFrame(list(texts(np.random.default_rng(1), 50).items()), "id long, t string"), "id", "t")
    blocks = index.postings(["red", "wine"])
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*part", plan) and "PushedFilters: [" in plan
    assert len({re.search(r"part=(\d+)", f)[1] for f in blocks.select(F.input_file_name().alias("f")).distinct().toPandas().f}) <= 2


def test_blocks_that_cannot_reach_the_top_are_not_read():
    """One block has the frequent occurrences: of the others only as many are unpacked as it takes to be sure."""
    rng = np.random.default_rng(0)
    keys = np.arange(128 * 100)
    counts = np.where(keys < 128, 9, rng.integers(1, 4, len(keys)))
    rows = pd.DataFrame({"lexeme": "red", "shard": 0, "key": keys, "places": [np.arange(1, c + 1, dtype=np.int32) for c in counts]})
    made = pd.concat(b.to_pandas() for b in ti._blocks(1, iter([pa.RecordBatch.from_pandas(part, preserve_index=False) for part in (rows.iloc[:5000], rows.iloc[5000:])])))
    assert made["n"].sum() == len(keys) and (made["n"].iloc[:-1] == ti.BLOCK).all()
    blocks = [ti.Block(r.first, r.last, r.impact, 1, (r.keys, r.counts, r.places)) for r in made.itertuples()]
    ti.Block.read = 0
    assert ti.Shard({"red": blocks}, {}).search([([["red"]], [])], 10) == [(k, pytest.approx(0.9)) for k in range(10)]
    assert ti.Block.read <= 2
    two = ti.Shard({"red": blocks, "wine": [ti.Block(r.first, r.last, r.impact, 1, (r.keys, r.counts, r.places)) for r in made.itertuples()]}, {})
    ti.Block.read = 0
    assert len(two.search([([["red"], ["wine"]], [])], 10)) == 10 and ti.Block.read <= 6


def test_packed_numbers():
    for values in ([], [0], [255], [256, 1], [1 << 16], [1 << 40, 3], list(range(300))):
        assert ti.unpack(ti.pack(np.array(values, dtype=np.int64))).tolist() == values


# --- scores where rows are ---------------------------------------------------


def test_best_matches_in_blocks_of_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in texts(np.random.default_rng(8), 300).items()] + [(300, None), (None, "red"), (301, "")], "id long, t string").repartition(5)
    asked = spark.createDataFrame([(j, w) for j, w in enumerate(["red wine", "boat", "zzz", None, "apple apple tart"])], "q long, w string")
    from folioscope.functions import vectors as vx

    want = {}
    rows, plain = docs.collect(), {j: vx.sparse(w, 1536) for j, w in enumerate(["red wine", "boat", "zzz", None, "apple apple tart"])}
    for j, q in plain.items():
        scored = [(-round(sum(q[k] * v for k, v in own.items() if k in q), 6), r.id) for r in rows if r.id is not None and set(own := vx.sparse(r.t, 1536)) & set(q)]
        want.update({(j, i): -s for s, i in sorted(scored)[:4]})
    for packed in (1024, 2):
        monkeypatch.setattr(rt, "PACKED", packed)
        got = {(r.q, r.id): r.similarity for r in rt.best_matches(docs, "id", "t", asked, "q", "w", 4).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
    plan = rt.best_matches(docs, "id", "t", asked, "q", "w", 4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*\bid#", plan)


def test_equal_texts_have_equal_similarities_wherever_they_are(spark):
    query = " ".join(f"w{i} " * (1 + i % 5) for i in range(60))
    one, other = [" ".join(f"{w}{i} " * (1 + i % 7) for i in range(90)) for w in ("w", "v")]
    docs = spark.createDataFrame([(i, one if i % 3 else other) for i in range(1000)], "id long, t string").repartition(7)
    asked = spark.createDataFrame([(0, query)], "q long, w string")
    got = rt.best_matches(docs, "id", "t", asked, "q", "w", 500, None).collect()
    assert [r.id for r in sorted(got, key=lambda r: (-r.similarity, r.id))] == [i for i in range(1000) if i % 3][:500] and len({r.similarity for r in got}) == 1


# --- cells -------------------------------------------------------------------


def test_all_cells_give_the_exact_search(spark, tmp_path):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, x[0].tolist()), (404, (x[1] * 1e300).tolist()), (None, x[0].tolist()), (405, [None] * 8)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    index = cells.CellIndex.build(frame, "id", "v", str(tmp_path / "i"), lists=12, rounds=4)
    got = index.search(frame.where("id < 20"), "id", "v", 7, probes=12).collect()
    for q in range(20):
        own = [(r.similarity, -r.id) for r in got if r.query == q]
        good = [(i, np.asarray(v) / np.abs(v).max()) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
        want = sorted(((round(float(v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q])), 12), -i) for i, v in good), reverse=True)[:7]
        assert sorted(own, reverse=True) == [(pytest.approx(s, abs=1e-9), i) for s, i in want]
    assert index.cells().select("cell").distinct().count() > 6
    plan = index.search(frame.where("id = 3"), "id", "v", 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*cell", plan)
    index.add(spark.createDataFrame([(500, (2 * x[3]).tolist())], "id long, v array<double>"), "id", "v")
    assert [r.id for r in index.search(frame.where("id = 3"), "id", "v", 2, probes=2).collect()] == [3, 500]
    none = cells.CellIndex.build(frame.limit(0), "id", "v", str(tmp_path / "e"))
    assert none.search(frame.where("id = 3"), "id", "v").count() == 0


def test_cells_of_tables_with_empty_tasks_and_vectors_of_other_lengths(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0, 3.0]), (3, [])]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(16)
    index = cells.CellIndex.build(frame, "id", "v", str(tmp_path / "i"), lists=2)
    found = index.search(frame.where("id in (0, 2)"), "id", "v", 5, probes=2)
    assert [(r.query, r.id) for r in found.orderBy("query", "id").collect()] == [(0, 0), (0, 1)]


def test_probed_cells_find_nine_in_ten(spark):
    row = corpus.vector_cells_recall(spark, SMALL).first()
    assert row.wanted == 100 and row.found <= row.wanted and row.recall >= 0.9


def test_recall_where_nothing_is_asked(spark, tmp_path):
    spark.createDataFrame([(1, None), (7, [1.0, 0.0])], "vec_id long, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert tuple(corpus.vector_cells_recall(spark, str(tmp_path)).first()) == (0, 0, None, corpus.WIDE)


# --- trigrams ----------------------------------------------------------------


def test_patterns_of_all_kinds_equal_ilike(spark, tmp_path):
    names = ["Green apple", "GREENISH", "gr%een", "ab", "a", "", "Straße", "ÉTÉ d'été", "x_y", "back\\slash", "été", "abcabc", " green", "İstanbul", "a\x00b", "ΣΑΣ"]
    rows = [(i, n) for i, n in enumerate(names)] + [(99, None), (None, "green"), (0, "another")]
    frame = spark.createDataFrame(rows, "id long, name string")
    index = grams.GramIndex.build(frame, "id", "name", str(tmp_path / "g"))
    for p in ["%green%", "green%", "%ab", "a", "", "%", "%_%", "%é%", "_b", "%bc%bc%", "%\\%%", "%x\\_y%", "%zzz%", "%ı%", "%i%", "ΣΑΣ", "% %", "__", "%ß%", "%\x00%", "%abcd%"]:
        want = sorted(map(tuple, frame.where(F.col("id").isNotNull() & F.col("name").ilike(p)).collect()))
        assert sorted(map(tuple, index.ilike(p).collect())) == want, p
    assert index.contains(" GREEN ").count() == 3 and index.contains(grams.folded("gr%e")).count() == 1
    assert index.candidates("%zzz%").count() == 0 and index.candidates("%abcabc%").count() == 1 and index.candidates("%_%") is None
    assert index.rarest("%green apple%")[0][1] == 1


def test_candidates_are_few(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet")
    index = grams.GramIndex.build(part, "p_partkey", "p_name", str(tmp_path / "g"))
    name = part.orderBy("p_partkey").first()["p_name"]
    held, fits = index.candidates(f"%{name[2:14]}%").count(), index.ilike(f"%{name[2:14]}%").count()
    assert 1 <= fits <= held <= part.count() / 10
    plan = index._of(index.grams(), "gre")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*part", plan)


# --- layouts and passes ------------------------------------------------------


@pytest.mark.parametrize("name", ["bucketed_owner_three_way", "bucketed_audit_detail", "bucketed_child_stats"])
def test_bucketed_tables_need_no_shuffle_on_their_key(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = machinery.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not re.search(r"Exchange hashpartitioning\(audit_id", plan) and "Bucketed: true" in plan


def test_passes_until_no_orphan_is_left(spark):
    children = spark.createDataFrame([(i, i % 7) for i in range(100)], "id long, p long")
    parents = spark.createDataFrame([(0,), (3,)], "k long")
    first = rel.orphan_pass(children, parents, "p", "k", "id", F.col("id") > 10, 5).collect()
    assert [r.id for r in first] == [11, 12, 13, 15, 16]

    def store(frame, n):
        path = shared_path(spark, "pass")
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    left, taken = rel.without_orphans(children, parents, "p", "k", "id", store, most=30)
    assert {r.p for r in left.collect()} == {0, 3} and taken == [30, 30, 11] and left.count() == 29
    assert rel.orphans(children, parents, "p", "k").count() == 71


def test_a_bucketed_table_keeps_its_rows(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(50)] + [(None, 1)], "k long, v long")
    assert Counter(map(tuple, layout.bucketed(df, "t", "k", 4).collect())) == Counter(map(tuple, df.collect()))


# --- networks and suffixes ---------------------------------------------------

ADDRESSES = ["10.0.0.1", "8.8.8.8", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "01.2.3.4", "::", "::1", "1::", "fe80::1", "FE80::A", "[::1]", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1", "1:", "12345::", "g::", "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "::1.2.3.400", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", ":::", "", " ", "a.b", "1.2.3.4.5", "1:2:3:4:5:6:7", "2001:db8::"]


def test_digits_of_addresses(spark):
    rows = spark.createDataFrame([(a,) for a in [*ADDRESSES, None]], "a string").select("a", nw.digits(F.col("a")).alias("d")).collect()
    for r in rows:
        try:
            ip = ipaddress.ip_address((r.a or "").strip("[]"))
            want = f"{int(ip) + (0xFFFF << 32 if ip.version == 4 else 0):032x}"
        except ValueError:
            want = None
        assert r.d == want, r.a


def test_networks_equal_the_plain_library(spark):
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.3", "0.0.0.0/0", "192.168.0.0/13", "::/0", "fe80::/10", "fe80:1::/33", "2001:db8::1/128", "nonsense", "10.0.0.0/33", "1::/129", "64:ff9b::/95", None]
    draw = np.random.default_rng(3)
    own = [a for a in ADDRESSES if a] + [str(ipaddress.ip_address(int(x))) for x in draw.integers(0, 1 << 32, 60)] + [f"10.1.{i}.3" for i in range(4)] + [str(ipaddress.ip_address((0xFE80 << 112) + (int(x) << 70))) for x in draw.integers(0, 1 << 40, 40)] + ["2001:db8::1", "64:ff9a::5", "192.170.1.1"]
    frame = spark.createDataFrame([(a,) for a in own] + [(None,)], "a string")
    got = {r.a: r.network for r in nw.longest_match(frame, "a", spark.createDataFrame([(n,) for n in nets], "net string"), "net").collect()}
    good = []
    for n in nets:
        try:
            good.append(ipaddress.ip_network(n, strict=False))
        except (ValueError, TypeError):
            pass
    for a in own:
        try:
            ip = ipaddress.ip_address(a.strip("[]"))
            ip = getattr(ip, "ipv4_mapped", None) or ip
        except ValueError:
            assert got[a] is None, a
            continue
        best = max((n for n in good if n.version == ip.version and ip in n), key=lambda n: n.prefixlen, default=None)
        assert (got[a] and ipaddress.ip_network(got[a], strict=False)) == best, a
    assert got[None] is None and len(got) == len(set(own)) + 1


HOSTS = {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "www.ck": "www.ck", "a.www.ck": "www.ck", "x.y.ck": "x.y.ck", "q.x.y.ck": "x.y.ck", "y.ck": "y.ck", "city.kobe.jp": "city.kobe.jp", "a.city.kobe.jp": "city.kobe.jp", "s.x.kobe.jp": "s.x.kobe.jp", "me.github.io": "github.io", "shop.example": "shop.example", "localhost": "localhost", "1.2.3.4": "1.2.3.4", "A.B.Com.": "b.com", "deep.unknown.tld": "unknown.tld", "": ""}


def test_suffixes_by_column_join_and_plain_form(spark):
    frame = spark.createDataFrame([(h,) for h in HOSTS] + [(None,)], "h string")
    column = {r.h: r.s for r in frame.select("h", sx.registrable(F.col("h")).alias("s")).collect()}
    joined = {r.h: r.site for r in sx.registrable_hosts(frame, "h", spark.createDataFrame([(r,) for r in sx.RULES] + [(None,)], "rule string")).collect()}
    for h, want in HOSTS.items():
        assert column[h] == joined[h] == sx.registrable_name(h) == want, h
    assert column[None] is None and joined[None] is None


def test_a_published_list_is_read_with_its_sections(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// ===BEGIN ICANN DOMAINS===\n// note\ncom\n*.ck\n!www.ck  // inline\n\nСРБ\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\n// owner\ngithub.io\r\nblogspot.com\n// ===END PRIVATE DOMAINS===\n")
    rules = sx.read_rules(spark, str(tmp_path / "list.dat"))
    assert {(r.rule, r.private) for r in rules.collect()} == {("com", False), ("*.ck", False), ("!www.ck", False), ("срб", False), ("github.io", True), ("blogspot.com", True)}
    hosts = spark.createDataFrame([("me.github.io",), ("a.me.github.io",)], "h string")
    assert {r.site for r in sx.registrable_hosts(hosts, "h", rules.where("not private")).collect()} == {"github.io"}
    assert {r.site for r in sx.registrable_hosts(hosts, "h", rules).collect()} == {"me.github.io"}


# --- table functions ---------------------------------------------------------


def test_first_rows_of_any_table(spark):
    rg.register(spark)
    spark.createDataFrame([(i % 3 if i % 7 else None, i, str(i)) for i in range(40)], "k int, v int, s string").createOrReplaceTempView("any_rows")
    got = spark.sql("SELECT * FROM first_rows(TABLE(any_rows) PARTITION BY (k) ORDER BY (v DESC), 2)")
    assert got.columns == ["place", "k", "v", "s"] and {tuple(r) for r in got.where("k = 1").collect()} == {(1, 1, 37, "37"), (2, 1, 34, "34")} and got.count() == 8
    with pytest.raises(Exception, match="first_rows takes a table"):
        spark.sql("SELECT * FROM first_rows(1, 2)").collect()
    assert spark.sql("SELECT wilson_low(x) AS w FROM VALUES (true), (true), (false), (null) AS t(x)").first().w == pytest.approx(0.2076550, abs=1e-6)


# --- streams -----------------------------------------------------------------


@pytest.mark.parametrize("files", [1, 16])
def test_limiter_stream_in_any_order_of_files(spark, files):
    got = machinery.stream_limiter(spark, SMALL, files).toPandas()
    want = corpus.limiter_sliding(spark, SMALL).toPandas()
    key = lambda f, scale: sorted(zip(f["user_id"], (f["at"] * scale).round().astype("int64"), f["event_id"], f["allowed"], f["remaining"], strict=True))
    assert key(got, 1) == key(want, 1_000_000)


def test_a_watermark_that_moves_gives_the_same_and_prunes(spark, tmp_path):
    """Files in order of time and a short lateness: rows come out as the watermark passes, and idle keys leave no state."""
    from folioscope.streaming import queue, stateful

    rng = np.random.default_rng(2)
    rows = sorted((float(t), int(k)) for t, k in zip(rng.uniform(0, 3000, 400), rng.integers(0, 5, 400), strict=True))
    schema = "k int, at timestamp, n long"
    for part in range(4):
        own = [(k, pd.Timestamp(t, unit="s").to_pydatetime(), i) for i, (t, k) in enumerate(rows) if i // 100 == part]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, pd.Timestamp(10**6, unit="s").to_pydatetime(), -1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = queue.jobs_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    q = stateful.limit_in_order(source, "k", "at", "n", 3, 100.0, "50 seconds").writeStream.format("memory").queryName("moving").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    want, logs = [], {}
    for i, (t, k) in enumerate(rows):
        want.append((k, i, *logs.setdefault(k, SlidingLog(3, 100.0)).hit(int(t * 1e6) / 1e6)))
    got = sorted((r.k, r.tie, r.allowed, r.remaining) for r in spark.table("moving").where("k >= 0").collect())
    assert got == sorted(want)


def test_retries_keep_their_times(spark):
    got = Counter(machinery.stream_retry(spark, SMALL, 5).toPandas()["outcome"])
    ids = pd.read_parquet(f"{SMALL}/events.parquet")["event_id"]
    assert got == Counter({"completed": int((ids % 5 < 3).sum()), "dead": int((ids % 5 >= 3).sum()), "retry": int((ids % 5).clip(upper=2).sum())})


def test_retries_call_the_store_by_group_not_by_job():
    from folioscope.streaming import stateful

    calls, timers = Counter(), []

    class Stored:
        def __init__(self):
            self.rows = []

        def get(self):
            calls["get"] += 1
            return iter(list(self.rows))

        def appendList(self, rows):
            calls["append"] += 1
            self.rows += rows

        def put(self, rows):
            calls["put"] += 1
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    class Handle:
        getListState = staticmethod(lambda name, schema: Stored())
        registerTimer = staticmethod(timers.append)

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: now)

    now = 0
    p = stateful.Retries("job", "bigint", machinery._fails, 3)
    p.init(Handle())
    rows = [pd.DataFrame({"job": [*range(1000), 7], "event_micros": [(2 + j) * 1_000_000 for j in range(1000)] + [5_000_000]})]
    first = pd.concat(p.handleInputRows((1,), iter(rows), Times()))
    assert len(first) == 1000 and first.set_index("job")["at"][7] == 5_000_000 and sum(calls.values()) < 10
    assert timers == [5000]  # job 1 failed at 3 s and waits for 2
    assert len(pd.concat(p.handleInputRows((1,), iter(rows), Times()))) == 0  # delivered again
    now = 5000
    assert [tuple(r) for r in pd.concat(p.handleExpiredTimer((1,), Times(), None)).itertuples(index=False)] == [(1, 2, 5_000_000, "completed")]
    now = 10**9
    rest = pd.concat([first, pd.concat(p.handleExpiredTimer((1,), Times(), None))])
    assert Counter(rest["outcome"]) == {"completed": 599, "dead": 400, "retry": 1400} and sum(calls.values()) < 20


def test_arrival_limits_with_a_time_to_live(spark, tmp_path):
    from folioscope.streaming import queue, stateful

    rows = [("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 20.0), ("b", 5.0)]
    spark.createDataFrame(rows, "k string, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = queue.jobs_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "k string, at double").schema)
    q = stateful.limit_on_arrival(source, "k", "at", 2, 10.0, ttl_ms=60_000).writeStream.format("memory").queryName("arrival").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 40
        while spark.table("arrival").count() < 5 and time.time() < end:  # its timers make batches for ever
            time.sleep(0.5)
        assert sorted((r.k, r["at"], r.allowed, r.remaining) for r in spark.table("arrival").collect()) == [("a", 0.0, True, 1), ("a", 1.0, True, 0), ("a", 2.0, False, 0), ("a", 20.0, True, 1), ("b", 5.0, True, 1)]
    finally:
        q.stop()


def test_a_killed_consumer_loses_and_repeats_nothing(spark, tmp_path):
    base = f"file://{tmp_path}"
    for n in range(5):
        messages = spark.createDataFrame([(100 * n + i, "odd" if i % 2 else "even") for i in range(20)], "m long, kind string")
        assert queues.publish(messages, f"{base}/q", F.col("kind"), ["odd", "even"]) == {"odd": n, "even": n}

    def run(fail_at):
        def work(df, n):
            if n == fail_at:
                raise RuntimeError("killed")
            df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

        made = queues.consume(spark, f"{base}/q", ["odd", "even"], "m long", prefetch=1)
        q = made.writeStream.foreachBatch(work).option("checkpointLocation", f"{base}/s").trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="killed"):
        run(2)
    held = queues.Segments(f"{base}/q", ["odd", "even"])
    done = spark.read.parquet(f"{base}/out").where("queue = 'odd'").count() // 10
    assert 1 <= done < 5 and held.first("odd") <= done  # what was not worked off is still there
    run(None)
    run(None)
    got = [tuple(r) for r in spark.read.parquet(f"{base}/out").select("queue", "m").collect()]
    assert sorted(got) == sorted(("odd" if i % 2 else "even", 100 * n + i) for n in range(5) for i in range(20))
    for n in (5, 6):  # what comes after all was worked off is found by the next start
        assert queues.publish(spark.createDataFrame([(1000 + n, "odd")], "m long, kind string"), f"{base}/q", F.col("kind"), ["odd"])["odd"] == n
    run(None)
    assert spark.read.parquet(f"{base}/out").where("m >= 1000").count() == 2 and spark.read.parquet(f"{base}/out").count() == 102


# --- keys that are created once ----------------------------------------------


def test_a_lost_race_is_read_again(spark, tmp_path):
    from folioscope.sources.keyed import KeyedTable

    table = KeyedTable(spark, f"file://{tmp_path}/t", "k string, v string", ["k"])
    frame = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    seen = []

    def other(attempt):
        seen.append(attempt)
        if attempt < 2:  # two others are quicker, one after the other
            table.get_or_create(frame("a", f"x{attempt}"), v=F.lit(f"other{attempt}"))

    got = {r.k: (r.v, r.created) for r in table.get_or_create(frame("a", "b", "x1", "b", None), other, v=F.lit("mine")).collect()}
    assert seen == [0, 1, 2] and got == {"a": ("other0", False), "x1": ("other1", False), "b": ("mine", True)}
    assert sorted(map(tuple, table.read().collect())) == [("a", "other0"), ("b", "mine"), ("x0", "other0"), ("x1", "other1")]
    again = {r.k: r.created for r in KeyedTable(spark, f"file://{tmp_path}/t", "k string, v string", ["k"]).get_or_create(frame("b", "c"), v=F.lit("late")).collect()}
    assert again == {"b": False, "c": True}


def test_a_batch_of_a_key_is_one_value_of_state():
    """InOrder hands the store one value for all rows of a key that a batch brings, and folds them in order of time and tie."""
    from folioscope.streaming import stateful

    class State(list):
        appendList = list.extend

        def get(self):
            return self[0] if self and not isinstance(self[0][0], bytes) else iter(self)

        def exists(self):
            return bool(self)

        def update(self, value):
            self[:] = [value]

        def put(self, values):
            self[:] = values

    waiting, memory, timers = State(), State(), []
    handle = type("H", (), {"getListState": lambda *_: waiting, "getValueState": lambda *_: memory, "registerTimer": lambda _, t: timers.append(t), "deleteTimer": lambda _, t: timers.remove(t)})()
    mark = type("T", (), {"getCurrentWatermarkInMs": lambda _: 10_000})()
    own = stateful.InOrder("k", "at", "tie", lambda: stateful.Sliding(2, 5.0), ["k", "at", "tie", "allowed", "remaining"])
    own.init(handle)
    list(own.handleInputRows((7,), iter([pd.DataFrame({"at": [3_000_000, 1_000_000, 99_000_000], "tie": [2, 1, 4]}), pd.DataFrame({"at": [3_000_000], "tie": [1]})]), mark))
    assert len(waiting) == 1
    out = pd.concat(own.handleExpiredTimer((7,), mark, None))
    assert list(out.itertuples(index=False, name=None)) == [(7, 1_000_000, 1, True, 1), (7, 3_000_000, 1, True, 0), (7, 3_000_000, 2, False, 0)]
    assert np.frombuffer(waiting[0][0], np.int64).tolist() == [99_000_000, 4]


def test_grams_are_sorted_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Texts that are all alike, whose trigrams are few and frequent, are dealt over as many tasks as their number asks for."""
    from folioscope.operators import grams

    monkeypatch.setattr(grams, "TOGETHER", 100)
    texts = spark.range(1000).selectExpr("id", "'aaaa' AS text")
    index = grams.GramIndex.build(texts, "id", "text", str(tmp_path / "g"))
    sizes = [r["count"] for r in index.grams().groupBy(F.input_file_name().alias("f")).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1000  # aaa, aa and a with their ends
    assert index.ilike("%aaa%").count() == 1000
