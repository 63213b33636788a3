"""Queries that SQL can't express, held against plain versions over the whole smallest tables, and stated cases of what they are made of."""

import json
import re

import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from folioscope.conf import EngineConf, InvalidInput
from folioscope.functions import chunking as ck
from folioscope.functions import html as hx
from folioscope.functions import text as tx
from folioscope.operators import retrieval as rt
from folioscope.operators import scoring as sc
from folioscope.plans import catalog, corpus


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def rows(spark, name):
    return catalog.queries()[name](spark, SMALL).toPandas()


# --- chunks ----------------------------------------------------------------


def test_chunks_hold_every_word_once(spark, docs):
    """Without their overlap the chunks of a document are its words in order; with it each begins with the end of the one before."""
    got = rows(spark, "chunk_documents").sort_values(["doc_id", "chunk_index"])
    assert set(got.doc_id) == {i for i, t in zip(docs.doc_id, docs.text, strict=True) if t.strip()} and not got.is_cut.any()
    texts = docs.set_index("doc_id").text
    lead = max(1, int(32 / 1.3))
    for i, own in got.groupby("doc_id"):
        assert own.chunk_index.tolist() == list(range(len(own))) and (own.char_count == own.content.str.len()).all()
        assert own.token_count.tolist() == [max(1, round(len(c.split()) * 1.3)) for c in own.content]
        assert (own.token_count[:-1] <= 256 + 33).all()
        words, before = [], []
        for c in own.content.str.split():
            assert c[: len(before)] == before
            words += c[len(before) :]
            before = c[len(before) :][-lead:]
        assert words == texts[i].split()


def test_chunk_sums_and_ingestion(spark):
    chunks = rows(spark, "chunk_documents").groupby("doc_id").token_count.agg(["count", "sum", "max"])
    stats = rows(spark, "chunk_stats").set_index("doc_id").loc[chunks.index]
    assert (stats.chunks == chunks["count"]).all() and (stats.tokens == chunks["sum"]).all() and (stats.largest == chunks["max"]).all()
    for name in ("ingest_documents", "reingest_documents"):
        got = rows(spark, name).set_index("doc_id").loc[chunks.index]
        assert (got.chunks == chunks["count"]).all() and (got.tokens == chunks["sum"]).all()
    embedded = {i for i, c in zip(*[rows(spark, "chunk_documents")[x] for x in ("doc_id", "content")], strict=True) if re.search("[a-z0-9]", c.lower())}
    got = rows(spark, "ingest_documents").set_index("doc_id")
    assert all((got.embedded[i] > 0) == (i in embedded) for i in got.index) and (got.embedded <= got.chunks).all()


GUIDE = """# Harbour guide

Opening words about the harbour and its boats.

## Fees

| boat | fee |
| --- | --- |
| small | 10 |

Fees rise by 5% in 2025.

## Mooring

```
# no heading here
def moor():
    return 1
```

### At night

Keep the lights on.
"""


def test_sections_follow_headings():
    got = list(ck.sections(GUIDE))
    assert [p for p, _ in got] == ["Harbour guide", "Harbour guide > Fees", "Harbour guide > Mooring", "Harbour guide > Mooring > At night"]
    assert got[0][1].startswith("# Harbour guide") and "# no heading here" in got[2][1]
    assert list(ck.sections("One paragraph.\n\nAnother one.")) == [(None, "One paragraph.\n\nAnother one.")]


def test_chunk_budgets_overlaps_and_ends():
    assert ck.chunks("") == ck.chunks("  \n\n ") == []
    assert [c.content for c in ck.chunks("A short line on boats.", EngineConf(min_tokens=1))] == ["A short line on boats."]
    many = "\n\n".join(f"Part {i} " + "word " * 60 for i in range(12))
    got = ck.chunks(many, EngineConf(chunk_size=120, overlap=10, min_tokens=5))
    assert len(got) > 1 and all(ck.tokens_of(c.content) <= 131 for c in got)
    two = ck.chunks("alpha " * 60 + "\n\n" + "beta " * 60, EngineConf(chunk_size=100, overlap=30, min_tokens=5))
    assert len(two) == 2 and two[1].content.split()[:23] == ["alpha"] * 23 and two[1].content.split()[23] == "beta"
    tail = ck.chunks("word " * 60 + "\n\ntiny tail", EngineConf(chunk_size=100, overlap=10, min_tokens=20))
    assert len(tail) == 1 and tail[0].content.endswith("tiny tail")
    huge = ck.chunks("a sentence about boats. " * 200, EngineConf(chunk_size=100, overlap=0, min_tokens=5))
    assert len(huge) > 1 and all(ck.tokens_of(c.content) <= 100 for c in huge)
    assert any("def moor()" in c.content for c in ck.chunks(GUIDE, EngineConf(chunk_size=64, overlap=8, min_tokens=5)))
    assert any(c.heading_path == "Harbour guide > Fees" for c in ck.chunks(GUIDE, EngineConf(chunk_size=20, overlap=3, min_tokens=5)))
    for bad in ({"chunk_size": 0}, {"chunk_size": 50, "overlap": 50}):
        with pytest.raises(InvalidInput):
            EngineConf(**bad)


def test_a_cut_document_says_so(spark):
    text = "\n\n".join("word " * 60 for _ in range(50))
    df = spark.createDataFrame([(1, text), (2, "short")], "k long, t string")
    got = ck.chunk_documents(df, "k", "t", EngineConf(chunk_size=60, overlap=0, min_tokens=5, max_chunks=3)).toPandas()
    assert got[got.k == 1].is_cut.tolist() == [True] * 3 and got[got.k == 2].is_cut.tolist() == [False]
    exact = ck.chunk_documents(df, "k", "t", EngineConf(chunk_size=60, overlap=0, min_tokens=5, max_chunks=100)).toPandas()
    assert not exact.is_cut.any() and len(exact) > 4


# --- pages -----------------------------------------------------------------

SHOP = """<html><head><title>Boats</title><style>.x{display: none}</style><script>window.count()</script></head><body>
<header><nav>Home Shop</nav></header><div class="cookie-banner">Take all cookies <form>yes</form></div><!-- a comment -->
<main><article><h1>Boats for rent</h1><p>Rents fell by 41% in 2024, says the <a href="https://port.org/report">port</a>.</p><h2>Where to find them</h2>
<ul><li>north pier</li><li>south pier</li></ul><table><tr><th>boat</th><th>rent</th></tr><tr><td>small</td><td>10</td></tr></table>
<p>See <a href="https://www.shop.com/more">more</a>.</p></article></main>
<aside class="sidebar">Other shops</aside><footer>(c) 2024 Boats</footer><noscript>Enable it</noscript></body></html>"""


def test_page_cleaning_cases():
    got = hx.clean(SHOP, "https://shop.com/a")
    m = got["markdown"]
    assert m.startswith("# Boats for rent") and "## Where to find them" in m and "* north pier" in m and "boat | rent\n---|---\nsmall | 10" in m
    assert not any(x in m + got["text"] for x in ("cookies", "Other shops", "(c) 2024", "Enable", "window", "display", "Home"))
    assert got["has_lists"] and got["has_tables"] and got["external_link_count"] == 1 and got["word_count"] == len(m.split())
    assert 0 <= got["boilerplate_ratio"] < 0.1 and 0 < got["avg_paragraph_words"] < 120
    assert "41% in 2024" in got["text"] and "<p>" not in got["text"]
    # style, script, noscript, the form in the banner, nav, header, footer, aside; then the banner; then the comment
    assert got["removed_elements"] == 10
    assert "unclosed" in hx.clean("<html><body><div><p>unclosed", None)["markdown"]
    empty = hx.clean("<html><body></body></html>", None)
    assert (empty["markdown"], empty["word_count"], empty["boilerplate_ratio"], empty["removed_elements"]) == ("", 0, 1.0, 0)


@pytest.mark.parametrize(
    "html,want",
    [("<nav><nav>a</nav></nav>", 2), ("<header><nav>a</nav></header>", 2), ("<nav><header>a</header></nav>", 1), ("<div class=menu><p class=menu>a</p></div>", 2), ("<div class=menu><script>1</script><!--x--></div>", 2), ("<footer><div class=ad></div><!--x--></footer><!--y-->", 2), ("<p>a</p>", 0)],
)
def test_removed_elements(html, want):
    assert hx.clean(f"<html><body>{html}</body></html>", None)["removed_elements"] == want


def test_text_after_removed_elements_stays_and_small_regions_do_not_win():
    assert hx.clean("<body><p>a</p><nav>x</nav>tail words<p>b</p></body>", None)["markdown"] == "a\n\ntail words\n\nb"
    page = "<body><main>few</main>" + "<p>many other words</p>" * 30 + "</body>"
    got = hx.clean(page, None)
    assert got["boilerplate_ratio"] == 0.0 and got["markdown"].count("many") == 30
    whole = hx.clean("<body><article>" + "body words " * 40 + "</article><p>" + "x " * 40 + "</p></body>", None)
    assert 0 < whole["boilerplate_ratio"] < 0.5 and "x x" not in whole["markdown"]


def test_scorecards_from_their_parts(spark):
    """Scores recomputed in plain Python from what the parsed pages say."""
    stats = rows(spark, "html_clean_stats").set_index("page_id")
    pages = pd.read_parquet(f"{SMALL}/pages.parquet").set_index("page_id")
    got = rows(spark, "page_scorecard").set_index("page_id")
    machine = rows(spark, "machine_score").set_index("page_id").machine
    clamp = lambda x: min(1.0, max(0.0, x))
    targets = sc.EVIDENCE_TARGETS
    patterns = {"numbers": [sc.NUMBER], "percentages": [sc.PERCENT], "dates": [sc.YEAR, sc.DATE], "units": [sc.UNIT], "citations": [sc.CITATION], "quotes": [sc.QUOTE]}
    for i, s in stats.iterrows():
        html = pages.html[i]
        m, words = s.markdown, len(s.markdown.split())
        assert s.word_count == words and s.removed_elements >= html.count("<nav>") + html.count("<!--")
        levels = [int(x) for x in re.findall("<h([1-6])[ >]", html)]
        ok = levels.count(1) == 1 and all(b <= a + 1 for a, b in zip(levels, levels[1:], strict=False))
        parts = [p for p in re.split(r"\n\s*\n", m) if p.strip()]
        mean = sum(len(p.split()) for p in parts) / len(parts) if parts else 0
        semantic = 0.45 * bool(re.search("<(?:main|article)[ >]", html)) + 0.30 * bool(re.search("<(?:section|header|footer)[ >]", html)) + 0.25 * bool(re.search("<(?:figure|time)[ >]", html))
        want = 0.20 * (ok and bool(re.search(tx.HEADING, m))) + 0.15 * bool(re.search(tx.LIST, m)) + 0.10 * bool(re.search(tx.TABLE, m)) + 0.15 * clamp(max(0.0, (120 - mean) / 120) / 0.6) + 0.15 * (1 - clamp(s.boilerplate_ratio / 0.35)) + 0.10 * clamp(semantic / 0.6)
        assert got.machine[i] == pytest.approx(clamp(want), abs=1e-6) and machine[i] == got.machine[i]
        counts = {n: sum(len(re.findall(p, m, re.ASCII)) if n != "x" else 0 for p in ps) for n, ps in patterns.items()}
        told = json.loads(got.explanation[i])
        assert set(told) == {"evidentiary", "technical", "components", "pcs", "missing", "effective_weight"} and set(told["technical"]["passed"]) | set(told["technical"]["failed"]) == set(sc.TECHNICAL)
        shown = told["evidentiary"]["counts"]
        assert all(shown[n] == counts[n] for n in ("citations", "quotes")) and told["evidentiary"]["words"] == words
        assert told["evidentiary"]["densities"] == {n: pytest.approx(c * 100 / words, abs=6e-4) for n, c in shown.items()}
        assert got.evidentiary[i] == pytest.approx(clamp(sum(w * clamp(shown[n] * 100 / words / targets[n]) for n, w in sc.EVIDENCE.items())), abs=1e-6)
        weights = {"technical": 0.35, "evidentiary": 0.20, "machine": 0.15}
        assert got.pcs[i] == pytest.approx(sum(w * got[n][i] for n, w in weights.items()) / 0.70, abs=2e-6) and got.missing[i] == "semantic"


# --- full text -------------------------------------------------------------


def plain_cover(lists):
    """Every shortest span that holds all terms, by trying all spans."""
    marks = sorted(p for own in lists for p in own)
    holds = lambda a, b: all(any(a <= p <= b for p in own) for own in lists)
    spans = [(a, b) for a in marks for b in marks if a <= b and holds(a, b)]
    least = [s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)]
    return sum(0.1 / (1 + max(0, b - a + 1 - len(lists))) for a, b in set(least))


def test_cover_ranks_by_brute_force(spark, docs):
    w = corpus._words(spark, SMALL)
    a, b, c = w[corpus.ONE], w[corpus.TWO], w[corpus.NOT]
    want = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        words = re.findall("[a-z0-9]+", t.lower())
        at = {x: [k + 1 for k, y in enumerate(words) if y == x] for x in (a, b, c)}
        if any(p + 1 in at[b] for p in at[a]):
            want[i] = plain_cover([at[x] for x in sorted((a, b))])
        elif at[b] and at[c]:
            want[i] = plain_cover([at[x] for x in sorted((b, c))])
    top = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:50]
    got = rows(spark, "fts_cover_rank")
    assert dict(zip(got.doc_id, got["rank"], strict=True)) == {i: pytest.approx(r) for i, r in top}


def test_stemmed_search_by_brute_force(spark, docs):
    term = rt.stem(corpus._words(spark, SMALL)[corpus.ONE] + "s")
    counts = {i: n for i, t in zip(docs.doc_id, docs.text, strict=True) if (n := sum(rt.stem(x) == term for x in re.findall("[a-z0-9]+", t.lower()) if x not in rt.STOP))}
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50]
    got = rows(spark, "fts_stemmed")
    assert len(got) > 0 and dict(zip(got.doc_id, got["rank"], strict=True)) == {i: pytest.approx(0.1 * n) for i, n in top}


#: Words and stems that the published description of the algorithm gives.
PUBLISHED = "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consolation consol consolatory consolatori conspicuous conspicu conspicuously conspicu conspiracy conspiraci kneel kneel kneeling kneel knightly knight knitting knit knives knive knotted knot knotty knotti knowledge knowledg generate generat generously generous running run hopping hop hoping hope cries cri ties tie gas gas gaps gap kiwis kiwi youth youth boy boy say say by by happily happili relational relat skies sky dying die inning inning proceed proceed exceed exceed nationalization nation hopefulness hope controlling control rolls roll bed bed shed shed shred shred".split()


def test_published_stems():
    pairs = list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
    assert [(w, rt.stem(w)) for w, _ in pairs] == pairs


def test_inflected_forms_are_found(spark):
    df = spark.createDataFrame([(1, "The boats are running late"), (2, "a boat runs"), (3, "boating")], "id long, t string")
    index = rt.postings(df, "id", "t")
    assert sorted(r.id for r in rt.text_search(index, "id", "runs boat").collect()) == [1, 2]
    assert [r.id for r in rt.text_search(index, "id", '"run late"').collect()] == [1]
    exact = rt.postings(df, "id", "t", stemmed=False)
    assert [r.id for r in rt.text_search(exact, "id", "runs", stemmed=False).collect()] == [2]


# --- streams ---------------------------------------------------------------


@pytest.mark.parametrize("files", [1, 3, 16])
def test_claims_lose_nothing_in_any_order_of_files(spark, tmp_path, files):
    from folioscope.streaming import queue

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    twice = events.union(events.where("event_id % 3 = 0"))
    twice.orderBy(F.xxhash64("event_id")).repartition(files).write.parquet(str(tmp_path / "in"))
    made = queue.claim_once(queue.jobs_stream(spark, str(tmp_path / "in"), events.schema), "event_id")
    queue.run_available(made, str(tmp_path / "out"), str(tmp_path / "state"))
    got = [r.event_id for r in spark.read.parquet(str(tmp_path / "out")).select("event_id").collect()]
    assert sorted(got) == sorted(r.event_id for r in events.select("event_id").collect())


def test_windows_count_every_hit_in_any_order_of_files(spark, tmp_path):
    from folioscope.streaming import queue

    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy(F.xxhash64("event_id")).repartition(3).write.parquet(str(tmp_path / "in"))
    made = queue.windowed_counts(queue.jobs_stream(spark, str(tmp_path / "in"), events.schema), "ts", "event_type")
    made.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    want = events.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("hits"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_periodic_sweep(spark, tmp_path):
    import time

    from folioscope.streaming import queue

    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    q = queue.run_every(queue.jobs_stream(spark, str(tmp_path / "in"), spark.range(1).schema), str(tmp_path / "s"), lambda df, _: seen.append(df.count()), 1)
    end = time.time() + 30
    while sum(seen) < 5 and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert sum(seen) == 5
