"""Each operator against brute force, an exact round trip or held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from folioscope.llm import catalog, flac, lattice, licences, mixing, packing, pii, quality, sharding, simhash, warc
from folioscope.llm._common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def rows(spark, name):
    return catalog.queries()[name](spark, SMALL).toPandas()


# --- 1 ---------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    got = rows(spark, "op1_quality").set_index("doc_id")
    labels = pd.read_parquet(f"{SMALL}/labels.parquet").set_index("doc_id")["quality"]
    both = got.join(labels, how="inner")
    held = both[both["held_out"]]
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    if len(good) and len(bad):
        assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert (both["predicted"] == both["quality"]).mean() > 0.9


def test_bradley_terry_recovers_order():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(2000, len(quality.NAMES)))
    y = (x[:, 0] - 2 * x[:, 3] > 1).astype(int)
    m = quality.fit(x, y)
    assert ((m.score(x) >= quality.CUT) == y).mean() > 0.97


def test_bradley_terry_equals_plain_ascent():
    """The fitted weights are where plain gradient ascent on the pairs' likelihood ends."""
    draw = np.random.default_rng(18)
    x = draw.normal(size=(600, 6))
    y = (x @ [1.0, -0.5, 0.0, 0.3, 0.0, 0.0] + draw.normal(size=600) > 0).astype(int)
    m = quality.fit(x, y)
    again = np.random.default_rng(7)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    good, bad = z[y == 1], z[y == 0]
    diff = good[again.integers(0, len(good), quality.PAIRS)] - bad[again.integers(0, len(bad), quality.PAIRS)]
    w = np.zeros(6)
    for _ in range(4000):
        w += 0.5 * (diff.T @ (1 / (1 + np.exp(diff @ w))) / len(diff) - quality.L2 * w)
    assert m.weights == pytest.approx(w, abs=1e-4)


@pytest.mark.parametrize("text", ["🙂 ", "→ ", "é ü ", "word, "])
def test_letters_mean_the_same_at_every_length(text):
    at = quality.NAMES.index("letters")
    short, long = (quality.features((text * 300)[:n])[at] for n in (399, 400))
    assert short == pytest.approx(long, abs=0.01) and long == pytest.approx(sum(map(str.isalpha, (text * 300)[:400])) / 400)


# --- 2 ---------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash_whole_table(spark, docs):
    got = rows(spark, "op2_simhash").sort_values("doc_id")
    docs = docs.sort_values("doc_id")
    prints = [brute_fingerprint(t) for t in docs.text]
    assert [f"{p:016x}" for p in prints] == got.fingerprint.tolist()
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    ids = docs.doc_id.tolist()
    assert [ids[r] for r in brute_components(len(ids), links)] == got.component_id.tolist()


def test_gray_index_finds_all_pairs():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 40).astype(np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << draw.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)]))
    for fanout in (2, 5, 16):
        a, b = simhash.GrayIndex(codes, fanout).pairs(codes)
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(near).tolist()))


def test_split_branches_lose_nothing(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centre = 0x0123456789ABCDEF
    codes = sorted({centre ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), replace=False)) for _ in range(300)} | {int(x) for x in draw.integers(0, 2**63, 50)})
    monkeypatch.setattr(simhash, "BRANCH", 8)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    edges = simhash.links(spark.createDataFrame(signed, "code long")).collect()
    at = {c[0]: i for i, c in enumerate(signed)}
    want = brute_components(len(codes), [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 2])
    assert brute_components(len(codes), [(at[e.a], at[e.b]) for e in edges]) == want


def test_components(spark):
    draw = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    names = sorted({x for e in real for x in e})
    at = {x: i for i, x in enumerate(names)}
    assert got == {x: names[r] for x, r in zip(names, brute_components(len(names), [(at[a], at[b]) for a, b in real]), strict=True)}


# --- 3 ---------------------------------------------------------------------


def test_flac_round_trip_whole_table(spark, docs):
    got = rows(spark, "op3_flac").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        raw = flac.payload_of(t)
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        stream = flac.encode_many([raw])[0]
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())


def test_flac_kinds_seek_and_checks():
    draw = np.random.default_rng(2)
    wave = (128 + 90 * np.sin(np.arange(5760) / 9)).astype(np.uint8).tobytes()
    for raw in (b"\x07" * 1152, draw.integers(0, 256, 5760, dtype=np.uint8).tobytes(), wave, np.arange(5760).astype(np.uint8).tobytes()):
        s = flac.encode_many([raw])[0]
        x = flac.decode_many([s])[0]
        assert (x + 128).astype(np.uint8).tobytes() == raw
        assert (flac.decode_in_turn(s, flac.Info(s)) == x).all()
        for start in (0, 575, 576, 3000, 5700):
            n = min(40, len(raw) - start)
            assert (flac.read_samples(s, start, n) == x[start : start + n]).all()
    assert len(flac.encode_many([wave])[0]) < len(wave) * 0.7
    bad = bytearray(s)
    bad[-20] ^= 4
    with pytest.raises(flac.Broken):
        flac.decode_many([bytes(bad)])
    with pytest.raises(ValueError):
        flac.encode_many([b"123"])


def test_pcm_blocks(spark):
    df = spark.createDataFrame([(1, "abc" * 5000), (2, ""), (3, None)], "k long, t string").withColumn("m", flac.to_flac(F.col("t")))
    got = flac.pcm_blocks(df, "k", "m").orderBy("k", "block").collect()
    own = [r for r in got if r.k == 1]
    assert [r.sample_offset for r in own] == [0, 9216] and sum(r.n_samples for r in own) == len(flac.payload_of("abc" * 5000))
    assert bytes(b ^ 128 for r in own for b in r.pcm) == flac.payload_of("abc" * 5000)


def test_media_tables_with_damage(spark, tmp_path):
    """Stored, read back, and null and damaged streams give a row each and stop nothing."""
    texts = [f"text {i} " * (i * 40 + 1) for i in range(12)]
    docs = spark.createDataFrame([*enumerate(texts), (98, None), (99, "")], "doc_id long, text string")
    flac.write_media(docs, str(tmp_path / "a"))
    kept = spark.read.parquet(str(tmp_path / "a")).toPandas()
    got = {r.doc_id: r for r in flac.read_media(spark, str(tmp_path / "a")).collect()}
    assert all((got[i].payload_sha256, got[i].n_bytes, got[i].broken) == (hashlib.sha256(flac.payload_of(t)).hexdigest(), len(t), None) for i, t in enumerate(texts)) and len(got) == 14
    hurt = {}
    for i, m in zip(kept.doc_id, kept.media, strict=True):
        raw = bytearray(m)
        if i == 3:
            raw[-20] ^= 4
        hurt[i] = {5: None, 6: b"", 7: b"RIFF....", 8: bytes(raw[: len(raw) // 2])}.get(i, bytes(raw))
    spark.createDataFrame([(int(i), 0, m) for i, m in hurt.items()], "doc_id long, n_bytes long, media binary").write.parquet(str(tmp_path / "b"))
    after = {r.doc_id: r for r in flac.read_media(spark, str(tmp_path / "b")).collect()}
    assert {i for i, r in after.items() if r.broken} == {3, 6, 7, 8} and after[5].payload_sha256 is None and after[5].media_bytes is None
    assert all(after[i].payload_sha256 == r.payload_sha256 for i, r in got.items() if i not in (3, 5, 6, 7, 8)) and after[3].media_bytes == got[3].media_bytes
    own = spark.read.parquet(str(tmp_path / "b"))
    assert {r.doc_id for r in flac.pcm_blocks(own, "doc_id", "media").select("doc_id").distinct().collect()} == set(got) - {3, 5, 6, 7, 8}
    flac.write_media(docs.limit(0), str(tmp_path / "c"))
    assert flac.read_media(spark, str(tmp_path / "c")).count() == 0 and flac.pcm_blocks(own.limit(0), "doc_id", "media").count() == 0


# --- 4 ---------------------------------------------------------------------


def test_mixing_targets_and_taken(spark, docs):
    got = rows(spark, "op4_mixing").set_index("doc_id")
    sizes = pd.Series([len(WORD.findall(t or "")) for t in docs.text], index=docs.doc_id)
    assert (got["size"].loc[sizes.index] == sizes).all()
    by = sizes.groupby(docs.set_index("doc_id").source).sum().sort_index()
    weights = [(5, 2, 1)[i % 3] for i in range(len(by))]
    caps, want, free, left = 3.0 * by.to_numpy(), np.zeros(len(by)), set(range(len(by))), float(by.sum())
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > caps[i]]
        for i in over or list(free):
            want[i] = caps[i] if over else level * weights[i]
            left -= want[i]
            free.discard(i)
    got["source"] = docs.set_index("doc_id").source
    for (_, own), target in zip(got.groupby("source"), want, strict=True):
        assert own.target.iloc[0] == pytest.approx(target) and abs(own.taken.sum() - target) <= own["size"].max() / 2 + 1
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = rows(spark, "op4_mixing").set_index("doc_id").taken
    assert (again == got.taken.loc[again.index]).all()


@pytest.mark.parametrize("weighted", [False, True])
def test_mixing_draw_follows_keys(spark, weighted):
    """The fraction beyond whole epochs is the prefix of the keys, found without sorting a source."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "a" if i % 4 else "b", 0.05 if i % 3 else 1.0) for i in range(1200)], "doc_id long, text string, source string, w double")
    weight = F.col("w") if weighted else None
    key = (-F.log(mixing.uniform(F.col("doc_id"))) / (F.col("w") if weighted else F.lit(1.0))).alias("key")
    keys = {r.doc_id: r.key for r in docs.select("doc_id", key).collect()}
    got = mixing.mix(docs, weight, ["source"]).collect()
    assert len(got) == 1200
    for s in "ab":
        own = sorted((r for r in got if r.source == s), key=lambda r: keys[r.doc_id])
        times = [r.times for r in own]
        assert times == sorted(times, reverse=True) and times[0] - times[-1] <= 1
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5


def test_mixing_prefers_good_documents(spark):
    """Weights fitted on labels: where a source gives a part of what it has, good documents come more often."""
    draw = np.random.default_rng(16)
    rows, labels = [], []
    for i in range(2000):
        good = i % 2
        words = ["word", "other", "text", "and"] if good else ["wo$$rd", "OTHER!!", "|", "99"]
        rows.append((i, " ".join(draw.choice(words, 30)), "abc"[i % 3] if i % 7 else "d"))
        labels += [(i, good)] if i < 1000 else []
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = mixing.mix(docs, mixing.fitted_weight(docs, labels)).toPandas()
    part = got[got.target < got.source_size]
    assert len(part) and part[part.doc_id % 2 == 1].times.mean() > 2 * part[part.doc_id % 2 == 0].times.mean()
    alike = mixing.mix(docs, mixing.fitted_weight(docs, labels.limit(0))).toPandas()
    assert len(alike) == 2000


def test_sources_in_code_point_order_null_last(spark):
    names = ["z", "a", "é", "\U0001f600", "\uffff", None, "Z", "zz"]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(n, 1000) for n in names], "source string, source_size long")).collect()}
    order = [*sorted(n for n in names if n is not None), None]
    level = 8000 / sum((5, 2, 1)[i % 3] for i in range(8))
    assert all(level * 5 <= 3000 for _ in order) and got == {n: pytest.approx(level * (5, 2, 1)[i % 3]) for i, n in enumerate(order)}


# --- 5 ---------------------------------------------------------------------


def test_packing_ids_and_places(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    want = {}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[(i, k)] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    got = rows(spark, "op5_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, own in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_merges_rebuild_every_token():
    """Every token is what the merges make of it alone, on which the faster library's ids rest."""
    import json

    with open(packing.default_vocabulary(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    assert [model["vocab"][a + b] for a, b in rank] == sorted(model["vocab"][a + b] for a, b in rank)
    for token in model["vocab"]:
        if token.startswith("<|"):
            continue
        stem = token.removesuffix("</w>")
        parts = [*stem[:-1], stem[-1] + token[len(stem) :]] if stem else [token]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [token]


@pytest.mark.parametrize("text", ["ΑΣ ΑΣ. x", "a b\x85c", "é ́x İ ǅ", "it's we'll don't 're", "a\x1cb", "<|endoftext|> x", "ﬀ ½ Ⅷ 👩‍👩‍👧 z　y", "x\x00y \x7f", "ÀÉ×÷ß²³¹ªº", "1a2b!!c..", ""])
def test_encoder_equals_tokenizer(text):
    e = packing.encoder(packing.default_vocabulary())
    assert e.encode(text) == e.whole(text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>x", "A<|EndOfText|>b é", "a <| b |> c", "ж<|endoftext|>ж <|endoftext|", "<|endoftext|>"])
def test_encoder_takes_added_tokens_as_the_file_does(text):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(packing.default_vocabulary())
    assert all(t.content.startswith("<|") for t in fresh.get_added_tokens_decoder().values())
    assert np.frombuffer(packing.encoder(packing.default_vocabulary()).encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])
    bins = packing.improve([[0, 5], [1, 6], [2, 3], [4]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7)) and all(lengths[b].sum() <= 10 for b in bins)
    draw = np.random.default_rng(4)
    for _ in range(30):
        own = draw.integers(1, 4097, draw.integers(1, 300))
        where, offset = packing.pack(own)
        for k in set(where.tolist()):
            mine = np.flatnonzero(where == k)
            mine = mine[np.argsort(offset[mine])]
            assert (offset[mine] == np.cumsum(own[mine]) - own[mine]).all() and own[mine].sum() <= 4096


def gains(bins, sizes, capacity):
    """Every step of the search that makes the sum of squared fills larger, by trying all."""
    import itertools

    fill = [sum(sizes[i] for i in b) for b in bins]
    parts = [[(), *itertools.combinations(b, 1), *itertools.combinations(b, 2)] for b in bins]
    for g, k in itertools.permutations(range(len(bins)), 2):
        if fill[k] < capacity:
            for gives, takes in itertools.product(parts[g], parts[k]):
                gain = sum(sizes[i] for i in gives) - sum(sizes[i] for i in takes)
                if gives and not (len(gives) == len(takes) == 2) and 0 < gain <= capacity - fill[k] and gain > fill[g] - fill[k]:
                    yield g, k, gives, takes


def test_local_search_ends_where_no_step_is_left():
    draw = np.random.default_rng(14)
    better = 0
    for _ in range(25):
        sizes = draw.integers(20, 52, 30)
        first = packing.best_fit(sizes, 100)
        bins = packing.improve(first, sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(30)) and all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= len(first)
        assert len(bins) == -(-sizes.sum() // 100) or not any(gains(bins, sizes.tolist(), 100))
        better += len(bins) < len(first)
    assert better > 0


def test_packing_in_several_groups(spark, monkeypatch):
    """Where best fit isn't optimal the search empties bins, in each group."""
    monkeypatch.setattr(packing, "GROUP", 200)
    draw = np.random.default_rng(15)
    lengths = draw.integers(26, 50, 600)
    df = spark.createDataFrame([(i, "the " * int(n - 1)) for i, n in enumerate(lengths)], "doc_id long, text string")
    got = packing.packed(df, capacity=100).toPandas()
    assert (got.sort_values("doc_id").length.to_numpy() == lengths).all()
    first = 0
    for _, own in got.groupby(got.sequence_id.to_numpy() >> 32):
        bins = len(packing.best_fit(own.sort_values("doc_id").length.to_numpy(), 100))
        assert own.sequence_id.nunique() < bins
        first += bins
    assert len(set(got.sequence_id.to_numpy() >> 32)) == 3 and got.sequence_id.nunique() < 0.98 * first
    for _, own in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 100


# --- 6 ---------------------------------------------------------------------


def _records(n=20):
    bodies = [f"page {i} ".encode() * 30 for i in range(n)]
    return [warc.record(i, f"http://a/{i}", b, hashlib.sha256(b).hexdigest(), "response", None) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    made = [warc.member(r) if packed else r for r in _records()]
    whole = b"".join(made)
    assert len(warc.salvage(whole)[0]) == 20 and warc.salvage(whole)[1] == [] and warc.salvage(b"") == ([], [])
    starts = np.cumsum([0, *map(len, made)]).tolist()
    for hurt in range(20):
        raw = bytearray(whole)
        raw[starts[hurt] + len(made[hurt]) // 2] ^= 0x55
        found, gaps = warc.salvage(bytes(raw))
        names = {h["warc-record-id"] for _, h, _ in found}
        assert names >= {f"<urn:page:{i}>" for i in range(20) if i != hurt} and len(names) in (19, 20)
        assert gaps == ([] if len(names) == 20 else [(starts[hurt], starts[hurt + 1], gaps[0][2])])
    found, gaps = warc.salvage(b"junk" + whole[:-9])
    assert len(found) == 19 and gaps[0][:2] == (0, 4) and gaps[-1][1] == len(whole) - 5


def test_salvage_within_a_member():
    """Several records in one gzip member: a failed record costs itself, a broken end what lies behind it."""
    made = _records()
    names = lambda found: [h["warc-record-id"] for _, h, _ in found]
    want = [f"<urn:page:{i}>" for i in range(20)]
    starts = np.cumsum([0, *map(len, made)]).tolist()
    for hurt in (0, 7, 19):
        raw = bytearray(b"".join(made))
        raw[starts[hurt + 1] - 20] ^= 0x55
        packed = warc.member(bytes(raw))
        found, gaps = warc.salvage(packed + warc.member(made[0]))
        assert names(found) == [w for i, w in enumerate(want) if i != hurt] + want[:1]
        assert gaps == [(0, gaps[0][1], f"block digest in inflated bytes {starts[hurt]} to {starts[hurt + 1]}")]
    for level in (0, 4):  # level 0 shows the records in the stored bytes as well
        packed = warc.member(b"".join(made), level)
        found, gaps = warc.salvage(packed[: len(packed) * 3 // 4] + warc.member(made[19]))
        kept = names(found)[:-1]
        assert kept == want[: len(kept)] and len(kept) >= 10 and names(found)[-1] == want[19] and (len(gaps) == 1 if level else gaps)
        broken = bytearray(packed)
        broken[-6] ^= 1  # the CRC
        found, gaps = warc.salvage(bytes(broken) + warc.member(made[19]))
        assert sorted(names(found)) == sorted(want + want[19:]) and gaps


def test_salvage_of_headers_and_ends():
    """A flipped byte of a header is a gap; a cut member gives what was whole; a bad record in a valid member costs itself."""
    made = _records()
    plain = b"".join(made)
    for text in (b"WARC-Record-ID: <urn:page:9>", b"X-Payload-Length: 210", b"WARC-Target-URI: http://a/9\r"):
        raw = bytearray(plain)
        at = plain.index(text, plain.index(made[9])) + len(text) - 2
        raw[at] ^= 1
        found, gaps = warc.salvage(bytes(raw))
        assert [h["warc-record-id"] for _, h, _ in found] == [f"<urn:page:{i}>" for i in range(20) if i != 9] and [g[2] for g in gaps] == ["header digest"]
    packed = warc.member(plain)
    found, gaps = warc.salvage(packed[:-50])
    assert len(found) == 19 and len(gaps) == 1


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    draw = np.random.default_rng(17)
    pages = [(i, "u", draw.bytes(1500).hex()) for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    warc.write_archives(df, str(tmp_path / "a"))
    sizes = [os.path.getsize(tmp_path / "a" / f) for f in os.listdir(tmp_path / "a") if f.startswith("part")]
    assert len(sizes) > 5 and max(sizes) < 20_000 + 4_000
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()) == [(i, 3000) for i in range(120)]


def test_gap_log(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(b"??" + b"".join(map(warc.member, _records(3))))
    assert [(r.start, r.stop) for r in warc.read_gaps(spark, str(tmp_path)).collect()] == [(0, 2)] and warc.read_archives(spark, str(tmp_path)).count() == 3


# --- 7 ---------------------------------------------------------------------


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(t):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(out, key=lambda x: (x[1].start(), pii.KINDS.index(x[0])))]


def test_pii_base_spans(spark, docs):
    got = rows(spark, "op7_pii").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        want = brute_base(t or "")
        r = got.loc[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]


def test_pii_hard_texts(spark):
    made = ["a@b.c_x@d.e.f a@b", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 12", "+1 (555) 123-4567 ++49.30.1234567- +1 2", "é🙂 x@y.zz 10.0.0.1🙂", "1" * 400, "9.9.9.9" * 300, "+1234567890 " * 700, "%@-.-.a@@b.c"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r.w for r in df.select("doc_id", pii.written(pii.base_spans(F.col("text"))).alias("w")).collect()}
    for i, t in enumerate(made):
        assert got[i] == ",".join(brute_base(t)), t[:60]


def test_pii_trees_add_what_context_shows(spark):
    """A phone run into a card number fails the base check; the candidate beside it is found, plain numbers aren't."""
    draw = np.random.default_rng(0)
    num = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    texts = [f"word +1 ({num(3)}) 555-{num(4)} other" for _ in range(900)] + [f"of {num(9)} or {num(4)}.{num(8)} and" for _ in range(400)] + [f"see +1 (555) 555-{num(4)} 4{num(15)} end" for _ in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.added for r in pii.find(df).select("doc_id", "added").collect()}
    assert all(not got[i] for i in range(1300))
    assert sum(any(s.kind == "phone" and s.span.startswith("+1 (555)") for s in got[i]) for i in range(1300, 1303)) >= 2


def planted_corpus(seed=0, n=600):
    """Texts with base spans to learn from, texts with one span in another form (with its place), and look-alikes."""
    draw = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, draw.integers(0, 10, k)))
    word = lambda: "".join(draw.choice(list("abcdefghiklmnoprstuw"), draw.integers(3, 9)))
    some = lambda: " ".join(word() for _ in range(draw.integers(2, 9)))

    def card():
        head = "4" + num(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    fours = lambda s, by: by.join(s[i : i + 4] for i in range(0, 16, 4))
    parts = lambda: (word(), word(), draw.choice(["com", "org", "net", "de"]))
    octets = lambda: [str(x) for x in draw.integers(1, 256, 4)]
    base = [lambda: "{}.{}@{}.{}".format(word(), *parts()), lambda: ".".join(octets()), card, lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"]
    other = [
        ("email", lambda: "{}(at){}.{}".format(*parts())), ("email", lambda: "{} [at] {} [dot] {}".format(*parts())), ("email", lambda: "{} at {} dot {}".format(*parts())), ("ip", lambda: " . ".join(octets())), ("ip", lambda: "[.]".join(octets())),
        ("card", lambda: fours(card(), ".")), ("card", lambda: fours(card(), "/")), ("phone", lambda: f"00{num(1)}.{num(3)}.{num(3)}.{num(4)}"), ("phone", lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)} {'.'.join(octets())}"),
    ]
    decoys = [lambda: f"2024-{draw.integers(10, 13)}-{draw.integers(10, 28)} 10:{draw.integers(10, 60)}:{draw.integers(10, 60)}", lambda: f"v{num(1)}.{num(2)}.{num(1)}-{num(4)}", lambda: f"order {num(10)}", lambda: f"{num(3)},{num(3)},{num(3)}.{num(2)}", lambda: f"{word()} (at) {word()} and", lambda: "1 2 3 4 5 6 7 8 9", lambda: f"{word()} @ {num(1)}.{num(2)}", lambda: f"met at {word()}. The", lambda: fours(num(15) + "x", "-")]
    made = [(f"{some()} {base[i % 4]()} {some()}", None) for i in range(n)]
    for i in range(n // 3):
        kind, form = other[i % len(other)]
        left, span = some() + " ", form()
        own = span[: span.index(")") + 10] if kind == "phone" and span[0] == "+" else span
        made.append((f"{left}{span} {some()}", (kind, len(left), len(left) + len(own))))
    return made + [(f"{some()} {decoys[i % len(decoys)]()} {some()}", None) for i in range(n // 3)]


def test_pii_finds_planted_forms(spark):
    """Of planted spans in other forms nearly all are added, and of what is added nearly all was planted."""
    made = planted_corpus()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).select("doc_id", pii.written(F.col("base")).alias("base"), "added").collect()}
    added = {(i, s.kind, s.start, s.end) for i, r in got.items() for s in r.added}
    want = {(i, *w) for i, (_, w) in enumerate(made) if w}
    assert all(got[i].base == ",".join(brute_base(t)) for i, (t, _) in enumerate(made))
    assert len(added & want) >= 0.95 * len(added) and len(added & want) >= 0.85 * len(want)
    for i, r in got.items():  # added spans overlap neither base spans nor each other
        places = sorted((s.start, s.end) for s in r.added) + sorted(tuple(map(int, b.split(":")[1:])) for b in r.base.split(",") if b)
        assert all(a[1] <= b[0] or b[1] <= a[0] for k, a in enumerate(places) for b in places[:k])


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc, ip 1.2.3.4 🙂 x")], "doc_id long, text string")
    assert df.select(pii.redacted(F.col("text"), pii.base_spans(F.col("text"))).alias("t")).first().t == "mail <EMAIL>, ip <IP> 🙂 x"


# --- 8 ---------------------------------------------------------------------


def test_sharding(spark, docs):
    got = rows(spark, "op8_sharding").merge(docs, on="doc_id")
    assert (got["size"] == [len(t.encode()) + 8 for t in got.text]).all() and (got.text_crc32 == [zlib.crc32(t.encode()) for t in got.text]).all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert got.groupby("text").shard.nunique().max() == 1 and got.shard.between(0, 23).all()


def test_sharding_of_heavy_groups(spark):
    draw = np.random.default_rng(6)
    texts = ["copy " * 40] * 700 + ["other " * 40] * 60 + ["x" * int(n) for n in draw.integers(5, 400, 1500)]
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() < 1.03 * sums.mean() and sums.min() > 0.97 * sums.mean()
    assert got[got.doc_id.between(700, 759)].shard.nunique() == 1


def test_sharding_is_even_on_whole_tables(spark, docs):
    """Shards as even as the groups of equal texts allow: what stays open is below half of the smallest groups."""
    got = rows(spark, "op8_sharding").merge(docs, on="doc_id")
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.sum() == sum(len(t.encode()) + 8 for t in docs.text) and sums.max() < 1.02 * sums.mean() and sums.min() > 0.98 * sums.mean()


def test_sharding_of_several_overfull_groups(spark):
    """Groups above a share are subdivided; the small groups of their ranges and all others stay whole."""
    texts = ["first " * 60] * 900 + ["second " * 60] * 700 + ["third " * 60] * 500 + [f"small {i % 400} " * (i % 7 + 1) for i in range(2800)]
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    got["text"] = [texts[i] for i in got.doc_id]
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) and len(sums) == 24 and sums.max() < 1.03 * sums.mean() and sums.min() > 0.97 * sums.mean()
    homes = got.groupby("text").shard.nunique()
    assert all(homes[t] > 1 for t in ("first " * 60, "second " * 60, "third " * 60)) and (homes.drop(["first " * 60, "second " * 60, "third " * 60]) == 1).all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_splitters_are_quantiles_of_size(spark):
    """Of many small groups the sampled splitters make ranges of about equal bytes, whatever the groups' sizes."""
    draw = np.random.default_rng(12)
    keys, sizes = draw.integers(-(2**63), 2**63 - 1, 60_000), draw.integers(1, 40, 60_000) ** 2
    groups = spark.createDataFrame(pd.DataFrame({"key": keys, "size": sizes}))
    cuts = sharding.splitters(groups, int(sizes.sum()))
    inside = np.bincount(np.searchsorted(np.array(cuts), keys, side="right"), weights=sizes)
    assert 0.9 * sharding.RANGES <= len(cuts) <= 1.1 * sharding.RANGES and inside.max() < 3 * sizes.sum() / sharding.RANGES
    got = sharding._range_of(groups, cuts).groupBy("cell").agg(F.sum("size").alias("s")).toPandas()
    assert dict(zip(got.cell, got.s, strict=True)) == {i: x for i, x in enumerate(inside) if x}


# --- 9 ---------------------------------------------------------------------


def brute_licence(line):
    import math
    from collections import Counter

    weights, unseen = licences.template_weights()
    idf = {t: i for _, _, t, _, i in weights}
    bag = Counter(licences._terms(line))
    norm = math.sqrt(sum((n * idf.get(t, unseen)) ** 2 for t, n in bag.items())) or 1
    best = Counter()
    for template, name, t, w, _ in weights:
        best[(template, name)] += bag[t] * idf[t] * w / norm
    (_, name), cosine = max(best.items(), key=lambda x: (x[1], [-ord(c) for c in x[0][1]]))
    return (name, cosine) if cosine >= licences.LEAST_COSINE else None


def test_licences_by_brute_force(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "licensed under cc by-nc 4.0", "This file is released under the MIT license", "GNU General Public License version 2", "no licence here", "the license of my car", "Released under the MIT License. All rights.", "SPDX License MIT", "public domain"]
    got = {r.line: (r.licence, r.cosine) for r in licences.judge_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    for line in lines:
        want = brute_licence(line)
        assert (line in got) == (want is not None)
        if want:
            assert got[line][0] == want[0] and got[line][1] == pytest.approx(want[1])


def test_licences_are_inherited_from_the_nearest_directory(spark):
    files = [("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/COPYING.txt", "Released under the MIT License."), ("a/b/c/d/x.py", "code"), ("a/y.py", "code\n"), ("a/b/z.py", "Licensed under CC BY-NC 4.0.\ncode"), ("q/w.py", "x"), ("LICENSE.md", "Licensed under the ISC License."), ("ab/n.py", None), (None, "x")]
    got = {r.path: r for r in licences.scan(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "file_id long, path string, text string")).collect()}
    assert (got["a/b/c/d/x.py"].licence, got["a/b/c/d/x.py"].inherited_from) == ("MIT", "a/b/COPYING.txt") and got["a/y.py"].licence == "Apache-2.0"
    assert (got["a/b/z.py"].licence, got["a/b/z.py"].origin) == ("CC-BY-NC-4.0", "own") and got["q/w.py"].licence == got["ab/n.py"].licence == "ISC"
    assert got[None].origin == "none"


def test_lines_without_the_word_licence(spark):
    """What reaches the cosine is found whatever words it holds, and the filter before the join loses nothing."""
    line = "Redistribution and use in source and binary forms, with or without"
    assert brute_licence(line)[0] == "BSD-3-Clause"
    words = sorted({t for _, x in licences.TEMPLATES for t in licences._terms(x) if " " not in t})
    draw = np.random.default_rng(9)
    made = [line, *(" ".join(draw.choice(words, draw.integers(1, 7))) for _ in range(300))]
    own = [" ".join(w for w in x.split() if draw.random() < 0.6) for _, x in licences.TEMPLATES * 8]
    frame = spark.createDataFrame([(x,) for x in made + own], "line string")
    passed = {r.line for r in frame.where(licences.may_name(F.col("line"))).collect()}
    assert all(x in passed for x in made + own if brute_licence(x))
    got = licences.scan(spark.createDataFrame([(1, "a/b.py", "x\n" + line)], "file_id long, path string, text string")).first()
    assert (got.licence, got.origin) == ("BSD-3-Clause", "own")


def test_whole_licence_files(spark):
    full = {n: t for n, t in licences.file_templates()[-12:]}
    wrapped = {n: "Copyright (c) 2020 Some One\n\n" + "\n".join(re.findall(r"\S(?:.{0,68}\S)?(?=\s|$)", " ".join(t.split()))) for n, t in full.items()}
    made = [(n, f"{n}/LICENSE", t) for n, t in wrapped.items()] + [("MIT", "s/LICENSE", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "t/LICENSE.txt", "SPDX-License-Identifier: Apache-2.0"), (None, "u/LICENSE", "ask the owner of this house")]
    got = {r.path: r.licence for r in licences.scan(spark.createDataFrame([(i, p, t) for i, (_, p, t) in enumerate(made)], "file_id long, path string, text string")).collect()}
    assert got == {p: n for n, p, _ in made} and len(full) >= 11


def test_wrapped_headers(spark):
    """A header over several commented lines is judged as one; prose that fills the block hides no line."""
    def wrap(text, mark, width):
        return "\n".join(mark + x for x in re.findall(rf"\S(?:.{{0,{width}}}\S)?(?=\s|$)", text))

    made = [(n, wrap(t, mark, 50)) for n, t in licences.HEADERS if len(t) > 120 for mark in ("# ", "// ", " * ", "")]
    files = [(i, f"src/{i}.c", "int x;\n\n" + t + "\n\nint main() {}\n") for i, (_, t) in enumerate(made)] + [(900, "src/z.c", "int a;\nint b;\n\nint c;"), (901, "y.c", "some words\nReleased under the MIT License.\nmore words " * 3)]
    got = {r.file_id: r.licence for r in licences.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert {i: got[i] for i in range(len(made))} == {i: n for i, (n, _) in enumerate(made)} and got[900] is None and got[901] == "MIT"


def test_ties_go_to_the_first_name(spark):
    two = (("B-1", "some common licence words"), ("A-1", "some common licence words"))
    assert licences.judge_lines(spark.createDataFrame([("some common licence words",)], "line string"), two).first().licence == "A-1"


def test_licences_whole_table(spark, docs):
    got = rows(spark, "op9_licences").set_index("doc_id")
    names = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    first = docs.groupby(["source", "lang"]).doc_id.transform("min") == docs.doc_id
    assert {i: got.path[i].endswith("/LICENSE") for i in docs.doc_id} == dict(zip(docs.doc_id, first, strict=True))
    given = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        want = {n for line, n in names.items() if line in t}
        assert (got.loc[i].licence in want and got.loc[i].origin == "own") if want else got.loc[i].origin != "own"
        if want and got.path[i].endswith("/LICENSE"):
            given[got.path[i].rsplit("/", 1)[0]] = got.licence[i]
    for i in docs.doc_id:
        if got.origin[i] != "own":
            folder = got.path[i].rsplit("/", 1)[0]
            assert (got.licence[i] or None, got.inherited_from[i] or None) == ((given[folder], folder + "/LICENSE") if folder in given else (None, None))
    assert len(given) > 0


# --- 10 --------------------------------------------------------------------


def near_pairs(n, cosine, seed=0, width=64):
    draw = np.random.default_rng(seed)
    a = draw.normal(size=(n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = draw.normal(size=(n, width))
    v -= (v * a).sum(1, keepdims=True) * a
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * v


def test_e8_is_the_nearest_point():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 8)) * 2
    p = lattice.e8(x)
    assert len(lattice.neighbours()) == 240
    near = np.concatenate([p[:, None], p[:, None] + lattice.neighbours()[None]], 1)
    d = ((near - x[:, None]) ** 2).sum(-1)
    assert (d.argmin(1) == 0).all() and (np.isclose(p % 1, 0).all(1) | np.isclose(p % 1, 0.5).all(1)).all() and (np.rint(p.sum(1)) % 2 == 0).all()


@pytest.mark.parametrize("level", range(len(lattice.LEVELS)))
def test_recall_at_the_threshold(level):
    """Pairs just above 0.93 share a bucket nearly always, at every level: above the 0.9 asked for."""
    a, b = near_pairs(1200, 0.9301)
    share = (lattice.buckets(a, level)[:, :, :, None] == lattice.buckets(b, level)[:, :, None, :]).any((1, 2, 3))
    assert share.mean() > 0.98


def test_finer_cells_hold_fewer_chance_pairs():
    x = near_pairs(4000, 0.0)[0]
    met = []
    for level in range(len(lattice.LEVELS)):
        names, counts = zip(*(np.unique(lattice.buckets(x, level)[:, t], return_counts=True) for t in range(lattice.LEVELS[level][3])), strict=True)
        met.append(sum((c * (c - 1) // 2).sum() for c in counts))
    assert met[0] > 20 * met[1] > 200 * met[2]


@pytest.mark.parametrize("block,level", [(4096, 0), (7, 0), (4096, 1), (5, 2)])
def test_lattice_by_brute_force(spark, monkeypatch, block, level):
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "LEVELS", tuple((0 if k <= level else 1 << 60, *x[1:]) for k, x in enumerate(lattice.LEVELS)))
    draw = np.random.default_rng(8)
    a, b = near_pairs(60, 0.95, 1)
    tight = a[0] + 0.02 * draw.normal(size=(60, 64))
    x = np.concatenate([a, b, tight, np.repeat(a[:1], 4, 0), draw.normal(size=(100, 64))])
    label = np.where(np.arange(len(x)) % 17 == 0, 2, 1)
    ids = draw.permutation(len(x)) + 10
    df = spark.createDataFrame([(int(i), v.tolist(), int(l)) for i, v, l in zip(ids, x, label, strict=True)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(s, False)
    want = s.sum(1)
    n = np.array([got[int(i)][0] for i in ids])
    assert (n <= want).all() and n.sum() >= 0.97 * want.sum()
    order = np.argsort(ids)
    comp = brute_components(len(ids), [(int(np.flatnonzero(order == i)[0]), int(np.flatnonzero(order == j)[0])) for i, j in np.argwhere(s) if i < j])
    assert np.mean([got[int(ids[order[k]])][1] == ids[order[c]] for k, c in enumerate(comp)]) > 0.95
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


# --- pipeline --------------------------------------------------------------


def brute_shingles(text):
    """All sequences of five words; fewer words are one sequence."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_stages_by_brute_force(spark, docs):
    import corpus_pipeline

    def keep(df):
        from folioscope.llm._common import stored

        return stored(df, "test")

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    one = keep(stages["quality"](spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL))
    accepted = set(rows(spark, "op1_quality").query("predicted == 1").doc_id)
    assert set(one.toPandas().doc_id) == accepted
    two = keep(stages["near_duplicates"](spark, one, SMALL)).toPandas()
    own = docs[docs.doc_id.isin(accepted)].sort_values("doc_id")
    sets = [brute_shingles(t) for t in own.text]
    comp = brute_components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    assert sorted(two.doc_id) == sorted(own.doc_id.iloc[c] for c in set(comp))
    three = keep(stages["pii"](spark, spark.createDataFrame(two), SMALL)).toPandas().set_index("doc_id")
    for i, t in zip(two.doc_id, two.text, strict=True):
        spans = brute_base(t)
        assert three.loc[i].n_chars == (len(three.loc[i].text) if three.loc[i].text != t else two.set_index("doc_id").loc[i].n_chars)
        assert not brute_base(three.loc[i].text) if spans else True
    mixed = keep(stages["mixing"](spark, spark.createDataFrame(three.reset_index()), SMALL))
    left = spark.createDataFrame(three.reset_index())
    times = mixing.mix(left, mixing.fitted_weight(left, spark.read.parquet(f"{SMALL}/labels.parquet"))).toPandas().set_index("doc_id").times
    counts = mixed.toPandas().doc_id.value_counts()
    assert counts.to_dict() == times[times > 0].to_dict()
    assert stages["packing"](spark, mixed, SMALL).toPandas().query("piece == 0").shape[0] == counts.sum()


def test_hash_sample_is_bounded_and_steady(spark):
    from folioscope.llm._common import hash_sample

    df = spark.range(20_000).withColumnRenamed("id", "k")
    got = [r.k for r in hash_sample(df, 500, "k").collect()]
    assert 450 <= len(got) <= 500 and got == [r.k for r in hash_sample(df.repartition(7), 500, "k").collect()]
    assert hash_sample(df.limit(30), 500, "k").count() == 30 and hash_sample(df.limit(0), 5, "k").count() == 0


def test_near_copies_by_brute_force(spark):
    """Components at 5-word Jaccard 0.8, which 2 bits of a fingerprint hardly ever reach."""
    from folioscope.llm import jaccard

    draw = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(60):
        base = draw.choice(vocabulary, 200).tolist()
        texts.append(" ".join(base))
        for changes in (1, 3, 4, 5, 8, 40):
            copy = list(base)
            for at in draw.choice(200, changes, replace=False):
                copy[at] = "other"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [(i, j) for k in range(60) for i in range(7 * k, 7 * k + 7) for j in range(7 * k, i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = {texts[c] for c in set(brute_components(len(texts), links))}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.text for r in simhash.keep_one_of_each(spark, frame, SMALL).collect()}
    assert want <= got and len(got) <= len(want) + 3  # candidates at 0.8 itself are found with probability 0.997
    assert len(want) < 0.6 * len(texts) and jaccard.LEAST == (4, 5)


def test_one_row_of_each_component_stays(spark):
    """Null ids and ids with several texts lose no component."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    made = [(None, a), (None, b), (None, b), (1, c), (None, c), (2, c), (2, "zz " + "other text entirely " * 3), (3, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one_of_each(spark, frame, SMALL).collect()))
    assert got == sorted([(0, a), (0, b), (1, c), (2, made[6][1]), (3, "")])
