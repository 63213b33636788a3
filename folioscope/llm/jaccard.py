"""Near copies by the Jaccard similarity of their word shingles.

This is the pipeline's form of the near-duplicate operator. Two texts are linked
when the sets of their WORDS-word shingles have a similarity of LEAST or more.
Candidates come from two sides. The Gray-order index of simhash.py, over
fingerprints of these shingles, gives texts within 2 of 64 bits, which are the
closest copies; at a similarity of 0.8 fingerprints differ in about 10 bits, too
many for any index of 64. So MinHash gives the others: BANDS bands of ROWS
minima each, and texts that agree on a whole band share a bucket; a pair at
LEAST shares one with probability 1 - (1 - LEAST ** ROWS) ** BANDS = 0.997, more
similar ones more surely. Every candidate is then held against the sets
themselves, so nothing less similar is linked.

Texts of equal sets are one node. Of each bucket all nodes are first held
against its smallest one; only where that leaves a bucket in several components
are the pairs across them looked at, each once, and of these only the ones that
parity sketches leave possible: classes of shingles in which one text has an odd
number and the other an even one each hold a shingle that they don't share, so
their number bounds the similarity from above. A large group of near copies
thus costs a few comparisons a node, and no pair that could still join two
components is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import components, stored
from folioscope.llm.simhash import links, majority

WORDS = 5
SEED = 42
#: Similarity from which texts are near copies, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS = 32
ROWS = 8
#: Candidates up to so many are broadcast by the digests of their texts, 40 bytes each.
BROADCAST = 200_000
#: Shingles whose minima are taken together, which bounds the memory for a long text.
STEP = 1 << 11

_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _draw.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))])
#: Words of 64 bits of a parity sketch.
PARITY = 16


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a text of fewer than WORDS words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII space alone
    if not words:
        return np.zeros(0, np.uint64)
    parts = [words] if len(words) < WORDS else zip(*(words[i:] for i in range(WORDS)), strict=False)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(p), SEED) for p in parts], np.uint64))


def buckets(grams: np.ndarray) -> np.ndarray:
    """One bucket for each band; none for a text without words."""
    if not len(grams):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(grams), STEP):
        np.minimum(least, (grams[at : at + STEP, None] * _TIMES + _PLUS).min(0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64).view(np.int64)


def parity(grams: np.ndarray) -> np.ndarray:
    """For each of PARITY * 64 classes of shingles whether their number is odd."""
    odd = np.bincount((grams % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@F.pandas_udf(_SKETCH)
def _sketch(texts: pd.Series) -> pd.DataFrame:
    grams = [shingles(t) for t in texts]
    node = [xxhash.xxh64_intdigest(g.tobytes(), SEED) if len(g) else 0 for g in grams]
    return pd.DataFrame({"node": np.array(node, np.uint64).view(np.int64), "n": [len(g) for g in grams], "code": np.array([majority(g) for g in grams], np.uint64).view(np.int64), "buckets": [buckets(g) for g in grams], "parity": [parity(g) for g in grams]})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _grams(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


def _alike(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b members with so many in common reach LEAST."""
    part, whole = LEAST
    return (part + whole) * shared >= part * (a + b)


def _may_link(p: Column, q: Column, a: Column, b: Column) -> Column:
    """False only for sets of a and b members that can't reach LEAST: classes with different parities hold a member of one set alone."""
    differ = sum((F.bit_count(p[i].bitwiseXOR(q[i])) for i in range(PARITY)), F.lit(0))
    part, whole = LEAST
    return (part + whole) * differ <= (whole - part) * (a + b)


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Candidates (a, b) of prints (node, code): the nodes of one fingerprint with its smallest, and the smallest ones of fingerprints that link."""
    nodes = prints.distinct()
    codes = stored(nodes.groupBy("code").agg(F.min("node").alias("first")), "codes")
    alike = nodes.join(codes, "code").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    x, y = (codes.select(F.col("code").alias(c), F.col("first").alias(f"{c}_node")) for c in "ab")
    linked = links(codes.select("code")).join(x, "a").join(y, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return alike.union(linked).distinct()


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, node) of every row of docs (doc_id long, text string), and (node, component) of the nodes that link.

    key is the text's SHA-256. Null texts, empty texts and texts of blanks are
    one node. Other columns are neither read nor returned.
    """
    prints = stored(docs.select("doc_id", text_key().alias("key"), _sketch("text").alias("s")).select("doc_id", "key", "s.*"), "sketches")
    dealt = prints.select("node", "n", "buckets").dropDuplicates(["node"]).select("node", "n", F.explode("buckets").alias("bucket"))
    dealt = stored(dealt, "buckets")
    leaders = dealt.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    members = stored(dealt.join(leaders, "bucket"), "members")
    close = stored(_by_fingerprint(prints.where("n > 0").select("node", "code")), "close")
    wanted = members.select("node").union(close.select(F.col("a"))).union(close.select(F.col("b"))).distinct()
    # shingles are kept of candidates alone, made anew from one text of each
    keys = stored(prints.select("node", "key").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("key").alias("of")), "keys")
    few = F.broadcast(keys) if keys.count() <= BROADCAST else keys
    texts = docs.select(text_key().alias("of"), "text").join(few, "of").select("node", _grams("text").alias("grams"))
    sets = stored(texts.groupBy("node").agg(F.first("grams").alias("grams")), "grams")

    def fit(a: Column, b: Column) -> Column:
        return _alike(F.least(a, b), a, b)  # sizes too far apart can't reach it

    def checked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        return both.where(_alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")

    star = members.where((F.col("node") != F.col("leader.node")) & fit(F.col("n"), F.col("leader.n"))).select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(checked(star.union(close).distinct()), "links")
    made = components(first)
    placed = stored(members.select("bucket", "node", "n").join(made, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("c")), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket")
    halves = placed.join(open_, "bucket", "left_semi")
    odd = prints.select("node", "parity").join(halves.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    rest = stored(halves.join(odd, "node"), "open")
    other = rest.select("bucket", *[F.col(x).alias(f"{x}2") for x in ("node", "n", "c", "parity")])
    near = fit(F.col("n"), F.col("n2")) & _may_link(F.col("parity"), F.col("parity2"), F.col("n"), F.col("n2"))
    across = rest.join(other, "bucket").where((F.col("node") < F.col("node2")) & (F.col("c") != F.col("c2")) & near).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    second = stored(checked(across.join(star, ["a", "b"], "left_anti")), "links")
    if not second.isEmpty():
        made = components(first.union(second))
    return prints.select("doc_id", "key", "node"), made


def text_key() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
