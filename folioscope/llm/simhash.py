"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within LINK differing bits are linked. The 64 bits are cut into
LINK + 1 blocks; two fingerprints that differ in at most LINK bits agree on
one block at least, so each fingerprint is dealt to one branch for each block
(the branch is the top of the index: the block's value, difference 0).
In a branch the fingerprints are sorted by Gray rank, which puts those that
share long bit patterns next to each other. FANOUT neighbours form a node,
whose mask says which bits they all share and whose pattern holds those bits;
FANOUT nodes form an upper node, and so on. A node keeps only the bits that the
node above it doesn't share, so a probe's differences are added up on the way
down; where they exceed LINK, the node is pruned with all below it.

Copies are folded before the index: it holds each distinct fingerprint once.
From a branch comes a spanning forest of its links (at most one edge for each
fingerprint), which keeps every component whole without listing all pairs. A
branch of more than BRANCH fingerprints is split again by the blocks of its
other bits, by the same argument and so without loss, as long as bits remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import components, stored, table

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer.
LINK = 2
#: Children of a node of the index.
FANOUT = 16
#: A branch with more fingerprints is split by further blocks.
BRANCH = 2048
#: How often a branch can be split: 64 bits, 3 blocks of about 21, then of 14, then of 9.
LEVELS = 3
#: Shingles whose bits are counted together, which bounds the memory for a long text.
STEP = 1 << 15


def fingerprint(text: str | None) -> int:
    """Unsigned 64 bits. Null and texts without words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII space alone
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; none of no hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        counts += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray order: the number whose Gray code it is."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over distinct fingerprints; see the module's docstring."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fanout = codes[self.order], fanout
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up: mask and pattern, of own bits alone
        mask, pattern = np.full(len(codes), ~np.uint64(0)), self.codes
        while len(mask) > 1:
            edges = np.arange(0, len(mask), fanout)
            shared = np.bitwise_and.reduceat(mask, edges)
            shared &= ~(np.bitwise_or.reduceat(pattern, edges) ^ np.bitwise_and.reduceat(pattern, edges))
            above = np.repeat(shared, fanout)[: len(mask)]
            self.levels.append((mask & ~above, pattern & ~above))
            mask, pattern = shared, pattern[edges] & shared
        self.levels.append((mask, pattern))

    def pairs(self, probes: np.ndarray, most: int = LINK) -> tuple[np.ndarray, np.ndarray]:
        """(probe, code) positions, in the order given, of all that differ in at most `most` bits."""
        probe = np.arange(len(probes) if len(self.codes) else 0)
        node, so_far = np.zeros(len(probe), np.int64), np.zeros(len(probe), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[depth]
            so_far = so_far + np.bitwise_count((probes[probe] & mask[node]) ^ pattern[node])
            stays = so_far <= most
            probe, node, so_far = probe[stays], node[stays], so_far[stays]
            if depth:
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                probe, so_far = np.repeat(probe, self.fanout), np.repeat(so_far, self.fanout)
                inside = node < len(self.levels[depth - 1][0])
                probe, node, so_far = probe[inside], node[inside], so_far[inside]
        return probe, self.order[node]


def spanning(codes: np.ndarray, most: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a spanning forest of the links among distinct codes."""
    index, parent = GrayIndex(codes), np.arange(len(codes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for at in range(0, len(codes), 512):  # blocks of probes, which bound the memory
        p, q = index.pairs(codes[at : at + 512], most)
        p = p + at
        for i, j in zip(*(x[p < q].tolist() for x in (p, q)), strict=True):
            if (u := root(i)) != (v := root(j)):
                parent[max(u, v)] = min(u, v)
                a.append(i)
                b.append(j)
    return np.array(a, np.int64), np.array(b, np.int64)


def _edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Input sorted by branch; a branch that two batches share is carried over."""
    names, rest = ["b0", "b1", "b2"], None

    def of(codes: np.ndarray) -> pd.DataFrame:
        a, b = spanning(codes.view(np.uint64))
        return pd.DataFrame({"a": codes[a], "b": codes[b]})

    for part in parts:
        if rest is not None:
            part = pd.concat([rest, part], ignore_index=True)
        keys, codes = part[names].to_numpy(), part["code"].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        start = int(cuts[-1]) if len(cuts) else 0
        rest = part.iloc[start:]
        edges = np.append(0, cuts)
        for i in np.flatnonzero(np.diff(edges) > 1):
            yield of(codes[edges[i] : edges[i + 1]])
    if rest is not None and len(rest) > 1:
        yield of(rest["code"].to_numpy())


def blocks(level: int) -> list[list[int]]:
    """Bits of each block at a level, for blocks of the level above numbered by path: [bits of branch path]."""
    paths = [list(range(64))]
    for _ in range(level):
        paths = [rest for path in paths for rest in _without(path)]
    return paths


def _parts(bits: list[int]) -> list[list[int]]:
    n, k = len(bits), LINK + 1
    return [bits[i * n // k : (i + 1) * n // k] for i in range(k)]


def _without(bits: list[int]) -> list[list[int]]:
    return [[x for x in bits if x not in part] for part in _parts(bits)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def links(codes: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in codes (code long) that keep every component whole."""
    k = LINK + 1
    first = _parts(list(range(64)))
    branch = F.explode(F.array(*[F.struct(F.lit(i).alias("path"), F.lit(i).cast("long").alias("b0"), F.col("code").bitwiseAND(F.lit(_mask(p))).alias("b1"), F.lit(0).cast("long").alias("b2")) for i, p in enumerate(first)]))
    rows = codes.select("code", branch.alias("x")).select("code", "x.*")
    done = []
    for level in range(1, LEVELS + 1):
        sizes = rows.groupBy("b0", "b1", "b2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if level == LEVELS:
            done.append(rows.join(sizes.drop("n"), ["b0", "b1", "b2"], "left_semi"))
            break
        heavy = stored(sizes.where(F.col("n") > BRANCH).drop("n"), "heavy")
        done.append(rows.join(sizes.where(F.col("n") <= BRANCH).drop("n"), ["b0", "b1", "b2"], "left_semi"))
        if heavy.isEmpty():
            break
        paths = blocks(level)
        choices = F.lit(None)
        for i, bits in enumerate(paths):
            sub = F.array(*[F.struct(F.lit(i * k + j).alias("path"), F.lit(level * 100 + i * k + j).cast("long").alias("b0"), F.col("b1").bitwiseOR(F.lit(0)).alias("b1"), F.col("b2").bitwiseOR(F.col("code").bitwiseAND(F.lit(_mask(p)))).alias("b2")) for j, p in enumerate(_parts(bits))])
            choices = F.when(F.col("path") == i, sub).otherwise(choices)
        rows = rows.join(heavy, ["b0", "b1", "b2"], "left_semi").select("code", F.explode(choices).alias("x")).select("code", "x.*")
    out = None
    for part in done:
        made = part.repartition("b0", "b1", "b2").sortWithinPartitions("b0", "b1", "b2", "code").select("b0", "b1", "b2", "code").mapInPandas(_edges, "a long, b long")
        out = made if out is None else out.union(made)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id long, text string).

    component_id is the smallest doc_id that links reach. Null texts, empty
    texts and texts of blanks have fingerprint 0 and link with each other.
    Repeated rows each come back. A null doc_id keeps its row and never gives
    a component its id, unless nothing else is in it. Other columns are
    neither read nor returned. An empty table gives an empty result.
    """
    prints = stored(docs.select("doc_id", _fingerprints("text").alias("code")), "prints")
    groups = stored(prints.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    made = components(links(groups.select("code")))
    # each component's smallest doc_id, for the few fingerprints that link with another one
    linked = made.join(groups, made["node"] == groups["code"]).select("code", "component", "first")
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    known = stored(linked.join(lowest, "component").select("code", "lowest"), "lowest")
    least = groups.join(known, "code", "left").select("code", F.coalesce("lowest", "first").alias("component_id"))
    return prints.join(least, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies (jaccard.py) exactly one row stays.

    Candidates come from this index over the copies' own fingerprints as well as
    from MinHash, and each is verified. The one that stays is that with the smallest doc_id, null only where no row has one; of
    several such rows that with the smallest text, then the other columns.
    """
    from folioscope.llm.jaccard import near_copies, text_key  # it builds on this module

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    rows, made = near_copies(docs)
    marks = stored(rows.join(made, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("_group")), "marks")
    number = marks.groupBy("_group", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    lowest = number.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("low")).select(F.col("_group").alias("_of"), F.col("low.doc_id").alias("_low"), F.col("low.n").alias("_n"))
    stays = marks.join(lowest, (F.col("_group") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_low"))).select("_group", "_low", F.col("key").alias("_stays"), "_n").distinct()
    kept = docs.select(*cols, text_key().alias("_text")).join(stays, F.col("doc_id").eqNullSafe(F.col("_low")) & (F.col("_text") == F.col("_stays")))
    repeated = kept.where("_n > 1").groupBy("_group").agg(F.min(F.struct("text", "doc_id", *cols[2:])).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in cols])
    return kept.where("_n = 1").select(*cols).union(repeated)
