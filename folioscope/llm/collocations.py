"""Collocations: phrases whose words stand together more often than their parts would.

Counting is by direct-address tiling, one level of phrase length after another.
Words that occur LEAST times or more are the units of level 1, phrases of k
words that do those of level k. The HEAD most frequent units of a level have
their frequency rank as their number. A phrase of k words is a pair: the unit of
its first k - 1 words and its last word. Where both have ranks the pair is a
cell of a tile of EDGE x EDGE ranks; a task gathers cells, and counts a tile
that many of them fall in with one dense bincount, and any other as sorted
coordinates. Units without a rank keep their 64-bit name and are counted as
sorted coordinates too. Frequent pairs are ranked anew and are the units of the
next level. Counts of a task are added up before they are shuffled, so a
frequent word or phrase is one row from each task.

What is broadcast has a fixed size: HEAD names for each level and a bit map of
BITS bits that says whether a unit may be frequent; where it errs, pairs are
counted that the exact totals then drop. A word's name is the XXH64 of its
language and letters; were two words of the corpus to share one and either is
frequent, all names are drawn anew with another salt, so counts are exact.

A null text counts as empty, a null language as `und`. Repeated rows count each
time. Texts are read whole; very long ones in parts of about CHUNK bytes, cut where a
piece ends. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm._common import stored, table

#: Fewest occurrences of a candidate, and so of its words.
LEAST = 10
LONGEST = 3
SCALE = 1_000_000
#: A candidate goes if a longer one that holds it has this share of its occurrences, in hundredths.
COVERED = 50
FIRST = 2000
#: Candidates that a task ranks, about.
RANKED = 20_000
#: Units of a level that have ranks.
HEAD = 1 << 13
EDGE = 1 << 10
#: Cells in a tile from which it is counted densely.
DENSE = EDGE * EDGE // 64
#: Cells that a task gathers before it counts them.
GATHERED = 1 << 21
BITS = 1 << 26
CHUNK = 1 << 22
SEED = 42
_MARK = b"\xff"  # in no UTF-8 text
_SEPARATED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _MARK * 10 + b" ")


def words(text: bytes) -> list[bytes]:
    """Lower-case words in order, with a mark where a piece ends."""
    return text.translate(_SEPARATED).replace(_MARK, b" " + _MARK + b" ").split(b" ")


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes, cut where pieces end."""
    if len(text) <= CHUNK:
        yield text
        return
    text, at = text.translate(_SEPARATED), 0
    while at < len(text):
        end = text.find(_MARK, at + CHUNK)
        yield text[at : end if end >= 0 else len(text)]
        at = end + 1 if end >= 0 else len(text)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(language, distinct words, code of each word in order) of some texts of a language; an end of a text ends a piece; code 0 is the mark."""
    own: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}

    def coded(lang: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        listed = [w for w in words(_MARK + _MARK.join(own.pop(lang)) + _MARK) if w]
        codes, distinct = pd.factorize(np.array(listed, dtype=object))
        return lang, distinct, codes

    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        for part in _parts(text):
            own.setdefault(lang, []).append(part)
            sizes[lang] = sizes.get(lang, 0) + len(part)
            if sizes[lang] >= CHUNK:
                sizes[lang] = 0
                yield coded(lang)
    for lang in list(own):
        yield coded(lang)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, distinct, codes in _chunks(batch):
            n = np.bincount(codes, minlength=len(distinct))[1:]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.binary()), pa.array(list(distinct[1:]), pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _prefix(salt: int, lang: bytes) -> bytes:
    return b"%d:%d:%s" % (salt, len(lang), lang)


def _hash(salt: int) -> Column:
    """A word's name, as _prefix and XXH64 give it in a task."""
    return F.xxhash64(F.concat(F.concat(F.lit(f"{salt}:"), F.octet_length("lang").cast("string"), F.lit(":")).cast("binary"), F.col("lang"), F.col("word")))


def _mixed(names: np.ndarray) -> np.ndarray:
    """A number for each row of names (n, k)."""
    out = np.zeros(len(names), dtype=np.uint64)
    for column in names.T:
        out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Level(NamedTuple):
    """The frequent units of a length: a bit map over all, and the names of the most frequent in order of rank."""

    bits: np.ndarray
    head: np.ndarray

    def may_hold(self, names: np.ndarray) -> np.ndarray:
        at = _mixed(names) & np.uint64(BITS - 1)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def rank(self, names: np.ndarray) -> np.ndarray:
        """Rank of each unit, -1 without one."""
        if not len(self.head):
            return np.full(len(names), -1, np.int64)
        keys = _mixed(self.head)
        order = np.argsort(keys, kind="stable")
        own, mixed = keys[order], _mixed(names)
        at, out = np.searchsorted(own, mixed), np.full(len(names), -1, np.int64)
        while (open_ := (at < len(own)) & (out < 0)).any():  # units of equal keys stand side by side
            at[open_ & (own[np.minimum(at, len(own) - 1)] != mixed)] = len(own)
            open_ &= at < len(own)
            hit = order[at[open_]]
            same = (self.head[hit] == names[open_]).all(axis=1)
            place = np.flatnonzero(open_)
            out[place[same]] = hit[same]
            at[open_] += 1
        return out


def _set_bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        at = _mixed(part.to_numpy(np.int64)) & np.uint64(BITS - 1)
        yield pd.DataFrame({"slot": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})


def _level(counts: DataFrame, names: list[str]) -> Level:
    """The level of frequent units (names, n): HEAD rows and BITS bits at most come to the driver."""
    marked = counts.select(*names).mapInPandas(_set_bits, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, dtype=np.uint64)
    bits[marked["slot"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    head = counts.orderBy(F.col("n").desc(), *names).limit(HEAD).select(*names).toPandas()
    return Level(bits, head.to_numpy(np.int64).reshape(len(head), len(names)))


def tiled(cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ranks (first * width + second), counted tile by tile: first, second, n."""
    first, second = cells // width, cells % width
    tiles = first // EDGE * width + second // EDGE
    order = np.argsort(tiles, kind="stable")
    found: list[tuple] = []
    for own in np.split(order, np.flatnonzero(np.diff(tiles[order])) + 1):
        if not len(own):
            continue
        row, column = first[own[0]] // EDGE * EDGE, second[own[0]] // EDGE * EDGE
        inside = (first[own] - row) * EDGE + second[own] - column
        if len(own) >= DENSE:
            n = np.bincount(inside, minlength=EDGE * EDGE)
            cell = np.flatnonzero(n)
            n = n[cell]
        else:
            cell, n = np.unique(inside, return_counts=True)
        found.append((row + cell // EDGE, column + cell % EDGE, n))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))


def _count_phrases(length: int, salt: int, shared, width: int, most: int):
    """mapInArrow: counts of the phrases of a length whose shorter phrases may all be frequent; ranks are below width, and `most` cells are gathered."""
    names = [f"w{i}" for i in range(1, length + 1)] + ["n"]

    def batch_of(table_: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c), pa.int64()) for c in table_.T), pa.array(n, pa.int64())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[Level] = shared.value
        gathered: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            first, second, n = tiled(np.concatenate(gathered), width)
            gathered.clear()
            return batch_of(np.column_stack([levels[-1].head[first] if length > 2 else first, second]), n)

        for batch in batches:
            for lang, distinct, codes in _chunks(batch):
                start = _prefix(salt, lang)
                hashes = np.fromiter((xxhash.xxh64_intdigest(start + w, SEED) for w in distinct), np.uint64, len(distinct)).view(np.int64)
                ranks = levels[0].rank(hashes[:, None])
                keep = levels[0].may_hold(hashes[:, None])
                keep[:1] = False  # the mark
                name = np.where(ranks >= 0, ranks, hashes)
                units, unit_ranks, at = name[:, None], ranks, np.where(keep[codes], codes, -1)
                for k in range(2, length + 1):
                    # units of k - 1 words that begin here and one word later
                    here = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0)) if k > 2 else np.flatnonzero(keep[codes[:-1]] & keep[codes[1:]])
                    last = codes[here + k - 1]
                    pairs = at[here] * len(distinct) + last
                    if k == length:
                        dense = (unit_ranks[at[here]] >= 0) & (ranks[last] >= 0)
                        gathered.append(unit_ranks[at[here]][dense] * width + ranks[last][dense])
                        key, n = np.unique(pairs[~dense], return_counts=True)
                        if len(key):
                            yield batch_of(np.column_stack([units[key // len(distinct)], name[key % len(distinct)]]), n)
                    else:
                        key, inverse = np.unique(pairs, return_inverse=True)
                        units = np.column_stack([units[key // len(distinct)], name[key % len(distinct)]])
                        known, unit_ranks = levels[k - 1].may_hold(units), levels[k - 1].rank(units)
                        at = np.full(len(codes), -1, np.int64)
                        at[here] = np.where(known[inverse], inverse, -1)
                if sum(map(len, gathered)) >= most:
                    yield flush()
        if gathered:
            yield flush()

    return count


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, word (as bytes), n of every word, and a salt with which no frequent word shares its name."""
    counts = _texts(docs).mapInArrow(_count_words, "lang binary, word binary, n long")
    held = stored(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for salt in range(100):
        named = held.select(_hash(salt).alias("h"), "n").groupBy("h").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most"))
        if named.where((F.col("most") >= LEAST) & ((F.col("words") > 1) | F.col("h").between(0, HEAD - 1))).isEmpty():
            return held, salt
    raise RuntimeError("no salt gives every frequent word a name of its own")


def _cuts(length: int) -> Column:
    """Of all cuts the one with the lowest score, then the smallest k: score, k, l, r."""
    big = "decimal(14,0)"

    def cut(k: int) -> Column:
        l, r = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        score = F.expr(f"(cast({SCALE} as decimal(7,0)) * (cast(a as {big}) * cast(a as {big}))) div (cast(heads[{k - 1}] as {big}) * cast(tails[{length - k - 1}] as {big}))")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.array(*[cut(k) for k in range(1, length)]))


def collocations(docs: DataFrame, longest: int = LONGEST, first: int | None = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases, all of them where first is None.

    a, l and r are exact; scores are worked out in decimals of up to 37 digits.
    """
    spark = docs.sparkSession
    held, salt = vocabulary(docs)
    frequent = held.where(F.col("n") >= LEAST).withColumn("h", _hash(salt))
    levels = [_level(frequent.select("h", "n"), ["h"])]
    ranked = spark.createDataFrame(pd.DataFrame({"_h": levels[0].head[:, 0], "_rank": np.arange(len(levels[0].head))}), "_h long, _rank long")
    one = frequent.join(F.broadcast(ranked), F.col("h") == F.col("_h"), "left").select(F.coalesce("_rank", "h").alias("w1"), F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"), "n")
    # of each level: the words' names, its phrase and last word, a, and how often its first and its last 1, 2, ... words occur
    own = stored(one.select("w1", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("a"), F.array("n").alias("heads"), F.array("n").alias("tails")), "level")
    found = []
    for length in range(2, longest + 1):
        names = [f"w{i}" for i in range(1, length + 1)]
        shared = spark.sparkContext.broadcast(levels)
        counted = _texts(docs).mapInArrow(_count_phrases(length, salt, shared, max(HEAD, 1), GATHERED), ", ".join(f"{c} long" for c in [*names, "n"]))
        counts = stored(counted.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), "counts")
        shared.destroy()
        if length < longest:
            levels.append(_level(counts, names))
        before = own.select(*names[:-1], "lang", F.col("phrase").alias("_phrase"), F.col("heads").alias("_heads"))
        after = own.select(*[F.col(n).alias(m) for n, m in zip(names[:-1], names[1:], strict=True)], "last", F.col("tails").alias("_tails"))
        full = counts.join(before, names[:-1]).join(after, names[1:])
        a = F.array("n")
        own = stored(full.select(*names, "lang", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", F.col("n").alias("a"), F.concat("_heads", a).alias("heads"), F.concat("_tails", a).alias("tails")), "level")
        found.append((names, own))
    kept = None
    for place, (names, phrases) in enumerate(found):
        longer = None
        for more, above in found[place + 1 :]:
            for start in range(len(more) - len(names) + 1):
                part = above.select(*[F.col(more[start + i]).alias(n) for i, n in enumerate(names)], F.col("a").alias("longer"))
                longer = part if longer is None else longer.union(part)
        rows = phrases.select(*names, "lang", "phrase", "a", _cuts(len(names)).alias("_cut"))
        if longer is not None:
            most = longer.groupBy(*names).agg(F.max("longer").alias("longer"))
            rows = rows.join(most, names, "left").where(F.coalesce(100 * F.col("longer") < COVERED * F.col("a"), F.lit(True)))
        rows = rows.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))
        kept = rows if kept is None else kept.union(rows)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if first is not None:  # a language's candidates are cut in salted parts until one task can rank what is left
        most = max(RANKED, 2 * first)
        salts = kept.count() // most
        while salts > 1:
            part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
            kept = kept.withColumn("_p", F.row_number().over(part)).where(F.col("_p") <= first).drop("_p")
            salts = salts * first // most
    totals = held.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    top = kept.withColumn("rank", place)
    top = top if first is None else top.where(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
