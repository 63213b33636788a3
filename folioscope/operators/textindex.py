"""A stored inverted index for ranked search.

The index is a folder of Parquet tables. `postings` holds blocks: the documents
of a shard that have a lexeme, BLOCK at a time in order of their keys, with the
keys as packed differences, how often each has the lexeme, and where. A block
names its first and last key and its largest number of occurrences, its impact.
The table is partitioned by a hash of the lexeme, so a search reads the
partitions of its words and no others. A shard is a hash of the document, so all
that a document can be found by is judged in one place.

A search goes through each shard's blocks by their highest possible rank and
leaves out, unread, every block that can't reach the worst of the rows it holds
(block-max pruning); a shard sends on as many rows as are asked for.

Documents are added and replaced one generation after another. A generation's
postings are new files; what it replaces is noted in `gone` (key, generation),
and a posting counts only while no later generation has its key there. compact()
writes all that counts into one generation of a new folder. Keys are whole
numbers. Null texts have no postings, rows without a key are left out, and of
rows with the same key in one generation the one with the longest text counts,
of equally long ones the last in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import retrieval as rt

#: Documents of a block.
BLOCK = 128
#: Folders that the lexemes are dealt to.
PARTS = 32
#: Documents whose words are in memory at a time while postings are made.
TOGETHER = 256
#: Words whose postings a task gathers before it sends them on.
GATHERED = 1_000_000
#: Postings of a lexeme and shard that are sorted together, fewer where they hold 2 * GATHERED words.
LONG = 65_536
RUN = "lexeme string, shard int, first long, keys binary, counts binary, places binary"
BLOCKS = "generation int, lexeme string, shard int, first long, last long, n int, impact int, keys binary, counts binary, places binary"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of 0 or more in 1, 2, 4 or 8 bytes each, as the largest needs; the first byte says which."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def part_of(lexeme, parts: int = PARTS):
    return F.pmod(F.xxhash64(lexeme), F.lit(parts)).cast("int")


def _postings(stemmed: bool, stop: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document and lexeme, made where the document is; a word is looked at once for all documents that are in memory."""
    for batch in (whole.slice(a, TOGETHER) for whole in batches for a in range(0, len(whole), TOGETHER)):
        texts = [re.findall("[a-z0-9]+", (text or "").lower()) for text in batch.column("text").to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        coded = pa.array([word for text in texts for word in text], pa.string()).dictionary_encode()
        lexemes, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        docs, places = np.repeat(np.arange(len(texts)), sizes), np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        words = lexemes.to_pylist()
        if stop:
            kept = np.fromiter((w not in rt.STOP for w in words), bool, len(words))[codes]
            codes, docs, places = codes[kept], docs[kept], places[kept]
        if stemmed:
            stems = pa.array([rt.stem(w) for w in words], pa.string()).dictionary_encode()
            lexemes, codes = stems.dictionary, stems.indices.to_numpy().astype(np.int64)[codes]
        both = codes * len(texts) + docs
        order = np.argsort(both, kind="stable")
        starts = np.flatnonzero(np.diff(both[order], prepend=-1))
        own = docs[order[starts]]
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(places[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(codes[order[starts]], pa.int32()), lexemes), batch.column("shard").take(pa.array(own)), batch.column("key").take(pa.array(own)), lists], names=["lexeme", "shard", "key", "places"])


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers as one binary value for each stretch of them."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of such values, one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings as one row for each lexeme and shard of about GATHERED words, in order of their keys, as packed numbers."""

    def made() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).unify_dictionaries()
        coded = table["lexeme"].chunks
        codes, shards, keys = np.concatenate([c.indices.to_numpy() for c in coded]), table["shard"].to_numpy(), table["key"].to_numpy()
        order = np.lexsort((keys, shards, codes))
        codes, shards, keys, lists = codes[order], shards[order], keys[order], pa.concat_arrays(table["places"].chunks).take(pa.array(order))
        counts = pc.list_value_length(lists).to_numpy()
        starts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(shards, prepend=-1) != 0))
        ends = np.append(starts[1:], len(order))
        return pa.RecordBatch.from_arrays([coded[0].dictionary.take(pa.array(codes[starts])), pa.array(shards[starts], pa.int32()), pa.array(keys[starts], pa.int64()), _cut(keys, ends), _cut(counts, ends), _cut(lists.flatten().to_numpy(), np.cumsum(counts)[ends - 1])], names=["lexeme", "shard", "first", "keys", "counts", "places"])

    held, size = [], 0
    for batch in batches:
        if len(batch):
            lexemes = batch.column("lexeme")
            lexemes = lexemes if pa.types.is_dictionary(lexemes.type) else lexemes.cast(pa.string()).dictionary_encode()
            held.append(pa.RecordBatch.from_arrays([lexemes, *(batch.column(c) for c in ("shard", "key", "places"))], names=["lexeme", "shard", "key", "places"]))
            size += len(batch.column("places").flatten())
        if size >= GATHERED:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of such rows again, one row each, about GATHERED words at a time."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("places")).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (4 * GATHERED))) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            if low < high:
                own = batch.slice(low, high - low)
                keys, counts, places = (_numbers(own.column(c).cast(pa.binary()), kind) for c, kind in (("keys", np.int64), ("counts", np.int32), ("places", np.int32)))
                rows = pa.array(np.repeat(np.arange(len(own)), pc.binary_length(own.column("keys")).to_numpy() // 8))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(places))
                yield pa.RecordBatch.from_arrays([own.column("lexeme").take(rows), own.column("shard").take(rows), pa.array(keys), lists], names=["lexeme", "shard", "key", "places"])


def _pack_each(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """pack() of each stretch of numbers from one start to the next, all at once."""
    sizes, most = np.diff(starts, append=len(values)), np.maximum.reduceat(values, starts)
    widths = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    offsets = np.concatenate([[0], np.cumsum(1 + widths * sizes)])
    out = np.empty(offsets[-1], np.uint8)
    out[offsets[:-1]] = widths
    width = np.repeat(widths, sizes)
    at = np.repeat(offsets[:-1] + 1, sizes) + width * (np.arange(len(values)) - np.repeat(starts, sizes))
    for w in (1, 2, 4, 8):
        own = np.flatnonzero(width == w)
        for byte in range(w):
            out[at[own] + byte] = values[own] >> 8 * byte & 255
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _blocks(generation: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows in order of lexeme and shard; the last, unfinished group of a batch waits for the next. A group's rows are put in order of their keys, of a long one LONG at a time."""
    held = None

    def made(lexemes: pa.Array, shards: np.ndarray, keys: np.ndarray, lists: pa.ListArray, first: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(first)
        if ((np.diff(keys) < 0) & ~first[1:]).any():
            order = np.lexsort((keys, group))
            keys, lists = keys[order], lists.take(pa.array(order))
        counts, places = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64)
        starts = np.flatnonzero((np.arange(len(keys)) - np.flatnonzero(first)[group - 1]) % BLOCK == 0)
        begins, sizes = np.cumsum(counts) - counts, np.diff(starts, append=len(keys))
        steps, gaps = np.diff(places, prepend=0), np.diff(keys, prepend=0)
        steps[begins], gaps[starts] = places[begins], 0
        columns = {
            "generation": pa.array(np.full(len(starts), generation), pa.int32()), "lexeme": lexemes.take(pa.array(starts)), "shard": pa.array(shards[starts], pa.int32()), "first": pa.array(keys[starts], pa.int64()), "last": pa.array(keys[starts + sizes - 1], pa.int64()),
            "n": pa.array(sizes, pa.int32()), "impact": pa.array(np.maximum.reduceat(counts, starts), pa.int32()), "keys": _pack_each(gaps, starts), "counts": _pack_each(counts, starts), "places": _pack_each(steps, begins[starts]),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    for batch in batches:
        part = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not len(part):
            continue
        part = part.combine_chunks()
        lexemes, shards = part["lexeme"].chunk(0), part["shard"].to_numpy()
        first = (np.diff(lexemes.dictionary_encode().indices.to_numpy(), prepend=-1) != 0) | (np.diff(shards, prepend=-1) != 0)
        last = int(np.flatnonzero(first)[-1])
        cut = last or (len(part) // BLOCK * BLOCK if len(part) >= LONG or len(part["places"].chunk(0).flatten()) >= 2 * GATHERED else 0)  # of one long group all full blocks go
        held = part.slice(cut)
        if cut:
            yield made(lexemes[:cut], shards[:cut], part["key"].to_numpy()[:cut], part["places"].chunk(0)[:cut], first[:cut])
    if held is not None and len(held):
        yield made(held["lexeme"].combine_chunks(), held["shard"].to_numpy(), held["key"].to_numpy(), held["places"].combine_chunks(), np.arange(len(held)) == 0)


class Block:
    """A block's bounds, and its rows once they are asked for."""

    __slots__ = ("first", "last", "impact", "generation", "packed", "keys", "counts", "lists")
    read = 0  # blocks unpacked in this process: tests look at it

    def __init__(self, first: int, last: int, impact: int, generation: int, packed: tuple[bytes, bytes, bytes]):
        self.first, self.last, self.impact, self.generation, self.packed = first, last, impact, generation, packed
        self.keys = self.counts = self.lists = None

    def open(self, gone: dict[int, int]) -> Block:
        """Unpacked, less what a later generation has replaced."""
        if self.keys is None:
            Block.read += 1
            keys, counts, places = map(unpack, self.packed)
            keys = np.cumsum(keys) + self.first
            lists = [np.cumsum(x) for x in np.split(places, np.cumsum(counts)[:-1])]
            live = np.fromiter((gone.get(k, -1) <= self.generation for k in keys.tolist()), bool, len(keys))
            self.keys, self.counts, self.lists = keys[live], counts[live], [x for x, ok in zip(lists, live, strict=True) if ok]
        return self


class Shard:
    """The blocks of some lexemes in one shard, and the search over them."""

    def __init__(self, blocks: dict[str, list[Block]], gone: dict[int, int]):
        self.blocks, self.gone = blocks, gone

    def at(self, lexeme: str, keys: np.ndarray) -> dict[int, np.ndarray]:
        """Where each of the keys that hold a lexeme has it."""
        out = {}
        for b in self.blocks.get(lexeme, ()):
            low, high = np.searchsorted(keys, [b.first, b.last + 1])
            if low < high:
                b.open(self.gone)
                for k, place in zip(*(x.tolist() for x in np.intersect1d(b.keys, keys[low:high], assume_unique=True, return_indices=True)[:2]), strict=True):
                    out[k] = b.lists[place]
        return out

    def matching(self, wanted: list[list[str]], refused: list[list[str]], keys: np.ndarray) -> dict[int, list[np.ndarray]]:
        """Of the keys those that hold every wanted phrase and no refused one, with the places of the wanted words in order of the words."""
        lexemes = sorted({w for p in wanted for w in p})
        held = {}
        for w in sorted(lexemes, key=lambda w: sum(b.last - b.first for b in self.blocks.get(w, ()))):
            held[w] = self.at(w, keys)
            keys = np.array(sorted(held[w]), dtype=np.int64)
            if not len(keys):
                return {}
        found = keys.tolist()
        for phrase in wanted:
            if len(phrase) > 1:
                found = [k for k in found if _together([held[w][k] for w in phrase])]
        for phrase in refused:
            if found:
                there = [self.at(w, np.array(found, dtype=np.int64)) for w in phrase]
                found = [k for k in found if not (all(k in x for x in there) and _together([x[k] for x in there]))]
        return {k: [held[w][k] for w in lexemes] for k in found}

    def search(self, alternatives: list, limit: int | None) -> list[tuple[int, float]]:
        """(key, rank): the best by rank, then key; all of them without a limit."""
        best: list[tuple[float, int]] = []
        for place, (wanted, refused) in enumerate(alternatives):
            lexemes = sorted({w for p in wanted for w in p})
            if any(not self.blocks.get(w) for w in lexemes):
                continue
            rarest = min(lexemes, key=lambda w: len(self.blocks[w]))
            others = [self.blocks[w] for w in lexemes if w != rarest]
            bounds = []
            for b in self.blocks[rarest]:
                tops = [b.impact, *(max((o.impact for o in own if o.first <= b.last and o.last >= b.first), default=0) for own in others)]
                bounds.append(rt.OCCURRENCE * min(tops))
            for i in sorted(range(len(bounds)), key=lambda i: -bounds[i]):
                if not bounds[i] or limit is not None and len(best) >= limit and bounds[i] * (1 + 1e-9) < -best[limit - 1][0]:
                    break  # no block that follows can reach the worst row held
                keys = np.unique(self.blocks[rarest][i].open(self.gone).keys)
                for earlier in alternatives[:place]:  # a document ranks by the first alternative that it matches
                    keys = np.setdiff1d(keys, np.array(list(self.matching(*earlier, keys)), dtype=np.int64))
                best.extend((-rt.cover_rank(places), k) for k, places in self.matching(wanted, refused, keys).items())
                if limit is not None:
                    best = sorted(best)[:limit]
        return [(k, -rank) for rank, k in sorted(best)]


def _together(lists: list[np.ndarray]) -> bool:
    """Whether the words of a phrase stand one after another somewhere."""
    starts = lists[0]
    for i, own in enumerate(lists[1:], 1):
        starts = np.intersect1d(starts, own - i)
    return len(starts) > 0


def _merged(blocks: list[Block], gone: dict[int, int]) -> list[Block]:
    """The blocks of several lexemes as blocks of one: what a document has of any of them is in one place."""
    opened = [b.open(gone) for b in blocks]
    lists = [x for b in opened for x in b.lists]
    keys = np.concatenate([b.keys for b in opened])
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1 - abs(keys.min(initial=0))))
    own = [lists[o[0]] if len(o) == 1 else np.sort(np.concatenate([lists[i] for i in o])) for o in np.split(order, starts[1:])] if len(starts) else []
    keys, counts, out = keys[order[starts]], np.fromiter(map(len, own), np.int64, len(own)), []
    for a in range(0, len(own), BLOCK):
        b = min(a + BLOCK, len(own))
        out.append(Block(int(keys[a]), int(keys[b - 1]), int(counts[a:b].max()), 0, None))
        out[-1].keys, out[-1].counts, out[-1].lists = keys[a:b], counts[a:b], own[a:b]
    return out


def _search(alternatives: list, limit: int | None, forms: dict[str, str], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of shard, each shard's replaced keys (no lexeme) before its blocks. Lexemes that are forms of a word are found as that word."""
    now, gone, blocks = None, {}, {}

    def done() -> Iterator[pd.DataFrame]:
        if blocks:
            words: dict[str, list[list[Block]]] = {}
            for lexeme, own in blocks.items():
                words.setdefault(forms.get(lexeme, lexeme), []).append(own)
            held = {word: own[0] if len(own) == 1 else _merged([b for x in own for b in x], gone) for word, own in words.items()}
            yield pd.DataFrame(Shard(held, gone).search(alternatives, limit), columns=["key", "rank"])

    for part in parts:
        for row in part.itertuples(index=False):
            if row.shard != now:
                yield from done()
                now, gone, blocks = row.shard, {}, {}
            if row.lexeme is None or row.lexeme != row.lexeme:
                gone[row.first] = max(gone.get(row.first, -1), row.generation)
            else:
                blocks.setdefault(row.lexeme, []).append(Block(row.first, row.last, row.impact, row.generation, (row.keys, row.counts, row.places)))
    yield from done()


class TextIndex:
    """An index in a folder that the driver and all executors see. How words are read and how many shards there are is settled when it is made."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = True, stop: bool = True, shards: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([(stemmed, stop, shards)], "stemmed boolean, stop boolean, shards int").coalesce(1).write.mode("ignore").parquet(f"{self.path}/settings")
        self.stemmed, self.stop, self.shards = spark.read.parquet(f"{self.path}/settings").first()
        for name, schema in (("gone", "key long, generation int"), ("documents", "key long, generation int")):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")
        spark.createDataFrame([], f"{BLOCKS}, part int").write.mode("ignore").partitionBy("part").parquet(f"{self.path}/postings")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _shard(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def add(self, docs: DataFrame, key: str, text: str) -> int:
        """Add a generation; documents whose key is there are replaced. Gives its number."""
        return self._generation(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null"))

    def remove(self, keys: DataFrame, key: str) -> int:
        """A generation in which these documents have no words."""
        return self.add(keys.select(key, F.lit(None).cast("string").alias("_none")), key, "_none")

    def _generation(self, docs: DataFrame) -> int:
        known = self._read("documents", "key long, generation int")
        number = (known.agg(F.max("generation")).first()[0] or 0) + 1
        one = docs if self._unique(docs) else docs.groupBy("key").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
        if number > 1:
            known.select("key").distinct().join(one.select("key"), "key", "left_semi").select("key", F.lit(number).alias("generation")).write.mode("append").parquet(f"{self.path}/gone")
        stemmed, stop = self.stemmed, self.stop
        self._write(one.withColumn("shard", self._shard("key")).select("key", "shard", "text").mapInArrow(lambda batches: _gathered(_postings(stemmed, stop, batches)), RUN), number, self.path)
        one.select("key", F.lit(number).alias("generation")).write.mode("append").parquet(f"{self.path}/documents")
        return number

    @staticmethod
    def _write(runs: DataFrame, number: int, path: str) -> None:
        dealt = runs.withColumn("part", part_of("lexeme")).repartition("part", "shard").drop("part").sortWithinPartitions("lexeme", "shard", "first")
        dealt.mapInArrow(lambda batches: _blocks(number, _spread(batches)), BLOCKS).withColumn("part", part_of("lexeme")).write.mode("append").partitionBy("part").parquet(f"{path}/postings")

    @staticmethod
    def _unique(docs: DataFrame) -> bool:
        return docs.groupBy("key").count().where("count > 1").isEmpty()

    def postings(self, lexemes: list[str] | None = None) -> DataFrame:
        """Blocks, of some lexemes: only their partitions are read."""
        blocks = self._read("postings", f"{BLOCKS}, part int")
        if lexemes is None:
            return blocks
        return blocks.where(F.col("part").isin(*[part_of(F.lit(w)) for w in lexemes]) & F.col("lexeme").isin(lexemes)) if lexemes else blocks.limit(0)

    def lexicon(self) -> DataFrame:
        """lexeme, documents: in how many postings each is, those of replaced documents included until compact()."""
        return self._read("postings", f"{BLOCKS}, part int").groupBy("lexeme").agg(F.sum("n").alias("documents"))

    def frequent(self, most: int) -> list[str]:
        """The lexemes that most documents hold, most frequent first, id breaking ties: `most` words come to the driver."""
        return [r["lexeme"] for r in self.lexicon().orderBy(F.col("documents").desc(), "lexeme").limit(most).collect()]

    def forms(self, stems: list[str]) -> dict[str, str]:
        """The lexemes of an index of unstemmed words that have one of the stems, with it; every lexeme is stemmed once, and those found come to the driver."""
        lexemes = self.lexicon().select("lexeme", F.element_at(rt._stems(F.array("lexeme")), 1).alias("stem"))
        return dict(lexemes.where(F.col("stem").isin(stems)).collect()) if stems else {}

    def search(self, query: str, limit: int | None = 10, stemmed: bool = False) -> DataFrame:
        """key, rank of the documents that match a web-style query, by rank, then key; all of them, in no order, without a limit. If stemmed, words match by their stems in an index of unstemmed words too."""
        alternatives = rt.parse_query(query, stemmed or self.stemmed)
        words = sorted({w for wanted, refused in alternatives for phrase in wanted + refused for w in phrase})
        forms = self.forms(words) if stemmed and not self.stemmed else {w: w for w in words}
        blocks = self.postings(sorted(forms)).select("shard", "lexeme", "generation", "first", "last", "impact", "keys", "counts", "places")
        gone = self._read("gone", "key long, generation int").select(self._shard("key").alias("shard"), F.lit(None).cast("string").alias("lexeme"), "generation", F.col("key").alias("first"), F.col("key").alias("last"), F.lit(0).alias("impact"), *[F.lit(None).cast("binary").alias(c) for c in ("keys", "counts", "places")])
        rows = blocks.union(gone).repartition("shard").sortWithinPartitions("shard", F.col("lexeme").asc_nulls_first(), "first")
        found = rows.mapInPandas(partial(_search, alternatives, limit, forms), "key long, rank double")
        return found if limit is None else found.orderBy(F.col("rank").desc(), "key").limit(limit)

    def compact(self, path: str) -> TextIndex:
        """A new index in a folder of its own, of one generation, with what counts of this one."""
        out = TextIndex(self.spark, path, self.stemmed, self.stop, self.shards)
        gone = self._read("gone", "key long, generation int").groupBy("key").agg(F.max("generation").alias("_until"))
        live = self.postings().mapInPandas(_unblocked, "lexeme string, shard int, key long, places array<int>, generation int").join(gone, "key", "left").where("_until is null or _until <= generation")
        self._write(live.select("lexeme", "shard", "key", "places").mapInArrow(_gathered, RUN), 1, out.path)
        self._read("documents", "key long, generation int").select("key", F.lit(1).alias("generation")).distinct().write.mode("append").parquet(f"{out.path}/documents")
        return out


def _unblocked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for row in part.itertuples(index=False):
            b = Block(row.first, row.last, row.impact, row.generation, (row.keys, row.counts, row.places)).open({})
            out.extend((row.lexeme, row.shard, k, x.tolist(), row.generation) for k, x in zip(b.keys.tolist(), b.lists, strict=True))
        yield pd.DataFrame(out, columns=["lexeme", "shard", "key", "places", "generation"])
