"""Best-fit packing of token sequences with a swap-based local search.

Documents become token ids with an end token each; one longer than a sequence
is cut, nothing else is. The pieces' measures (not their ids) are dealt evenly
to groups of about GROUP pieces, which bounds every task's memory, and each
group is packed alone: best fit in falling order of length, then a local
search over all bins that are not full, until no step is left. It exchanges one
piece for one, two for one, or moves a piece or two, whenever the sum of
squared fills grows; emptied bins are dropped. A group can leave one poorly filled bin, so at GROUP pieces
the loss against one global packing stays below one bin in several thousand.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._common import stored, table

CAPACITY = 4096
#: The id that ends a document.
END = 1
#: Pieces packed together.
GROUP = 1 << 15
#: Parts whose ids a worker remembers in each of two halves; beyond, the older half goes.
REMEMBERED = 800_000
#: With these in it a text is encoded whole: separators on which the libraries differ, and what added tokens begin with.
_UNCLEAR = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Texts for which lower case and the tokenizer's parts are beyond doubt: printable ASCII, blanks and Latin-1 letters.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
#: Stands for the end of a word; no UTF-8 text holds it.
_WORD_END = b"\xff"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest for 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def word_merger(path: str):
    """The vocabulary's merges as ranks of byte strings, word ends written as one byte.

    Every token of the vocabulary is what its own merges make of it (the tests
    check that), so ranks of strings and ranks of pairs give the same ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters, ranks = byte_letters(), {}
    for token, number in vocabulary.items():
        if token.startswith("<|"):
            continue
        stem = token.removesuffix("</w>")
        ranks[bytes(letters[c] for c in stem) + (_WORD_END if stem != token else b"")] = number
    return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Remembered(dict):
    """Ids of the parts of words, worked out when first asked for; parts still in use come over from the older half."""

    def __init__(self, work):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.work(part)
        self[part] = ids
        return ids

    def shrink(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Token ids as little-endian unsigned 32-bit words.

    The tokenizer drops white space and merges only within parts of words, so
    a text's ids are those of its parts in turn; parts come back often and are
    remembered. Texts of printable ASCII and Latin-1 letters, for which lower
    case and the parts are beyond doubt, are cut here and merged by the faster
    library; others go word by word through the tokenizer itself, and whole
    where they hold separators on which the two libraries differ or what may
    be an added token (all of them begin with "<|").
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        merge = word_merger(path)
        self.parts = Remembered(lambda part: array("I", merge(part.encode() + _WORD_END)).tobytes())
        self.words = Remembered(self.whole)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _UNCLEAR):
            return self.whole(text)
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.split()))

    def shrink(self) -> None:
        self.parts.shrink()
        self.words.shrink()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; a null or empty text is its end token alone."""
    end = np.array([END], dtype="<u4").tobytes()

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(vocabulary)
        for part in parts:
            rows = []
            for doc, text in zip(part["doc_id"], part["text"], strict=True):
                ids = memoryview(known.encode(text or "") + end)
                known.shrink()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room they have
    rooms = 0  # bit r: some bin has room r
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class _Under:
    """The bins that aren't full, by what they could give: for each size the bins with such a piece, or such a pair of pieces."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.one: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.two: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.ones = self.twos = 0  # bit s: some bin has a piece, or a pair, of size s
        self.bits = [(0, 0)] * len(bins)
        for k in range(len(bins)):
            self.enter(k)

    def enter(self, k: int) -> None:
        """Put a bin into the index, with the bits of its pieces and of its pairs' sums."""
        if self.fill[k] == self.capacity or not self.bins[k]:
            self.bits[k] = (0, 0)
            return
        ones = pairs = 0
        for i in self.bins[k]:
            pairs |= ones << self.sizes[i]
            ones |= 1 << self.sizes[i]
        self.bits[k] = (ones, pairs)
        for bits, where in ((ones, self.one), (pairs, self.two)):
            for size in _sizes(bits):
                where[size].add(k)
        self.ones |= ones
        self.twos |= pairs

    def leave(self, k: int) -> None:
        for bits, where in zip(self.bits[k], (self.one, self.two), strict=True):
            for size in _sizes(bits):
                where[size].discard(k)
                if not where[size]:
                    if where is self.one:
                        self.ones &= ~(1 << size)
                    else:
                        self.twos &= ~(1 << size)

    def pieces(self, k: int, size: int, pair: bool) -> list[int]:
        """A piece of a bin, or two, of a size."""
        if not pair:
            return [next(i for i in self.bins[k] if self.sizes[i] == size)]
        seen: dict[int, int] = {}
        for i in self.bins[k]:
            if (j := seen.get(size - self.sizes[i])) is not None:
                return [j, i]
            seen[self.sizes[i]] = i
        raise AssertionError("no such pair")

    def best(self, k: int) -> tuple[int, int, int, bool, int, bool] | None:
        """The step that fills bin k most: gain, giver, size given and whether by a pair, size taken and whether by a pair.

        A move, two of them, an exchange of one for one, of two for one or of
        one for two. It must make the sum of squared fills larger: what is
        gained exceeds what the giver holds more than bin k.
        """
        room, found = self.capacity - self.fill[k], None
        most = 0
        ones, pairs = self.bits[k]
        for back, from_pair in ((0, False), *((s, False) for s in _sizes(ones)), *((s, True) for s in _sizes(pairs))):
            for bits, where, pair in ((self.ones, self.one, False), (self.twos, self.two, True)):
                if pair and from_pair:
                    continue
                high = min(self.capacity, back + room)
                window = (bits >> (back + most + 1)) & ((1 << max(0, high - back - most)) - 1)
                while window:
                    gain = window.bit_length() + most
                    giver = min((g for g in where[back + gain] if g != k and gain > self.fill[g] - self.fill[k]), key=lambda g: (self.fill[g], g), default=None)
                    if giver is not None:
                        found, most = (gain, giver, back + gain, pair, back, from_pair), gain
                        break
                    window &= (1 << (window.bit_length() - 1)) - 1
                if most == room:
                    return found
        return found

    def step(self, k: int) -> bool:
        found = self.best(k)
        if not found:
            return False
        gain, g, size, pair, back, from_pair = found
        gives, takes = self.pieces(g, size, pair), self.pieces(k, back, from_pair) if back else []
        self.leave(k)
        self.leave(g)
        self.bins[g] = [i for i in self.bins[g] if i not in gives] + takes
        self.bins[k] = [i for i in self.bins[k] if i not in takes] + gives
        self.fill[g] -= gain
        self.fill[k] += gain
        self.enter(k)
        self.enter(g)
        return True


def _sizes(bits: int) -> list[int]:
    """The places of the bits that are set."""
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over all underfull bins, until no step is left or no packing can have fewer bins.

    Each accepted step makes the sum of squared fills larger, so it ends. Every
    bin is held against all others at once, by the sizes that they can give.
    """
    least = -(-int(lengths.sum()) // capacity)
    under = _Under([list(b) for b in bins], lengths.tolist(), capacity)
    moved = True
    while moved and sum(map(bool, under.bins)) > least:
        moved = False
        for k in sorted(range(len(bins)), key=lambda k: (-under.fill[k], k)):  # the fullest first
            while under.bins[k] and under.fill[k] < capacity and under.step(k):
                moved = True
    return [b for b in under.bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    bins = best_fit(lengths, capacity)
    if len(bins) > -(-int(lengths.sum()) // capacity):  # else no packing has fewer
        bins = improve(bins, lengths, capacity)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            where[i], offset[i] = k, at
            at += int(lengths[i])
    return where, offset


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of docs (doc_id long, text string): its place in a sequence of at most `capacity` tokens.

    Repeated rows are packed as often as they come. Other columns are neither
    read nor returned. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, vocabulary or default_vocabulary(), capacity), "pieces")
    groups = max(1, -(-made.count() // GROUP))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = [p for p in parts if len(p)]  # about GROUP rows of six numbers
        if not rows:
            return
        part = pd.concat(rows).sort_values(["doc_id", "piece", "length", "ids_crc32"], ignore_index=True)
        where, offset = pack(part["length"].to_numpy(), capacity)
        part["sequence_id"] = where + (TaskContext.get().partitionId() << 32)
        part["offset"] = offset
        yield part

    # dealt round robin: even groups whatever the keys; Spark sorts before dealing, so a rerun deals alike
    return made.repartition(groups).mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packing of all rows that came so far, null texts as empty ones and repeated rows each by itself; an empty table gives an empty result."""
    return packed(docs)
