"""Vector and full-text search, and their fusion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.conf import RRF_K, InvalidInput
from folioscope.functions import vectors as vx
from folioscope.functions.text import tokens
from folioscope.operators.relational import fuse_rankings

# Words that an index skips.
STOP = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split())
#: Queries that a task holds at a time, of dimensions times 8 bytes each.
PACKED = 1024
#: Scopes whose maxima a task gathers.
SCOPES = 4096
#: What one occurrence of a term weighs in a rank.
OCCURRENCE = 0.1


def check_request(query: str, limit: int = 10, threshold: float = 0.0) -> None:
    if not 1 <= len(query) <= 2000 or not 1 <= limit <= 50 or not 0 <= threshold <= 1:
        raise InvalidInput("query of 1 to 2000 characters, limit 1 to 50, threshold 0 to 1")


def vector_search(items: DataFrame, key: str, vector: str, query: Column, limit: int = 10, threshold: float = 0.0) -> DataFrame:
    """The nearest items by cosine, id breaking ties: a top-k in each task, then one of those. A zero vector is never found."""
    found = items.where(F.col(vector).isNotNull()).select(key, vx.cosine(F.col(vector), query).alias("similarity")).where("similarity is not null")
    if threshold > 0:
        found = found.where(1 - F.col("similarity") <= 1 - threshold)
    return found.orderBy(F.col("similarity").desc(), key).limit(limit)


def tracked(prompts: DataFrame, project: str, prompt: str, most: int = 25) -> DataFrame:
    """The prompts that count: the first of each project, so many at most."""
    place = F.row_number().over(Window.partitionBy(project).orderBy(prompt))
    return prompts.withColumn("_p", place).where(F.col("_p") <= most).drop("_p")


def _query_blocks(queries: DataFrame, query: str, text: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the queries, about PACKED at a time: what a task holds has that size, however many there are."""
    blocks = max(1, -(-queries.count() // PACKED))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b).select(query, text).collect()
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows]


def best_matches(docs: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int, digits: int | None = 6, dimensions: int = 1536, threshold: float | None = None) -> DataFrame:
    """query, key, similarity: the k documents most similar to each query, by similarity to some digits, or as it is (None), then key.

    A document is scored against a packed block of queries where it is; a task
    sends on at most k rows of each query. Documents that share no dimension
    with a query are no match.
    """
    out = None
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(key, docs.schema[key].dataType), T.StructField("similarity", T.DoubleType())])
    for ids, texts in _query_blocks(queries, query, query_text):
        def score(parts: Iterator[pd.DataFrame], ids=ids, texts=texts) -> Iterator[pd.DataFrame]:
            packed = vx.matrix(texts, dimensions)
            best: list[list[tuple[float, object]]] = [[] for _ in ids]
            for part in parts:
                keys = part[key].tolist()
                for at, found in vx.similarities(part[text], packed, digits is None):
                    rounded = found if digits is None else np.round(found, digits)
                    if threshold is not None:
                        rounded[found < threshold] = np.nan
                    for j, own in enumerate(best):
                        least = own[-1][0] if len(own) == k else np.inf
                        hits = np.flatnonzero(-rounded[:, j] <= least)
                        if len(hits):
                            best[j] = sorted([*own, *((-rounded[i, j], keys[at + i]) for i in hits if keys[at + i] is not None)])[:k]
            rows = [(ids[j], at, -x) for j, own in enumerate(best) for x, at in own]
            yield pd.DataFrame(rows, columns=[query, key, "similarity"])

        made = docs.select(key, text).mapInPandas(score, schema)
        out = made if out is None else out.union(made)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("similarity").desc(), key))
    return out.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def alignment(docs: DataFrame, scope: str, text: str, prompts: DataFrame, prompt: str, prompt_text: str, dimensions: int = 1536) -> DataFrame:
    """For each scope the mean over prompts of the best clamped similarity of its documents.

    A document is scored against a packed block of prompts where it is; a task
    sends on one maximum for each scope and prompt, at most every SCOPES scopes.
    """
    schema = T.StructType([docs.schema[scope], T.StructField("prompt", T.IntegerType()), T.StructField("best", T.DoubleType())])
    out = None
    for block, (_, texts) in enumerate(_query_blocks(prompts, prompt, prompt_text)):
        def score(parts: Iterator[pd.DataFrame], texts=texts, first=block * 2 * PACKED) -> Iterator[pd.DataFrame]:
            packed, best = vx.matrix(texts, dimensions), {}

            def rows() -> pd.DataFrame:
                made = [(s, first + j, x) for s, own in best.items() for j, x in enumerate(own.tolist()) if x == x]
                best.clear()
                return pd.DataFrame(made, columns=[scope, "prompt", "best"])

            for part in parts:
                scopes = part[scope].tolist()
                for at, found in vx.similarities(part[text], packed):
                    for i, own in enumerate(found):
                        old = best.get(scopes[at + i])
                        best[scopes[at + i]] = own if old is None else np.fmax(old, own)
                if len(best) > SCOPES:
                    yield rows()
            yield rows()

        made = docs.select(scope, text).mapInPandas(score, schema)
        out = made if out is None else out.union(made)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    best = out.groupBy(scope, "prompt").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("best"))).alias("_best"))
    return best.groupBy(scope).agg(F.avg("_best").alias("alignment"), F.count(F.lit(1)).alias("prompts"))


# --- stemming --------------------------------------------------------------


# The endings of the published English stemming algorithm (Porter2) and what they become, and its exceptions.
ENDINGS_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful",
    "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
ENDINGS_3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
ENDINGS_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
UNCHANGED_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
LI_AFTER, DOUBLES = "cdeghkmnrt", frozenset("bb dd ff gg mm nn pp rr tt".split())
_REGION, _SHORT = re.compile("[aeiouy][^aeiouy]"), re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts after the first and the second vowel-consonant pair begin."""
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        m = _REGION.search(word)
        first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that a word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The English stem of a lower-case word, by Porter2."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(word)
    word = re.sub("'(?:s'?)?$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in UNCHANGED_PLURAL:
        return word
    end = _ending(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if end in ("eed", "eedly"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    elif end and re.search("[aeiouy]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:] in DOUBLES:
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    end = _ending(word, ENDINGS_2)
    if end and len(word) - len(end) >= r1 and (end != "ogi" or word[:-3].endswith("l")) and (end != "li" or word[-3:-2] in LI_AFTER and len(word) > 2):
        word = word[: -len(end)] + ENDINGS_2[end]
    end = _ending(word, ENDINGS_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + ENDINGS_3[end]
    end = _ending(word, ENDINGS_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    elif word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT.search(word[:-1])):
        return word[:-1].replace("Y", "y")
    elif word.endswith("ll") and len(word) - 1 >= r2:
        return word[:-1].replace("Y", "y")
    if end and word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT.search(word[:-1])):
        word = word[:-1]
    elif end and word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: [stem(x) for x in w])


# --- full text -------------------------------------------------------------


def postings(docs: DataFrame, key: str, text: str, stemmed: bool = True, stop: bool = True) -> DataFrame:
    """Rows key, lexeme, pos. Positions count every word; stop words have no row. A search must be stemmed as its index is."""
    words = F.transform(tokens(F.col(text)), lambda w, i: F.struct((i + 1).alias("pos"), w.alias("lexeme")))
    if stop:
        words = F.filter(words, lambda w: ~w["lexeme"].isin(*sorted(STOP)))
    if not stemmed:
        return docs.select(key, F.explode(words).alias("_w")).select(key, F.col("_w.lexeme").alias("lexeme"), F.col("_w.pos").alias("pos"))
    both = docs.select(key, words.alias("_w")).select(key, F.explode(F.arrays_zip(F.col("_w.pos").alias("pos"), _stems(F.col("_w.lexeme")).alias("lexeme"))).alias("_w"))
    return both.select(key, F.col("_w.lexeme").alias("lexeme"), F.col("_w.pos").alias("pos"))


def frequent_terms(index: DataFrame, key: str, most: int = 100) -> list[str]:
    """The lexemes that most documents hold, most frequent first; `most` of them come to the driver."""
    counts = index.select(key, "lexeme").distinct().groupBy("lexeme").agg(F.count(F.lit(1)).alias("n"))
    return [r["lexeme"] for r in counts.orderBy(F.col("n").desc(), "lexeme").limit(most).collect()]


def parse_query(query: str, stemmed: bool = False) -> list[tuple[list[list[str]], list[list[str]]]]:
    """Alternatives of (wanted phrases, unwanted phrases): words are all wanted, quotes keep words together, `or` parts, - forbids."""
    out: list[tuple[list, list]] = [([], [])]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query.lower()):
        if word == "or" and not minus:
            out.append(([], []))
            continue
        own = [stem(w) if stemmed else w for w in re.findall("[a-z0-9]+", phrase or word.removeprefix("-")) if w not in STOP]
        if own:
            out[-1][bool(minus or word.startswith("-"))].append(own)
    return [x for x in out if x[0]]


@F.pandas_udf(T.DoubleType())
def _cover_rank(places: pd.Series) -> pd.Series:
    return places.map(cover_rank)


def cover_rank(places: list) -> float:
    """Cover density: every shortest span that holds all terms adds 0.1 over 1 plus the other words within.

    places: for each term its positions. One term ranks by its number of occurrences.
    """
    lists = [sorted(p) for p in places]
    if len(lists) == 1:
        return OCCURRENCE * len(lists[0])
    marks = sorted((p, t) for t, own in enumerate(lists) for p in own)
    held, low, total = [0] * len(lists), 0, 0.0
    for high, (end, term) in enumerate(marks):
        held[term] += 1
        if all(held):
            while held[marks[low][1]] > 1:
                held[marks[low][1]] -= 1
                low += 1
            total += OCCURRENCE / (1 + end - marks[low][0] + 1 - len(lists)) if end - marks[low][0] + 1 >= len(lists) else OCCURRENCE
            held[marks[low][1]] -= 1
            low += 1
    return total


def text_search(index: DataFrame, key: str, query: str, limit: int | None = 10, stemmed: bool = True) -> DataFrame:
    """Documents that match a web-style query, by rank, id breaking ties; all of them, in no order, without a limit.

    Only the postings of the query's words are read, grouped by document
    before anything is ranked.
    """
    alternatives = parse_query(query, stemmed)
    if not alternatives:
        return index.select(key, F.lit(0.0).alias("rank")).limit(0)
    every = sorted({w for wanted, refused in alternatives for phrase in wanted + refused for w in phrase})
    held = index.where(F.col("lexeme").isin(every)).groupBy(key, "lexeme").agg(F.sort_array(F.collect_list("pos")).alias("at")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "at"))).alias("m"))

    def has(phrase: list[str]) -> Column:
        first = F.col("m")[phrase[0]]
        if len(phrase) == 1:
            return first.isNotNull()
        starts = F.array_distinct(first)
        for i, word in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, _shifted(word, i))
        return F.coalesce(F.size(starts) > 0, F.lit(False))

    match, places = F.lit(False), F.lit(None).cast("array<array<int>>")
    for wanted, refused in reversed(alternatives):
        own = F.lit(True)
        for phrase in wanted:
            own = own & has(phrase)
        for phrase in refused:
            own = own & ~has(phrase)
        match = match | own
        places = F.when(own, F.array(*[F.col("m")[w] for w in sorted({w for p in wanted for w in p})])).otherwise(places)
    found = held.where(F.coalesce(match, F.lit(False))).select(key, places.alias("places"))
    if max(len({w for p in wanted for w in p}) for wanted, _ in alternatives) == 1:
        ranked = found.select(key, (OCCURRENCE * F.size(F.col("places")[0])).alias("rank"))
    else:
        ranked = found.select(key, _cover_rank("places").alias("rank"))
    return ranked if limit is None else ranked.orderBy(F.col("rank").desc(), key).limit(limit)


def _shifted(word: str, by: int) -> Column:
    return F.transform(F.coalesce(F.col("m")[word], F.array().cast("array<int>")), lambda p: p - by)


def hybrid(vector: DataFrame, text: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Two lists, each cut to limit before, fused by reciprocal rank; total is the number of fused items."""
    both = vector.select(F.lit("vector").alias("list"), key, F.col("similarity").alias("score")).union(text.select(F.lit("text").alias("list"), key, F.col("rank").alias("score")))
    fused = fuse_rankings(both, "list", key, "score", RRF_K)  # 2 * limit rows at most
    total = fused.agg(F.count(F.lit(1)).alias("total"))
    return fused.crossJoin(F.broadcast(total)).select(key, F.round("fused", 6).alias("score"), "lists", "total").orderBy(F.col("score").desc(), key).limit(limit)


def search(items: DataFrame, key: str, content: str, sparse: DataFrame | None, query: str, mode: str = "hybrid", limit: int = 10, threshold: float = 0.0, dimensions: int = 1536, stemmed: bool = True, index=None) -> DataFrame:
    """key, score: semantic, full_text, or both fused.

    Semantic is over sparse vectors (key, dim, weight) where they are given,
    else each text is scored where it is. Full text is over a stored index
    (textindex.TextIndex) where one is given, else the texts are read.
    """
    check_request(query, limit, threshold)
    if mode not in ("semantic", "full_text", "hybrid"):
        raise InvalidInput("mode is semantic, full_text or hybrid")
    asked = items.sparkSession.createDataFrame([(0, query)], "q int, _text string")
    if mode == "full_text":
        vector = None
    elif sparse is None:
        vector = best_matches(items, key, content, asked, "q", "_text", limit, None, dimensions, threshold if threshold > 0 else None).select(key, "similarity")
    else:
        found = vx.sparse_similarity(sparse, key, vx.embed_sparse(asked, "q", "_text", dimensions), "q")
        vector = found.where(F.lit(threshold <= 0) | (F.col("similarity") >= threshold)).orderBy(F.col("similarity").desc(), key).limit(limit).select(key, "similarity")
    if mode == "semantic":
        return vector.select(key, F.round("similarity", 6).alias("score"))
    text = text_search(postings(items, key, content, stemmed), key, query, limit, stemmed) if index is None else index.search(query, limit).select(F.col("key").alias(key), "rank")
    if mode == "full_text":
        return text.select(key, F.round("rank", 6).alias("score"))
    return hybrid(vector, text, key, limit)


def positions(df: DataFrame, ranking: str, score: str, tie: str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(ranking).orderBy(F.col(score).desc(), F.col(tie))))
