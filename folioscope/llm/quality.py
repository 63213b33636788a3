"""Quality classifier: Bradley-Terry pairwise ranking.

Labelled rows give preference pairs (a row of label 1 over a row of label 0).
The weights maximise the Bradley-Terry likelihood: logistic loss on the
difference of the two rows' features, with an L2 term. A document's strength
is the weighted sum of its own features, so scoring needs one pass over the
texts and no shuffle. The accepting threshold is a quantile of the training
strengths, the one with the best balanced accuracy; strengths are then mapped
by one increasing function to scores in which that quantile lies at CUT.

Bounds: at most SAMPLE labelled rows are fitted, those with the smallest hash
of doc_id, and PAIRS pairs. Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._common import hash_sample, table

#: At most so many labelled rows are fitted.
SAMPLE = 12_000
#: So many preference pairs are drawn from them.
PAIRS = 60_000
#: The score from which a document is accepted.
CUT = 0.3
FOLDS = 5
#: Weight of the L2 term.
L2 = 1e-3

NAMES = ("log_words", "mean_word", "letters", "upper", "digits", "symbols", "tail_symbols", "bare_symbols", "top_symbol", "repeats", "distinct", "top_word", "stops", "caps_words", "long_words", "worst_line", "lines", "worst_window", "window_symbols", "capital_starts", "bad_share")
#: A word's end of two or more signs other than those that prose ends with.
_TAIL = re.compile(rb"[^\x00-\x200-9A-Za-z.,;:'\"()\x80-\xff-]{2,}(?=[\x20\x09-\x0D]|$)")
#: Signs that prose has as words of their own.
_PROSE = frozenset("-.,;:'\"()/&+=\u2013\u2014\u2026")
_SYMBOL = bytes(i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'-()\"")
_SIGNS = np.frombuffer(_SYMBOL, np.uint8)
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: Words looked at together when parts of a text are judged.
WINDOW = 24


def _count(raw: bytes, kept: bytes) -> int:
    return len(raw) - len(raw.translate(None, kept))


def _letters(text: str, raw: bytes) -> int:
    """Letters of any script; of ASCII alone they are counted as bytes, which is faster."""
    return _count(raw, _UPPER + _LOWER) if text.isascii() else sum(map(str.isalpha, text))


def features(text: str | None) -> list[float]:
    """What the score is made of: ratios over the whole text and over its worst part. Null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(NAMES)
    lengths = np.fromiter(map(len, words), np.int32, n)
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat = np.zeros(n, bool)
    repeat[1:] = codes[1:] == codes[:-1]
    shouting = np.fromiter((w.isupper() and len(w) > 2 for w in words), bool, n)
    bare = np.fromiter((not w[0].isalnum() and not any(map(str.isalnum, w)) and not _PROSE.issuperset(w) for w in words), bool, n)
    odd = bare | np.fromiter((w[-1] == w[-2:-1] and not w[-1].isalnum() and w[-1] not in _PROSE for w in words), bool, n)
    signs = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)[_SIGNS]
    bad = repeat | shouting | odd
    full = max(1, n // WINDOW)
    edges = np.arange(full) * WINDOW
    spans = np.maximum(np.diff(np.append(edges, n)), WINDOW // 2)  # so that two odd words don't damn a very short text
    share = np.add.reduceat(bad, edges, dtype=np.int64) / spans
    symbols = np.add.reduceat(odd, edges, dtype=np.int64) / spans
    uses = np.bincount(codes)
    starts = sum(w[0].isupper() for w in words)
    lines = text.count("\n") + 1
    return [
        np.log1p(n), lengths.mean() / 10, _letters(text, raw) / len(text), _count(raw, _UPPER) / size, _count(raw, _DIGIT) / size,
        _count(raw, _SYMBOL) / size, len(_TAIL.findall(raw)) / n, bare.sum() / n, signs.max() / n, repeat.sum() / (n + 6), (len(ids) + 6) / (n + 6), uses.max() / (n + 12),
        float((lengths <= 3).mean()), shouting.mean(), float((lengths >= 20).mean()), float(share.max()), min(1.0, lines / n), float(np.quantile(share, 0.75)), float(symbols.max()), starts / n, bad.sum() / (n + 6),
    ]


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(NAMES))


class Model:
    """Weights over standardised features and the increasing map from strength to score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(CUT / (1 - CUT)) + self.slope * (self.strength(x) - self.cut)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Bradley-Terry weights by Newton steps on pairs. Without rows of both labels all strengths are 0 and all scores 0.5."""
    width = x.shape[1] if x.ndim == 2 else len(NAMES)
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.log(CUT / (1 - CUT)), 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    draw = np.random.default_rng(seed)
    diff = np.clip((good[draw.integers(0, len(good), PAIRS)] - mean) / scale, -8, 8) - np.clip((bad[draw.integers(0, len(bad), PAIRS)] - mean) / scale, -8, 8)
    w = np.zeros(width)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))  # that the preferred one wins
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + L2 * np.eye(width), diff.T @ (1 - p) / len(diff) - L2 * w)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    model = Model(mean, scale, w, 0.0, 1.0)
    s = model.strength(x)
    model.cut = threshold_quantile(s, y)[1]
    spread = np.subtract(*np.quantile(np.abs(s - model.cut), [0.9, 0.0]))
    model.slope = 4 / max(float(spread), 1e-6)
    return model


def threshold_quantile(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The quantile of the strengths, and its value, that best parts the labels (balanced accuracy; of equals the widest gap)."""
    order = np.sort(s)
    if len(order) < 2:
        return 0.5, float(order[0]) if len(order) else 0.0
    cuts = (order[1:] + order[:-1]) / 2
    good, bad = np.sort(s[y == 1]), np.sort(s[y == 0])
    worth = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(worth >= worth.max() - 1e-12)
    k = best[np.argmax(order[best + 1] - order[best])]
    return float((k + 1) / len(order)), float(cuts[k])


def held_out(doc_id) -> F.Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sampled_labels(labels: DataFrame) -> DataFrame:
    """doc_id and _quality of at most SAMPLE labelled rows outside the held-out fold."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    return hash_sample(rows, SAMPLE, "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    Rows with a null doc_id or quality teach nothing; of repeated labels the
    lowest quality counts; a label of another value than 0 and 1 is ignored.
    """
    rows = sampled_labels(labels)  # SAMPLE rows of two numbers at most: fit to broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = pd.DataFrame(_matrix(part["text"]), columns=list(NAMES))
            yield pd.concat([part[["doc_id", "_quality"]].reset_index(drop=True), out], axis=1)

    # bounded as well: features of the sampled ids, repeated rows reduced to one each
    got = found.mapInPandas(measure, "doc_id long, _quality int, " + ", ".join(f"{n} double" for n in NAMES)).groupBy("doc_id").agg(F.min("_quality").alias("_quality"), *[F.min(n).alias(n) for n in NAMES]).toPandas().sort_values("doc_id")
    return fit(got[list(NAMES)].to_numpy(), got["_quality"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score in [0, 1]; a null text scores as an empty one. Any column score that docs has is replaced."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    return docs.withColumn("score", of("text"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of documents: null texts count as empty, repeated rows come as often as they are, a null doc_id is of no fold and held out never. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int").alias("predicted"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go.

    A null text is scored as an empty one. Repeated rows share their score, so
    all stay or all go. Null ids, languages and sources stay as they are. An
    empty table gives an empty result.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.drop("score"), model).where(F.col("score") >= CUT).drop("score").select("doc_id", "text", "lang", "source", "n_chars")
