"""Personal data: base patterns, and gradient-boosted candidates beside them.

Base spans follow four fixed patterns and checks and always stay. High-recall
generators propose further, overlapping spans: addresses with spelled-out,
bracketed or spaced signs, full-width digits, numbers with other separators or
without the sign that the base asks for, and numbers that a base match has
swallowed. Boosted trees judge each candidate by its format and its context.

They learn from the corpus itself, without hand labels. A bounded sample of
base spans is written anew in other forms (VARIANTS), each in the context that
the span stands in; candidates at such a place are examples. Counter-examples
are candidates with other bounds or of other kinds, decoys put in the same contexts (DECOYS:
dates, versions, order numbers, sums, hashes), and matches of a base pattern
that fail its check. What no base pattern matches in the corpus teaches
nothing, since nobody knows what it is. Half of the sampled spans, with all
their forms, are held out; on them the threshold of each kind is the lowest
that reaches PRECISION, and where none does the kind adds nothing (report()
shows the figures). Accepted spans that overlap a base span go; of accepted
spans that overlap each other the one with the highest margin stays.

Matching, forms, features, trees and thresholds are DataFrame expressions: the
trees are fitted by the driver on at most SAMPLE rows of numbers and are rows of
a small table that candidates are joined to.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm._common import hash_sample, stored, table

KINDS = ("email", "ip", "card", "phone")
#: Base spans of each kind that are written anew, at most.
SEEDS = 150
#: At most so many candidates are learned from.
SAMPLE = 16_000
#: Share of accepted candidates in the held-out part that must be examples.
PRECISION = 0.995
#: Fewest examples of a kind in either part of the sample.
LEAST = 20
TREES = 20
DEPTH = 3
RATE = 0.3
#: Characters of context on either side that features look at.
AROUND = 24

# The base patterns, in a form that takes time in proportion to
# the text (possessive loops; a start inside a run of its own characters only
# right after a match).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_D, _WIDE = "[0-9\uff10-\uff19]", "\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19"
_AT = r"(?:[@\uff20]|[\(\[{](?:at|AT)[\)\]}])"
_DOT = r"(?:[.\uff0e]|[\(\[{](?:dot|DOT)[\)\]}]|\x20(?:dot|DOT)\x20)"
_NAME = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++"
_LABEL = "[A-Za-z0-9-]++"
#: High-recall generators, by the kind that they propose; those of a kind overlap.
LOOSE = (
    ("email", rf"{_NAME}\x20?{_AT}\x20?{_LABEL}(?:{_DOT}{_LABEL})++"),
    ("email", rf"{_NAME}\x20?{_AT}\x20?{_LABEL}(?:\x20?{_DOT}\x20?{_LABEL})++"),
    ("email", rf"{_NAME}\x20(?:at|AT)\x20{_LABEL}(?:\x20(?:dot|DOT)\x20{_LABEL})++"),
    ("ip", rf"(?<![0-9.]){_D}{{1,3}}+(?:\x20?(?:[.,:_\uff0e]|[\(\[][.][\)\]]|\x20(?:dot|DOT)\x20)\x20?{_D}{{1,3}}+){{3}}(?![0-9])"),
    ("card", rf"(?<![0-9]){_D}(?:[\x20./_-]{{0,2}}{_D}){{11,18}}+(?![0-9])"),
    ("card", rf"(?<![0-9]){_D}{{4}}(?:[\x20./_-]{{1,2}}{_D}{{4}}){{3}}(?![0-9])"),
    ("phone", rf"(?<![0-9+])(?:\+|00)?(?:{_D}|\()(?:[\x20()./-]|{_D}){{7,22}}(?<={_D})(?!{_D})"),
    ("phone", rf"(?<![0-9])(?:(?:[+\uff0b]|00)\x20?{_D}{{1,3}}[\x20./-]{{0,2}})?\(?{_D}{{2,4}}\)?[\x20./-]{{1,2}}{_D}{{3,4}}[\x20./-]{{1,2}}{_D}{{3,4}}(?!{_D})"),
)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words that often stand before such data.
CUE = {"email": r"(?i)\b(?:e-?mail|contact|write|reach|correo)\b", "ip": r"(?i)\b(?:ip|host|server|address|addr|ping)\b", "card": r"(?i)\b(?:card|visa|amex|mastercard|credit|karte|tarjeta)\b", "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|handy)\b"}
FEATURES = ("chars", "digits", "separators", "groups", "longest", "shortest", "last", "tail", "letters", "left_letter", "right_letter", "left_space", "right_space", "left_words", "right_words", "left_sign", "distinct", "plus", "brackets", "spelled", "loose_dots", "blanks", "dashes", "points", "octets", "luhn", "wide", "cue")


def _plain(s: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(s, _WIDE, "0123456789")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    backwards = F.reverse(digits)
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(i.alias("i"), F.substring(backwards, i, F.lit(1)).cast("int").alias("d")))
    value = F.aggregate(places, F.lit(0), lambda acc, p: acc + F.when(p["i"] % 2 == 1, p["d"]).otherwise(p["d"] * 2 - F.when(p["d"] > 4, 9).otherwise(0)))
    return F.length(digits).between(1, 30) & (value % 10 == 0)


def passes(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(s, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(s))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


#: Matches whose places are summed up together, so that a text with very many of them takes time in proportion.
TOGETHER = 256
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,span:string,left:string,right:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Array of all leftmost matches that pass their kind's check (all, where base is false), with places in code points.

    Places are sums of the lengths of the matches and of the texts between
    them. left and right are the ends of the texts on either side.
    """
    none = F.expr(f"cast(array() as {SPANS})")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["span"])
        left, right = F.substring(x["gap"], -AROUND, AROUND), F.substring(x["after"], 1, AROUND)
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), F.lit(base).alias("base"), x["span"].alias("span"), left.alias("left"), right.alias("right"))
        kept = passes(kind, x["span"]) if base else F.lit(True)
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def some(acc: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    def every(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / TOGETHER).cast("int")), lambda i: F.slice(pairs, i * TOGETHER + 1, TOGETHER))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPANS}>)").alias("out"))
        return F.when(F.size(pairs) > 0, F.flatten(F.aggregate(chunks, start, some)["out"])).otherwise(none)

    def paired(gaps: Column) -> Column:
        zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("span"), F.slice(gaps, 2, F.size(gaps)).alias("after"))
        return _let(F.filter(zipped, lambda x: x["span"].isNotNull()), every)  # the last gap has no match after it

    return _let(F.split(text, pattern, -1), paired)


def _bare(text: Column) -> Column:
    """Whether a text can hold a base span or a candidate."""
    return F.regexp_like(text, F.lit(r"[0-9@\uff10-\uff20]|[\(\[{](?:at|AT)[\)\]}]|\x20(?:dot|DOT)\x20"))


def base_spans(text: Column) -> Column:
    """Array of the base spans of a text by start, then kind."""
    kept = [matches(text, BASE[kind], kind, True) for kind in KINDS]
    return F.array_sort(F.concat(*kept), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(_rank(a["kind"]) - _rank(b["kind"])))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def _context(m: dict[str, Column]) -> list[Column]:
    """FEATURES of a candidate."""
    kind, span, left, right = m["kind"], _plain(m["span"]), m["left"], m["right"]
    runs, digits = F.regexp_extract_all(span, F.lit("[0-9]+"), F.lit(0)), _digits(span)
    sizes = F.transform(runs, F.length)

    def has(column: Column, pattern: str) -> Column:
        return F.regexp_like(column, F.lit(pattern)).cast("int")

    def count(pattern: str) -> Column:
        return F.regexp_count(span, F.lit(pattern))

    octets = F.when(kind == "ip", F.coalesce(F.forall(runs, lambda r: r.cast("int") <= 255), F.lit(False)).cast("int")).otherwise(0)
    cue = F.lit(0)
    for k, pattern in CUE.items():
        cue = F.when(kind == k, has(left, pattern)).otherwise(cue)
    return [
        F.length(span), F.length(digits), F.length(F.regexp_replace(span, "[A-Za-z0-9+]", "")), F.size(runs), F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)), F.length(F.regexp_extract(span, "[0-9]*$", 0)), F.length(F.regexp_extract(span, "[A-Za-z]*$", 0)), F.length(F.regexp_replace(span, "[^A-Za-z]", "")),
        has(left, r"[\p{L}0-9]$"), has(right, r"^[\p{L}0-9]"), has(left, r"(?:^|\s)$"), has(right, r"^(?:$|\s)"), F.size(F.split(left, r"\s+", -1)), F.size(F.split(right, r"\s+", -1)), has(left, r"[0-9.,:;/+=-]\s?$"), F.length(digits) - F.length(F.regexp_replace(digits, r"([0-9])(?=.*\1)", "")),
        has(span, r"^(?:[+\uff0b]|00)"), count(r"[()\[\]{}]"), has(span, r"(?:at|AT|dot|DOT)[\)\]}\x20]"), count(r"[.]\x20"), count(r"\x20"), count("-"), count("[.]"), octets, F.when(kind == "card", luhn(digits).cast("int")).otherwise(0), has(m["span"], "[\uff0b-\uff20]"), cue,
    ]


def _featured(rows: DataFrame, *keep: Column | str) -> DataFrame:
    own = {c: F.col(c) for c in ("kind", "span", "left", "right")}
    return rows.select(*keep, *[x.cast("double").alias(n) for n, x in zip(FEATURES, _context(own), strict=True)])


def _proposed(text: Column) -> Column:
    """Array of all generators' matches; a place that two of them propose comes twice."""
    return F.concat(*[matches(text, pattern, k, False) for k, pattern in LOOSE])


def passes_any(kind: Column, s: Column) -> Column:
    """Whether a span passes its kind's check, a phone number with its sign; false for addresses, which have none."""
    out = F.when(kind == "phone", F.startswith(s, F.lit("+")) & passes("phone", s)).otherwise(False)
    for k in ("ip", "card"):
        out = F.when(kind == k, passes(k, s)).otherwise(out)
    return out


def candidates(looked: DataFrame) -> DataFrame:
    """row, kind, start, end, span, the features, whether a base span overlaps it (covered), and whether it is a base match that fails its check (refused).

    A base span that begins before a candidate's end overlaps it if it ends
    after its start: a running maximum of the base spans' ends, in order of
    their starts, tells that without holding spans against each other.
    """
    rows = looked.select("row", F.explode(F.concat(_proposed(F.col("text")), "base")).alias("m")).select("row", "m.*").dropDuplicates(["row", "base", "kind", "start", "end"])
    place = F.when(F.col("base"), 2 * F.col("start") + 1).otherwise(2 * F.col("end"))  # a base span that starts at the end comes after it
    before = Window.partitionBy("row").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.max(F.when(F.col("base"), F.col("end"))).over(before)).where("not base")
    form = F.lit(False)
    for kind in ("ip", "card", "phone"):
        form = F.when(F.col("kind") == kind, F.regexp_like("span", F.lit(f"^(?:{BASE[kind]})$"))).otherwise(form)
    covered = F.coalesce(F.col("upto") > F.col("start"), F.lit(False))
    return _featured(rows, "row", "kind", "start", "end", "span", covered.alias("covered"), (~covered & form & ~passes_any(F.col("kind"), F.col("span"))).alias("refused"))


def _written_anew(kind: str, s: Column) -> list[Column]:
    """VARIANTS: other forms of a base span; the first is the span as it stands."""
    def wide(x: Column) -> Column:
        return F.translate(x, "0123456789", _WIDE)

    if kind == "email":
        user, host = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
        forms = [(" at ", " dot "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", " . "), ("\uff20", "."), ("{at}", "{dot}"), (" [at] ", ".")]
        return [s, *[F.concat(user, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in forms]]
    if kind == "ip":
        return [s, *[F.replace(s, F.lit("."), F.lit(x)) for x in (" . ", "[.]", "(.)", " dot ", "\uff0e")], wide(s)]
    if kind == "card":
        return [s, *[F.regexp_replace(_digits(s), "([0-9]{4})(?=[0-9])", f"$1{x}") for x in (".", "/", "  ", "_", " - ")], wide(_digits(s)), wide(F.regexp_replace(_digits(s), "([0-9]{4})(?=[0-9])", "$1 "))]
    bare = F.regexp_replace(s, r"^\+", "")
    return [s, F.concat(F.lit("00"), bare), F.regexp_replace(s, r"[^0-9+]+", "/"), F.concat(F.lit("00"), F.regexp_replace(bare, r"[^0-9]+", ".")), F.regexp_replace(bare, r"^[0-9]{1,3}[\x20./-]+(?=\()", ""), wide(s), F.concat(F.lit("00 "), F.regexp_replace(bare, r"[^0-9]+", " "))]


#: Forms of decoys: a run of 9 stands for digits, a run of Q for letters.
DECOYS = (
    "2099-09-09 09:59:59", "09.09.2099, 09:09", "9.9.9.9999", "v9.99.999-9999", "No. 9999999999", "99999999999999999999", "999999999999", "9,999,999,999.99", "99/99/99/99", "9.9999999999999", "1999-2099", "978-9-99-999999-9", "09:15-10:45, 11:00-12:30",
    "1 2 3 4 5 6 7 8 9 10 11 12 13", "99.9999, -99.9999", "$9,999 - $99,999", "(9) and (9) of 9999", "QQQQQQ @ 9.99 each", "QQQ @ 99.9", "QQQQQQQQQ @ 9.99", "QQ@9.9", "met at noon. The 9", "QQQQ @ 9.99.QQ", "9999 x 9999 x 9999", "ID9999999999999", "SKU 9999-9999-99", "999 999 999 999 999 999 999", "A dot B at 9", "QQQQQ (at) 9.9 percent", "QQQQ [at] 99.999", "9999:9999:9999:9999", "300.9999.299.8", "99-99-99 99-99-99", "0099999999999999", "00 99999999999999999", "0099999", "QQ @ b9.T", "Q @ self.w + 9", "m = Q @ Q.T", "QQQ (at) page 9.The rest", "order 0099999999", "999,999,999.99", "99, 99, 99, 99", "999, 999, 99, 9", "9999.9999.9999.9999", "9999/9999/9999/9999", "00.99.9999",
)


def _decoys(seed: Column) -> Column:
    """Array of DECOYS, what looks alike and is no personal data, with digits and letters drawn from a hash of the seed, in turn.

    Forms are data, not expressions: what is planned and compiled doesn't grow with their number.
    """
    n = F.concat(F.lpad(F.abs(F.xxhash64(seed)).cast("string"), 19, "7"), F.lpad(F.abs(F.xxhash64(seed, F.lit(1))).cast("string"), 19, "3"))
    whole = F.sha2(seed, 256)
    drawn = F.struct(n.alias("n"), F.translate(whole, "0123456789", "ghklmnoprs").alias("names"))

    def made(form: Column, x: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            digits, letters = F.startswith(part, F.lit("9")), F.startswith(part, F.lit("Q"))
            size = F.length(part)
            put = F.when(digits, F.substring(x["n"], acc["n"], size)).when(letters, F.substring(x["names"], acc["q"], size)).otherwise(part)
            return F.struct((acc["n"] + F.when(digits, size).otherwise(0)).alias("n"), (acc["q"] + F.when(letters, size).otherwise(0)).alias("q"), F.concat(acc["out"], put).alias("out"))

        start = F.struct(F.lit(1).alias("n"), F.lit(1).alias("q"), F.lit("").alias("out"))
        return F.aggregate(F.regexp_extract_all(form, F.lit("9+|Q+|[^9Q]+"), F.lit(0)), start, step)["out"]

    all_made = _let(drawn, lambda x: F.transform(F.split(F.lit("\n".join(DECOYS)), "\n"), lambda form: made(form, x)))
    return F.concat(all_made, F.array(F.substring(whole, 1, 40), F.regexp_replace(whole, "[a-f]", "9")))


def examples(looked: DataFrame) -> DataFrame:
    """kind, label, held (whether its seed is held out) and the features of candidates in sampled base spans written anew and in decoys."""
    base = stored(looked.select(F.explode("base").alias("m")).select("m.kind", "m.span", "m.left", "m.right").distinct(), "spans")
    mark = F.xxhash64("span", "left", "right").bitwiseAND(F.lit((1 << 52) - 1))
    share = F.lit(False)
    for kind, n in base.groupBy("kind").count().collect():
        share = F.when(F.col("kind") == kind, mark < int(min(1.0, (SEEDS - 4 * SEEDS**0.5) / n if n > SEEDS else 1.0) * (1 << 52))).otherwise(share)
    drawn = stored(base.where(share), "seeds")  # about SEEDS of each kind, by their hash
    forms = F.array()
    for kind in KINDS:
        forms = F.when(F.col("kind") == kind, F.array(*_written_anew(kind, F.col("span")))).otherwise(forms)
    true = F.transform(forms, lambda x: F.struct(x.alias("put"), F.lit(True).alias("true")))
    every = F.concat(true, F.transform(_decoys(F.col("span")), lambda x: F.struct(x.alias("put"), F.lit(False).alias("true"))))
    texts = drawn.select(F.col("kind").alias("of"), F.col("span").alias("seed"), "left", "right", F.explode(every).alias("f"))
    texts = texts.select("of", "seed", "f.*", F.length("left").alias("at"), F.concat("left", "f.put", "right").alias("text"))
    made = texts.select("of", "seed", "put", "true", "at", F.explode(_proposed(F.col("text"))).alias("m")).select("of", "seed", "put", "true", "at", "m.*")
    stop = F.col("at") + F.length("put")
    over = (F.col("start") < stop) & (F.col("end") > F.col("at"))  # the context may hold other data, which teaches nothing
    exact = F.col("true") & (F.col("kind") == F.col("of")) & (F.col("start") == F.col("at")) & (F.col("end") == stop)
    sound = exact | ~passes_any(F.col("kind"), F.col("span"))  # else chance has made a base span
    return _featured(made.where(over & sound), "kind", exact.cast("int").alias("label"), (F.pmod(F.xxhash64("seed"), F.lit(2)) == 1).alias("held"), "span", "start")


class Trees:
    """Boosted regression trees on the logistic loss, all of one depth; a tree is a nested (feature, cut, left, right) or a value."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            chance = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - chance, np.maximum(chance * (1 - chance), 1e-6), DEPTH)
            self.trees.append(tree)
            margin += self.of(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = float(RATE * g.sum() / (h.sum() + 1))
        best = (1e-6, None)
        for f in range(x.shape[1]) if depth else ():
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33), method="nearest")):
                low = x[:, f] <= cut
                if not low.any() or low.all():
                    continue
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0]:
                    best = (gain, (f, float(cut)))
        if best[1] is None:
            return value
        f, cut = best[1]
        low = x[:, f] <= cut
        return (f, cut, self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1))

    def of(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, self.of(a, x), self.of(b, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self.of(t, x) for t in self.trees)

    def column(self) -> Column:
        """The margin as one expression, for few rows or trees; margins() is for many."""
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, cut, a, b = tree
            return F.when(F.col(FEATURES[f]) <= cut, of(a)).otherwise(of(b))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + of(t)
        return out

    def rows(self) -> list[tuple[list[int], list[float], list[float]]]:
        """Each tree as the features and cuts of its inner nodes, level by level, and its leaves; a value above the leaves stands at all that are below it."""
        def filled(tree) -> tuple[list[int], list[float], list[float]]:
            level, features, cuts = [tree], [], []
            for _ in range(DEPTH):
                nodes = [t if isinstance(t, tuple) else (0, 0.0, t, t) for t in level]
                features += [t[0] for t in nodes]
                cuts += [t[1] for t in nodes]
                level = [x for t in nodes for x in t[2:]]
            return features, cuts, [float(x) for x in level]

        return [filled(t) for t in self.trees]


def margins(found: DataFrame, learned: dict[str, Learned]) -> DataFrame:
    """found with the margin over its kind's threshold; rows of kinds that add nothing go.

    The trees are rows of a table that is joined by kind: a candidate walks
    down each from its root, so what is planned and compiled doesn't grow with
    their number.
    """
    rows = [(kind, own.trees.start, own.cut, own.trees.rows()) for kind, own in learned.items() if own.cut is not None]
    model = found.sparkSession.createDataFrame(rows, "kind string, began double, cut double, trees array<struct<f:array<int>,c:array<double>,v:array<double>>>")
    x = F.array(*FEATURES)

    def step(acc: Column, tree: Column) -> Column:
        at = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), lambda i, _: 2 * i + F.when(F.col("x")[tree["f"][i]] <= tree["c"][i], 1).otherwise(2))
        return acc + tree["v"][at - (2**DEPTH - 1)]

    scored = found.withColumn("x", x).join(F.broadcast(model), "kind").withColumn("margin", F.aggregate("trees", F.col("began"), step) - F.col("cut"))
    return scored.drop("x", "began", "cut", "trees")


class Learned(NamedTuple):
    """A kind's trees, its threshold (a margin) and what that gives on the held-out part; cut is None where PRECISION isn't reached."""

    trees: Trees
    cut: float | None
    precision: float
    recall: float
    held: int


def learn(looked: DataFrame, found: DataFrame) -> dict[str, Learned]:
    """Trees and threshold of each kind that has enough examples."""
    refused = found.where("refused").select("kind", F.lit(0).alias("label"), (F.pmod(F.xxhash64("span"), F.lit(2)) == 1).alias("held"), "span", "start", *FEATURES)
    rows = hash_sample(stored(examples(looked), "examples").unionByName(refused), SAMPLE, "kind", "span", "start").select("kind", "label", "held", *FEATURES).toPandas()  # bounded by SAMPLE
    out = {}
    for kind in KINDS:
        own = rows[rows["kind"] == kind]
        x, y, held = own[list(FEATURES)].to_numpy(), own["label"].to_numpy(), own["held"].to_numpy(bool)
        if min(y[~held].sum(), y[held].sum(), (1 - y[~held]).sum()) < LEAST:
            continue
        trees = Trees(x[~held], y[~held])
        m, y = trees.margin(x[held]), y[held]
        order = np.argsort(-m, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        last = np.append(m[order][1:] < m[order][:-1], True)  # a threshold takes equal margins together
        good = np.flatnonzero((right >= PRECISION) & last & (np.arange(1, len(y) + 1) >= LEAST))
        k = int(good[-1]) if len(good) else -1
        below = m[order][k + 1] if 0 <= k < len(y) - 1 else -np.inf
        cut = float(max((m[order][k] + below) / 2, m[order][k] - 2)) if k >= 0 else None  # between the lowest accepted margin and the next
        out[kind] = Learned(trees, cut, float(right[k]) if k >= 0 else 0.0, float(y[order][: k + 1].sum() / y.sum()), len(y))
    return out


def report(docs: DataFrame) -> dict[str, tuple[float | None, float, float, int]]:
    """What calibration finds for the corpus docs: by kind the threshold, and precision, recall and rows of the held-out part."""
    looked = _looked(docs)
    return {k: tuple(v)[1:] for k, v in learn(looked, stored(candidates(looked), "candidates")).items()}


def _looked(docs: DataFrame) -> DataFrame:
    """The few texts that can hold any such data, each once, with their base spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return stored(docs.select(text.alias("text")).where(_bare(F.col("text"))).select(F.sha2("text", 256).alias("row"), "text").dropDuplicates(["row"]).withColumn("base", base_spans(F.col("text"))), "looked")


def find(docs: DataFrame) -> DataFrame:
    """docs with base (array of base spans) and added (array of spans that the trees accept); columns of these names are replaced.

    A null text counts as empty and has no spans. Repeated rows each get their
    own spans. Very long texts are matched whole. An empty table gives an empty
    result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr(f"cast(array() as {SPANS})")
    docs = docs.drop("base", "added")
    looked = _looked(docs)
    found = stored(candidates(looked), "candidates")
    scored = stored(margins(found.where("not covered"), learn(looked, found)), "scored")
    taken = scored.where("margin >= 0").select("row", "kind", "start", "end", "span", "margin")
    # accepted spans that overlap form a run: it begins where all before it have ended, and its best one stays
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    runs = taken.withColumn("begins", F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True)).cast("int")).withColumn("run", F.sum("begins").over(so_far))
    one = F.struct("kind", "start", "end", F.lit(False).alias("base"), "span", F.lit("").alias("left"), F.lit("").alias("right"))
    best = runs.groupBy("row", "run").agg(F.max_by(one, F.struct("margin", F.col("end") - F.col("start"), -_rank(F.col("kind")), -F.col("start"))).alias("s"))
    more = best.groupBy("row").agg(F.collect_list("s").alias("added"))
    known = looked.select("row", "base").join(more, "row", "left").where("size(base) > 0 or added is not null").select(F.col("row").alias("_pii_row"), "base", "added")
    own = docs.where(_bare(text)).withColumn("_pii_key", F.sha2(text, 256)).join(known, F.col("_pii_key") == F.col("_pii_row"), "left").drop("_pii_key", "_pii_row")
    # texts without any sign of such data, nearly all, never enter the join
    rest = docs.where(~_bare(text)).withColumn("base", none).withColumn("added", none)
    return own.withColumn("base", F.coalesce("base", none)).withColumn("added", F.coalesce("added", none)).unionByName(rest)


def by_place(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(_rank(a["kind"]) != _rank(b["kind"]), _rank(a["kind"]) - _rank(b["kind"])).otherwise(a["end"] - b["end"]))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first names the whole."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).alias("out"))

    done = F.aggregate(by_place(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(by_place(F.concat("base", "added"))).alias("spans"))


def redact_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays, with its spans redacted and n_chars counted anew where that changed the text; null texts stay null, repeated rows repeated, and an empty table empty."""
    found = find(docs.select("doc_id", "text", "lang", "source", "n_chars")).withColumn("_new", redacted(F.col("text"), F.concat("base", "added")))
    changed = F.size("base") + F.size("added") > 0
    return found.select("doc_id", F.col("_new").alias("text"), "lang", "source", F.when(changed, F.length("_new").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
