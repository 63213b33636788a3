"""Text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is cleaned out of crawled text, in this order.
SANITISE = (
    (r"(?is)<\s*script[^>]*>.*?<\s*/\s*script\s*>", " "),
    (r"(?is)<\s*style[^>]*>.*?<\s*/\s*style\s*>", " "),
    (r"(?is)<!--.*?-->", " "),
    (r"(?i)ignore\s+(all\s+)?(the\s+)?previous\s+instructions?", "[SANITIZED]"),
    (r"(?i)disregard\s+(all\s+)?(the\s+)?previous\s+instructions?", "[SANITIZED]"),
    (r"(?i)you\s+are\s+now\s+", "[SANITIZED]"),
    (r"(?i)new\s+instructions?\s*:", "[SANITIZED]"),
    (r"(?i)system\s*:\s*", "[SANITIZED]"),
    (r"(?i)assistant\s*:\s*", "[SANITIZED]"),
    (r"(?i)developer\s+mode\s*:", "[SANITIZED]"),
    (r"(?is)\{\{.*?\}\}", " "),
)
ZERO_WIDTH = "​‌‍⁠﻿"
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml")
SPA_MARKERS = ('id="root"', "id='root'", 'id="app"', "id='app'", "__next_data__", "window.__nuxt__", "ng-version", "data-reactroot", "v-app")
SPA_WORDS = 120
WORDS_PER_TOKEN = 1.3
# What is looked for in markup and headers.
SCRIPT_BLOCK, STYLE_BLOCK, ANY_TAG = r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<[^>]+>"
MIME = r"(?i)^\s*([a-z0-9.+-]+/[a-z0-9.+-]+)"
IMAGE, ALT = r"(?is)<img\b[^>]*>", r"(?is)\balt\s*=\s*[\"']([^\"']*)[\"']"
OPEN_GRAPH = r"(?i)<meta[^>]+property=[\"'](og:[^\"']+)[\"'][^>]+content=[\"']([^\"']*)[\"']"
JSON_LD = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
#: What follows a sentence's end.
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"
TABLE = r"(?m)^\s*\|?[^\n|]*\|[^\n]*\n\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$"
LIST = r"(?m)^\s*(?:[-*+]|\d+\.)\s+"
HEADING = r"(?m)^#{1,6}\s+\S"


def words(text: Column) -> Column:
    """Array of the parts between white space, Unicode's included."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"(?U)\s+", -1))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, half to even; 1 at least unless there are none."""
    n = word_count(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(WORDS_PER_TOKEN), 0).cast("int")))


def per_100(count: Column, n_words: Column) -> Column:
    return F.when(n_words > 0, count * 100.0 / n_words).otherwise(0.0)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def saturate(value: Column, target: float) -> Column:
    return clamp(value / F.lit(float(target))) if target > 0 else F.lit(0.0)


def strip_controls(text: Column, keep_layout: bool = False) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\r\t]]" if keep_layout else r"\p{Cc}", "")


def sanitise(text: Column, most: int | None = None) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, instead in SANITISE:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(instead))
    out = F.translate(out, ZERO_WIDTH, "")
    out = F.regexp_replace(out, "\r\n?", "\n")
    out = strip_controls(out, keep_layout=True)
    return out if most is None else F.substring(out, 1, most)


def collapse(text: Column) -> Column:
    """Runs of blanks become one, blank lines go."""
    flat = F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"(?m)^ +| +$", ""), r"\n{2,}", "\n"))


def limit_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


#: Fixed value: what stands after a text that was cut.
TRUNCATED = "…[truncated]"


def truncate(text: Column, most: int, marker: str = TRUNCATED) -> Column:
    return text if most <= 0 else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def tail_words(text: Column, tokens_wanted: int) -> Column:
    """The last words worth so many tokens."""
    if tokens_wanted <= 0:
        return F.lit("")
    own, take = words(text), max(1, int(tokens_wanted / WORDS_PER_TOKEN))
    return F.array_join(F.slice(own, F.greatest(F.size(own) - take + 1, F.lit(1)), take), " ")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE, -1), F.trim), lambda s: s != "")


def visible_words(html: Column) -> Column:
    out = F.regexp_replace(F.coalesce(html, F.lit("")), SCRIPT_BLOCK, " ")
    out = F.regexp_replace(out, STYLE_BLOCK, " ")
    return word_count(F.regexp_replace(out, ANY_TAG, " "))


def spa_shell(html: Column) -> Column:
    low, n = F.lower(html), visible_words(html)
    marked = F.lit(False)
    for marker in SPA_MARKERS:
        marked = marked | F.contains(low, F.lit(marker))
    thin = F.when(marked, (n < SPA_WORDS) | F.contains(low, F.lit("<noscript"))).otherwise(n < max(20, SPA_WORDS // 4))
    return F.when(F.coalesce(html, F.lit("")) == "", False).otherwise(thin)


def mime(content_type: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), MIME, 1))


def is_html(content_type: Column) -> Column:
    return mime(content_type).isin(*HTML_TYPES)


def pseudonym(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def error_name(kind: Column) -> Column:
    """Short names of failure classes."""
    known = {"robots": "robots_disallowed", "timeout": "timeout", "too_large": "response_too_large", "content_type": "unsupported_content_type", "status": "http_error"}
    out = F.lit("fetch_error")
    for k, v in known.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def image_counts(html: Column) -> Column:
    """Struct of images and of those whose alt is missing or blank."""
    images = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(IMAGE), F.lit(0))
    bare = F.filter(images, lambda i: F.trim(F.regexp_extract(i, ALT, 1)) == "")
    return F.struct(F.size(images).alias("total"), F.size(bare).alias("missing_alt"))


def open_graph(html: Column) -> Column:
    """Map of og: properties whose property comes before the content; the last of a name wins."""
    names = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(OPEN_GRAPH), F.lit(1))
    values = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(OPEN_GRAPH), F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def _json_ld(html: Column) -> Column:
    """Array of the texts of all readable JSON-LD blocks; a trailing comma is forgiven, other damage skips the block."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(JSON_LD), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(F.regexp_replace(b, r",\s*([}\]])", "$1"))))
    return F.transform(F.filter(parsed, lambda v: v.isNotNull()), lambda v: F.to_json(v))


def json_ld(html: Column) -> Column:
    """JSON of a page's blocks: null for none, the one itself, or an array of several."""
    texts = _json_ld(html)
    return F.when(F.size(texts) == 1, texts[0]).when(F.size(texts) > 1, F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))


def json_ld_types(html: Column) -> Column:
    """Distinct @type values of all readable JSON-LD blocks, first come first."""
    objects = F.flatten(F.transform(_json_ld(html), lambda t: F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<struct<`@type`:string>>")).otherwise(F.array(F.from_json(t, "struct<`@type`:string>")))))
    kinds = F.filter(F.transform(objects, lambda o: o["@type"]), lambda t: t.isNotNull())
    spread = F.flatten(F.transform(kinds, lambda t: F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>")).otherwise(F.array(t))))
    return F.array_distinct(spread)
