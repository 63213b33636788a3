"""Text, URL, HTML, vector, retrieval, limiter and citation queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import chunking, html as hx, text as tx, urls as ux, vectors as vx
from folioscope.operators import citations as ci
from folioscope.operators import limits as li
from folioscope.operators import retrieval as rt
from folioscope.operators import scoring as sc
from folioscope.operators.cells import LISTS, CellIndex, recall
from folioscope.operators.grams import GramIndex
from folioscope.operators.textindex import TextIndex
from folioscope.sources.tables import load, shared_path, stamp, with_robots

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: Words of a text, as the SQL engine counts them: letters of its white-space class match for the corpus.
WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
#: Accented letters as plain ones, for an engine whose word bounds know ASCII only.
PLAIN = r"regexp_replace(text, '[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{024F}]', 'x', 'g')"


def _count(pattern: str, text: str = PLAIN) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all({text}, '{quoted}'))"


# --- text ------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(CASE WHEN w = 0 THEN 0 ELSE greatest(1, round_even(w * 1.3::DOUBLE, 0)) END AS BIGINT) AS tokens, CAST(w AS BIGINT) AS words FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def text_token_estimate(s, d):
    return load(s, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("tokens"), tx.word_count(F.col("text")).cast("long").alias("words"))


_SANITISE_SQL = "coalesce(text, '')"
for _pattern, _instead in tx.SANITISE:
    _SANITISE_SQL = f"regexp_replace({_SANITISE_SQL}, '{_pattern}', '{_instead}', 'g')"


@query(f"SELECT page_id, sha256({_SANITISE_SQL.replace('text', 'html', 1)}) AS cleaned, CAST(len({_SANITISE_SQL.replace('text', 'html', 1)}) AS BIGINT) AS n FROM pages")
def text_sanitise(s, d):
    out = load(s, d, "pages").select("page_id", tx.sanitise(F.col("html")).alias("t"))
    return out.select("page_id", F.sha2("t", 256).alias("cleaned"), F.length("t").cast("long").alias("n"))


@query(r"SELECT page_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM pages")
def text_visible_words(s, d):
    return load(s, d, "pages").select("page_id", tx.visible_words(F.col("html")).cast("long").alias("words"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(lower(html), 'id=\"root\"|id=''root''|id=\"app\"|id=''app''|__next_data__|window\.__nuxt__|ng-version|data-reactroot|v-app') THEN w < 120 OR contains(lower(html), '<noscript') ELSE w < 30 END AS shell FROM (SELECT page_id, html, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+'), lambda x: x <> '')) AS w FROM pages)")
def text_spa_shell(s, d):
    return load(s, d, "pages").select("page_id", tx.spa_shell(F.col("html")).alias("shell"))


_TYPES = ("text/html; charset=utf-8", "APPLICATION/XHTML+XML", "image/png", "", " text/xml;q=1")


@query("SELECT page_id, regexp_extract(lower(t), '^\\s*([a-z0-9.+-]+/[a-z0-9.+-]+)', 1) AS mime, regexp_extract(lower(t), '^\\s*([a-z0-9.+-]+/[a-z0-9.+-]+)', 1) IN ('text/html', 'application/xhtml+xml', 'application/xml', 'text/xml') AS is_html FROM (SELECT page_id, ['text/html; charset=utf-8', 'APPLICATION/XHTML+XML', 'image/png', '', ' text/xml;q=1'][page_id % 5 + 1] AS t FROM pages)")
def text_mime(s, d):
    t = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("page_id") % 5 + 1).cast("int"))
    return load(s, d, "pages").select("page_id", tx.mime(t).alias("mime"), tx.is_html(t).alias("is_html"))


@query("SELECT doc_id, CASE WHEN len(text) > 80 THEN left(text, 80) || '…[truncated]' ELSE text END AS short FROM documents")
def text_truncate(s, d):
    return load(s, d, "documents").select("doc_id", tx.truncate(F.col("text"), 80).alias("short"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x0B\f\r]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{2,}', chr(10), 'g'))) AS digest FROM documents")
def text_normalise(s, d):
    return load(s, d, "documents").select("doc_id", F.sha2(tx.collapse(F.col("text")), 256).alias("digest"))


@query("SELECT token, COUNT(*) AS n, COUNT(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY token")
def text_tokens(s, d):
    per = load(s, d, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(r"SELECT doc_id, array_to_string(list_slice(w, greatest(len(w) - 23, 1), len(w)), ' ') AS tail FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)")
def text_tail_words(s, d):
    return load(s, d, "documents").select("doc_id", tx.tail_words(F.col("text"), 32).alias("tail"))


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '')) AS BIGINT) AS sentences FROM documents""")
def text_sentences(s, d):
    return load(s, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(r"SELECT doc_id, regexp_matches(text, '(?m)^\s*(?:[-*+]|\d+\.)\s+') AS has_lists, regexp_matches(text, '(?m)^#{1,6}\s+\S') AS has_headings, regexp_matches(text, '(?m)^\s*\|?[^\n|]*\|[^\n]*\n\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$') AS has_tables FROM documents")
def markdown_shape_flags(s, d):
    return load(s, d, "documents").select("doc_id", F.regexp_like("text", F.lit(tx.LIST)).alias("has_lists"), F.regexp_like("text", F.lit(tx.HEADING)).alias("has_headings"), F.regexp_like("text", F.lit(tx.TABLE)).alias("has_tables"))


@query(r"SELECT doc_id, round(CASE WHEN w > 0 THEN c * 100.0::DOUBLE / w ELSE 0 END, 6) AS per_100, round(least(greatest(CASE WHEN w > 0 THEN c * 100.0::DOUBLE / w ELSE 0 END / 4.0::DOUBLE, 0), 1), 6) AS saturated FROM (SELECT doc_id, " + WORDS + r" AS w, len(regexp_extract_all(text, ',')) AS c FROM documents)")
def per_100_saturate(s, d):
    rate = tx.per_100(F.col("n"), F.col("w"))
    return load(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(",")).alias("n"), tx.word_count(F.col("text")).alias("w")).select("doc_id", F.round(rate, 6).alias("per_100"), F.round(tx.saturate(rate, 4.0), 6).alias("saturated"))


_EVIDENCE_SQL = {
    "numbers": _count(sc.NUMBER), "percentages": _count(sc.PERCENT), "dates": f"({_count(sc.YEAR)} + {_count(sc.DATE)})", "units": _count(sc.UNIT),
    "citations": _count(r"\[[^\]]+\]\([^#)][^)]*\)", "text"), "quotes": _count(sc.QUOTE, "text"),
}


@query("SELECT doc_id, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _EVIDENCE_SQL.items()) + " FROM documents")
def evidence_counts(s, d):
    return load(s, d, "documents").select("doc_id", *[c.cast("long").alias(n) for n, c in sc.evidence_counts(F.col("text")).items()])


@query("SELECT doc_id, round(CASE WHEN w > 0 THEN " + " + ".join(f"{w}::DOUBLE * least(greatest({_EVIDENCE_SQL[k]} * 100.0::DOUBLE / w / {sc.EVIDENCE_TARGETS[k]}::DOUBLE, 0), 1)" for k, w in sc.EVIDENCE.items()) + f" ELSE 0 END, 6) AS score FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)")
def evidence_score(s, d):
    docs, counts, n_words = sc.with_evidence(load(s, d, "documents").select("doc_id", "text"), F.col("text"))
    return docs.select("doc_id", F.round(sc.evidence_score(counts, n_words), 6).alias("score"))


# --- urls ------------------------------------------------------------------

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def url_host(s, d):
    return load(s, d, "pages").select("page_id", ux.host(F.col("url")).alias("host"))


@query(f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {_HOST} AS origin FROM pages")
def url_origin(s, d):
    return load(s, d, "pages").select("page_id", ux.origin(F.col("url")).alias("origin"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def url_strip_fragment(s, d):
    return load(s, d, "pages").select("page_id", ux.without_fragment(F.col("url")).alias("url"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def url_redact(s, d):
    return load(s, d, "pages").select("page_id", ux.redact(F.col("url")).alias("url"))


_HREFS = r"""regexp_extract_all(html, '(?i)<a[^>]*\bhref="([^"]*)"', 1)"""


_HOPS = ("", "../", "./", "a/../b/./", "../../../", "/x/../", "?q=", "//other.org/")


@query(rf"""WITH l AS (SELECT DISTINCT page_id, url, ['', '../', './', 'a/../b/./', '../../../', '/x/../', '?q=', '//other.org/'][length(href) % 8 + 1] || ltrim(regexp_replace(href, '^https?:', ''), '/') AS href FROM (SELECT page_id, url, unnest({_HREFS}) AS href FROM pages)),
w AS (SELECT page_id, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(href, '#.*$', '') AS h FROM l),
f AS (SELECT page_id, href, site, CASE WHEN h LIKE '//%' THEN regexp_extract(site, '^[a-z]+:') || h WHEN h LIKE '?%' THEN site || path || h END AS whole, CASE WHEN h LIKE '/%' THEN h ELSE regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || h END AS way FROM w),
s AS (SELECT page_id, href, site, whole, regexp_extract(way, '(\?.*)?$') AS q, list_slice(string_split(regexp_replace(way, '\?.*$', ''), '/'), 2, 1000) AS steps FROM f),
k AS (SELECT *, list_reduce(list_concat([''], list_transform(steps, lambda x: '/' || x)), lambda a, x: CASE WHEN x = '/.' THEN a WHEN x = '/..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || x END) AS walked FROM s)
SELECT page_id, href, CASE WHEN whole IS NOT NULL THEN whole ELSE site || CASE WHEN walked = '' THEN '/' ELSE walked || CASE WHEN steps[-1] IN ('.', '..') THEN '/' ELSE '' END END || q END AS absolute FROM k""")
def url_absolutise_links(s, d):
    links = load(s, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a[^>]*\bhref="([^"]*)"'), F.lit(1))).alias("href"))
    hop = F.element_at(F.array(*map(F.lit, _HOPS)), (F.length("href") % 8 + 1).cast("int"))
    links = links.select("page_id", "url", F.concat(hop, F.regexp_replace(F.regexp_replace("href", "^https?:", ""), "^/+", "")).alias("href")).distinct()
    return links.select("page_id", "href", ux.absolutise(F.col("href"), F.col("url")).alias("absolute"))


@query(f"SELECT a.page_id, array_to_string(list_slice(string_split(a.h, '.'), greatest(len(string_split(a.h, '.')) - 1, 1), len(string_split(a.h, '.'))), '.') AS site FROM (SELECT page_id, {_HOST} AS h FROM pages) a")
def url_registrable(s, d):
    return load(s, d, "pages").select("page_id", ux.registrable(ux.host(F.col("url"))).alias("site"))


@query(f"SELECT site, COUNT(*) AS pages, COUNT(DISTINCT h) AS hosts FROM (SELECT array_to_string(list_slice(string_split(h, '.'), greatest(len(string_split(h, '.')) - 1, 1), len(string_split(h, '.'))), '.') AS site, h FROM (SELECT {_HOST} AS h FROM pages)) GROUP BY site")
def url_same_site_two_label(s, d):
    per = load(s, d, "pages").select(ux.host(F.col("url")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(ux.registrable(F.col("h")).alias("site")).agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("hosts"))


@query(f"SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') AS inside FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def inside_scope(s, d):
    return load(s, d, "pages").select("page_id", ux.inside(F.col("url"), F.lit("example.com")).alias("inside"))


@query("SELECT o_orderkey, a, (n BETWEEN 0 AND 16777215) OR (n BETWEEN 167772160 AND 184549375) OR (n BETWEEN 1681915904 AND 1686110207) OR (n BETWEEN 2130706432 AND 2147483647) OR (n BETWEEN 2851995648 AND 2852061183) OR (n BETWEEN 2886729728 AND 2887778303) OR (n BETWEEN 3221225472 AND 3221225727) OR (n BETWEEN 3232235520 AND 3232301055) OR (n BETWEEN 3323068416 AND 3323199487) OR (n BETWEEN 3758096384 AND 4026531839) OR (n BETWEEN 4026531840 AND 4294967295) AS blocked FROM (SELECT o_orderkey, (o_orderkey * 7919) % 4294967296 AS n, ((o_orderkey * 7919) % 4294967296 // 16777216) || '.' || ((o_orderkey * 7919) // 65536 % 256) || '.' || ((o_orderkey * 7919) // 256 % 256) || '.' || ((o_orderkey * 7919) % 256) AS a FROM orders)")
def ipv4_blocked(s, d):
    n = (F.col("o_orderkey") * 7919) % 4_294_967_296
    part = [F.expr(f"(o_orderkey * 7919) % 4294967296 div {1 << sh} % 256").cast("string") for sh in (24, 16, 8, 0)]
    rows = load(s, d, "orders").select("o_orderkey", F.concat_ws(".", *part).alias("a"), n.alias("n"))
    return rows.select("o_orderkey", "a", ux.ipv4_blocked(F.col("a")).alias("blocked"))


_URLS = ("{}", " {} ", "HTTP://Example.COM:80/a/", "ftp://a.b/", "https://u:p@a.b/x?q#f", "https://host/", "https://[::1]:8443/", "a.b/c", "https://a b.c/", "", "https://a.b:443", "{}/")


@query(r"""WITH u AS (SELECT page_id, replace(['{}', ' {} ', 'HTTP://Example.COM:80/a/', 'ftp://a.b/', 'https://u:p@a.b/x?q#f', 'https://host/', 'https://[::1]:8443/', 'a.b/c', 'https://a b.c/', '', 'https://a.b:443', '{}/'][page_id % 12 + 1], '{}', url) AS url FROM pages),
p AS (SELECT page_id, trim(url) AS t, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(trim(url), '^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)) AS host, regexp_extract(trim(url), '^[A-Za-z]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)', 1) AS port, regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*(.*)$', 1) AS rest FROM u),
r AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN contains(t, ' ') THEN 'whitespace' WHEN NOT contains(t, '://') OR scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' OR (NOT contains(host, '.') AND NOT starts_with(host, '[')) THEN 'host' END AS refused FROM p),
m AS (SELECT *, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END || rest AS made FROM r)
SELECT page_id, CASE WHEN refused IS NULL THEN CASE WHEN regexp_matches(rest, '[?#]') THEN made ELSE rtrim(made, '/') END END AS url, refused FROM m""")
def url_validate(s, d):
    form = F.element_at(F.array(*map(F.lit, _URLS)), (F.col("page_id") % 12 + 1).cast("int"))
    return load(s, d, "pages").select("page_id", ux.normalised(F.replace(form, F.lit("{}"), F.col("url"))).alias("r")).select("page_id", "r.*")


_RULES = "User-agent: *\nDisallow: /de/\nAllow: /de/a\nDisallow: /*.pdf$\nDisallow: /p*e*9\n\nUser-agent: other\nDisallow: /\nSitemap: https://{}/sitemap.xml"


@query(rf"""SELECT page_id, NOT ruled OR NOT (longest_no > longest_yes) AS allowed, CASE WHEN ruled THEN 'https://' || h || '/sitemap.xml' END AS sitemap FROM (SELECT page_id, h, len(h) % 2 = 0 AS ruled, CASE WHEN starts_with(path, '/de/a') THEN 5 ELSE 0 END AS longest_yes, CASE WHEN regexp_matches(path, '^/.*\.pdf$') THEN 7 WHEN regexp_matches(path, '^/p.*e.*9') THEN 6 WHEN starts_with(path, '/de/') THEN 4 ELSE 0 END AS longest_no
FROM (SELECT page_id, {_HOST} AS h, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS path FROM pages))""")
def robots_decision(s, d):
    pages = load(s, d, "pages").select("page_id", "url", ux.host(F.col("url")).alias("host"))
    rules = pages.select("host").distinct().where(F.length("host") % 2 == 0).withColumn("rules", F.replace(F.lit(_RULES), F.lit("{}"), F.col("host")))
    return with_robots(pages, rules, "host").select("page_id", ux.robots_decision("rules", "url").alias("r")).select("page_id", "r.*")


# Pages with heads that say more: each part is in some pages, by their number.
_HEAD = (
    ("page_id % 2 = 0", '<link rel="canonical" href="/c/#"><meta name="viewport" content="width=device-width">'), ("page_id % 3 = 0", '<meta name="description" content="about #">'), ("page_id % 4 = 1", '<script type="application/ld+json">{"@type": "Article", "n": 1}</script>'),
    ("page_id % 4 = 2", '<script type="application/ld+json">{"@type": ["FAQPage", "Thing"],}</script><script type="application/ld+json">{"@type": "Thing", "k": [1, 2,]}</script><script type="application/ld+json">{broken</script>'),
    ("page_id % 5 = 0", '<link rel="sitemap" href="/sitemap.xml">'), ("page_id % 3 = 1", '<meta property="og:title" content="first"><meta property="og:title" content="page #"><meta property="og:type" content="article">'),
)
_BODY = (("page_id % 2 = 1", '<img src="a.png" alt="a picture"><img src="b.png"><IMG alt=" " src="c.png">'), ("page_id % 7 = 0", "<figure><time>2024</time></figure>"))


def _full(s, d):
    def added(parts):
        return F.concat(*[F.when(F.expr(rule), F.replace(F.lit(text), F.lit("#"), F.col("page_id").cast("string"))).otherwise("") for rule, text in parts])

    html = F.replace(F.replace(F.col("html"), F.lit("<head>"), F.concat(F.lit("<head>"), added(_HEAD))), F.lit("<article>"), F.concat(F.lit("<article>"), added(_BODY)))
    return load(s, d, "pages").select("page_id", "url", html.alias("html"))


def _added_sql(parts):
    return " || ".join(f"CASE WHEN {rule} THEN replace('{text}', '#', page_id::VARCHAR) ELSE '' END" for rule, text in parts)


_FULL = f"(SELECT page_id, url, replace(replace(html, '<head>', '<head>' || {_added_sql(_HEAD)}), '<article>', '<article>' || {_added_sql(_BODY)}) AS html FROM pages)"
_SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<link[^>]+rel="?sitemap') THEN {_SITE} || regexp_extract(html, '(?i)<link[^>]+rel="?sitemap"?[^>]*href="([^"]*)"', 1) END AS sitemap FROM {_FULL}""")
def sitemap_hint(s, d):
    return _full(s, d).select("page_id", ux.sitemap_hint(F.col("html"), F.col("url")).alias("sitemap"))


# --- html ------------------------------------------------------------------


def _pages(s, d):
    return load(s, d, "pages").select("page_id", "url", "html", hx.read_page(F.col("html"), F.col("url")).alias("p"))


def _signals(df):
    return df.select("page_id", "url", hx.read_signals(F.col("html"), F.col("url")).alias("p"))


def _text_sql(html: str) -> str:
    """Text of a piece of markup: tags go, the usual entities become characters, white space is one blank."""
    out = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(rf"""SELECT page_id, {_text_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '(?i)<h1[ >]')) AS BIGINT) AS h1,
CASE WHEN page_id % 2 = 0 THEN {_SITE} || '/c/' || page_id END AS canonical, nullif(regexp_extract(html, 'name="description" content="([^"]*)"', 1), '') AS description, nullif(regexp_extract(html, 'name="viewport" content="([^"]*)"', 1), '') AS viewport,
nullif(regexp_extract(html, '(?i)rel="sitemap" href="([^"]*)"', 1), '') IS NOT NULL AS has_sitemap, CAST(len(regexp_extract_all(html, '(?i)<img\b')) AS BIGINT) AS images, CAST(CASE WHEN page_id % 2 = 1 THEN 2 ELSE 0 END AS BIGINT) AS bare_images FROM {_FULL}""")
def html_signals(s, d):
    p = _signals(_full(s, d))
    return p.select("page_id", F.col("p.title").alias("title"), F.col("p.lang").alias("lang"), F.size(F.filter("p.headings", lambda h: h["level"] == 1)).cast("long").alias("h1"), F.col("p.canonical_url").alias("canonical"), F.col("p.meta_description").alias("description"), F.col("p.viewport").alias("viewport"),
                    F.col("p.sitemap_url").isNotNull().alias("has_sitemap"), F.col("p.images_total").cast("long").alias("images"), F.col("p.images_missing_alt").cast("long").alias("bare_images"))


@query()
def html_clean_stats(s, d):
    return _pages(s, d).select("page_id", *[F.col(f"p.{c}").alias(c) for c in ("word_count", "boilerplate_ratio", "has_lists", "has_tables", "avg_paragraph_words", "external_link_count", "removed_elements", "markdown")])


@query()
def machine_score(s, d):
    return sc.score_pages(load(s, d, "pages")).select("page_id", "machine")


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<h1[ >]')) = 1 AND NOT regexp_matches(html, '(?i)<h[3-6][ >]') AS valid FROM pages")
def heading_validity(s, d):
    return _signals(load(s, d, "pages")).select("page_id", hx.headings_valid(F.col("p.headings")).alias("valid"))


@query(rf"""SELECT page_id, CAST(len(i) AS BIGINT) AS total, CAST(len(list_filter(i, lambda x: trim(regexp_extract(x, '(?i)\balt="([^"]*)"', 1)) = '')) AS BIGINT) AS missing_alt FROM (SELECT page_id, regexp_extract_all(html, '(?is)<img\b[^>]*>') AS i FROM {_FULL})""")
def image_alt_counts(s, d):
    i = tx.image_counts(F.col("html"))
    return _full(s, d).select("page_id", i["total"].cast("long").alias("total"), i["missing_alt"].cast("long").alias("missing_alt"))


@query(rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<meta[^>]+property="og:[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?i)<meta[^>]+property="og:[^>]*>'), 1) AS o FROM {_FULL}),
k AS (SELECT page_id, regexp_extract(tag, 'property="(og:[^"]*)"', 1) AS name, arg_max(regexp_extract(tag, 'content="([^"]*)"', 1), o) AS content FROM t GROUP BY 1, 2)
SELECT p.page_id, k.name, k.content FROM pages p LEFT JOIN k USING (page_id)""")
def open_graph_pairs(s, d):
    return _full(s, d).select("page_id", F.explode_outer(tx.open_graph(F.col("html"))).alias("name", "content"))


@query(rf"""WITH l AS (SELECT page_id, url, unnest({_HREFS}) AS href, generate_subscripts({_HREFS}, 1) AS o FROM pages),
a AS (SELECT page_id, o, regexp_replace(replace(CASE WHEN regexp_matches(href, '^https?:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^[a-z]+:') || href WHEN href LIKE '/%' THEN {_SITE} || href END, '&amp;', '&'), '#.*$', '') AS link, url FROM l WHERE href <> '' AND NOT regexp_matches(href, '^(?:mailto:|tel:|javascript:|data:|#)')),
u AS (SELECT page_id, link, min(o) AS o, any_value(url) AS url FROM a GROUP BY page_id, link),
k AS (SELECT page_id, link, o, CASE WHEN regexp_extract(link, '([^./]+\.[^./]+)(?:[/:?]|$)', 1) = regexp_extract(url, '([^./]+\.[^./]+)(?:[/:?]|$)', 1) THEN 'internal' ELSE 'external' END AS kind FROM u)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id, kind ORDER BY o) - 1 AS INT) AS pos, link, kind FROM k QUALIFY pos < 500""")
def page_links(s, d):
    p = _signals(load(s, d, "pages"))
    inner = p.select("page_id", F.posexplode("p.internal_links").alias("pos", "link")).withColumn("kind", F.lit("internal"))
    return inner.union(p.select("page_id", F.posexplode("p.external_links").alias("pos", "link")).withColumn("kind", F.lit("external")))


_HEADS = "regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')"


@query(rf"""WITH h AS (SELECT page_id, unnest({_HEADS}) AS tag, generate_subscripts({_HEADS}, 1) AS o FROM pages), t AS (SELECT page_id, o, CAST(tag[3] AS INT) AS level, {_text_sql("tag")} AS text FROM h)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INT) AS pos, level, text FROM t WHERE text <> ''""")
def page_headings(s, d):
    return _signals(load(s, d, "pages")).select("page_id", F.posexplode("p.headings").alias("pos", "h")).select("page_id", "pos", "h.level", "h.text")


_LD = r"""(SELECT page_id, o, regexp_replace(b, ',\s*([}\]])', '\1', 'g') AS j FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>', 1)) AS b, generate_subscripts(regexp_extract_all(html, '(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>', 1), 1) AS o FROM """ + _FULL + r""") WHERE json_valid(regexp_replace(b, ',\s*([}\]])', '\1', 'g')))"""


@query(rf"""WITH k AS (SELECT page_id, o, unnest(CASE WHEN json_type(j, '$."@type"') = 'ARRAY' THEN json_extract_string(j, '$."@type"[*]') ELSE [json_extract_string(j, '$."@type"')] END) AS kind, generate_subscripts(CASE WHEN json_type(j, '$."@type"') = 'ARRAY' THEN json_extract_string(j, '$."@type"[*]') ELSE [json_extract_string(j, '$."@type"')] END, 1) AS i FROM {_LD}),
f AS (SELECT page_id, kind, min(o * 1000 + i) AS at FROM k WHERE kind IS NOT NULL GROUP BY page_id, kind)
SELECT p.page_id, coalesce(string_agg(f.kind, ',' ORDER BY f.at), '') AS kinds FROM pages p LEFT JOIN f USING (page_id) GROUP BY p.page_id""")
def jsonld_types(s, d):
    return _full(s, d).select("page_id", F.array_join(tx.json_ld_types(F.col("html")), ",").alias("kinds"))


@query(f"""SELECT p.page_id, CASE WHEN count(j) = 1 THEN replace(any_value(j), ' ', '') WHEN count(j) > 1 THEN '[' || replace(string_agg(j, ',' ORDER BY o), ' ', '') || ']' END AS data FROM pages p LEFT JOIN {_LD} USING (page_id) GROUP BY p.page_id""")
def jsonld_data(s, d):
    return _full(s, d).select("page_id", tx.json_ld(F.col("html")).alias("data"))


def _native_checks():
    return sc.technical_checks(F.col("url"), F.regexp_like("html", F.lit(r"(?i)<link[^>]*rel=.?canonical")), F.regexp_like("html", F.lit(r"(?i)<meta[^>]*name=.?description")), F.size(tx.json_ld_types(F.col("html"))) > 0, F.regexp_count("html", F.lit("(?i)<h1[ >]")) == 1, ux.sitemap_hint(F.col("html"), F.col("url")).isNotNull(), F.regexp_like("html", F.lit(r"(?i)<html[^>]*\blang=")), F.regexp_like("html", F.lit(r"(?i)<meta[^>]*name=.?viewport")), (F.col("page_id") * 37 % 4000).cast("int"))


_CHECKS_SQL = rf"""(SELECT page_id, starts_with(url, 'https://') AS https, regexp_matches(html, '(?i)<link[^>]*rel=.?canonical') AS canonical, regexp_matches(html, '(?i)<meta[^>]*name=.?description') AS meta_description, contains(html, 'application/ld+json') AS json_ld, len(regexp_extract_all(html, '(?i)<h1[ >]')) = 1 AS heading_structure, contains(html, 'rel="sitemap"') AS sitemap, regexp_matches(html, '(?i)<html[^>]*\blang=') AS language, regexp_matches(html, '(?i)<meta[^>]*name=.?viewport') AS viewport, page_id * 37 % 4000 <= 2000 AS response_time FROM {_FULL})"""
_T_SQL = " + ".join(f"CASE WHEN {n} THEN {w}::DOUBLE ELSE 0 END" for n, w in sc.TECHNICAL.items())


@query(f"SELECT page_id, round({_T_SQL}, 6) AS technical FROM {_CHECKS_SQL}")
def technical_score(s, d):
    return _full(s, d).select("page_id", F.round(sc.technical_score(_native_checks()), 6).alias("technical"))


@query("SELECT page_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in sc.TECHNICAL) + "], lambda x: x IS NOT NULL)), ',') AS passed FROM " + _CHECKS_SQL)
def score_explanation(s, d):
    return _full(s, d).select("page_id", F.array_join(sc.passed(_native_checks()), ",").alias("passed"))


@query(f"""SELECT page_id, round((0.35::DOUBLE * t + CASE WHEN m IS NULL THEN 0 ELSE 0.30::DOUBLE * m END + CASE WHEN e IS NULL THEN 0 ELSE 0.20::DOUBLE * e END) / (0.35::DOUBLE + CASE WHEN m IS NULL THEN 0 ELSE 0.30::DOUBLE END + CASE WHEN e IS NULL THEN 0 ELSE 0.20::DOUBLE END), 6) AS pcs, 'machine' || CASE WHEN e IS NULL THEN ',evidentiary' ELSE '' END || CASE WHEN m IS NULL THEN ',semantic' ELSE '' END AS missing_raw FROM (SELECT page_id, {_T_SQL} AS t, CASE WHEN page_id % 2 = 0 THEN (page_id % 10) / 10.0::DOUBLE END AS m, CASE WHEN page_id % 3 = 0 THEN (page_id % 7) / 7.0::DOUBLE END AS e FROM {_CHECKS_SQL})""")
def pcs_renormalised(s, d):
    rows = _full(s, d).select("page_id", sc.technical_score(_native_checks()).alias("technical"), F.when(F.col("page_id") % 2 == 0, (F.col("page_id") % 10) / 10.0).alias("semantic"), F.when(F.col("page_id") % 3 == 0, (F.col("page_id") % 7) / 7.0).alias("evidentiary"), F.lit(None).cast("double").alias("machine"))
    made = sc.composite({n: F.col(n) for n in ("technical", "semantic", "evidentiary", "machine")})
    raw = F.concat(F.lit("machine"), F.when(F.col("evidentiary").isNull(), ",evidentiary").otherwise(""), F.when(F.col("semantic").isNull(), ",semantic").otherwise(""))
    return rows.select("page_id", F.round(made["pcs"], 6).alias("pcs"), raw.alias("missing_raw"))


@query()
def page_scorecard(s, d):
    return sc.score_pages(load(s, d, "pages"))


@query(f"SELECT page_id, round({_T_SQL}, 6) AS technical FROM (SELECT * REPLACE (heading_structure AND page_id NOT IN (SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)<h[3-6][ >]')) AS heading_structure, false AS response_time) FROM {_CHECKS_SQL})")
def page_technical(s, d):
    """The technical part of the scorecard, from parsed pages whose response time is not known."""
    return sc.score_pages(_full(s, d)).select("page_id", "technical")


# --- chunks and vectors ----------------------------------------------------


@query()
def chunk_documents(s, d):
    return chunking.chunk_documents(load(s, d, "documents"), "doc_id", "text")


@query()
def chunk_stats(s, d):
    c = chunk_documents(s, d)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest"))


_SPARSE = """(SELECT doc_id, dim, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 1536 AS dim, CAST(sum(CASE WHEN ('0x' || substr(h, 10, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS raw FROM (SELECT doc_id, sha256(t) AS h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {0})) GROUP BY ALL HAVING raw <> 0))"""


@query("SELECT doc_id, dim, round(weight, 6) AS weight FROM " + _SPARSE.format("documents"))
def embed_sparse(s, d):
    return vx.embed_sparse(load(s, d, "documents"), "doc_id", "text").select("doc_id", "dim", F.round("weight", 6).alias("weight"))


@query(f"SELECT b.item_id, coalesce(round(sqrt(sum(e.weight * e.weight)), 6), 0) AS norm FROM benchmark b LEFT JOIN {_SPARSE.format('(SELECT item_id AS doc_id, text FROM benchmark)')} e ON e.doc_id = b.item_id GROUP BY b.item_id")
def embed_dense_norm(s, d):
    return load(s, d, "benchmark").select("item_id", vx.embed_dense(F.col("text")).alias("v")).select("item_id", F.round(vx.norm(F.col("v")), 6).alias("norm"))


_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _probe(s, d):
    """The vector with the smallest id: one row, taken to be a literal's width."""
    return load(s, d, "embeddings").agg(F.min_by("embedding", "vec_id").alias("q"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]) DESC, vec_id LIMIT 10")
def vector_topk(s, d):
    items = load(s, d, "embeddings").crossJoin(F.broadcast(_probe(s, d)))
    return rt.vector_search(items, "vec_id", "embedding", F.col("q"), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS similarity FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]) >= 0.2 ORDER BY 2 DESC LIMIT 50")
def vector_threshold(s, d):
    items = load(s, d, "embeddings").crossJoin(F.broadcast(_probe(s, d)))
    return rt.vector_search(items, "vec_id", "embedding", F.col("q"), 50, 0.2).select("vec_id", F.round("similarity", 6).alias("similarity"))


_PROMPTS = "(SELECT item_id AS doc_id, text FROM benchmark QUALIFY row_number() OVER (PARTITION BY item_id % 8 ORDER BY item_id) <= 25)"


def _prompts(s, d):
    """Tracked prompts of eight projects, at most 25 of each."""
    return rt.tracked(load(s, d, "benchmark").select("item_id", "text", (F.col("item_id") % 8).alias("project")), "project", "item_id").select("item_id", "text")


@query(f"SELECT item_id, doc_id, similarity FROM (SELECT q.doc_id AS item_id, i.doc_id, round(sum(i.weight * q.weight), 6) AS similarity, row_number() OVER (PARTITION BY q.doc_id ORDER BY round(sum(i.weight * q.weight), 6) DESC, i.doc_id) AS r FROM {_SPARSE.format('documents')} i JOIN {_SPARSE.format(_PROMPTS)} q USING (dim) GROUP BY q.doc_id, i.doc_id) WHERE r <= 5")
def semantic_topk_sparse(s, d):
    return rt.best_matches(load(s, d, "documents"), "doc_id", "text", _prompts(s, d), "item_id", "text", 5).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT source, round(avg(best), 6) AS alignment, COUNT(*) AS prompts FROM (SELECT source, item, greatest(0, least(1, max(sim))) AS best FROM (SELECT d.source, q.doc_id AS item, i.doc_id, sum(i.weight * q.weight) AS sim FROM {_SPARSE.format('documents')} i JOIN {_SPARSE.format(_PROMPTS)} q USING (dim) JOIN documents d ON d.doc_id = i.doc_id GROUP BY ALL) GROUP BY source, item) GROUP BY source")
def alignment_score(s, d):
    return rt.alignment(load(s, d, "documents"), "source", "text", _prompts(s, d), "item_id", "text").select("source", F.round("alignment", 6).alias("alignment"), "prompts")


#: The queries of the searches through cells: every fiftieth vector.
_ASKED = "vec_id % 50 = 0"
#: Probes for nine in ten of the ten nearest on these vectors, which are all but evenly spread.
WIDE = 60


def _exact(s, d):
    """The ten nearest of each query among all vectors."""
    v = load(s, d, "embeddings")
    return CellIndex.build(v, "vec_id", "embedding", shared_path(s, "one"), lists=1, rounds=0).search(v.where(_ASKED), "vec_id", "embedding", probes=1)


@query(f"""WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS similarity FROM (SELECT * FROM embeddings WHERE {_ASKED}) q, embeddings v)
SELECT query, id, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s.similarity DESC, id) <= 10""")
def vector_cells_all(s, d):
    """All cells probed: the exact search."""
    v = load(s, d, "embeddings")
    index = CellIndex.build(v, "vec_id", "embedding", shared_path(s, "cells"), lists=LISTS)
    return index.search(v.where(_ASKED), "vec_id", "embedding", probes=LISTS).withColumn("similarity", F.round("similarity", 6))


@query()
def vector_cells_recall(s, d):
    """What some probes find of the ten nearest of each query."""
    v = load(s, d, "embeddings")
    index = CellIndex.build(v, "vec_id", "embedding", shared_path(s, "cells"), lists=LISTS)
    found = index.search(v.where(_ASKED), "vec_id", "embedding", probes=WIDE)
    return recall(found, _exact(s, d)).withColumn("probes", F.lit(WIDE))


#: Typed patterns of all lengths, with and without wildcards.
PATTERNS = ("%green%", "%Choc%", "%ar%", "%e_t%", "b%", "%a", "_a%", "%zq%", "%o%l%e%", "%n r%")


@query(f"SELECT x.p AS pattern, p_partkey, p_name FROM part, unnest([{', '.join(repr(p) for p in PATTERNS)}]) AS x(p) WHERE p_name ILIKE x.p")
def search_name_grams(s, d):
    """Substring searches through one index of trigrams."""
    index = GramIndex.build(load(s, d, "part"), "p_partkey", "p_name", shared_path(s, "grams"))
    out = None
    for p in PATTERNS:
        own = index.ilike(p).select(F.lit(p).alias("pattern"), F.col("id").alias("p_partkey"), F.col("text").alias("p_name"))
        out = own if out is None else out.union(own)
    return out


# --- full text -------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in sorted(rt.STOP))
#: The words that most documents hold, by rank: those that searches ask for are taken from the corpus.
_RANKED = f"(SELECT token, row_number() OVER (ORDER BY COUNT(DISTINCT doc_id) DESC, token) AS r FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) WHERE token NOT IN ({_STOP}) GROUP BY token)"
_TOKENS = "(SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)"
#: Ranks of the words of the queries.
ONE, TWO, NOT = 40, 55, 70


def _word(rank: int) -> str:
    return f"(SELECT token FROM {_RANKED} WHERE r = {rank})"


#: Indexes over documents of this process, by session, folder and the state of its table.
_INDEXES: dict[tuple, TextIndex] = {}
#: Documents of a shard, about.
SHARD = 50_000
#: The most frequent words of each, by its folder.
_FREQUENT: dict[str, list[str]] = {}


def _index(s, d) -> TextIndex:
    """The stored index of a folder's documents: built at the first search and again when they change."""
    key = (s.sparkContext.applicationId, d, stamp(s, f"{d}/documents.parquet"))
    if key not in _INDEXES:
        docs = load(s, d, "documents")
        index = TextIndex(s, shared_path(s, "index"), stemmed=False, shards=1 + docs.count() // SHARD)
        index.add(docs, "doc_id", "text")
        _INDEXES[key] = index
    return _INDEXES[key]


def _words(s, d) -> dict[int, str]:
    """The words that the queries ask for, from the index's lexicon: NOT of them come to the driver."""
    index = _index(s, d)
    if index.path not in _FREQUENT:
        _FREQUENT[index.path] = index.frequent(NOT)
    found = _FREQUENT[index.path]
    return {r: found[min(r, len(found)) - 1] for r in (ONE, TWO, NOT)}


@query(f"SELECT doc_id, round(0.1::DOUBLE * n, 6) AS rank FROM (SELECT doc_id, len(list_filter(t, lambda x: x = w)) AS n FROM {_TOKENS}, (SELECT {_word(ONE)} AS w)) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 50")
def fts_single_term(s, d):
    return _index(s, d).search(_words(s, d)[ONE], 50).select(F.col("key").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id FROM {_TOKENS}, (SELECT {_word(ONE)} AS a, {_word(TWO)} AS b, {_word(NOT)} AS c) WHERE list_contains(t, a) AND list_contains(t, b) AND NOT list_contains(t, c)")
def fts_all_terms_match(s, d):
    w = _words(s, d)
    return _index(s, d).search(f"{w[ONE]} {w[TWO]} -{w[NOT]}", None).select(F.col("key").alias("doc_id"))


@query(f"SELECT doc_id FROM (SELECT doc_id, t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS pairs FROM {_TOKENS}), (SELECT {_word(ONE)} AS a, {_word(TWO)} AS b, {_word(NOT)} AS c) WHERE list_contains(pairs, a || ' ' || b) OR list_contains(t, b) AND list_contains(t, c)")
def fts_phrase_or_match(s, d):
    w = _words(s, d)
    return _index(s, d).search(f'"{w[ONE]} {w[TWO]}" or {w[TWO]} {w[NOT]}', None).select(F.col("key").alias("doc_id"))


@query()
def fts_cover_rank(s, d):
    w = _words(s, d)
    return _index(s, d).search(f'"{w[ONE]} {w[TWO]}" or {w[TWO]} {w[NOT]}', 50).select(F.col("key").alias("doc_id"), "rank")


@query()
def fts_stemmed(s, d):
    """A search for a form that the texts need not hold: they match by their stems, in the index that the other searches have."""
    return _index(s, d).search(_words(s, d)[ONE] + "s", 50, stemmed=True).select(F.col("key").alias("doc_id"), "rank")


_HYBRID = f"""WITH w AS (SELECT {_word(ONE)} AS w), q AS (SELECT * FROM {_SPARSE.format("(SELECT 0 AS doc_id, w AS text FROM w)")}), v AS (SELECT i.doc_id, sum(i.weight * q.weight) AS s FROM {_SPARSE.format('documents')} i JOIN q USING (dim) GROUP BY i.doc_id),
v10 AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS p FROM v QUALIFY p <= 10), t AS (SELECT doc_id, len(list_filter(t, lambda x: x = w)) AS n FROM {_TOKENS}, w),
t10 AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS p FROM t WHERE n > 0 QUALIFY p <= 10), f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + p)) AS f, COUNT(*) AS lists FROM (SELECT * FROM v10 UNION ALL SELECT * FROM t10) GROUP BY doc_id)
SELECT doc_id, round(f / (SELECT max(f) FROM f), 6) AS score, lists, (SELECT COUNT(*) FROM f) AS total FROM f ORDER BY score DESC, doc_id LIMIT 10"""


@query(_HYBRID)
def hybrid_rrf(s, d):
    return rt.search(load(s, d, "documents"), "doc_id", "text", None, _words(s, d)[ONE], limit=10, index=_index(s, d))


@query(f"SELECT doc_id, round(0.1::DOUBLE * n, 6) AS rank FROM (SELECT doc_id, len(list_filter(t, lambda x: x = w)) AS n FROM {_TOKENS}, (SELECT {_word(ONE)} AS w) WHERE doc_id % 10 <> 7) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 50")
def fts_index_generations(s, d):
    """An index built from texts some of which are old, then added to, replaced in part and thinned out, finds what the last state holds."""
    docs, word = load(s, d, "documents").select("doc_id", "text"), _words(s, d)[ONE]
    index = TextIndex(s, shared_path(s, "generations"), stemmed=False)
    index.add(docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(f"{word} " * 20), "text")).otherwise(F.col("text"))), "doc_id", "text")
    index.add(docs.where("doc_id % 3 = 0 or doc_id % 4 = 0"), "doc_id", "text")
    index.remove(docs.where("doc_id % 10 = 7"), "doc_id")
    return index.search(word, 50).select(F.col("key").alias("doc_id"), F.round("rank", 6).alias("rank"))


# --- limiters and citations ------------------------------------------------


def _hits(s, d):
    return load(s, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), "event_id")


#: Hits of each user in order of time, one step after another; what was admitted so far is carried along.
_HITS_SQL = "(SELECT user_id, floor(epoch(ts))::DOUBLE AS s, event_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE h AS MATERIALIZED (SELECT * FROM {_HITS_SQL}), f AS (
SELECT user_id, s, event_id, n, true AS allowed, [s] AS kept FROM h WHERE n = 1 UNION ALL
SELECT user_id, s, event_id, n, len(k) < 3, CASE WHEN len(k) < 3 THEN list_append(k, s) ELSE k END FROM (SELECT h.user_id, h.s, h.event_id, h.n, list_filter(f.kept, lambda x: x >= h.s - 86400) AS k FROM f JOIN h ON h.user_id = f.user_id AND h.n = f.n + 1))
SELECT user_id, s AS "at", event_id, allowed, CAST(greatest(0, 3 - len(kept)) AS INT) AS remaining FROM f""")
def limiter_sliding(s, d):
    return li.admit(_hits(s, d), "user_id", "at", "event_id", li.SlidingLog, 3, 86_400)


@query(f"""WITH RECURSIVE h AS MATERIALIZED (SELECT * FROM {_HITS_SQL}), f AS (
SELECT user_id, s, event_id, n, s AS began, 1 AS c FROM h WHERE n = 1 UNION ALL
SELECT h.user_id, h.s, h.event_id, h.n, CASE WHEN h.s >= f.began + 86400 THEN h.s ELSE f.began END, CASE WHEN h.s >= f.began + 86400 THEN 1 ELSE f.c + 1 END FROM f JOIN h ON h.user_id = f.user_id AND h.n = f.n + 1)
SELECT user_id, s AS "at", event_id, c <= 3 AS allowed, CAST(greatest(0, 3 - c) AS INT) AS remaining FROM f""")
def limiter_fixed_anchor(s, d):
    return li.admit(_hits(s, d), "user_id", "at", "event_id", li.FixedWindow, 3, 86_400)


_CITED = "value > 50"


def _runs(s, d):
    return load(s, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("engine"), "value").withColumn("day", F.to_date("ts"))


_WILSON = "runs, hits, round(hits::DOUBLE / runs, 6) AS p, round(greatest(0, (hits::DOUBLE / runs + 3.8416 / (2 * runs)) / (1 + 3.8416 / runs) - 1.96 * sqrt(hits::DOUBLE / runs * (1 - hits::DOUBLE / runs) / runs + 3.8416 / (4.0 * runs * runs)) / (1 + 3.8416 / runs)), 6) AS low, round(least(1, (hits::DOUBLE / runs + 3.8416 / (2 * runs)) / (1 + 3.8416 / runs) + 1.96 * sqrt(hits::DOUBLE / runs * (1 - hits::DOUBLE / runs) / runs + 3.8416 / (4.0 * runs * runs)) / (1 + 3.8416 / runs)), 6) AS high"


@query(f"SELECT user_id, engine, {_WILSON} FROM (SELECT user_id, event_type AS engine, COUNT(*) AS runs, COUNT(*) FILTER ({_CITED}) AS hits FROM events GROUP BY ALL)")
def cpi_wilson(s, d):
    own = ci.citation_probability(_runs(s, d), F.expr(_CITED), "user_id", "engine")
    return own.select("user_id", "engine", "runs", "hits", *[F.round(c, 6).alias(c) for c in ("p", "low", "high")])


_DAILY = f"(SELECT event_type AS engine, CAST(ts AS DATE) AS day, avg(CASE WHEN {_CITED} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM events GROUP BY ALL)"


def _daily(s, d):
    return _runs(s, d).groupBy("engine", "day").agg(F.avg(F.when(F.expr(_CITED), 1.0).otherwise(0.0)).alias("p"))


@query(f"SELECT engine, CAST(day AS VARCHAR) AS day, round((p - lag(p) OVER (PARTITION BY engine ORDER BY day)) * 100, 4) AS delta FROM {_DAILY}")
def cpi_delta(s, d):
    return ci.change(_daily(s, d), "engine", "day", "p").select("engine", F.col("day").cast("string").alias("day"), F.round("delta", 4).alias("delta"))


@query(f"SELECT a.engine, CAST(a.day AS VARCHAR) AS day, round((a.p - w.p) * 100, 4) AS week, round((a.p - m.p) * 100, 4) AS month FROM {_DAILY} a LEFT JOIN {_DAILY} w ON w.engine = a.engine AND w.day = a.day - 7 LEFT JOIN {_DAILY} m ON m.engine = a.engine AND m.day = a.day - 28")
def cpi_change_windows(s, d):
    daily = _daily(s, d)
    return daily.select("engine", F.col("day").cast("string").alias("day"), *[F.round(ci.change_since(daily, "engine", "day", "p", n), 4).alias(name) for n, name in ((7, "week"), (28, "month"))])


_ENGINES = ["click", "purchase", "view", "search", "signup"]


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, " + ", ".join(f"round(avg(CASE WHEN {_CITED} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (event_type = '{e}'), 6) AS {e}" for e in _ENGINES) + " FROM events GROUP BY 1")
def cpi_trend_pivot(s, d):
    runs = _runs(s, d)
    return ci.trend(runs, F.date_trunc("week", F.col("ts")).cast("date").cast("string"), "engine", _ENGINES, F.expr(_CITED))


_WEEKLY = f"(SELECT event_type AS engine, CAST(date_trunc('week', ts) AS DATE) AS week, avg(CASE WHEN {_CITED} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM events GROUP BY ALL)"


@query(f"SELECT engine, CAST(week AS VARCHAR) AS week, coalesce(n = 3 AND abs(p - m) > sd, false) AS drift FROM (SELECT engine, week, p, avg(p) OVER w AS m, stddev_samp(p) OVER w AS sd, COUNT(p) OVER w AS n FROM {_WEEKLY} WINDOW w AS (PARTITION BY engine ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))")
def cpi_drift_weekly(s, d):
    weekly = _runs(s, d).groupBy("engine", F.date_trunc("week", F.col("ts")).cast("date").alias("week")).agg(F.avg(F.when(F.expr(_CITED), 1.0).otherwise(0.0)).alias("p"))
    return ci.drift(weekly, "engine", "week", "p", 3, 1.0).select("engine", F.col("week").cast("string").alias("week"), "drift")


@query(f"SELECT engine, CAST(day AS VARCHAR) AS day, coalesce(n = 8 AND abs(p - m) > 3 * sd, false) AS drift FROM (SELECT engine, day, p, avg(p) OVER w AS m, stddev_samp(p) OVER w AS sd, COUNT(p) OVER w AS n FROM {_DAILY} WINDOW w AS (PARTITION BY engine ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))")
def cpi_drift(s, d):
    return ci.drift(_daily(s, d), "engine", "day", "p").select("engine", F.col("day").cast("string").alias("day"), "drift")


@query(f"SELECT engine, a.high < b.low OR b.high < a.low AS significant FROM (SELECT engine, {_WILSON} FROM (SELECT event_type AS engine, COUNT(*) AS runs, COUNT(*) FILTER ({_CITED}) AS hits FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL)) a JOIN (SELECT engine, {_WILSON} FROM (SELECT event_type AS engine, COUNT(*) AS runs, COUNT(*) FILTER ({_CITED}) AS hits FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)) b USING (engine)")
def cpi_significance(s, d):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    both = ci.citation_probability(_runs(s, d).withColumn("late", F.col("ts") >= cut), F.expr(_CITED), "engine", "late")
    sides = both.groupBy("engine").agg(*[F.max(F.when(F.col("late") == late, F.col(c))).alias(f"{c}_{n}") for late, n in ((False, "a"), (True, "b")) for c in ("low", "high")])
    return sides.where("low_a is not null and low_b is not null").select("engine", ci.significant(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b")).alias("significant"))


@query(f"SELECT engine, citations, round(citations::DOUBLE / (SELECT COUNT(*) FROM events WHERE {_CITED}), 6) AS share FROM (SELECT event_type AS engine, COUNT(*) FILTER ({_CITED}) AS citations FROM events GROUP BY 1)")
def share_of_voice(s, d):
    return ci.share_of_voice(_runs(s, d), F.expr(_CITED), "engine").select("engine", "citations", F.round("share", 6).alias("share"))


@query(f"SELECT user_id, COUNT(*) AS used, greatest(0, 200 - COUNT(*)) AS remaining, round(least(1, COUNT(*) / 200.0::DOUBLE), 6) AS use FROM events GROUP BY user_id")
def quota_usage(s, d):
    from folioscope.operators.relational import remaining

    own = _runs(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    return own.select("user_id", "used", remaining(F.lit(200), F.col("used")).cast("long").alias("remaining"), F.round(tx.clamp(F.col("used") / 200.0), 6).alias("use"))


@query(f"SELECT round(avg(CASE WHEN {_CITED} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS mean_p, COUNT(DISTINCT user_id) AS active, COUNT(*) AS runs, 10000 AS run_limit FROM events")
def dashboard_tiles(s, d):
    return _runs(s, d).agg(F.round(F.avg(F.when(F.expr(_CITED), 1.0).otherwise(0.0)), 6).alias("mean_p"), F.countDistinct("user_id").alias("active"), F.count(F.lit(1)).alias("runs"), F.lit(10000).alias("run_limit"))


@query(rf"SELECT conv_id, round(sum(w * exp(-turn::DOUBLE / n)) / sum(w), 6) AS pwc FROM (SELECT conv_id, turn, {WORDS} AS w, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant') GROUP BY conv_id HAVING sum(w) > 0")
def pwc(s, d):
    own = load(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", tx.word_count(F.col("text")).alias("w"))
    n = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return own.join(n, "conv_id").groupBy("conv_id").agg((F.sum(ci.position_weighted(F.col("w"), F.col("turn"), F.col("n"))) / F.sum("w")).alias("pwc"), F.sum("w").alias("all")).where("all > 0").select("conv_id", F.round("pwc", 6).alias("pwc"))


@query("SELECT item_id, t AS temperature, r AS run_index FROM benchmark, unnest([0.0::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE]) AS x(t), range(1, 11) AS y(r)")
def plan_grid(s, d):
    return ci.plan_grid(load(s, d, "benchmark").select("item_id"), 10, [0.0, 0.7, 1.0]).withColumn("run_index", F.col("run_index").cast("long"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%' || (SELECT split_part(p_name, ' ', 1) FROM part ORDER BY p_partkey LIMIT 1) || '%'")
def palette_filter(s, d):
    from folioscope.operators.relational import contains_text

    part = load(s, d, "part")
    typed = part.orderBy("p_partkey").first()["p_name"].split(" ")[0]  # what a user types: a word of some name
    return part.where(contains_text("p_name", f" {typed.upper()} ")).select("p_partkey", "p_name")


# --- streams ---------------------------------------------------------------


def _streamed(s, d, make, mode: str = "append", files: int = 1):
    """make over events as a stream of so many files; folders are in spark.checkpoint.dir, and beside the session's own on one machine."""
    from folioscope.streaming import queue

    base = shared_path(s, "stream")
    events = load(s, d, "events")
    (events if files == 1 else events.repartition(files)).write.parquet(f"{base}/in")
    made = make(queue, queue.jobs_stream(s, f"{base}/in", events.schema))
    queue.run_available(made, f"{base}/out", f"{base}/state", mode)
    return s.read.schema(made.schema).parquet(f"{base}/out")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_claim_once(s, d):
    return _streamed(s, d, lambda q, e: q.claim_once(e, "event_id").select("event_id", "user_id", "event_type"), files=3)


@query("SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type = 'view'")
def stream_stale_sweep(s, d):
    from folioscope.operators.changes import stale

    old = stale(None, "event_type", "view", "ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    return _streamed(s, d, lambda q, e: e.where(old).select("event_id", "user_id"))


