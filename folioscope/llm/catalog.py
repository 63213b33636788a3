"""The training-data queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from folioscope.llm import collocations, flac, lattice, licences, mixing, negatives, packing, pii, quality, secrets, sharding, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_simhash": simhash.op2_simhash,
        "op3_flac": flac.op3_flac,
        "op4_mixing": mixing.op4_mixing,
        "op5_packing": packing.op5_packing,
        "op6_warc": warc.op6_warc,
        "op7_pii": pii.op7_pii,
        "op8_sharding": sharding.op8_sharding,
        "op9_licences": licences.op9_licences,
        "op10_lattice": lattice.op10_lattice,
        "op11_secrets": secrets.op11_secrets,
        "op12_collocations": collocations.op12_collocations,
        "op13_negatives": negatives.op13_negatives,
        "pipeline": corpus_pipeline.run,
    }


#: Payloads and their digests, the first page of each that is long enough, and what the others refer to.
_WARC_SQL = f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS g FROM pages),
f AS (SELECT g, min(page_id) AS first FROM d WHERE n >= {warc.LEAST_BYTES} GROUP BY g)
SELECT d.page_id, d.n AS payload_bytes, d.g AS payload_digest, CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.g = f.g AND d.n >= {warc.LEAST_BYTES}"""

#: All pairs of a label, and all that links reach.
_LATTICE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {lattice.THRESHOLD}),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.vec_id),
n AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a)
SELECT r.vec_id, coalesce(max(n.n), 0) AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id"""


def _judged_sql(name: str, units: str, templates: tuple[tuple[str, str], ...]) -> str:
    """Tables that end in {name}_best: licence and cosine of each text in units (line) that reaches the least cosine."""
    weights, unseen = licences.template_weights(templates)
    rows = ", ".join(f"({t}, '{n}', '{term}', {w:.17e}, {i:.17e})" for t, n, term, w, i in weights)
    return rf"""
{name}_w(template, licence, term, weight, idf) AS (VALUES {rows}),
{name}_words AS (SELECT line, regexp_extract_all(lower(line), '{licences._TERM}') AS ws FROM (SELECT DISTINCT line FROM {units})),
{name}_bags AS (SELECT line, term, COUNT(*) AS tf FROM (SELECT line, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM {name}_words) GROUP BY ALL),
{name}_weighed AS (SELECT line, term, tf * coalesce(idf, {unseen:.17e}) AS x FROM {name}_bags LEFT JOIN (SELECT DISTINCT term, idf FROM {name}_w) USING (term)),
{name}_norms AS (SELECT line, sqrt(sum(x * x)) AS norm FROM {name}_weighed GROUP BY line),
{name}_scored AS (SELECT line, licence, round(dot / norm, 9) AS cosine FROM (SELECT line, template, licence, sum(x * weight) AS dot FROM {name}_weighed JOIN {name}_w USING (term) GROUP BY ALL) JOIN {name}_norms USING (line)),
{name}_best AS (SELECT line, licence, cosine FROM {name}_scored WHERE cosine >= {licences.LEAST_COSINE} QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, licence) = 1)"""


def _licences_sql() -> str:
    """All lines, blocks and whole licence files against their templates; then the folder's LICENSE where a file names none."""
    marks = licences.MARKS.replace("'", "''")
    return rf"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS folder FROM documents),
d AS (SELECT doc_id, text, folder, doc_id IS NOT NULL AND doc_id = min(doc_id) OVER (PARTITION BY folder) AS is_licence FROM f),
lines AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM d),
headers AS (SELECT doc_id, trim(regexp_replace(regexp_replace(block, '{marks}', '', 'g'), '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{licences.BLOCK_END}')) AS block FROM d) WHERE contains(trim(block), chr(10))),
wholes AS (SELECT doc_id, text AS line FROM d WHERE is_licence),{_judged_sql("line", "lines", licences.TEMPLATES)},{_judged_sql("header", "headers", licences.BLOCK_TEMPLATES)},{_judged_sql("whole", "wholes", licences.file_templates())},
hits AS (SELECT doc_id, licence, cosine FROM lines JOIN line_best USING (line) UNION ALL SELECT doc_id, licence, cosine FROM headers JOIN header_best USING (line) UNION ALL SELECT doc_id, licence, cosine FROM wholes JOIN whole_best USING (line)),
own AS (SELECT doc_id, licence, cosine FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1),
g AS (SELECT folder, folder || '/LICENSE' AS path, licence, cosine FROM d JOIN own USING (doc_id) WHERE is_licence)
SELECT d.doc_id, d.folder || '/' || CASE WHEN d.is_licence THEN 'LICENSE' ELSE d.doc_id || '.txt' END AS path, coalesce(own.licence, g.licence) AS licence, coalesce(own.cosine, g.cosine) AS cosine,
CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN g.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own.licence IS NULL THEN g.path END AS inherited_from FROM d LEFT JOIN own USING (doc_id) LEFT JOIN g USING (folder)"""


def _secrets_sql() -> str:
    """Every rule on every text; the places of its matches are sums of the lengths of the matches and of the texts between them."""
    found = " UNION ALL ".join(rf"""
SELECT doc_id, row, {i} AS rule, '{r.kind}' AS kind, s AS start, s + m AS "end" FROM (SELECT doc_id, row, m, value, sum(gap) OVER w + sum(m) OVER w - m AS s FROM (
SELECT doc_id, row, unnest(range(len(ms))) AS i, length(unnest(ms)) AS m, unnest(vs) AS value, length(unnest(gaps[1:len(ms)])) AS gap FROM (
SELECT doc_id, row, regexp_extract_all(text, p) AS ms, regexp_extract_all(text, p, {r.group}) AS vs, regexp_split_to_array(text, p) AS gaps FROM d, (SELECT '{r.pattern.replace("'", "''")}' AS p)) WHERE len(ms) > 0) WINDOW w AS (PARTITION BY row ORDER BY i)) WHERE length(value) >= {r.least}""" for i, r in enumerate(secrets.RULES))
    spans = """coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rule){0}, '')"""
    base = f" FILTER (rule < {len(secrets.BASE)})"
    counts = ", ".join(f"COUNT(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents), f AS ({found})
SELECT d.doc_id, {counts}, sha256({spans.format(base)}) AS base_sha256, {spans.format("")} AS spans FROM d LEFT JOIN f USING (row) GROUP BY row, d.doc_id"""


#: All words and phrases of up to three words, counted one by one.
_COLLOCATIONS_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
one AS (SELECT lang, x AS phrase, COUNT(*) AS a FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
two AS (SELECT lang, x[1] AS b, x[2] AS c, COUNT(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS x FROM w) GROUP BY ALL HAVING COUNT(*) >= {collocations.LEAST}),
three AS (SELECT lang, x[1] AS b, x[2] AS c, x[3] AS d, COUNT(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS x FROM w) GROUP BY ALL HAVING COUNT(*) >= {collocations.LEAST}),
longer AS (SELECT lang, b, c, max(a) AS a FROM (SELECT lang, b, c, a FROM three UNION ALL SELECT lang, c, d, a FROM three) GROUP BY ALL),
cuts AS (SELECT t.lang, t.b || ' ' || t.c AS phrase, t.a, 1 AS k, l.a AS l, r.a AS r FROM two t JOIN one l ON l.lang = t.lang AND l.phrase = t.b JOIN one r ON r.lang = t.lang AND r.phrase = t.c LEFT JOIN longer m ON m.lang = t.lang AND m.b = t.b AND m.c = t.c WHERE m.a IS NULL OR 100 * m.a < {collocations.COVERED} * t.a
UNION ALL SELECT t.lang, t.b || ' ' || t.c || ' ' || t.d, t.a, 1, l.a, r.a FROM three t JOIN one l ON l.lang = t.lang AND l.phrase = t.b JOIN two r ON r.lang = t.lang AND r.b = t.c AND r.c = t.d
UNION ALL SELECT t.lang, t.b || ' ' || t.c || ' ' || t.d, t.a, 2, l.a, r.a FROM three t JOIN two l ON l.lang = t.lang AND l.b = t.b AND l.c = t.c JOIN one r ON r.lang = t.lang AND r.phrase = t.d),
best AS (SELECT lang, phrase, a, l, r, CAST({collocations.SCALE}::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY {collocations.SCALE}::HUGEINT * a * a // (l::HUGEINT * r), k) = 1),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM one GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) QUALIFY rank <= {collocations.FIRST}"""

#: All anchors against all rows.
_NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1),
s AS (SELECT a.vec_id AS anchor_id, u.vec_id, u.label = a.label AS same, CAST(list_inner_product(a.e, u.e) AS BIGINT) AS score FROM u a JOIN u ON u.vec_id <> a.vec_id AND len(u.e) = len(a.e) WHERE a.vec_id % {negatives.ANCHORS} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= {negatives.NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    """The other operators rest on hashes, tokenizers, codecs or models that SQL lacks; the tests hold them against brute force."""
    return {"op6_warc": _WARC_SQL, "op9_licences": _licences_sql(), "op10_lattice": _LATTICE_SQL, "op11_secrets": _secrets_sql(), "op12_collocations": _COLLOCATIONS_SQL, "op13_negatives": _NEGATIVES_SQL}
