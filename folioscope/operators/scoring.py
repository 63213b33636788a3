"""The four sub-scores and their composite, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.conf import EngineConf
from folioscope.functions import text as tx

# Rubrics, and the patterns of evidence.
TECHNICAL = {"https": 0.10, "canonical": 0.12, "meta_description": 0.12, "json_ld": 0.18, "heading_structure": 0.15, "sitemap": 0.08, "language": 0.07, "viewport": 0.08, "response_time": 0.10}
EVIDENCE_TARGETS = {"numbers": 4.0, "percentages": 0.6, "dates": 0.8, "units": 0.8, "citations": 1.2, "quotes": 0.3}
EVIDENCE = {"numbers": 0.22, "percentages": 0.16, "dates": 0.14, "units": 0.10, "citations": 0.22, "quotes": 0.16}
MACHINE = {"headings": 0.20, "lists": 0.15, "tables": 0.10, "paragraph_length": 0.15, "boilerplate": 0.15, "semantic_html": 0.10, "structured_data": 0.15}
LONG_PARAGRAPH, BOILERPLATE_CEILING, GOOD_RESPONSE_MS = 120, 0.35, 2000
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
NUMBER = r"\b\d[\d,.]*\b"
PERCENT = r"(?i)\b\d[\d,.]*\s?(?:%|percent\b|percentage points?\b)"
YEAR = r"\b(?:19|20)\d{2}\b"
DATE = rf"(?i)\b(?:\d{{1,2}}\s+(?:{MONTHS})[a-z]*\.?\s+\d{{2,4}}|(?:{MONTHS})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{2,4}})\b"
UNIT = r"(?i)\b\d[\d,.]*\s?(?:kg|g|mg|km|m|cm|mm|mi|ft|in|lb|oz|ml|l|gb|mb|kb|tb|ms|s|min|h|hr|hours?|days?|weeks?|months?|years?|usd|eur|gbp|\$|€|£)\b"
CITATION = r"\[[^\]]+\]\((?!#)[^)]+\)"
QUOTE = "(?:“[^”]{15,}”|\"[^\"]{15,}\")"


def _counted(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def evidence_counts(text: Column) -> dict[str, Column]:
    """Occurrences of each kind of evidence; a full date counts its year once more."""
    return {
        "numbers": _counted(text, NUMBER), "percentages": _counted(text, PERCENT), "dates": _counted(text, YEAR) + _counted(text, DATE),
        "units": _counted(text, UNIT), "citations": _counted(text, CITATION), "quotes": _counted(text, QUOTE),
    }


def evidence_score(counts: dict[str, Column], n_words: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in EVIDENCE.items():
        out = out + weight * tx.saturate(tx.per_100(counts[name], n_words), EVIDENCE_TARGETS[name])
    return F.when(n_words > 0, tx.clamp(out)).otherwise(0.0)


def with_evidence(df: DataFrame, text: Column, n_words: Column | None = None) -> tuple[DataFrame, dict[str, Column], Column]:
    """df with the counts and the words as columns, and those columns: the patterns run once for each text, however often a score names them."""
    counts = evidence_counts(text)
    out = df.select("*", *[c.alias(f"_n_{n}") for n, c in counts.items()], (tx.word_count(text) if n_words is None else n_words).alias("_words"))
    return out, {n: F.col(f"_n_{n}") for n in counts}, F.col("_words")


def flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def number(value: Column, missing: float = 0.0) -> Column:
    """A number from anything; what is missing or no number takes the default."""
    return F.coalesce(value.try_cast("double"), F.lit(missing))


def technical_checks(url: Column, canonical: Column, description: Column, json_ld: Column, headings: Column, sitemap: Column, lang: Column, viewport: Column, response_ms: Column) -> dict[str, Column]:
    return {
        "https": F.coalesce(F.startswith(url, F.lit("https://")), F.lit(False)), "canonical": flag(canonical), "meta_description": flag(description), "json_ld": flag(json_ld), "heading_structure": flag(headings),
        "sitemap": flag(sitemap), "language": flag(lang), "viewport": flag(viewport), "response_time": F.coalesce(response_ms <= GOOD_RESPONSE_MS, F.lit(False)),
    }


def technical_score(checks: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in TECHNICAL.items():
        out = out + F.when(checks[name], weight).otherwise(0.0)
    return tx.clamp(out)


def machine_parts(headings_ok: Column, has_lists: Column, has_tables: Column, paragraph_words: Column, boilerplate: Column, semantic: Column, json_ld: Column) -> dict[str, Column]:
    return {
        "headings": flag(headings_ok).cast("double"), "lists": flag(has_lists).cast("double"), "tables": flag(has_tables).cast("double"),
        "paragraph_length": tx.saturate(F.greatest(F.lit(0.0), (LONG_PARAGRAPH - number(paragraph_words)) / LONG_PARAGRAPH), 0.6),
        "boilerplate": 1 - tx.saturate(number(boilerplate, 1.0), BOILERPLATE_CEILING), "semantic_html": tx.saturate(number(semantic), 0.6), "structured_data": flag(json_ld).cast("double"),
    }


def machine_score(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in MACHINE.items():
        out = out + weight * parts[name]
    return tx.clamp(out)


def composite(parts: dict[str, Column], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """pcs, missing and effective_weight: the mean over parts that aren't null, by weights made to sum to 1 again."""
    weights = weights or EngineConf().weights
    total, used = F.lit(0.0), F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.when(parts[name].isNotNull(), weight * parts[name]).otherwise(0.0)
        used = used + F.when(parts[name].isNotNull(), weight).otherwise(0.0)
    absent = F.array_sort(F.array_compact(F.array(*[F.when(parts[n].isNull(), F.lit(n)) for n in weights])))
    return {"pcs": F.when(used > 0, tx.clamp(total / used)), "missing": absent, "effective_weight": used}


def passed(checks: dict[str, Column], want: bool = True) -> Column:
    """Sorted names of the checks that hold, or that don't."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c == F.lit(want), F.lit(n)) for n, c in checks.items()])))


def densities(counts: dict[str, Column], n_words: Column) -> Column:
    """Struct of each kind of evidence for 100 words."""
    return F.struct(*[F.bround(tx.per_100(c, n_words), 3).alias(n) for n, c in counts.items()])


def explanation(checks: dict[str, Column], parts: dict[str, Column], made: dict[str, Column], evidence: tuple[dict[str, Column], Column] | None = None) -> Column:
    """JSON of what passed and failed, of the components and, with evidence (counts, words), of what was counted and how densely."""
    shown = F.struct(*[F.bround(parts[n], 3).alias(n) for n in parts])
    found = [] if evidence is None else [F.when(evidence[1] > 0, F.struct(F.struct(*[c.alias(n) for n, c in evidence[0].items()]).alias("counts"), densities(*evidence).alias("densities"), evidence[1].alias("words"))).alias("evidentiary")]
    return F.to_json(F.struct(*found, F.struct(passed(checks).alias("passed"), passed(checks, False).alias("failed")).alias("technical"), shown.alias("components"), F.bround(made["pcs"], 4).alias("pcs"), made["missing"].alias("missing"), F.bround(made["effective_weight"], 3).alias("effective_weight")))


def score_pages(pages: DataFrame) -> DataFrame:
    """A scorecard for each page (page_id, url, html): the parts that a page alone gives, and the composite over them."""
    from folioscope.functions import html as hx

    read = pages.select("page_id", "url", tx.json_ld_types(F.col("html")).alias("json_ld"), hx.read_page(F.col("html"), F.col("url")).alias("p"))
    checks = technical_checks(F.col("url"), F.coalesce(F.col("p.canonical_url"), F.lit("")) != "", F.col("p.meta_description").isNotNull(), F.size("json_ld") > 0, hx.headings_valid(F.col("p.headings")), F.col("p.sitemap_url").isNotNull(), F.col("p.lang").isNotNull(), F.col("p.viewport").isNotNull(), F.lit(None).cast("int"))
    read, counts, n_words = with_evidence(read, F.col("p.markdown"), F.col("p.word_count"))
    parts = machine_parts(hx.headings_valid(F.col("p.headings")) & F.regexp_like("p.markdown", F.lit(tx.HEADING)), F.col("p.has_lists"), F.col("p.has_tables"), F.col("p.avg_paragraph_words"), F.col("p.boilerplate_ratio"), hx.semantic_score(F.col("p.semantic_tags")), F.size("json_ld") > 0)
    scored = read.select("page_id", "url", F.col("p.title").alias("title"), F.col("p.word_count").alias("words"), technical_score(checks).alias("technical"), evidence_score(counts, n_words).alias("evidentiary"), machine_score(parts).alias("machine"), F.lit(None).cast("double").alias("semantic"), *[c.alias(f"_{n}") for n, c in checks.items()], *[F.col(f"_n_{n}") for n in counts], "_words")
    own = {n: F.col(n) for n in ("technical", "semantic", "evidentiary", "machine")}
    made = composite(own)
    return scored.select("page_id", "url", "title", "words", *[F.round(n, 6).alias(n) for n in ("technical", "evidentiary", "machine")], F.round(made["pcs"], 6).alias("pcs"), F.array_join(made["missing"], ",").alias("missing"), explanation({n: F.col(f"_{n}") for n in checks}, own, made, ({n: F.col(f"_n_{n}") for n in counts}, F.col("_words"))).alias("explanation"))
