"""Markdown to heading-aware, token-bounded, overlapping chunks.

A document is a fold over its blocks (whether a chunk is full, and what it
overlaps with, depends on all before it), so it is one Python function; many
documents go through it side by side as Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.conf import EngineConf
from folioscope.functions.text import SENTENCE, WORDS_PER_TOKEN

_FENCE, _TITLE, _SENTENCE = re.compile(r"\s*(?:```|~~~)"), re.compile(r"(#{1,6})\s+(.*)"), re.compile(SENTENCE)


@dataclass
class Chunk:
    content: str
    heading_path: str | None


def tokens_of(text: str) -> int:
    n = len(text.split())
    return max(1, round(n * WORDS_PER_TOKEN)) if n else 0


def _fenced(text: str) -> Iterator[tuple[str, bool]]:
    """Lines, each with whether it belongs to a code block."""
    inside = False
    for line in text.splitlines():
        mark = bool(_FENCE.match(line))
        yield line, inside or mark
        inside ^= mark


def sections(markdown: str) -> Iterator[tuple[str | None, str]]:
    """(heading path, text with its heading) of every section that holds anything."""
    path: list[str] = []
    held: list[str] = []
    name = None
    for line, code in _fenced(markdown):
        title = None if code else _TITLE.fullmatch(line.strip())
        if title:
            if body := "\n".join(held).strip():
                yield name, body
            path = [*path[: len(title[1]) - 1], title[2].strip()]
            name, held = " > ".join(path), [line.strip()]
        else:
            held.append(line)
    if body := "\n".join(held).strip():
        yield name, body


def paragraphs(text: str) -> list[str]:
    """Blocks between blank lines; those within a code block part nothing."""
    out: list[list[str]] = [[]]
    for line, code in _fenced(text):
        if code or line.strip():
            out[-1].append(line)
        else:
            out.append([])
    return [b for lines in out if (b := "\n".join(lines).strip())]


def fit(block: str, budget: int) -> list[str]:
    """A block as parts within the budget: sentences, else lines, packed in turn; what is still too long is cut by words."""
    parts = [s for p in _SENTENCE.split(block) if (s := p.strip())]
    if len(parts) < 2:
        parts = [s for p in block.split("\n") if (s := p.strip())] or [block]
    out, now, step = [], "", max(1, int(budget / WORDS_PER_TOKEN))
    for part in parts:
        longer = f"{now} {part}" if now else part
        if now and tokens_of(longer) > budget:
            out.append(now)
            longer = part
        if tokens_of(longer) > budget:
            words = longer.split()
            out += [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
            longer = ""
        now = longer
    return [p for p in [*out, now] if p.strip()]


def tail(text: str, budget: int) -> str:
    return " ".join(text.split()[-max(1, int(budget / WORDS_PER_TOKEN)) :]) if budget > 0 else ""


def chunks(markdown: str | None, conf: EngineConf | None = None) -> list[Chunk]:
    """Chunks in order. A piece too small for itself is added to the chunk before it, under that one's heading."""
    conf = conf or EngineConf()
    out: list[Chunk] = []
    before = ""
    for path, body in sections((markdown or "").strip()):
        for group in _groups(body, conf.chunk_size):
            own = "\n\n".join(group).strip()
            lead = tail(before, conf.overlap)
            whole = f"{lead}\n\n{own}".strip() if lead else own
            if out and tokens_of(whole) < conf.min_tokens:
                out[-1].content = before = f"{out[-1].content}\n\n{own}".strip()
            else:
                out.append(Chunk(whole, path))
                before = own
        if len(out) >= conf.max_chunks:
            break
    return out[: conf.max_chunks]


def _groups(body: str, budget: int) -> Iterator[list[str]]:
    """Blocks of a section gathered up to the budget."""
    held: list[str] = []
    size = 0
    for block in paragraphs(body):
        for part in fit(block, budget) if tokens_of(block) > budget else [block]:
            n = tokens_of(part)
            if held and size + n > budget:
                yield held
                held, size = [], 0
            held.append(part)
            size += n
            if size >= budget:
                yield held
                held, size = [], 0
    if held:
        yield held


#: Documents whose chunks are in memory at a time.
TOGETHER = 256


def chunk_documents(docs: DataFrame, key: str, markdown: str, conf: EngineConf | None = None) -> DataFrame:
    """Rows key, chunk_index, content, token_count, char_count, heading_path, is_cut; documents without text have none.

    is_cut is true in all chunks of a document that conf.max_chunks ends before its own end.
    """
    conf = conf or EngineConf()
    whole = replace(conf, max_chunks=conf.max_chunks + 1)  # one more shows whether any is left

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole.iloc[a : a + TOGETHER] for whole in parts for a in range(0, len(whole), TOGETHER)):
            rows = []
            for k, m in zip(part[key], part[markdown], strict=True):
                own = chunks(m, whole)
                rows += [(k, i, c.content, tokens_of(c.content), len(c.content), c.heading_path, len(own) > conf.max_chunks) for i, c in enumerate(own[: conf.max_chunks])]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "content", "token_count", "char_count", "heading_path", "is_cut"])

    kinds = [docs.schema[key], T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("token_count", T.IntegerType()), T.StructField("char_count", T.IntegerType()), T.StructField("heading_path", T.StringType()), T.StructField("is_cut", T.BooleanType())]
    return docs.select(key, markdown).mapInPandas(cut, T.StructType(kinds))
