"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down the directories.

A file's text is cut into lines, and into blocks: neighbouring lines with their
comment marks taken off, as wrapped headers are. The terms of each (words and
pairs of words) are weighted by TF-IDF, with the document frequencies of the
templates, and held against every template by sparse cosine: an equi-join on
terms, so that only what shares a term with a template is looked at. Lines are
held against short notices, blocks against notices and standard headers, and a
licence file's whole text against full texts (licence_texts) and SPDX lines as
well. A file's licence is that of the highest cosine; of equal ones that first
by name counts. A file without one takes that of the nearest ancestor directory
which holds a licence file; paths are exploded to their ancestors and joined on
equality.

Templates are few and fixed, so their terms are a small table of a size known
beforehand, and the join is a broadcast one. Equal lines and blocks of the whole
corpus are judged once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm._common import stored, table

#: A line names a licence from this cosine.
LEAST_COSINE = 0.6
#: Names of files whose licence the files below their directory inherit.
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicense|notice)(?:[.-][A-Za-z0-9.-]*)?$"

# Short licence notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Standard headers, as they stand at the top of files.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)
#: What blocks are held against.
BLOCK_TEMPLATES = TEMPLATES + HEADERS
#: Where blocks end, and the comment marks that lines of a block begin with.
BLOCK_END, MARKS = r"\n[ \t\r]*\n", r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|;+|--+|%+)?[ \t]*"
#: Folders, with their first files or givers of inherited licences, are broadcast up to so many.
BROADCAST = 100_000
#: Words of templates that are common elsewhere; key_words leaves out those that alone can't carry a line to LEAST_COSINE.
COMMON = (
    "the", "of", "to", "a", "and", "in", "is", "with", "this", "by", "any", "use", "you", "are", "not", "may", "under", "into", "that", "for", "be", "have", "or", "at", "one", "it", "an", "as", "if", "was", "can", "on", "even", "see", "more", "will", "should", "hope", "found", "either", "along", "without", "but", "its", "from", "out",
    "work", "free", "file", "version", "code", "software", "program", "terms", "form", "forms", "source", "person", "subject", "charge", "copy", "general", "public", "except", "v", "2", "3", "released", "international", "i", "write", "inc", "law", "kind", "language", "later", "option", "useful", "details", "received",
)
_TERM = "[a-z0-9.+-]*[a-z0-9+]"


def terms(text: Column) -> Column:
    """Words and pairs of neighbouring words, lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))

    def both(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))

    return F.element_at(F.transform(F.array(words), both), 1)  # words worked out once


def _terms(text: str) -> list[str]:
    words = re.findall(_TERM, text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def template_weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple], float]:
    """(template, licence, term, unit weight, idf) rows, and the idf of a term that no template has."""
    bags = [Counter(_terms(t)) for _, t in templates]
    seen = Counter(term for b in bags for term in b)
    n = len(bags)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in seen.items()}
    rows = []
    for i, (name, _) in enumerate(templates):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in bags[i].items()))
        rows += [(i, name, t, c * idf[t] / norm, idf[t]) for t, c in sorted(bags[i].items())]
    return rows, math.log(1 + n) + 1


@lru_cache(maxsize=1)
def file_templates() -> tuple[tuple[str, str], ...]:
    """What a licence file's whole text is held against: the notices, their SPDX lines and the full texts."""
    names = sorted({name for name, _ in TEMPLATES})
    full = {name: text.read_text("utf-8") for name in names if (text := resources.files("folioscope.llm") / "licence_texts" / f"{name}.txt").is_file()}
    # the text of the AGPL is the GPL's but for its name and one section
    full["AGPL-3.0"] = re.sub(r"(?i)(GNU\s+)(General\s+Public)", r"\1Affero \2", full["GPL-3.0"])
    return TEMPLATES + tuple((name, f"SPDX-License-Identifier: {name}") for name in names) + tuple(sorted(full.items()))


@lru_cache(maxsize=4)
def key_words(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[str, ...]:
    """Words of which a line that reaches LEAST_COSINE with a template holds one at least.

    By Cauchy and Schwarz the terms made of other words give a line at most
    the norm of their weights in a template, and that stays below LEAST_COSINE.
    """
    rows = template_weights(templates)[0]
    light: set[str] = set()
    for word in COMMON:
        tried, sums = light | {word}, Counter()
        for template, _, term, weight, _ in rows:
            if set(term.split()) <= tried:
                sums[template] += weight * weight
        if max(sums.values(), default=0) < LEAST_COSINE**2 - 1e-6:
            light = tried
    return tuple(sorted({w for r in rows for w in r[2].split()} - light))


def may_name(line: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """Whether one of key_words is a term of the line."""
    words = "|".join(map(re.escape, key_words(templates)))
    return F.regexp_like(F.lower(line), F.lit(rf"(?<![a-z0-9.+-])(?:{words})(?![.-]*[a-z0-9+])"))


def blocks(text: Column) -> Column:
    """Array of the blocks of two lines or more, each on one line without comment marks."""
    parts = F.filter(F.split(text, BLOCK_END, -1), lambda b: F.contains(F.trim(b), F.lit("\n")))
    return F.transform(parts, lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, MARKS, ""), r"\s+", " ")))


def _first_of_best(cosine: str = "cosine") -> Column:
    """What orders judgements: the cosine, then the first name."""
    return F.struct(cosine, F.transform(F.split(F.col("licence"), ""), lambda c: -F.ascii(c)))


def _squares(found: Column) -> Column:
    """The sum of the squares of how often each term of an array occurs."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, term: Column) -> Column:
        run = F.when(acc["last"] == term, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(term.alias("last"), run.alias("run"), (acc["sum"] + 2 * run - 1).alias("sum"))  # (r + 1)^2 - r^2

    return F.aggregate(F.array_sort(found), start, step)["sum"]


def marked(units: DataFrame) -> DataFrame:
    """units (line and others) with the mark that the line is known by: a term's row carries that, never the line itself."""
    return units.withColumn("mark", F.unhex(F.sha2("line", 256)))


def judge_marked(units: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """licence and cosine of each distinct mark of units (mark, line) whose line reaches LEAST_COSINE with a template; ties go to the first by name.

    Terms that no template has count in the norm alone, by a sum made where
    the line is. Only terms that templates have are counted by line and term.
    """
    spark = units.sparkSession
    weights, unseen = template_weights(templates)
    known = spark.createDataFrame(weights, "template int, licence string, term string, weight double, idf double")  # bounded by the templates: fit to broadcast
    idf = known.select("term", "idf").distinct()
    one = units.select("mark", "line").dropDuplicates(["mark"]).select("mark", terms(F.col("line")).alias("terms"))
    one = one.withColumn("all", _squares(F.col("terms")))  # beside explode() it would be worked out for each term
    bags = one.select("mark", "all", F.explode("terms").alias("term")).join(F.broadcast(idf), "term").groupBy("mark", "term", "idf").agg(F.count(F.lit(1)).alias("tf"), F.first("all").alias("all"))
    weighed = bags.withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("mark").agg(F.sqrt(F.sum(F.col("w") * F.col("w")) + (F.first("all") - F.sum(F.col("tf") * F.col("tf"))) * F.lit(unseen * unseen)).alias("norm"))
    dots = weighed.join(F.broadcast(known.select("template", "licence", "term", "weight")), "term").groupBy("mark", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "mark").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= LEAST_COSINE)
    return scored.groupBy("mark").agg(F.max_by(F.struct("licence", "cosine"), _first_of_best()).alias("best")).select("mark", "best.licence", "best.cosine")


def judge_lines(lines: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """licence and cosine of each distinct line of lines (line), as judge_marked gives them."""
    own = marked(lines.select("line"))
    return own.join(judge_marked(own, templates), "mark").dropDuplicates(["mark"]).select("line", "licence", "cosine")


def scan(files: DataFrame) -> DataFrame:
    """file_id, path, licence, cosine, origin, inherited_from of every row of files (file_id, path, text).

    origin is own (a line, a block or a licence file's whole text names the licence), inherited (the
    nearest ancestor directory with a licence file gives it) or none. Null
    texts are empty; a null path has no ancestors. Of several licence files
    in a directory that with the highest cosine counts, then the first path.
    Repeated rows come back as often as they are. Other columns are neither
    read nor returned. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # what can't reach the cosine is never split into terms
    lines = files.select("file_id", "path", F.explode(F.split(text, "\n")).alias("line")).where(may_name(F.col("line")))
    lines = stored(marked(lines.select("file_id", "path", F.trim("line").alias("line"))), "lines")
    headers = stored(marked(files.select("file_id", "path", F.explode(blocks(text)).alias("line")).where(may_name(F.col("line"), BLOCK_TEMPLATES))), "headers")
    named_so = F.regexp_like(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(LICENCE_FILE))
    wholes = stored(marked(files.where(named_so).select("file_id", "path", text.alias("line"))), "wholes")
    hits = lines.drop("line").join(stored(judge_marked(lines), "judged"), "mark")
    for units, templates in ((headers, BLOCK_TEMPLATES), (wholes, file_templates())):
        if not units.isEmpty():
            hits = hits.unionByName(units.drop("line").join(stored(judge_marked(units, templates), "judged"), "mark"))
    own = hits.groupBy("file_id", "path").agg(F.max_by(F.struct("licence", "cosine"), _first_of_best()).alias("o"))
    own = own.select(F.col("file_id").alias("own_id"), F.col("path").alias("own_path"), "o.licence", "o.cosine")
    named = files.select("file_id", "path").join(own, F.col("file_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left").drop("own_id", "own_path")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    givers = own.where(F.regexp_like(F.regexp_extract("own_path", r"([^/]*)$", 1), F.lit(LICENCE_FILE)))
    givers = givers.withColumn("folder", F.regexp_replace("own_path", r"/?[^/]*$", "")).groupBy("folder").agg(F.min_by(F.struct("own_path", "licence", "cosine"), F.struct(-F.col("cosine"), F.col("own_path"))).alias("g"))
    parts = F.split("folder", "/")
    # ancestors of each folder, judged once for each folder and not for each file
    folders = named.where("licence is null and path is not null").select(folder.alias("folder")).distinct()
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(parts))
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).withColumn("ancestor", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = above.join(givers.select(F.col("folder").alias("ancestor"), "g"), "ancestor").groupBy("folder").agg(F.max_by("g", "depth").alias("g"))
    nearest = stored(nearest, "nearest")
    if nearest.limit(BROADCAST + 1).count() <= BROADCAST:
        nearest = F.broadcast(nearest)  # a large folder's files then stay where they are
    out = named.withColumn("folder", folder).join(nearest, "folder", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("g").isNotNull(), "inherited").otherwise("none")
    return out.select("file_id", "path", F.coalesce("licence", "g.licence").alias("licence"), F.coalesce("cosine", "g.cosine").alias("cosine"), origin.alias("origin"), F.when(F.col("licence").isNull(), F.col("g.own_path")).alias("inherited_from"))


def as_files(docs: DataFrame) -> DataFrame:
    """doc_id, path and text of documents as files: source/lang/doc_id.txt, and the smallest doc_id of a folder is its LICENSE."""
    place = [F.coalesce("source", F.lit("unknown")).alias("_s"), F.coalesce("lang", F.lit("unknown")).alias("_l")]
    rows = docs.select("doc_id", "text", *place)
    first = rows.groupBy("_s", "_l").agg(F.min("doc_id").alias("_first")).select(F.col("_s").alias("_fs"), F.col("_l").alias("_fl"), "_first")
    first = stored(first, "first")
    if first.limit(BROADCAST + 1).count() <= BROADCAST:
        first = F.broadcast(first)  # the texts then stay where they are
    named = rows.join(first, (F.col("_s") == F.col("_fs")) & (F.col("_l") == F.col("_fl")) & (F.col("doc_id") == F.col("_first")), "left")
    name = F.when(F.col("_first").isNotNull(), "LICENSE").otherwise(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    return named.select("doc_id", F.concat_ws("/", "_s", "_l", name).alias("path"), "text")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, as the files that as_files makes of them."""
    found = scan(as_files(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "file_id"))
    return found.withColumnRenamed("file_id", "doc_id")
