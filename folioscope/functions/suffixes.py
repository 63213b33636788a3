"""Public suffixes: the longest rule that a host's end fits, with wildcards and exceptions.

RULES holds the second-level suffixes that sites in general use live under; a
whole published list is read with read_rules and joined with registrable_hosts.
A name is registered one label below its suffix. Without a rule the last label
is the suffix, as the list's own default rule says; a name that is itself a
suffix stays with its last two labels.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes below a country's, by country; * stands for any label, ! for a name below it that is registered all the same.
BELOW = {
    "ar": "com edu gob gov int mil net org", "au": "asn com edu gov id net org", "br": "com edu gov mil net org art blog eco eng ind", "cn": "ac com edu gov mil net org", "co": "com edu gov mil net nom org",
    "hk": "com edu gov idv net org", "id": "ac biz co desa go mil my net or sch web", "il": "ac co gov k12 net org", "in": "ac co edu firm gen gov ind net org res", "jp": "ac ad co ed go gr lg ne or *.kawasaki !city.kawasaki *.kobe !city.kobe",
    "kr": "ac co go ne or pe re", "mx": "com edu gob net org", "my": "com edu gov net org", "nz": "ac co cri geek gen govt iwi maori mil net org school", "pl": "com edu gov net org", "sg": "com edu gov net org per", "th": "ac co go in mi net or",
    "tr": "av bbs bel biz com edu gen gov k12 mil name net org pol tel tv web", "tw": "com edu gov idv mil net org", "ua": "com edu gov in net org", "uk": "ac co gov ltd me net nhs org plc police *.sch", "za": "ac co edu gov law mil net nom org web",
    "ck": "* !www", "bd": "*", "er": "*", "fk": "*", "kh": "*", "mm": "*", "np": "*", "pg": "*",
}


def _rule(name: str, country: str) -> str:
    return f"!{name[1:]}.{country}" if name.startswith("!") else f"{name}.{country}"


RULES = tuple(_rule(n, c) for c, names in BELOW.items() for n in names.split())
NUMERIC = r"^[0-9.]+$|:"
#: Rules up to so many are broadcast.
BROADCAST = 100_000


def registrable_name(host: str, rules: frozenset[str] = frozenset(RULES)) -> str:
    """The plain form: addresses as they are, else the suffix and a label more."""
    host = host.lower().strip(".")
    labels = host.split(".")
    if re.search(NUMERIC, host) or len(labels) < 2:
        return host
    held = 1
    for i in range(len(labels)):
        end = ".".join(labels[i:])
        if f"!{end}" in rules:
            held = len(labels) - i - 1
            break
        if end in rules or ".".join(["*", *labels[i + 1 :]]) in rules:
            held = max(held, len(labels) - i)
    return ".".join(labels[-min(max(held + 1, 2), len(labels)) :] if held < len(labels) else labels[-2:])


def _cut(host: Column, held: Column) -> Column:
    """The last labels of a host whose suffix has so many."""
    labels = F.split(host, r"\.")
    n = F.when(held < F.size(labels), held + 1).otherwise(2)
    return F.when(F.size(labels) < 2, host).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.size(labels)), "."))


def _plain(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")


def registrable(host: Column, rules: tuple[str, ...] = RULES) -> Column:
    """The same as a column, over a short list of rules."""
    known, name = F.array(*[F.lit(r) for r in rules]), _plain(host)
    labels = F.split(name, r"\.")

    def ends(i: Column) -> Column:
        end = F.array_join(F.slice(labels, i, F.size(labels)), ".")
        wild = F.concat_ws(".", F.lit("*"), F.when(i < F.size(labels), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
        n = F.size(labels) - i + 1
        return F.when(F.array_contains(known, F.concat(F.lit("!"), end)), F.lit(1000) + n - 1).when(F.array_contains(known, end) | F.array_contains(known, wild), n).otherwise(1)

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(labels)), ends))
    return F.when(F.regexp_like(name, F.lit(NUMERIC)), name).otherwise(_cut(name, best % 1000))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule, private of a published list: comments and blank lines go; the lines between the marks of private domains are private.

    The list is one small file, read as a whole so that its lines keep their order.
    """
    text = spark.read.text(path, wholetext=True)
    private = F.regexp_extract("value", r"(?s)===BEGIN PRIVATE DOMAINS===(.*?)===END PRIVATE DOMAINS===", 1)
    public = F.regexp_replace("value", r"(?s)===BEGIN PRIVATE DOMAINS===.*?===END PRIVATE DOMAINS===", "")
    both = F.array(F.struct(public.alias("part"), F.lit(False).alias("private")), F.struct(private.alias("part"), F.lit(True).alias("private")))
    lines = text.select(F.explode(both).alias("s")).select(F.explode(F.split("s.part", r"\r?\n")).alias("line"), "s.private")
    rule = F.lower(F.regexp_extract("line", r"^\s*([^\s/]\S*)", 1))
    return lines.select(rule.alias("rule"), "private").where("rule <> '' and not rule like '===%' and not line like '%//%==='")


def registrable_hosts(df: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """df with `site`, by rules (rule) of any number.

    Each distinct host is looked up once, by all its ends, in an equi-join with
    the rules; the longest rule wins and an exception wins over all. Rules are
    broadcast only where they are counted to be few. A null host has no site.
    """
    said = F.col("rule")
    kinds = F.when(F.startswith(said, F.lit("!")), F.struct(F.lit("!").alias("kind"), F.substring(said, 2, 1000).alias("end"))).when(F.startswith(said, F.lit("*.")), F.struct(F.lit("*").alias("kind"), F.substring(said, 3, 1000).alias("end"))).otherwise(F.struct(F.lit("").alias("kind"), said.alias("end")))
    table = rules.where("rule is not null").select(kinds.alias("_k")).select("_k.*").distinct()
    own = df.select(F.col(host).alias("_h")).distinct().where("_h is not null").withColumn("_name", _plain(F.col("_h")))
    labels = F.split("_name", r"\.")
    ends = own.where(~F.regexp_like("_name", F.lit(NUMERIC))).select("_h", F.size(labels).alias("_n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("end"), (F.size(labels) - i + 1).alias("n")))).alias("_e")).select("_h", "_n", "_e.*")
    side = F.broadcast(table) if table.limit(BROADCAST + 1).count() <= BROADCAST else table
    held = F.when(F.col("kind") == "!", F.lit(1000) + F.col("n") - 1).when(F.col("kind") == "", F.col("n")).when(F.col("n") < F.col("_n"), F.col("n") + 1)
    best = ends.join(side, "end").groupBy("_h").agg(F.max(held).alias("_held"))
    site = F.when(F.regexp_like("_name", F.lit(NUMERIC)), F.col("_name")).otherwise(_cut(F.col("_name"), F.coalesce(F.col("_held"), F.lit(1)) % 1000))
    known = own.join(best, "_h", "left").select("_h", site.alias("site"))
    return df.drop("site").join(known, F.col(host) == F.col("_h"), "left").drop("_h")
