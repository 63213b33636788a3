"""Addresses of both kinds as 32 hexadecimal digits, and the networks that hold them, all in native columns.

An IPv4 address stands at ::ffff:0:0, as its mapped form does, so the two are one
address; a network of IPv4 has 96 bits more than its number says. Text order of
the digits is the order of the addresses, so a network is an interval of them.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.columns import once

MAPPED = "00000000000000000000ffff"
_HEX = "0123456789abcdef"
#: Networks up to so many are broadcast, 80 bytes each; more are joined by their prefixes.
BROADCAST = 100_000


def _groups(text: Column) -> Column:
    """Groups between colons as four digits each; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, ":"), lambda g: F.lpad(g, 4, "0")))


def _octets(text: Column) -> Column:
    """Digits of a dotted address; null for anything else."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    fits = F.regexp_like(text, F.lit(rf"^{octet}(?:\.{octet}){{3}}$"))
    return F.when(fits, F.array_join(F.transform(F.split(text, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0")), ""))


def _six(a: Column) -> Column:
    """Digits of a lower-case address with colons; null for anything else."""
    def whole(plain: Column) -> Column:
        def halved(h: Column) -> Column:
            def grouped(g: Column) -> Column:
                held = F.size(g["l"]) + F.size(g["r"])
                good = F.when(F.size(h) == 2, held <= 7).otherwise((F.size(h) == 1) & (held == 8))
                zeros = F.array_repeat(F.lit("0000"), F.greatest(8 - held, F.lit(0)))
                return F.when(good, F.array_join(F.concat(g["l"], zeros, g["r"]), ""))

            return once(F.struct(_groups(h[0]).alias("l"), _groups(F.coalesce(F.get(h, 1), F.lit(""))).alias("r")), grouped)

        shape = F.regexp_like(plain, F.lit(r"^(?=.*:)[0-9a-f:]+$")) & ~F.regexp_like(plain, F.lit(r"[0-9a-f]{5}|:::|^:[^:]|[^:]:$"))
        return F.when(shape, once(F.split(plain, "::", -1), halved))

    # the last two groups may be dotted
    dotted = once(_octets(F.regexp_extract(a, r":([0-9.]+)$", 1)), lambda o: F.concat(F.regexp_replace(a, r"[0-9.]+$", ""), F.substring(o, 1, 4), F.lit(":"), F.substring(o, 5, 4)))
    return once(F.when(F.contains(a, F.lit(".")), dotted).otherwise(a), whole)


def digits(address: Column) -> Column:
    """32 digits of an address, with or without brackets; null for what isn't one."""
    bare = F.lower(F.regexp_replace(address, r"^\[|\]$", ""))
    return once(bare, lambda a: F.when(F.contains(a, F.lit(":")), _six(a)).otherwise(F.concat(F.lit(MAPPED), _octets(a))))


def is_four(hexed: Column) -> Column:
    return F.startswith(hexed, F.lit(MAPPED))


def low(hexed: Column, bits: Column) -> Column:
    """The first address of the network of so many bits."""
    return _filled(hexed, bits, "0")


def high(hexed: Column, bits: Column) -> Column:
    """The last one."""
    return _filled(hexed, bits, "f")


def _filled(hexed: Column, bits: Column, rest: str) -> Column:
    whole = (bits / 4).cast("int")
    step = F.element_at(F.array(*[F.lit(x) for x in (16, 8, 4, 2)]), bits % 4 + 1)  # what is free in the digit that the network cuts
    digit = F.conv(F.substring(hexed, whole + 1, F.lit(1)), 16, 10).cast("int")
    first = (digit / step).cast("int") * step
    cut = F.when(bits % 4 == 0, "").otherwise(F.substring(F.lit(_HEX), (first if rest == "0" else first + step - 1) + 1, F.lit(1)))
    return F.rpad(F.concat(F.substring(hexed, F.lit(1), whole), cut), 32, rest)


def network(cidr: Column) -> Column:
    """Struct of a network written as address/bits, or as an address alone: four, bits of 128, low, high; null for what isn't one."""
    address, said = F.substring_index(cidr, "/", 1), F.regexp_extract(cidr, r"^[^/]+/([0-9]{1,3})$", 1)
    hexed = digits(address)
    four = F.coalesce(_octets(F.lower(address)).isNotNull(), F.lit(False))
    bits = F.when(~F.contains(cidr, F.lit("/")), 128).when(said != "", said.cast("int") + F.when(four, 96).otherwise(0))
    good = hexed.isNotNull() & bits.between(F.when(four, 96).otherwise(0), 128)
    return F.when(good, F.struct(four.alias("four"), bits.alias("bits"), low(hexed, bits).alias("low"), high(hexed, bits).alias("high")))


def longest_match(df: DataFrame, address: str, networks: DataFrame, cidr: str) -> DataFrame:
    """df with `network`: of the networks (cidr) that hold its address, the one with the most bits; null without any.

    Each distinct address is looked up once, by its first bits of every length
    that some network has (at most 129, which come to the driver), in an
    equi-join; the networks are broadcast only where they are counted to be
    few. Networks of one kind hold no address of the other.
    """
    nets = networks.select(cidr).distinct().select(F.col(cidr).alias("_cidr"), network(F.col(cidr)).alias("_n")).where("_n is not null").select("_cidr", "_n.*")
    nets = nets.groupBy("four", "bits", "low").agg(F.min("_cidr").alias("_cidr"))  # one network may be written in several ways
    lengths = sorted(r[0] for r in nets.select("bits").distinct().collect())
    own = df.select(F.col(address).alias("_a")).distinct().withColumn("_d", digits(F.col("_a"))).where("_d is not null")
    bits = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    tried = own.select("_a", is_four(F.col("_d")).alias("four"), "_d", F.explode(bits).alias("bits")).withColumn("low", low(F.col("_d"), F.col("bits")))
    side = F.broadcast(nets) if nets.limit(BROADCAST + 1).count() <= BROADCAST else nets
    best = tried.join(side, ["four", "bits", "low"]).groupBy("_a").agg(F.max_by("_cidr", "bits").alias("network"))
    return df.drop("network").join(best, F.col(address) == F.col("_a"), "left").drop("_a")


def inside_any(hexed: Column, networks: tuple[str, ...]) -> Column:
    """Whether digits lie in one of some constant networks."""
    out = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        first, last = (f"{MAPPED}{int(x):08x}" if net.version == 4 else f"{int(x):032x}" for x in (net.network_address, net.broadcast_address))
        out = out | hexed.between(first, last) & (is_four(hexed) == F.lit(net.version == 4))
    return out


def blocked(address: Column, networks: tuple[str, ...], allowed: tuple[str, ...] = ()) -> Column:
    """Whether an address must not be fetched: in a blocked network and in no allowed one, or not an address at all; null stays null."""
    return F.when(address.isNotNull(), F.coalesce(once(digits(address), lambda h: inside_any(h, networks) & ~inside_any(h, allowed)), F.lit(True)))
