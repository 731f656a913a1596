"""Longest prefixes from tables: roots of paths, and networks of addresses.

A value has a prefix of each length that the table has, and each of these is
looked up by an equi-join; the longest found counts.  Lengths are few whatever
the table's size: as many as the longest root has characters, and at most 33
and 129 for networks.  Equal values are looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch.functions.net import ipv4_number


def _looked_up(df: DataFrame, value: Column, keys: Column, table: DataFrame, name: str) -> DataFrame:
    """Joins ``answer`` of the longest key; keys: an array of structs ``length`` and ``key`` from the column ``value_``."""
    own = df.withColumn("value_", value)
    each = own.select("value_").distinct().select("value_", F.explode(keys).alias("k")).select("value_", "k.*")
    found = each.join(table, ["length", "key"]).groupBy("value_").agg(F.max_by("answer", "length").alias(name))
    return own.drop(name).join(found, "value_", "left").drop("value_")


def longest_root(df: DataFrame, column: str, roots: DataFrame, name: str = "location", default: str = "UNKNOWN") -> DataFrame:
    """Adds the ``trust`` of the longest root (``prefix``) that the column begins with; capitals count as small letters.

    Of one root with several values the smallest counts.  Nulls and values
    without a root have the default.
    """
    known = roots.where("prefix is not null").groupBy(F.lower("prefix").alias("key")).agg(F.min("trust").alias("answer")).withColumn("length", F.length("key"))
    lengths = sorted(r.length for r in known.select("length").distinct().collect())
    keys = F.filter(F.array(*(F.struct(F.lit(n).alias("length"), F.substring("value_", 1, n).alias("key")) for n in lengths)), lambda k: k["length"] <= F.length("value_"))
    if not lengths:
        return df.withColumn(name, F.lit(default))
    out = _looked_up(df, F.lower(column), keys, known, name)
    return out.withColumn(name, F.coalesce(name, F.lit(default)))


def address_digits(ip: Column) -> Column:
    """8 hex digits of a dotted address, 32 of a colon one; null of anything else."""
    four = F.lower(F.lpad(F.hex(ipv4_number(ip)), 8, "0"))
    halves = F.split(F.lower(ip), "::")
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
    left, right = groups(halves[0]), F.when(F.size(halves) == 2, groups(halves[1])).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    fits = (ip.contains("::") & (missing >= 1) | ~ip.contains("::") & (missing == 0)) & ~ip.rlike(":::|::.*::|^:[^:]|[^:]:$") & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    six = F.when(ip.contains(":") & (F.size(halves) <= 2) & fits, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))
    return F.coalesce(four, six)


def _masked(digits: Column, bits: Column | int) -> Column:
    """The first bits as text: whole digits, and what is left of the next one."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    mask = F.element_at(F.array(*map(F.lit, (0, 8, 12, 14))), (rest + 1).cast("int"))
    next_ = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int").bitwiseAND(mask)
    return F.concat(F.length(digits).cast("string"), F.lit(":"), F.substring(digits, F.lit(1), whole), F.when(rest > 0, F.concat(F.lit("+"), next_.cast("string"))).otherwise(""))


def longest_network(df: DataFrame, column: str, networks: DataFrame, name: str = "network_label") -> DataFrame:
    """F3 with a table: adds the ``label`` of the smallest network (``network``, as ``10.0.0.0/8`` or ``fe80::/10``) that holds the address.

    Host bits of a network don't count, and one without a length is a single
    address.  Of one network with several labels the smallest counts; networks
    and addresses that are malformed, and addresses in none, have null.
    """
    address, bits = F.split_part("network", F.lit("/"), F.lit(1)), F.split_part("network", F.lit("/"), F.lit(2))
    known = networks.select(address_digits(address).alias("digits"), F.when(bits == "", 1024).otherwise(bits.try_cast("int")).alias("bits"), F.col("label").alias("answer"))
    known = known.where("digits is not null and bits is not null").withColumn("length", F.when(F.col("bits") == 1024, 4 * F.length("digits")).otherwise(F.col("bits"))).where("length between 0 and 4 * length(digits)")
    table = known.groupBy("length", _masked(F.col("digits"), F.col("length")).alias("key")).agg(F.min("answer").alias("answer"))
    sizes = sorted((r.size, r.length) for r in known.select(F.length("digits").alias("size"), "length").distinct().collect())
    if not sizes:
        return df.withColumn(name, F.lit(None).cast("string"))
    each = [F.when(F.length("value_") == size, F.struct(F.lit(n).alias("length"), _masked(F.col("value_"), n).alias("key"))) for size, n in sizes]
    return _looked_up(df, address_digits(F.col(column)), F.array_compact(F.array(*each)), table, name)
